"""Values that decide results.

Everything in this module is a FIXED VALUE: policies, keywords, word lists,
patterns, masks and event names must stay exactly as they are for results to
be comparable between versions.  They are plain data; the Spark code that uses
them lives in ``functions`` and ``operators``.
"""

# --- Fixed values: role -> intents forbidden for that role, in policy order ---
ROLE_INTENTS = {
    "client": ["access_other_users_data", "exfiltrate_sensitive_data"],
    "lawyer": [
        "access_other_users_data",
        "exfiltrate_sensitive_data",
        "perform_unapproved_surveillance",
    ],
    "admin": ["exfiltrate_sensitive_data"],
}

# --- Fixed values: intent -> phrases that reveal it (substring match) ---
INTENT_KEYWORDS = {
    "access_other_users_data": [
        "access other users",
        "other users data",
        "user data of",
        "get user data",
        "access account of",
        "steal user data",
    ],
    "exfiltrate_sensitive_data": [
        "ssn",
        "social security",
        "credit card",
        "creditcard",
        "cvv",
        "password",
        "secret",
        "private key",
        "private data",
    ],
    "perform_unapproved_surveillance": [
        "surveillance",
        "track",
        "spy on",
        "monitor user",
        "track user",
        "monitoring user",
    ],
}

# --- Fixed values: dictionary of detector B ---
NAMES = [
    "ali", "ahmad", "muhammad", "fatimah", "siti", "nurul", "musa", "hamid",
    "karim", "hassan", "aziz", "nasir", "rashid", "salim", "zainal", "zainab",
    "rania", "amira", "yasmin",
]
LOCATIONS = [
    "kuala lumpur", "selangor", "penang", "johor", "melaka", "perak", "kedah",
    "terengganu", "kelantan", "pahang", "perlis", "sabah", "sarawak",
    "putrajaya", "labuan", "kl", "jb", "malaysia", "ampang", "petaling jaya",
    "subang", "klang", "shah alam",
]

# --- Fixed values: patterns of detector A (strict) and detector C (loose) ---
STRICT_ID = r"\b\d{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])-?\d{2}-?\d{4}\b"
STRICT_PHONE = r"\b(?:\+?6?01)[0-46-9]-*[0-9]{7,8}\b"
STRICT_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
LOOSE_ID = r"\b\d{2}[-/]?\d{2}[-/]?\d{2}[-/]?\d{2}[-/]?\d{4}\b"
LOOSE_PHONE = r"\b(?:\+?6?01\d{1}[-\s]?\d{3,4}[-\s]?\d{3,4}|[0-9]{10,11})\b"
LOOSE_EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"

# --- Fixed values: masks ---
MASK_ID = "[REDACTED_ID]"
MASK_PHONE = "[REDACTED_PHONE]"
MASK_EMAIL = "[REDACTED_EMAIL]"
MASK_NAME = "[REDACTED_NAME]"
MASK_LOCATION = "[REDACTED_LOCATION]"

# --- Fixed values: event names, endpoints, defaults ---
DENIED = "SECURITY_DENIED"
REDACTED = "PII_REDACTED"
JURY_REDACTED = "PII_REDACTED_JURY"
TOKEN_USAGE = "LLM_TOKEN_USAGE"
PRIORITY_EVENTS = [DENIED, REDACTED, TOKEN_USAGE]
VERIFY_ENDPOINT = "/verify"
SANITIZE_ENDPOINT = "/sanitize"
GENERATE_ENDPOINT = "/generate"
DEFAULT_PROVIDER = "openai"
SAMPLE_CHARS = 200
SIGNATURE_PREVIEW_CHARS = 20
RECENT_EVENTS = 100
TAMPERED_SHOWN = 10
REPORT_HOURS = 24

# --- Fixed values: message texts ---
GATE_DENIED_MESSAGE = "[LLM_PROXY] Attempt to forward prompt containing PII; rejected"
DENIED_MESSAGE = "Denied access attempt: role=%s prompt=%s"
TOKEN_USAGE_PREFIX = "[LLM_PROXY] Token usage: "
JURY_MESSAGE_PREFIX = "PII detected and redacted using Redaction Jury. Winner: Tool "

# --- Fixed values: response labels of the tools' scores ---
SCORE_LABELS = {
    "A": "Tool_A_Regex_Count",
    "B": "Tool_B_Dictionary_Count",
    "C": "Tool_C_MockAI_Count",
}
