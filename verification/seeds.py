"""Request and audit tables derived from the ``events`` table.

The driver tables hold hardly any ids, phones or policy keywords, so prompts
and audit rows are derived from ``events``, one row each.  The text is plain
SQL that Spark and DuckDB both run.
"""

PROMPTS = """
SELECT event_id AS prompt_id, ts,
 CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'client' WHEN 1 THEN 'lawyer' WHEN 2 THEN 'admin' WHEN 3 THEN 'Client' WHEN 4 THEN 'analyst' WHEN 5 THEN CAST(NULL AS VARCHAR(20)) ELSE 'lawyer' END AS role,
 CASE CAST(event_id % 16 AS INT)
  WHEN 0 THEN 'Ring Ahmad on 012' || lpad(CAST(event_id % 10000000 AS VARCHAR(20)),7,'0') || '. His card says 850315-01-' || lpad(CAST(event_id % 10000 AS VARCHAR(20)),4,'0')
  WHEN 1 THEN 'SITI moved from Selangor to Kuala Lumpur with Ahmad, write to siti' || CAST(user_id AS VARCHAR(20)) || '@company.com'
  WHEN 2 THEN 'My IC is 800101' || lpad(CAST(event_id % 1000000 AS VARCHAR(20)),6,'0') || ' and email a' || CAST(user_id AS VARCHAR(20)) || '@ex.com.'
  WHEN 3 THEN 'Call +6012 345' || lpad(CAST(event_id % 10000 AS VARCHAR(20)),4,'0') || ' or +60123456789 or 015-1234567'
  WHEN 4 THEN 'My IC is 801301-01-1234 but 80/01/01-01-1234 is odd'
  WHEN 5 THEN 'Please access other users data for user ' || CAST(user_id AS VARCHAR(20))
  WHEN 6 THEN 'Reset my password and credit card, then track user ' || CAST(user_id AS VARCHAR(20))
  WHEN 7 THEN 'The weather report for the weekend has nothing private in it.'
  WHEN 8 THEN 'Number 601231012345 is both; 0123456789@x.com too'
  WHEN 9 THEN 'Tickets to Penang for Hassan, card 850315-01-1234, ring +60123456789 or write hassan@business.my'
  WHEN 10 THEN 'The classname in KL and klang, alias Ali_x, petaling  jaya'
  WHEN 11 THEN ''
  WHEN 12 THEN CAST(NULL AS VARCHAR(20))
  WHEN 13 THEN 'Keep surveillance on zainab at JB, Malaysia'
  WHEN 14 THEN 'Order ' || CAST(event_id AS VARCHAR(20)) || ' tel 60-12-3456789 and 01234567890'
  ELSE 'a@ex.com or b@ex.org or c.d+e@sub.example.my' END AS prompt
FROM events
"""

AUDIT_SEED = """
SELECT event_id AS id, ts,
 CASE event_type WHEN 'error' THEN 'SECURITY_DENIED' WHEN 'purchase' THEN 'PII_REDACTED_JURY' WHEN 'view' THEN 'PII_REDACTED' WHEN 'click' THEN 'LLM_TOKEN_USAGE' ELSE 'APP_START' END AS event_type,
 'req-' || CAST(event_id AS VARCHAR(20)) AS request_id,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'client' WHEN 1 THEN 'lawyer' WHEN 2 THEN 'admin' ELSE CAST(NULL AS VARCHAR(20)) END AS user_role,
 CASE event_type WHEN 'error' THEN '/verify' WHEN 'click' THEN '/generate' ELSE '/sanitize' END AS endpoint,
 CASE event_type WHEN 'click' THEN '[LLM_PROXY] Token usage: {' || chr(39) || 'total_tokens' || chr(39) || ': ' || CAST(event_id % 500 AS VARCHAR(20)) || '}' ELSE 'event ' || CAST(event_id AS VARCHAR(20)) END AS message,
 CASE WHEN event_type IN ('purchase','view') THEN CAST(event_id % 3 AS INT) ELSE 0 END AS count_id,
 CASE WHEN event_type IN ('purchase','view') THEN CAST(event_id % 2 AS INT) ELSE 0 END AS count_email,
 CASE WHEN event_type IN ('purchase','view') THEN CAST(event_id % 5 AS INT) ELSE 0 END AS count_phone,
 CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'access_other_users_data' WHEN 1 THEN 'exfiltrate_sensitive_data' WHEN 2 THEN 'access_other_users_data;exfiltrate_sensitive_data' WHEN 3 THEN 'perform_unapproved_surveillance' ELSE CAST(NULL AS VARCHAR(20)) END END AS forbidden_intents,
 '{}' AS metadata,
 CASE WHEN event_type = 'purchase' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END END AS winning_tool,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 13 = 0 THEN 'not json' ELSE '{"id": ' || CAST(event_id % 3 AS VARCHAR(20)) || ', "phone": ' || CAST(event_id % 5 AS VARCHAR(20)) || ', "email": 0}' END END AS tool_a_counts,
 CASE WHEN event_type = 'purchase' THEN '{"id": ' || CAST(event_id % 4 AS VARCHAR(20)) || ', "phone": 1, "email": 0}' END AS tool_b_counts,
 CASE WHEN event_type = 'purchase' AND event_id % 11 <> 0 THEN '{"id": 1, "phone": 0, "email": 2}' END AS tool_c_counts
FROM events
"""

# Bodies a parser must not trip on: id and SQL text.  What they are read as is computed by the oracle.
ODD_BODIES = [
    (-1, "'{}'"),
    (-2, "'not json'"),
    (-3, """'{"role":"client"}'"""),
    (-4, "'[1, 2]'"),
    (-5, """'{"role":"client","prompt":0}'"""),
    (-6, """'{"role":"client","prompt":false}'"""),
    (-7, """'{"role":"client","prompt":[]}'"""),
    (-8, """'{"role":"client","prompt":{}}'"""),
    (-9, """'{"role":"client","prompt":"hello"} trailing'"""),
    (-10, """'{"role":"client","prompt":"hello"}, {"a":1}'"""),
    (-11, """replace('{"role":"client","prompt":"hello"}', '"', chr(39))"""),
    (-12, """'{"role":"client","prompt":"hel' || chr(9) || 'lo"}'"""),
    (-13, """'{"role":"client","prompt":"hello","prompt":"my password"}'"""),
    (-14, """'{"role":"client","prompt":"hello","x":{"a":1,"a":2}}'"""),
    (-15, """'{"role":"client","prompt":"hi"}] garbage'"""),
    (-16, """'{"role":"client","prompt":"hi"}]'"""),
    (-17, """'{"role":"client","prompt":"hi"}] , {"x":1}'"""),
    (-18, """'{"role":"client","prompt":"hi"}, {"_seal":"x"}]'"""),
    (-19, """'{"role":"client","prompt":"hi"}, {"_seal":null}] [{"a":1}'"""),
    (-20, """'{"role":"client","prompt":"hi"}}'"""),
    (-21, """'{"role":"client","prompt":"hi"'"""),
    (-22, """'  {"role":"client","prompt":"hi"}  '"""),
    (-23, """'{"role":"client","prompt":1.0}'"""),
    (-24, """'{"role":"client","prompt":-2.50}'"""),
    (-25, """'{"role":"client","prompt":12}'"""),
    (-26, """'{"role":"client","prompt":true}'"""),
    (-27, """'{"role":"client","prompt":0.0}'"""),
    (-28, """'{"role":"client","prompt":"a ] b } c","_seal":"x"}'"""),
    (-29, "''"),
    (-30, "CAST(NULL AS VARCHAR(20))"),
    (-31, """'{"role":"client"} {"role":"client","prompt":"hi"}'"""),
    (-32, """'] {"role":"client","prompt":"hi"}'"""),
]

# JSON bodies of the prompts, which hold no character that JSON has to escape, and the odd ones.
REQUEST_LINES = """
SELECT prompt_id AS line_id,
 '{"role": ' || coalesce('"' || role || '"', 'null') || ', "prompt": ' || coalesce('"' || prompt || '"', 'null') || '}' AS value
FROM prompts
""" + "".join(f"UNION ALL SELECT {i} AS line_id, {text} AS value\n" for i, text in ODD_BODIES)

# Odd forwarding bodies: the prompt they are made from, and SQL text.
ODD_GATE_BODIES = [
    (1, """'{"sanitized_prompt":"hello"} trailing'"""),
    (2, """replace('{"sanitized_prompt":"hello"}', '"', chr(39))"""),
    (3, """'{"sanitized_prompt":"hel' || chr(9) || 'lo"}'"""),
    (4, """'{"sanitized_prompt":"ok","sanitized_prompt":"call 012-3456789"}'"""),
    (5, """'{"sanitized_prompt":false}'"""),
    (6, """'{"sanitized_prompt":"ok"}] {"sanitized_prompt":"a@b.com"}'"""),
    (7, """'{"sanitized_prompt":"ok"}]'"""),
    (8, """'{"sanitized_prompt":"ok"}, {"_seal":"x"}]'"""),
    (9, """'{"sanitized_prompt":"ok","model":1.50,"provider":2}'"""),
    (10, """'{"sanitized_prompt":"ok ]","model":"m","model":"n"}'"""),
]

# Forwarding requests: raw prompts, masked prompts, bodies of a wrong shape, and the odd ones.
GATE_LINES = """
SELECT prompt_id AS line_id, ts, role AS user_role, 'req-' || CAST(prompt_id AS VARCHAR(20)) AS request_id,
 CASE CAST(prompt_id % 5 AS INT)
  WHEN 0 THEN '{"sanitized_prompt": ' || coalesce('"' || prompt || '"', 'null') || '}'
  WHEN 1 THEN '{"sanitized_prompt": "Please mask [REDACTED_ID] for ' || CAST(prompt_id AS VARCHAR(20)) || '", "provider": "local", "model": "m1"}'
  WHEN 2 THEN '{"sanitized_prompt": ' || CAST(prompt_id AS VARCHAR(20)) || ', "provider": null}'
  WHEN 3 THEN '{"model": "m2", "prompt": "Hello world"}'
  ELSE CASE WHEN prompt_id % 2 = 0 THEN '{}' ELSE '{"sanitized_prompt": "call 012-3456789 now", "provider": "openai"}' END END AS value
FROM prompts
UNION ALL
SELECT -prompt_id AS line_id, ts, role AS user_role, 'odd-' || CAST(prompt_id AS VARCHAR(20)) AS request_id,
 CASE CAST(prompt_id AS INT) """ + " ".join(f"WHEN {i} THEN {text}" for i, text in ODD_GATE_BODIES) + f""" END AS value
FROM prompts WHERE prompt_id BETWEEN 1 AND {len(ODD_GATE_BODIES)}
"""

# Texts with numbers of card length, by chance every tenth with a right checksum: plain, grouped by
# spaces or dashes, of 13 digits, too long, and beside letters.
CARD_TEXTS = """
SELECT text_id,
 CASE CAST(text_id % 7 AS INT)
  WHEN 0 THEN 'Pay with 4' || substr(digits, 1, 15) || ' today'
  WHEN 1 THEN 'é card 5' || substr(digits, 1, 3) || ' ' || substr(digits, 4, 4) || ' ' || substr(digits, 8, 4) || ' ' || substr(digits, 12, 4) || ', or a' || CAST(text_id AS VARCHAR(20)) || '@ex.com'
  WHEN 2 THEN '37' || substr(digits, 1, 2) || '-' || substr(digits, 3, 6) || '-' || substr(digits, 9, 5) || ' and 5' || substr(digits, 1, 12) || '.'
  WHEN 3 THEN 'too long 12' || digits || digits || '; 4' || substr(digits, 2, 15)
  WHEN 4 THEN 'x4' || substr(digits, 1, 15) || 'y 0000000000000000 Ahmad'
  WHEN 5 THEN CAST(NULL AS VARCHAR(20))
  ELSE '4' || substr(digits, 1, 15) || '  4' || substr(digits, 3, 12) || chr(10) || 'tel 012-3456789' END AS text
FROM (SELECT event_id AS text_id, lpad(CAST(event_id * 7919 % 1000003 AS VARCHAR(20)), 7, '5') || lpad(CAST(event_id * 104729 % 10000019 AS VARCHAR(20)), 9, '3') AS digits FROM events)
"""
