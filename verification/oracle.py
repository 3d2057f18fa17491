"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from veilwork import fixed_values as fv
from verification import seeds
from verification.tables import KEYS, ROTATED

COUNTS = [f"{tool}_{slot}" for tool in "abc" for slot in ("id", "phone", "email")]
SCORES = ["score_a", "score_b", "score_c"]
NAMES = r"(?i)\b(?:" + "|".join(fv.NAMES) + r")\b"
LOCATIONS = r"(?i)\b(?:" + "|".join(fv.LOCATIONS) + r")\b"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _with(body: str, **ctes: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n" + body


def _hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _mask(text: str, *steps: tuple[str, str]) -> str:
    for pattern, mask in steps:
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


STRICT = [(fv.STRICT_ID, fv.MASK_ID), (fv.STRICT_PHONE, fv.MASK_PHONE), (fv.STRICT_EMAIL, fv.MASK_EMAIL)]
WORDS = [(NAMES, fv.MASK_NAME), (LOCATIONS, fv.MASK_LOCATION)]
LOOSE = [(fv.LOOSE_ID, fv.MASK_ID), (fv.LOOSE_PHONE, fv.MASK_PHONE), (fv.LOOSE_EMAIL, fv.MASK_EMAIL)]
PROMPTS = {"prompts": seeds.PROMPTS}
SEED = {"audit_seed": seeds.AUDIT_SEED}


def _jury(source: str, text: str, scores: dict[str, str] | None = None) -> dict[str, str]:
    """CTEs ``counted``, ``scored``, ``jury`` over a table with a text column."""
    scores = scores or {f"score_{x}": f"{x}_id + {x}_phone + {x}_email" for x in "abc"}
    t = f"coalesce({text}, '')"
    a, b, c = [[_hits(t, pattern) for pattern, _ in rules] for rules in (STRICT, WORDS, LOOSE)]
    exprs = dict(zip(COUNTS, a + b + ["0"] + c))
    counted = ", ".join(f"CAST({sql} AS INTEGER) AS {name}" for name, sql in exprs.items())
    masks = ", ".join(
        f"{_mask(text, *rules)} AS red_{x}" for x, rules in zip("abc", (STRICT, WORDS, LOOSE))
    )
    return {
        "counted": f"SELECT *, {counted}, {masks} FROM {source}",
        "scored": "SELECT *, " + ", ".join(f"CAST({s} AS INTEGER) AS {n}" for n, s in scores.items()) + " FROM counted",
        "won": f"""SELECT *, CASE WHEN {text} IS NULL OR {text} = '' THEN NULL
            WHEN score_a >= score_b AND score_a >= score_c THEN 'A' WHEN score_b >= score_c THEN 'B' ELSE 'C' END AS winning_tool
            FROM scored""",
        "jury": f"""SELECT *, CASE winning_tool WHEN 'A' THEN red_a WHEN 'B' THEN red_b WHEN 'C' THEN red_c ELSE {text} END AS sanitized
            FROM won""",
    }


def _prompt_jury(body: str, **more: str) -> str:
    return _with(body, **PROMPTS, **_jury("prompts", "prompt"), **more)


def _values(pairs: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    quoted = ["(" + ", ".join(map(text, row)) + ")" for row in pairs]
    return "VALUES " + ", ".join(quoted)


ROLE_ROWS = [(r, i, o) for r, intents in fv.ROLE_INTENTS.items() for o, i in enumerate(intents)]
KEYWORD_ROWS = [(i, k) for i, words in fv.INTENT_KEYWORDS.items() for k in words]
POLICY = {
    "policy": f"SELECT * FROM ({_values(ROLE_ROWS)}) AS p(role, intent, ord)",
    "keywords": f"SELECT * FROM ({_values(KEYWORD_ROWS)}) AS k(intent, keyword)",
}


def _decision(source: str, key: str) -> dict[str, str]:
    """CTE ``decided``: key, role, prompt, authorized, forbidden_intents."""
    return {
        **POLICY,
        "shown": f"""SELECT DISTINCT s.{key}, p.intent, p.ord FROM {source} s JOIN policy p ON lower(s.role) = p.role
            JOIN keywords k ON k.intent = p.intent AND contains(lower(s.prompt), k.keyword)""",
        "listed": f"SELECT {key}, string_agg(intent, ';' ORDER BY ord) AS forbidden_intents FROM shown GROUP BY {key}",
        "decided": f"""SELECT s.*, l.forbidden_intents,
            coalesce(s.prompt <> '' AND lower(s.role) IN (SELECT role FROM policy), false) AND l.forbidden_intents IS NULL AS authorized
            FROM {source} s LEFT JOIN listed l USING ({key})""",
    }


def _fields(source: str, names: list[str]) -> dict[str, str]:
    """CTEs ``bodies`` and ``typed``: ``ok`` where the line is one JSON object with keys, and of each name
    the JSON value of its last key (``<name>_json``)."""
    last = ", ".join(f"(SELECT last(value ORDER BY id) FROM json_each(b.body) WHERE key = '{n}') AS {n}_json" for n in names)
    return {
        "bodies": f"""SELECT *, CASE WHEN json_valid(value) THEN CASE WHEN json_type(value) = 'OBJECT' THEN value END END AS body
            FROM {source}""",
        "typed": f"SELECT *, coalesce(len(json_keys(body)) > 0, false) AS ok, {last} FROM bodies b",
    }


def _as_text(name: str) -> str:
    return f"CASE WHEN json_type({name}_json) = 'VARCHAR' THEN json_extract_string({name}_json, '$') ELSE CAST({name}_json AS VARCHAR) END"


def _if_filled(name: str) -> str:
    """The text of a value; none where it counts as empty: null, false, 0, an empty list or object."""
    numbers = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"
    return f"""CASE WHEN json_type({name}_json) = 'NULL' OR {_as_text(name)} IN ('[]', '{{}}') AND json_type({name}_json) <> 'VARCHAR'
            OR json_type({name}_json) = 'BOOLEAN' AND {_as_text(name)} = 'false'
            OR json_type({name}_json) IN {numbers} AND try_cast({_as_text(name)} AS DOUBLE) = 0 THEN NULL
            ELSE {_as_text(name)} END"""


PARSED = {
    **PROMPTS,
    "request_lines": seeds.REQUEST_LINES,
    **_fields("request_lines", ["role", "prompt"]),
    "parsed": f"SELECT line_id, value, ok AS valid, {_if_filled('role')} AS role, {_if_filled('prompt')} AS prompt FROM typed",
}


def _hmac(payload: str, key: bytes) -> str:
    # The keys of the checks are shorter than a block of SHA-256.
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({payload}))))"


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"


def _text(column: str) -> str:
    return f"coalesce(CAST(to_json({column}) AS VARCHAR), 'null')"


_PAYLOAD = " || ".join(
    [
        """'{"count_email":' || coalesce(count_email, 0)""",
        """',"count_id":' || coalesce(count_id, 0)""",
        """',"count_phone":' || coalesce(count_phone, 0)""",
        f"""',"endpoint":' || {_text('endpoint')}""",
        f"""',"event_type":' || {_text('event_type')}""",
        """',"forbidden_intents":' || coalesce('["' || replace(forbidden_intents, ';', '","') || '"]', '[]')""",
        f"""',"message":' || {_text('message')}""",
        """',"metadata":' || metadata""",
        f"""',"request_id":' || {_text('request_id')}""",
        f"""',"ts":"' || {_ISO} || '"'""",
        f"""',"user_role":' || {_text('user_role')}""",
        f"""',"winning_tool":' || {_text('winning_tool')} || '}}'""",
    ]
)
_PAYLOAD_V2 = " || ".join(
    [
        """'{"count_email":' || coalesce(count_email, 0)""",
        """',"count_id":' || coalesce(count_id, 0)""",
        """',"count_phone":' || coalesce(count_phone, 0)""",
        f"""',"endpoint":' || {_text('endpoint')}""",
        f"""',"event_type":' || {_text('event_type')}""",
        """',"forbidden_intents":' || coalesce('["' || replace(forbidden_intents, ';', '","') || '"]', '[]')""",
        """',"id":' || id""",
        f"""',"key_id":' || {_text('key_id')}""",
        f"""',"message":' || {_text('message')}""",
        """',"metadata":' || metadata""",
        f"""',"request_id":' || {_text('request_id')}""",
        *[f"""',"tool_{x}_counts":' || {_text(f'tool_{x}_counts')}""" for x in "abc"],
        f"""',"ts":"' || {_ISO} || '"'""",
        f"""',"user_role":' || {_text('user_role')}""",
        f"""',"winning_tool":' || {_text('winning_tool')} || '}}'""",
    ]
)
SIGNED = {
    **SEED,
    "with_payload": f"SELECT *, {_PAYLOAD} AS payload, CASE WHEN ts < TIMESTAMP '{ROTATED}' THEN 'k1' ELSE 'k2' END AS key_id FROM audit_seed",
    "signed": f"""SELECT * EXCLUDE (payload), CASE key_id WHEN 'k1' THEN {_hmac('payload', KEYS['k1'])}
        ELSE {_hmac('payload', KEYS['k2'])} END AS signature FROM with_payload""",
}
CHECKED = {
    **SIGNED,
    "tampered": """SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN message || ' (edited)' ELSE message END AS message,
        CASE WHEN id % 101 <> 0 THEN signature END AS signature) FROM signed""",
    "recomputed": f"SELECT *, {_PAYLOAD} AS payload FROM tampered",
    "checked": f"""SELECT * EXCLUDE (payload), CASE key_id WHEN 'k1' THEN {_hmac('payload', KEYS['k1'])}
        ELSE {_hmac('payload', KEYS['k2'])} END AS expected_signature FROM recomputed""",
    "verified": "SELECT *, coalesce(signature = expected_signature, false) AS valid FROM checked",
}


def _counts_json(tool: str) -> str:
    return f"""'{{"id": ' || {tool}_id || ', "phone": ' || {tool}_phone || ', "email": ' || {tool}_email || '}}'"""


def _winner_count(slot: str) -> str:
    return f"CASE winning_tool WHEN 'A' THEN a_{slot} WHEN 'B' THEN b_{slot} WHEN 'C' THEN c_{slot} ELSE 0 END"


_NULL_COLUMNS = {
    name: f"CAST(NULL AS VARCHAR) AS {name}"
    for name in ("forbidden_intents", "winning_tool", "tool_a_counts", "tool_b_counts", "tool_c_counts")
}
_NO_TOOLS = ", ".join(v for k, v in _NULL_COLUMNS.items() if k != "forbidden_intents")
_ZEROS = "0 AS count_id, 0 AS count_email, 0 AS count_phone"


def _summary(source: str, hours: int) -> dict[str, str]:
    recent = f"ts >= {AS_OF} - INTERVAL {hours} HOUR"
    return {
        "recent": f"SELECT * FROM {source} WHERE {recent}",
        "recent_intents": "SELECT unnest(string_split(forbidden_intents, ';')) AS item FROM recent WHERE event_type = 'SECURITY_DENIED' AND forbidden_intents IS NOT NULL",
        "summary": """SELECT 'blocked' AS section, 'total_blocked' AS item, count(*) AS value FROM recent WHERE event_type = 'SECURITY_DENIED'
            UNION ALL SELECT 'pii_redacted', 'malaysian_ic', CAST(coalesce(sum(count_id), 0) AS BIGINT) FROM recent WHERE event_type = 'PII_REDACTED'
            UNION ALL SELECT 'pii_redacted', 'emails', CAST(coalesce(sum(count_email), 0) AS BIGINT) FROM recent WHERE event_type = 'PII_REDACTED'
            UNION ALL SELECT 'intent', item, count(*) FROM recent_intents GROUP BY item""",
    }


def _recent(body: str) -> str:
    return _with(body, **SIGNED, recent_100="SELECT * FROM signed ORDER BY ts DESC, id DESC LIMIT 100")


def _detections(column: str) -> str:
    ok = f"json_valid({column}) AND json_type(CASE WHEN json_valid({column}) THEN {column} END) = 'OBJECT'"
    part = lambda name: f"coalesce(json_extract_string({column}, '$.{name}'), '0')"
    return f"CASE WHEN {ok} THEN {part('id')} || ' ID, ' || {part('phone')} || ' Phone' ELSE '-' END"


GATE = {
    **PROMPTS,
    "gate_lines": seeds.GATE_LINES,
    **_fields("gate_lines", ["sanitized_prompt", "provider", "model"]),
    "gate_fields": f"""SELECT *, CASE WHEN json_type(sanitized_prompt_json) = 'VARCHAR' THEN {_as_text('sanitized_prompt')} END AS sanitized_prompt,
        CASE WHEN list_contains(json_keys(body), 'provider') THEN CASE WHEN json_type(provider_json) <> 'NULL' THEN {_as_text('provider')} END
             WHEN ok THEN 'openai' END AS provider,
        CASE WHEN json_type(model_json) <> 'NULL' THEN {_as_text('model')} END AS model FROM typed""",
    "gated": f"""SELECT *, CASE WHEN NOT ok THEN 'invalid_body' WHEN sanitized_prompt IS NULL OR sanitized_prompt = '' THEN 'missing_prompt'
        WHEN {_mask('sanitized_prompt', *STRICT)} <> sanitized_prompt THEN 'contains_pii' ELSE 'forward' END AS reason FROM gate_fields""",
}
_GATE_OUTCOME = "CASE WHEN reason = 'forward' THEN 200 ELSE 400 END AS code, reason = 'contains_pii' AS audit"

CORPUS = {
    "corpus": """SELECT 'documents' AS collection, CAST(doc_id AS VARCHAR) AS row_key, text FROM documents
        UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), text FROM conversations
        UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages"""
}


def _findings(source: str, key: str, text: str) -> str:
    parts = [
        f"""SELECT {key}, '{tool}' AS tool, '{kind}' AS kind, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS "match"
            FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m FROM {source}) WHERE len(m) > 0"""
        for tool, kind, pattern in [
            ("A", "id", fv.STRICT_ID), ("A", "phone", fv.STRICT_PHONE), ("A", "email", fv.STRICT_EMAIL),
            ("B", "name", NAMES), ("B", "location", LOCATIONS),
            ("C", "id", fv.LOOSE_ID), ("C", "phone", fv.LOOSE_PHONE), ("C", "email", fv.LOOSE_EMAIL),
        ]
    ]
    columns = f"{key}, tool, kind, CAST(pos AS INTEGER) AS pos, \"match\""
    return f"SELECT {columns} FROM (" + " UNION ALL ".join(parts) + ")"


DETECTORS = [
    ("A", "id", fv.STRICT_ID, fv.MASK_ID), ("A", "phone", fv.STRICT_PHONE, fv.MASK_PHONE), ("A", "email", fv.STRICT_EMAIL, fv.MASK_EMAIL),
    ("B", "name", NAMES, fv.MASK_NAME), ("B", "location", LOCATIONS, fv.MASK_LOCATION),
    ("C", "id", fv.LOOSE_ID, fv.MASK_ID), ("C", "phone", fv.LOOSE_PHONE, fv.MASK_PHONE), ("C", "email", fv.LOOSE_EMAIL, fv.MASK_EMAIL),
]


def _spans(source: str, key: str, text: str) -> str:
    """Every hit with its place in code points: ``ord``, ``tool``, ``kind``, ``mask``, ``start``, ``stop``."""
    lengths = "CAST(coalesce(list_sum(list_transform({}, lambda x: length(x))), 0) AS BIGINT)".format
    before = f"{lengths('p[1:i]')} + {lengths('m[1:i - 1]')}"
    parts = [
        f"""SELECT {key}, {order} AS ord, '{tool}' AS tool, '{kind}' AS kind, '{mask}' AS mask,
            unnest(list_transform(generate_series(1, len(m)), lambda i: {{'start': {before}, 'stop': {before} + length(m[i])}}), recursive := true)
            FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS p FROM {source})
            WHERE len(m) > 0"""
        for order, (tool, kind, pattern, mask) in enumerate(DETECTORS)
    ]
    return " UNION ALL ".join(parts)


def _union(source: str, key: str, text: str) -> dict[str, str]:
    """CTE ``united``: the key, the counts and the text with overlapping hits masked as one."""
    order = f"PARTITION BY {key} ORDER BY start, stop DESC, ord"
    shown = f"substr({text}, 1 + CASE WHEN i = 1 THEN 0 ELSE s[i - 1].stop END, s[i].start - CASE WHEN i = 1 THEN 0 ELSE s[i - 1].stop END) || s[i].mask"
    return {
        "hit_spans": _spans(source, key, text),
        "reached": f"SELECT *, max(stop) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit_spans",
        "numbered": f"SELECT *, count(*) FILTER (reach IS NULL OR start >= reach) OVER ({order} ROWS UNBOUNDED PRECEDING) AS island FROM reached",
        "islands": f"""SELECT {key}, min(start) AS start, max(stop) AS stop, first(mask ORDER BY start, stop DESC, ord) AS mask,
            count(*) AS hits FROM numbered GROUP BY {key}, island""",
        "gathered": f"""SELECT {key}, list({{'start': start, 'stop': stop, 'mask': mask}} ORDER BY start) AS s, sum(hits) AS hits,
            sum(stop - start) AS masked_chars FROM islands GROUP BY {key}""",
        "united": f"""SELECT {key}, CAST(coalesce(hits, 0) AS INTEGER) AS hits, CAST(coalesce(len(s), 0) AS INTEGER) AS masked_spans,
            CAST(coalesce(masked_chars, 0) AS INTEGER) AS masked_chars,
            CASE WHEN s IS NULL THEN {text} ELSE array_to_string(list_transform(generate_series(1, len(s)), lambda i: {shown}), '')
              || substr({text}, 1 + s[len(s)].stop) END AS sanitized
            FROM {source} LEFT JOIN gathered USING ({key})""",
    }


# Card numbers: runs of 13 to 19 digits with single spaces or dashes between, a right Luhn sum, not all digits equal.
_RUN = "[0-9](?:[ -]?[0-9])*"
_DIGITS = "regexp_replace({}, '[ -]', '', 'g')"
_LUHN = """list_sum(list_transform(generate_series(1, length({0})), lambda j:
    CASE WHEN (length({0}) - j) % 2 = 1 THEN (CAST({0}[j] AS INTEGER) * 2) // 10 + (CAST({0}[j] AS INTEGER) * 2) % 10 ELSE CAST({0}[j] AS INTEGER) END)) % 10 = 0"""


def _is_card(run: str) -> str:
    digits = _DIGITS.format(run)
    return f"(length({digits}) BETWEEN 13 AND 19 AND {digits} <> repeat({digits}[1], length({digits})) AND {_LUHN.format(digits)})"


CARD_CORPUS = {
    "card_texts": seeds.CARD_TEXTS,
    "corpus": """SELECT 'cards' AS collection, CAST(text_id AS VARCHAR) AS row_key, text FROM card_texts
        UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents""",
    "runs": f"SELECT *, regexp_extract_all(text, '{_RUN}') AS m, regexp_split_to_array(text, '{_RUN}') AS p FROM corpus",
    "marked": f"SELECT *, list_transform(m, lambda x: {_is_card('x')}) AS good FROM runs",
}


def _level(columns: list[str]) -> str:
    return f"CAST(grouping({', '.join(columns)}) AS INTEGER) AS level"


def _sums(names: dict[str, str]) -> str:
    return ", ".join(f"CAST(coalesce(sum({sql}), 0) AS BIGINT) AS {name}" for name, sql in names.items())


_STREAMED = {
    **SEED,
    "hourly_base": "SELECT *, date_trunc('hour', ts) AS hour FROM audit_seed WHERE event_type IN ('SECURITY_DENIED', 'PII_REDACTED')",
}


def oracle_sql() -> dict[str, str]:
    counts, scores = ", ".join(COUNTS), ", ".join(SCORES)
    sql: dict[str, str] = {}

    # requests and policies
    sql["parse_requests"] = _with("SELECT line_id, role, prompt, valid FROM parsed", **PARSED)
    sql["request_ids"] = _with(
        """SELECT prompt_id, sha256(CAST(prompt_id AS VARCHAR) || chr(31) || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END) AS request_id,
        role AS user_role, '/sanitize' AS endpoint FROM prompts""",
        **PROMPTS,
    )
    sql["policy_matrix"] = _with(
        """SELECT p.role, p.intent, k.keyword, count(s.prompt_id) AS requests FROM policy p JOIN keywords k USING (intent)
        LEFT JOIN prompts s ON lower(s.role) = p.role AND contains(lower(s.prompt), k.keyword) GROUP BY ALL""",
        **PROMPTS, **POLICY,
    )
    sql["role_known"] = _with(
        "SELECT prompt_id, role, coalesce(lower(role) IN (SELECT role FROM policy), false) AS role_known FROM prompts",
        **PROMPTS, **POLICY,
    )
    sql["authorized_prompts"] = _with(
        "SELECT prompt_id, role, prompt FROM decided WHERE authorized", **PROMPTS, **_decision("prompts", "prompt_id")
    )
    sql["forbidden_intents"] = _with(
        "SELECT prompt_id, authorized, forbidden_intents FROM decided", **PROMPTS, **_decision("prompts", "prompt_id")
    )
    sql["verify_disposition"] = _with(
        """SELECT line_id, CASE WHEN valid AND authorized THEN 'authorized' ELSE 'denied' END AS status,
        CASE WHEN NOT valid THEN 400 WHEN authorized THEN 200 ELSE 403 END AS code, valid AND forbidden_intents IS NOT NULL AS audit FROM decided""",
        **PARSED, **_decision("parsed", "line_id"),
    )
    sql["sanitize_disposition"] = _with(
        """SELECT line_id, CASE WHEN valid AND authorized THEN 'sanitize' ELSE 'denied' END AS status,
        CASE WHEN NOT valid THEN 400 WHEN authorized THEN 200 ELSE 403 END AS code FROM decided""",
        **PARSED, **_decision("parsed", "line_id"),
    )

    # detectors and jury
    for tool in "abc":
        sql[f"tool_{tool}"] = _prompt_jury(
            f"SELECT prompt_id, red_{tool} AS redacted, {tool}_id AS count_id, {tool}_phone AS count_phone, {tool}_email AS count_email FROM jury"
        )
    sql["jury_scores"] = _prompt_jury(f"SELECT prompt_id, {scores} FROM jury")
    sql["jury_winner"] = _prompt_jury("SELECT prompt_id, winning_tool FROM jury")
    sql["jury_output"] = _prompt_jury("SELECT prompt_id, sanitized FROM jury")
    sql["redaction_jury"] = _prompt_jury(f"SELECT prompt_id, sanitized, winning_tool, {scores}, {counts} FROM jury")
    details = ", ".join(f"{c} AS Tool_{c[0].upper()}{c[1:]}" for c in COUNTS)
    sql["reliability_summary"] = _prompt_jury(
        f"""SELECT prompt_id, winning_tool, score_a AS "Tool_A_Regex_Count", score_b AS "Tool_B_Dictionary_Count",
        score_c AS "Tool_C_MockAI_Count", {details} FROM jury"""
    )
    sql["redacted_only"] = _prompt_jury("SELECT prompt_id, winning_tool, sanitized FROM jury WHERE sanitized <> coalesce(prompt, '')")
    sql["redact_pii"] = _prompt_jury("SELECT prompt_id, red_a AS redacted FROM jury")
    sql["detect_pii_counts"] = _prompt_jury("SELECT prompt_id, a_id AS count_id, a_phone AS count_phone, a_email AS count_email FROM jury")
    sql["pii_findings"] = _with(_findings("prompts", "prompt_id", "prompt"), **PROMPTS)
    weighted = {"score_a": "3 * a_id + 2 * a_phone + a_email", "score_b": "b_id + b_phone + b_email", "score_c": "c_id + c_phone + 2 * c_email"}
    sql["jury_weighted"] = _with(
        f"SELECT prompt_id, winning_tool, sanitized, {scores} FROM jury", **PROMPTS, **_jury("prompts", "prompt", weighted)
    )
    votes = {
        "id": "CAST(a_id > 0 AS INTEGER) + CAST(c_id > 0 AS INTEGER)",
        "phone": "CAST(a_phone > 0 AS INTEGER) + CAST(c_phone > 0 AS INTEGER)",
        "email": "CAST(a_email > 0 AS INTEGER) + CAST(c_email > 0 AS INTEGER)",
        "name": "CAST(b_id > 0 AS INTEGER)",
        "location": "CAST(b_phone > 0 AS INTEGER)",
    }
    sql["jury_consensus"] = _prompt_jury(
        "SELECT prompt_id, "
        + ", ".join(f"{v} AS votes_{k}, ({v}) >= 2 AS agreed_{k}" for k, v in votes.items())
        + " FROM jury"
    )
    sql["sanitize_end_to_end"] = _with(
        f"""SELECT line_id, code, CASE WHEN code = 200 THEN 'sanitized' ELSE 'denied' END AS status, sanitized, winning_tool, {scores}, {counts} FROM jury""",
        **PARSED, **_decision("parsed", "line_id"),
        admitted="""SELECT line_id, CASE WHEN NOT valid THEN 400 WHEN authorized THEN 200 ELSE 403 END AS code,
            CASE WHEN valid AND authorized THEN prompt END AS admitted FROM decided""",
        **_jury("admitted", "admitted"),
    )
    sql["corpus_jury"] = _with(
        f"SELECT collection, row_key, winning_tool, {scores}, {counts}, md5(sanitized) AS sanitized_md5 FROM jury",
        **CORPUS, **_jury("corpus", "text"),
    )
    sql["jury_vector_detector"] = _with(
        f"""SELECT collection, row_key, {scores}, score_v, score_v AS cards, winner AS winning_tool, md5(CASE winner WHEN 'A' THEN red_a
        WHEN 'B' THEN red_b WHEN 'C' THEN red_c WHEN 'V' THEN red_v ELSE text END) AS sanitized_md5 FROM judged""",
        **CARD_CORPUS,
        with_cards="""SELECT collection, row_key, text, CAST(coalesce(len(list_filter(good, lambda g: g)), 0) AS INTEGER) AS score_v,
            array_to_string(list_transform(generate_series(1, len(m)), lambda i: p[i] || CASE WHEN good[i] THEN '[REDACTED_CARD]' ELSE m[i] END), '')
              || p[len(p)] AS red_v FROM marked""",
        **_jury("with_cards", "text"),
        judged="""SELECT *, CASE WHEN text IS NULL OR text = '' THEN NULL WHEN score_v > greatest(score_a, score_b, score_c) THEN 'V'
            ELSE winning_tool END AS winner FROM jury""",
    )
    sql["vector_findings"] = _with(
        """SELECT collection, row_key, 'V' AS tool, 'card' AS kind, CAST(start AS INTEGER) AS start, CAST(start + size AS INTEGER) AS "end" FROM (
        SELECT collection, row_key, unnest(list_transform(generate_series(1, len(m)), lambda i: {'good': good[i], 'size': length(m[i]),
          'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)}),
          recursive := true) FROM marked) WHERE good""",
        **CARD_CORPUS,
    )
    sql["jury_table_dictionary"] = sql["redaction_jury"]
    sql["dictionary_counts"] = """
    WITH found AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?: [A-Za-z]+)?')) AS term FROM conversations),
    terms AS (SELECT DISTINCT CASE WHEN contains(term, ' ') THEN 'pair' ELSE 'word' END AS kind, lower(term) AS term FROM found),
    cut AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w, regexp_split_to_array(text, '[\\p{L}\\p{N}_]+') AS g
            FROM documents WHERE text <> ''),
    placed AS (SELECT doc_id, w, g, unnest(generate_series(1, len(w))) AS i FROM cut),
    windows AS (
      SELECT doc_id, i, 1 AS n, lower(w[i]) AS term FROM placed
      UNION ALL SELECT doc_id, i, 2, lower(w[i] || g[i + 1] || w[i + 1]) FROM placed WHERE i < len(w)),
    hits AS (SELECT doc_id, kind, i, n, length(term) AS chars FROM windows JOIN terms USING (term)),
    listed AS (SELECT doc_id, kind, list([i, n, chars] ORDER BY i, n DESC) AS h FROM hits GROUP BY doc_id, kind),
    -- [next free word, hits, characters], going from hit to hit
    chosen AS (SELECT doc_id, kind, list_reduce(h, lambda s, x: CASE WHEN x[1] >= s[1] THEN [x[1] + x[2], s[2] + 1, s[3] + x[3]] ELSE s END,
                 [0::BIGINT, 0, 0]) AS s FROM listed)
    SELECT doc_id, kind, CAST(s[2] AS INTEGER) AS n, CAST(s[3] AS INTEGER) AS chars FROM chosen"""
    sql["jury_union"] = _with(
        "SELECT collection, row_key, hits, masked_spans, masked_chars, md5(sanitized) AS sanitized_md5 FROM united",
        **PROMPTS,
        corpus="""SELECT 'prompts' AS collection, CAST(prompt_id AS VARCHAR) AS row_key, prompt AS text FROM prompts
            UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents""",
        **_union("corpus", "collection, row_key", "text"),
    )
    sql["pii_finding_spans"] = _with(
        'SELECT prompt_id, tool, kind, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM hit_spans',
        **PROMPTS, hit_spans=_spans("prompts", "prompt_id", "prompt"),
    )
    sql["corpus_findings"] = _with(_findings("corpus", "collection, row_key", "text"), **CORPUS)

    # gate
    sql["generate_gate"] = _with(
        f"SELECT line_id, sanitized_prompt, provider, model, reason, {_GATE_OUTCOME} FROM gated", **GATE
    )
    sql["gate_denied_events"] = _with(
        f"""SELECT ts, 'SECURITY_DENIED' AS event_type, request_id, user_role, '/generate' AS endpoint,
        '{fv.GATE_DENIED_MESSAGE}' AS message FROM gated WHERE reason = 'contains_pii'""",
        **GATE,
    )
    sql["token_events"] = f"""SELECT ts, 'LLM_TOKEN_USAGE' AS event_type, 'req-' || CAST(event_id AS VARCHAR) AS request_id, 'client' AS user_role,
        '/generate' AS endpoint, replace('{fv.TOKEN_USAGE_PREFIX}' || '{{"prompt_tokens": ' || CAST(event_id % 300 AS VARCHAR)
        || CASE WHEN event_id % 4 <> 0 THEN ', "completion_tokens": ' || CAST(event_id % 200 AS VARCHAR) ELSE '' END
        || ', "total_tokens": ' || CAST(event_id % 500 AS VARCHAR) || '}}', '"', chr(39)) AS message
        FROM events WHERE event_type = 'click'"""

    # audit events and the audit table
    request = {"requests": "SELECT *, 'req-' || CAST(prompt_id AS VARCHAR) AS request_id FROM prompts"}
    sql["denied_events"] = _with(
        f"""SELECT ts, 'SECURITY_DENIED' AS event_type, request_id, role AS user_role, '/verify' AS endpoint,
        'Denied access attempt: role=' || role || ' prompt=' || prompt AS message, {_ZEROS}, forbidden_intents, '{{}}' AS metadata, {_NO_TOOLS}
        FROM decided WHERE forbidden_intents IS NOT NULL""",
        **PROMPTS, **request, **_decision("requests", "prompt_id"),
    )
    sql["jury_events"] = _with(
        f"""SELECT ts, 'PII_REDACTED_JURY' AS event_type, request_id, role AS user_role, '/sanitize' AS endpoint,
        '{fv.JURY_MESSAGE_PREFIX}' || winning_tool AS message, {_winner_count('id')} AS count_id, {_winner_count('email')} AS count_email,
        {_winner_count('phone')} AS count_phone, {_NULL_COLUMNS['forbidden_intents']},
        '{{"original_prompt_sample": ' || CAST(to_json(substr(prompt, 1, 200)) AS VARCHAR) || ', "tool_scores": {{"A": ' || score_a || ', "B": ' || score_b || ', "C": ' || score_c || '}}}}' AS metadata,
        winning_tool, {_counts_json('a')} AS tool_a_counts, {_counts_json('b')} AS tool_b_counts, {_counts_json('c')} AS tool_c_counts
        FROM jury WHERE sanitized <> prompt""",
        **PROMPTS, **request, **_decision("requests", "prompt_id"),
        admitted="SELECT * FROM decided WHERE authorized", **_jury("admitted", "prompt"),
    )
    priority = "event_type IN ('SECURITY_DENIED', 'PII_REDACTED', 'LLM_TOKEN_USAGE')"
    sql["priority_events"] = _with(f"SELECT id, event_type FROM audit_seed WHERE {priority}", **SEED)
    sql["log_to_audit"] = _with(
        f"""SELECT id, ts, event_type, request_id, user_role, endpoint, message, count_id, 0 AS count_email, 0 AS count_phone,
        forbidden_intents, '{{}}' AS metadata, {_NO_TOOLS} FROM audit_seed WHERE {priority}""",
        **SEED,
    )
    log_fields = f"""{_ISO} || 'Z' AS timestamp, CASE WHEN event_type = 'SECURITY_DENIED' THEN 'WARNING' ELSE 'INFO' END AS level"""
    sql["event_log_json"] = _with(
        f"SELECT {log_fields}, message, 'app' AS logger, event_type, request_id, user_role, endpoint FROM audit_seed", **SEED
    )
    sql["incident_log_filter"] = _with(
        f"""SELECT {log_fields}, request_id, user_role, message FROM audit_seed
        WHERE event_type = 'SECURITY_DENIED' AND user_role IN ('client', 'lawyer')""",
        **SEED,
    )
    base = "ts, event_type, request_id, user_role, endpoint, message, count_id, count_email, count_phone, forbidden_intents, metadata"
    tools = "winning_tool, tool_a_counts, tool_b_counts, tool_c_counts"
    sql["audit_schema_union"] = _with(
        f"""SELECT id, {base}, CAST(NULL AS VARCHAR) AS signature, {tools}, CAST(NULL AS VARCHAR) AS key_id, CAST(NULL AS INTEGER) AS payload_version
        FROM audit_seed UNION ALL SELECT -id - 1, {base}, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM audit_seed""",
        **SEED,
    )
    copies = {
        "once": "SELECT * REPLACE (CASE WHEN id % 10 <> 0 THEN request_id END AS request_id) FROM audit_seed",
        "events_left": """SELECT * FROM once UNION ALL SELECT * FROM once WHERE event_type = 'SECURITY_DENIED' AND request_id IS NULL
            UNION ALL SELECT * REPLACE (message || ' again' AS message) FROM once WHERE id % 7 = 0""",
    }
    sql["audit_dedup"] = _with(f"SELECT id, {base}, {tools} FROM events_left", **SEED, **copies)
    two = {
        "v2": f"SELECT *, {_PAYLOAD_V2} AS payload2 FROM with_payload",
        "signed2": f"""SELECT * EXCLUDE (payload2), 2 AS payload_version, CASE key_id WHEN 'k1' THEN {_hmac('payload2', KEYS['k1'])}
            ELSE {_hmac('payload2', KEYS['k2'])} END AS signature FROM v2""",
    }
    sql["audit_signed_v2"] = _with("SELECT id, key_id, payload_version, signature FROM signed2", **SIGNED, **two)
    # An edit shows where the payload covers it: of old rows the message, of new ones also id and counts.
    sql["tampered_ids_mixed"] = _with(
        """SELECT CASE WHEN id % 83 = 0 THEN id + 1000000000 ELSE id END AS id FROM audit_seed
        WHERE id % 97 = 0 OR (id % 2 = 1 AND (id % 83 = 0 OR (id % 89 = 0 AND tool_a_counts IS DISTINCT FROM '{}')))""",
        **SEED,
    )
    sql["audit_signed"] = _with("SELECT id, key_id, signature FROM signed", **SIGNED)
    sql["audit_round_trip"] = _with(
        f"SELECT id, {base}, {tools}, signature, key_id, 1 AS payload_version, CAST(ts AS DATE) AS event_date FROM signed WHERE ts >= {AS_OF} - INTERVAL 96 HOUR",
        **SIGNED,
    )
    sql["audit_compacted"] = _with(
        f"SELECT id, {base}, {tools}, signature, key_id, 1 AS payload_version, CAST(ts AS DATE) AS event_date FROM signed", **SIGNED
    )
    sql["tampered_ids"] = _with("SELECT id FROM verified WHERE NOT valid", **CHECKED)
    sql["tampered_since"] = _with(f"SELECT id, ts FROM verified WHERE NOT valid AND ts >= {AS_OF} - INTERVAL 72 HOUR", **CHECKED)
    sql["tampered_top10"] = _with("SELECT id FROM verified WHERE NOT valid ORDER BY id LIMIT 10", **CHECKED)
    sql["integrity_rollup"] = _with(
        """SELECT count(*) FILTER (NOT valid) = 0 AS integrity_ok, count(*) FILTER (NOT valid) AS tampered_rows,
        min(id) FILTER (NOT valid) AS first_tampered_id, max(id) FILTER (NOT valid) AS last_tampered_id FROM verified""",
        **CHECKED,
    )
    sql["tamper_timeline"] = _with(
        f"""SELECT date_trunc('day', ts)::TIMESTAMP AS period, user_role, endpoint, count(*) AS tampered_rows,
        {_sums({'ids': 'count_id', 'phones': 'count_phone', 'emails': 'count_email'})} FROM verified WHERE NOT valid GROUP BY ALL""",
        **CHECKED,
    )
    sql["signature_discrepancies"] = _with(
        """SELECT v.id, s.signature AS stored_signature, v.expected_signature FROM verified v JOIN signed s USING (id)
        WHERE s.signature <> v.expected_signature""",
        **CHECKED,
    )
    sql["verified_export"] = _with("SELECT id, request_id, message, signature, key_id FROM verified WHERE valid", **CHECKED)

    # reports
    since48 = f"ts >= {AS_OF} - INTERVAL 48 HOUR"
    sql["blocked_window"] = _with(
        f"SELECT count(*) AS total_blocked FROM audit_seed WHERE event_type = 'SECURITY_DENIED' AND {since48}", **SEED
    )
    sql["pii_totals_window"] = _with(
        f"""SELECT {_sums({'malaysian_ic': 'count_id', 'emails': 'count_email', 'phones': 'count_phone'})} FROM audit_seed
        WHERE event_type IN ('PII_REDACTED', 'PII_REDACTED_JURY') AND {since48}""",
        **SEED,
    )
    sql["intent_frequency"] = _with(
        """SELECT unnest(string_split(forbidden_intents, ';')) AS intent, count(*) AS n FROM decided
        WHERE forbidden_intents IS NOT NULL GROUP BY 1""",
        **PROMPTS, **request, **_decision("requests", "prompt_id"),
    )
    sql["audit_summary_24h"] = _with("SELECT * FROM summary", **SEED, **_summary("audit_seed", 24))
    sql["audit_summary_stored"] = sql["audit_summary_24h"]
    sql["audit_summary_hours"] = _with(
        """SELECT * FROM summary
        UNION ALL SELECT 'integrity', 'ok', CASE WHEN bool_and(valid) THEN 1 ELSE 0 END FROM verified
        UNION ALL SELECT 'integrity', 'tampered_rows', count(*) FILTER (NOT valid) FROM verified
        UNION ALL SELECT 'tampered_id', CAST(id AS VARCHAR), 1 FROM (SELECT id FROM verified WHERE NOT valid ORDER BY id LIMIT 10)""",
        **CHECKED, **_summary("verified", 240),
    )
    sql["events_by_type"] = _with("SELECT event_type, count(*) AS n FROM audit_seed GROUP BY event_type", **SEED)
    sql["token_usage"] = _with(
        """SELECT user_role, count(*) AS calls, CAST(sum(TRY_CAST(regexp_extract(message, 'total_tokens.: (\\d+)', 1) AS BIGINT)) AS BIGINT) AS total_tokens
        FROM audit_seed WHERE event_type = 'LLM_TOKEN_USAGE' GROUP BY user_role""",
        **SEED,
    )
    shown = "id, ts, event_type, request_id, user_role, endpoint, message, count_id, count_phone, count_email, " + tools
    sql["recent_events_100"] = _recent(f"SELECT {shown}, signature FROM recent_100")
    built = {
        **PROMPTS, **request, **_decision("requests", "prompt_id"),
        "admitted": "SELECT * FROM decided WHERE authorized", **_jury("admitted", "prompt"),
    }
    sql["latest_jury_event"] = _with(
        f"""SELECT ts, request_id, winning_tool, '{fv.JURY_MESSAGE_PREFIX}' || winning_tool AS message
        FROM jury WHERE sanitized <> prompt ORDER BY ts DESC LIMIT 1""",
        **built,
    )
    sql["sample_jury_events"] = _with(
        f"""SELECT ts, request_id, winning_tool, {_counts_json('b')} AS tool_b_counts
        FROM jury WHERE sanitized <> prompt ORDER BY ts LIMIT 5""",
        **built,
    )
    t = "coalesce(prompt, '')"
    order = "'\\bOrder \\d+'"
    four = {
        **PROMPTS, **request, **_decision("requests", "prompt_id"), "admitted": "SELECT * FROM decided WHERE authorized",
        **{k: v for k, v in _jury("admitted", "prompt", {"score_a": "a_id + a_phone", "score_b": "b_id + b_phone + b_email", "score_c": "c_id + c_phone"}).items() if k in ("counted", "scored")},
        "with_d": f"""SELECT *, len(regexp_extract_all({t}, {order})) AS d_id, CAST(5 * len(regexp_extract_all({t}, {order})) AS INTEGER) AS score_d,
            regexp_replace(prompt, {order}, '[REDACTED_ORDER]', 'g') AS red_d FROM scored""",
        "four": """SELECT *, CASE WHEN prompt = '' THEN NULL WHEN score_a >= greatest(score_b, score_c, score_d) THEN 'A'
            WHEN score_b >= greatest(score_c, score_d) THEN 'B' WHEN score_c >= score_d THEN 'C' ELSE 'D' END AS winning_tool FROM with_d""",
        "changed": """SELECT *, CASE winning_tool WHEN 'A' THEN red_a WHEN 'B' THEN red_b WHEN 'C' THEN red_c WHEN 'D' THEN red_d ELSE prompt END AS sanitized FROM four""",
    }
    sql["jury_events_four_tools"] = _with(
        f"""SELECT request_id, winning_tool, CAST(CASE winning_tool WHEN 'D' THEN d_id ELSE {_winner_count('id')} END AS INTEGER) AS count_id,
        {_winner_count('email')} AS count_email, '{fv.JURY_MESSAGE_PREFIX}' || winning_tool AS message,
        '{{"original_prompt_sample": ' || CAST(to_json(substr(sanitized, 1, 200)) AS VARCHAR) || ', "tool_scores": {{"A": ' || score_a || ', "B": ' || score_b || ', "C": ' || score_c || ', "D": ' || score_d || '}}}}' AS metadata,
        {_counts_json('a')} AS tool_a_counts FROM changed WHERE sanitized <> prompt""",
        **four,
    )
    sql["audit_log_view"] = _recent(
        """SELECT id, ts, event_type, user_role, coalesce('Tool ' || winning_tool, 'N/A') AS winner,
        'ID: ' || count_id || ', Phone: ' || count_phone || ', Email: ' || count_email AS items_detected,
        substr(signature, 1, 20) || '...' AS signature_preview FROM recent_100"""
    )
    sql["reliability_view"] = _recent(
        f"""SELECT id, {_detections('tool_a_counts')} AS tool_a, {_detections('tool_b_counts')} AS tool_b,
        {_detections('tool_c_counts')} AS tool_c, 'Tool ' || winning_tool AS winner FROM recent_100 WHERE winning_tool IS NOT NULL"""
    )
    judged = "FROM jury WHERE winning_tool IS NOT NULL"
    sql["tool_win_rate"] = _prompt_jury(
        f"SELECT winning_tool, count(*) AS wins, CAST(sum(count(*)) OVER () AS BIGINT) AS judged_rows {judged} GROUP BY winning_tool"
    )
    sql["tool_avg_detections"] = _prompt_jury(
        " UNION ALL ".join(
            f"SELECT '{x.upper()}' AS tool, CAST(sum(score_{x}) AS BIGINT) AS detections, count(*) AS judged_rows {judged}" for x in "abc"
        )
    )
    pair = lambda x, y: f"CAST(sign(score_{x} - score_{y}) AS INTEGER) AS {x}_vs_{y}"
    sql["tool_agreement"] = _prompt_jury(
        f"SELECT {pair('a', 'b')}, {pair('b', 'c')}, {pair('a', 'c')}, count(*) AS n {judged} GROUP BY ALL"
    )
    wins = ", ".join(f"count(*) FILTER (winning_tool = '{x.upper()}') AS wins_{x}" for x in "abc")
    sql["tool_by_role"] = _prompt_jury(f"SELECT role, {wins} FROM jury GROUP BY role")
    sql["tool_trend_daily"] = _prompt_jury(
        f"""SELECT CAST(ts AS DATE) AS day, winning_tool, count(*) AS wins,
        CAST(sum(greatest(score_a, score_b, score_c)) AS BIGINT) AS detections {judged} GROUP BY ALL"""
    )
    sql["tool_by_input_type"] = _with(
        f"""SELECT lang, source, {_level(['lang', 'source'])}, count(*) AS n,
        {_sums({f'hits_{x}': f'score_{x}' for x in 'abc'})}, {wins} FROM jury GROUP BY ROLLUP (lang, source)""",
        **_jury("documents", "text"),
    )

    # streams, over all input that was there
    sql["stream_sanitize"] = _with(
        f"SELECT prompt_id, code, sanitized, winning_tool, {scores} FROM jury",
        **PROMPTS, **_decision("prompts", "prompt_id"),
        admitted="SELECT prompt_id, CASE WHEN authorized THEN 200 ELSE 403 END AS code, CASE WHEN authorized THEN prompt END AS admitted FROM decided",
        **_jury("admitted", "admitted"),
    )
    sql["stream_gate"] = _with(f"SELECT line_id, reason, {_GATE_OUTCOME} FROM gated", **GATE)
    sql["stream_audit_dedup"] = _with("SELECT request_id, event_type, ts, user_role, message FROM events_left", **SEED, **copies)
    sql["stream_blocked_24h"] = _with(
        f"""SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) FILTER (event_type = 'SECURITY_DENIED') AS blocked,
        {_sums({'malaysian_ic': "CASE WHEN event_type = 'PII_REDACTED' THEN count_id ELSE 0 END", 'emails': "CASE WHEN event_type = 'PII_REDACTED' THEN count_email ELSE 0 END"})}
        FROM (SELECT *, unnest(generate_series(hour - INTERVAL 23 HOUR, hour, INTERVAL 1 HOUR)) AS window_start FROM hourly_base)
        GROUP BY window_start""",
        **_STREAMED,
    )
    sql["stream_intents_hourly"] = _with(
        """SELECT hour AS window_start, hour + INTERVAL 1 HOUR AS window_end, intent, count(*) AS n
        FROM (SELECT hour, unnest(string_split(forbidden_intents, ';')) AS intent FROM hourly_base WHERE event_type = 'SECURITY_DENIED' AND forbidden_intents IS NOT NULL)
        GROUP BY ALL""",
        **_STREAMED,
    )
    sql["stream_gate_split"] = _with(
        """SELECT CASE WHEN reason = 'forward' THEN 'forwarded' ELSE 'rejected' END AS output, request_id, provider, reason,
        CASE WHEN reason = 'forward' THEN 200 ELSE 400 END AS code FROM gated
        UNION ALL SELECT 'audit', request_id, user_role, 'SECURITY_DENIED', 400 FROM gated WHERE reason = 'contains_pii'""",
        **GATE,
    )
    sql["stream_audit_dedup_keys"] = sql["stream_audit_dedup"]
    sql["stream_blocked_24h_store"] = sql["stream_blocked_24h"]
    sql["stream_intents_hourly_store"] = sql["stream_intents_hourly"]
    return sql
