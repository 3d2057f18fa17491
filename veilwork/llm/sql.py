"""The same results as DuckDB SQL, by query name."""

from __future__ import annotations

from veilwork.llm import line_templates, quality, secret_scan, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _sql_rule(rule: quality.Rule) -> str:
    unit = rule.per or "1"
    parts = []
    if rule.least is not None:
        parts.append(f"{rule.scale} * ({rule.measure} + {rule.grace}) < {rule.least} * {unit}")
    if rule.most is not None:
        parts.append(f"{rule.scale} * ({rule.measure} + {rule.grace}) > {rule.most} * {unit}")
    return "(" + " OR ".join(parts) + ")"


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

QUALITY_MEASURES = rf"""
split_up AS (
  SELECT doc_id, coalesce(text, '') AS body, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS window5
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS p FROM split_up WHERE len(w) >= 5)),
repeated AS (
  SELECT doc_id, p FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, window5) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n
  FROM repeated, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split_up LEFT JOIN covered USING (doc_id))"""

OP8 = f"""
WITH {QUALITY_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {' OR '.join(map(_sql_rule, quality.BASE_RULES))} AS base_failed,
       NOT ({' OR '.join(map(_sql_rule, quality.BASE_RULES + quality.DEFAULT_RULES))}) AS kept
FROM measured"""


OP3 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)
               AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size, 3 * sum(size)::HUGEINT AS most,
         1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER ()) - coalesce(sum(most) OVER before, 0) AS words,
         (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS shares
  FROM sources
  WINDOW before AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT words, shares FROM filled WHERE most * shares >= weight * words
  ORDER BY most / weight, source LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN most * shares < weight * words THEN most::DOUBLE
              ELSE (weight * words)::DOUBLE / shares::DOUBLE END AS target
  FROM sources, level),
rated AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies
  FROM targets),
ranked AS (
  SELECT doc_id, size, d.source, source_size, target, whole, copies - whole AS part, target - whole * source_size AS wanted,
         (u / (1 - u)) / ((copies - whole) / (1 - (copies - whole))) AS q
  FROM sized d JOIN rated t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND
         (sum(size) OVER (PARTITION BY source ORDER BY q ROWS UNBOUNDED PRECEDING)) - size / 2 <= wanted THEN 1 ELSE 0 END)
         AS BIGINT) AS taken
FROM ranked"""


def _sql_form(number: int) -> str:
    _, pattern, group, least = secret_scan.FORMS[number]
    pattern = pattern.replace("'", "''")
    return rf"""
  SELECT doc_id, {number} AS kind, start, stop FROM (
    SELECT doc_id, unnest(list_transform(generate_series(1, len(m)), lambda i: {{
             'start': list_sum(list_transform(p[1:i], lambda x: length(x)))
                      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
             'stop': list_sum(list_transform(p[1:i], lambda x: length(x)))
                     + list_sum(list_transform(m[1:i], lambda x: length(x))),
             'n': length(v[i])}}), recursive := true)
    FROM (SELECT doc_id, regexp_split_to_array(body, '{pattern}') AS p, regexp_extract_all(body, '{pattern}') AS m,
                 regexp_extract_all(body, '{pattern}', {group}) AS v
          FROM body WHERE regexp_matches(body, '{pattern}')))
  WHERE n >= {least}"""


_KIND = "['" + "', '".join([f[0] for f in secret_scan.FORMS] + [secret_scan.ENTROPY]) + "'][kind + 1]"
_TOLD = f"string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
_MOST = "CASE " + " ".join(
    f"WHEN regexp_matches(m, '{c.pattern}') THEN {c.most}" for c in secret_scan.CLASSES) + " END"

OP4 = rf"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
base AS ({' UNION ALL '.join(_sql_form(k) for k in range(len(secret_scan.FORMS)))}),
candidate AS (
  SELECT doc_id, start, start + length(m) AS stop, m FROM (
    SELECT doc_id, unnest(list_transform(generate_series(1, len(m)), lambda i: {{
             'start': list_sum(list_transform(p[1:i], lambda x: length(x)))
                      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
             'm': m[i]}}), recursive := true)
    FROM (SELECT doc_id, regexp_split_to_array(body, '{secret_scan.CANDIDATE}') AS p,
                 regexp_extract_all(body, '{secret_scan.CANDIDATE}') AS m
          FROM body WHERE regexp_matches(body, '{secret_scan.CANDIDATE}')))
  WHERE NOT regexp_matches(m, '{secret_scan.ALLOWED}')),
unknown AS (
  SELECT * FROM candidate c WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop)),
windows AS (
  SELECT doc_id, start, m, {_MOST} AS most, unnest(generate_series(1, length(m) - {secret_scan.WINDOW - 1})) AS p FROM unknown),
letters AS (
  SELECT doc_id, start, most, p, unnest(string_split(substr(m, p, {secret_scan.WINDOW}), '')) AS c FROM windows),
counted AS (SELECT doc_id, start, most, p, c, count(*) AS n FROM letters GROUP BY ALL),
good AS (
  SELECT doc_id, start, most, p FROM counted GROUP BY ALL
  HAVING sum({list(secret_scan.WEIGHTS)}[n + 1]) <= most),
added AS (
  SELECT doc_id, {len(secret_scan.FORMS)} AS kind, start + min(p) - 1 AS start, start + max(p) - 1 + {secret_scan.WINDOW} AS stop
  FROM good GROUP BY doc_id, good.start),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         {_TOLD} FILTER (kind < {len(secret_scan.FORMS)}) AS base_spans, {_TOLD} AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)"""

OP6 = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS h
  FROM pages),
named AS (
  SELECT page_id, body, payload_bytes, translate(array_to_string(list_transform(generate_series(0, 7),
           lambda k: to_base(CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT), 32, 4)), ''),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
         min(page_id) OVER (PARTITION BY body) AS first
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM named"""

OP10 = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY body)"""

OP7 = r"""
WITH RECURSIVE split_up AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM split_up WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
meet AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM meet JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id,
       d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, n"""

def _sequences_sql(more_than: int, least: int) -> str:
    """Lines of sequences of more than so many words that stand in so many groups: the sequences from each line on, and up to it."""
    made = []
    for order, frame, first, last in (
        ("start", f"CURRENT ROW AND {more_than} FOLLOWING", "nth", "nth + len(part) - 1"),
        ("stop", f"{more_than} PRECEDING AND CURRENT ROW", "nth - len(part) + 1", "nth"),
    ):
        over = f"(PARTITION BY body, run ORDER BY {order} RANGE BETWEEN {frame})"
        made.append(f"""SELECT body, grp, {first} AS first, {last} AS last, part FROM (
          SELECT body, grp, nth, list(template) OVER {over} AS part, sum(n_words) OVER {over} AS n FROM stretch) WHERE n > {more_than}""")
    both = " UNION ALL ".join(made)
    return f"""SELECT body, unnest(generate_series(first, last)) AS nth FROM (
      SELECT * FROM ({both})) JOIN (
      SELECT part FROM ({both}) GROUP BY part HAVING count(DISTINCT grp) >= {least}) USING (part)"""


OP9 = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce(text, '') AS body, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
cut AS (
  SELECT body, p, list_transform(regexp_extract_all(l[p], '[^\x20\x09-\x0D]+'),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM (SELECT body, l, unnest(generate_series(1, len(l))) AS p FROM (SELECT DISTINCT body, l FROM raw))),
shown AS (
  SELECT body, p, row_number() OVER (PARTITION BY body ORDER BY p) - 1 AS nth, len(w) AS n_words, w,
         [CAST(len(w) AS VARCHAR)] || w[1:{line_templates.LEADING}] AS leaf
  FROM cut WHERE len(w) > 0),
different AS (SELECT DISTINCT leaf, w FROM shown),
tokens AS (SELECT leaf, w, unnest(w) AS token, unnest(generate_series(1, len(w))) AS k FROM different),
counts AS (SELECT leaf, k, token, count(*) AS n FROM tokens GROUP BY ALL HAVING count(*) > 1),
shares AS (
  SELECT leaf, w, list({{'k': k, 'token': token, 'n': n}} ORDER BY k) AS fixed, list(n ORDER BY n DESC) AS ns
  FROM tokens JOIN counts USING (leaf, k, token) GROUP BY leaf, w
  HAVING count(*) * 100 >= len(w) * {line_templates.FIXED_PERCENT}),
templates AS (
  SELECT leaf, w, [CAST(len(w) AS VARCHAR)] || list_transform(
           list_filter(fixed, lambda x: x.n * 2 > ns[CAST(greatest(ceil(len(w) * {line_templates.FIXED_PERCENT} / 100.0), 1) AS BIGINT)]),
           lambda x: CAST(x.k AS VARCHAR) || ' ' || x.token) AS template
  FROM shares),
named AS (
  SELECT body, p, nth, n_words, coalesce(template, ['line'] || s.w) AS template
  FROM shown s LEFT JOIN templates t ON t.leaf = s.leaf AND t.w = s.w),
common AS (
  SELECT * FROM named SEMI JOIN (SELECT template FROM named GROUP BY template HAVING count(DISTINCT body) > 1) USING (template)),
met AS (SELECT body, row_number() OVER (ORDER BY body) AS id FROM (SELECT DISTINCT body FROM raw)),
spoken AS (
  SELECT id, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM met),
shingle AS (
  SELECT DISTINCT id, array_to_string(w[q:q + 4], ' ') AS s
  FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS q FROM spoken WHERE len(w) > 0)),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS n_both FROM shingle a JOIN shingle b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
link AS (
  SELECT a, b FROM pairs JOIN size x ON x.id = a JOIN size y ON y.id = b
  WHERE 100 * n_both >= {line_templates.NEAR} * (x.n + y.n - n_both)),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT id AS a, id AS b FROM met UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
grouped AS (
  SELECT c.*, g.grp FROM common c JOIN met USING (body) JOIN (SELECT a AS id, min(b) AS grp FROM reach GROUP BY a) g USING (id)),
repeated AS (
  SELECT * FROM grouped JOIN (SELECT template, count(DISTINCT grp) AS n_groups FROM grouped GROUP BY template) USING (template) WHERE n_groups > 1),
numbered AS (SELECT *, nth - row_number() OVER (PARTITION BY body ORDER BY nth) AS run FROM repeated),
stretch AS (
  SELECT *, sum(n_words) OVER (PARTITION BY body, run ORDER BY nth) AS stop,
         sum(n_words) OVER (PARTITION BY body, run ORDER BY nth) - n_words AS start FROM numbered),
gone AS (
  SELECT body, nth FROM repeated WHERE n_groups >= {line_templates.MIN_GROUPS}
  {' '.join(f'UNION {_sequences_sql(*run)}' for run in line_templates.RUNS)}),
dropped AS (SELECT body, list(p) AS places FROM repeated SEMI JOIN gone USING (body, nth) GROUP BY body),
filled AS (SELECT body, count(*) AS n_lines FROM shown GROUP BY body)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_dropped,
       CASE WHEN places IS NULL THEN text
            ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(places, i)), chr(10)) END AS text
FROM raw LEFT JOIN dropped USING (body) LEFT JOIN filled USING (body)"""


OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split_up AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (
  SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p
  FROM split_up, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
counted AS (
  SELECT lang, array_to_string(w[p:p + size - 1], ' ') AS phrase, any_value(size) AS size, count(*) AS f
  FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(len(w)) AS n FROM split_up GROUP BY lang),
candidate AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidate)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = c.first JOIN counted r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[p:p + s - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(generate_series(1, size - s + 1)) AS p
        FROM (SELECT *, unnest(generate_series(2, size - 1)) AS s FROM candidate WHERE size > 2))
  GROUP BY ALL)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank, o.phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase JOIN totals t ON t.lang = o.lang
WHERE over IS NULL OR 100 * over < 80 * a
QUALIFY rank <= 2000"""

OP12 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n,
         [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS d
  FROM cut),
formed AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS i, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS j,
         CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain'
              WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parted AS (
  SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s
  FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parted"""


def _sql_draw(key: str, node: sharding.Node) -> str:
    number = f"CAST('0x' || substr(md5('{node.name}|' || {key}), 1, 13) AS BIGINT)"
    return f"-ln(({number} + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {float(node.weight)}::DOUBLE"


def _sql_shard(key: str, node: sharding.Node) -> str:
    """The shard below ``node``: the child with the shortest time, then on below it."""
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_shard(key, node.children[0])
    draws = [_sql_draw(key, child) for child in node.children]
    least = f"least({', '.join(draws)})"
    branches = " ".join(f"WHEN {d} THEN {_sql_shard(key, c)}" for d, c in zip(draws, node.children, strict=True))
    return f"CASE {least} {branches} END"


_TREE = sharding.even_tree()

def _crc_digit(digit: int, place: int) -> int:
    """What hex digit ``place`` (0: the lowest) of four bytes adds to a CRC-32: its rule, bit by bit."""
    for _ in range(32 - 4 * place):
        digit = digit >> 1 ^ (3988292384 if digit & 1 else 0)
    return digit


_DIGITS = [[_crc_digit(digit, place) for digit in range(16)] for place in range(8)]
_FOUR = " || ".join(f"w[{7 - 2 * k}:{8 - 2 * k}]" for k in range(4))
_STEPS = "xor(" * 7 + ", ".join(
    f"CAST({_DIGITS[k]} AS BIGINT[])[1 + ((xor(c, d) >> {4 * k}) & 15)]" + ")" * (k > 0) for k in range(8)
)

# CRC-32 of four bytes a step, by hex digits; the bytes before the first multiple of four are
# taken digit by digit, low one first.
OP13 = f"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, (strlen(coalesce(text, '')) % 4) AS r,
         coalesce(CAST(doc_id AS VARCHAR), '') AS k
  FROM documents),
started AS (
  SELECT doc_id, k, x, r, list_reduce(
           [4294967295] || list_transform(generate_series(1, 2 * r),
             lambda p: CAST(instr('0123456789ABCDEF', x[p + CASE WHEN p % 2 = 1 THEN 1 ELSE -1 END]) - 1 AS BIGINT)),
           lambda c, d: xor(c >> 4, CAST({_DIGITS[7]} AS BIGINT[])[1 + (xor(c, d) & 15)])) AS c0
  FROM bytes),
summed AS (
  SELECT doc_id, k, CAST(length(x) // 2 + 8 AS BIGINT) AS size,
         xor(list_reduce([c0] || list_transform(regexp_extract_all(x[2 * r + 1:], '.{{8}}'),
           lambda w: CAST('0x' || {_FOUR} AS BIGINT)), lambda c, d: {_STEPS}), 4294967295) AS text_crc32
  FROM started),
placed AS (
  SELECT doc_id, size, text_crc32, {_sql_shard('k', _TREE)} AS shard, {_sql_shard('k', sharding.grown(_TREE))} AS grown_shard,
         substr(md5(concat_ws('|', k, CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR))), 1, 15) AS place
  FROM summed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed"""


def oracle_sql():
    return {
        "op3_mixing": OP3,
        "op4_secrets": OP4,
        "op6_warc": OP6,
        "op7_near_duplicates": OP7,
        "op8_quality_rules": OP8,
        "op9_line_templates": OP9,
        "op10_exact_index": OP10,
        "op11_collocations": OP11,
        "op12_fill_middle": OP12,
        "op13_hash_tree": OP13,
    }
