"""Plain-Python versions and small tables for the tests of this folder."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Column names that operators use inside.
CLASHES = [
    "row", "size", "u", "key", "body", "ids", "decoded", "rates", "score", "text_key", "class", "template", "first",
    "_text", "_argument", "bucket", "kept", "value", "word", "line", "copies", "target", "of", "block",
]


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source) as documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def clashing(df):
    """``df`` with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{i}").alias(name) for i, name in enumerate(CLASHES)])


def shingles(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def near_groups(rows, percent):
    """doc_id -> smallest doc_id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}
