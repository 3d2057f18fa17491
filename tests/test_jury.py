import random
import time

import pytest
from pyspark.sql import functions as F

import plain
from veilwork import fixed_values as fv
from veilwork.functions import patterns
from veilwork.functions.masking import STRICT_RULES, PatternRule, has_strict_pii
from veilwork.operators import jury
from veilwork.operators.detectors import DETECTORS, DICTIONARY, DictionaryDetector, PatternDetector, WordList

COUNTS = [f"{tool}_{slot}" for tool in "abc" for slot in ("id", "phone", "email")]

# text, scores of A, B, C, winner
GOLDEN = [
    ("Parcel 123456-12-5678 is late, the depot is 0987654321.", (0, 0, 2), "C"),
    ("Two seats for Musa and Karim in Johor, confirm to desk@rail.example please.", (1, 3, 1), "B"),
    ("Form: 900228-10-4321, +60198765432, zainab@shop.my, from Sabah for Zainab", (3, 3, 3), "A"),
    ("", (0, 0, 0), None),
    ("Rania flew from Penang to Perak, Amira stayed in Kedah: amira.k@fly.example", (1, 6, 1), "B"),
    ("Rashid wants 0198765432 on card 900228-10-4321", (2, 1, 2), "A"),
    ("Old number +6019 8765432, old card 900228-10-4321.", (1, 0, 2), "C"),
    ("Nasir (900228-10-4321), +60198765432, JB", (2, 2, 2), "A"),
    ("From yasmin@post.my to salim@post.my", (2, 2, 2), "A"),
]

MASKED = [
    ("Card 900228-10-4321 found", "Card [REDACTED_ID] found"),
    ("Card 900228104321 found", "Card [REDACTED_ID] found"),
    ("Write to x@one.com, then to y@two.org today", "Write to [REDACTED_EMAIL], then to [REDACTED_EMAIL] today"),
    ("Nothing to hide in this line.", "Nothing to hide in this line."),
    ("Ring +6019-8765432", "Ring +[REDACTED_PHONE]"),
    ("Ring 019-8765432", "Ring [REDACTED_PHONE]"),
    ("Ring 60198765432", "Ring [REDACTED_PHONE]"),
    ("Ring 0198765432", "Ring [REDACTED_PHONE]"),
    ("Card 901328-10-4321 is odd", "Card 901328-10-4321 is odd"),
    ("601231012345 and 0123456789@x.com", "[REDACTED_ID] and [REDACTED_PHONE]@x.com"),
]

FRAGMENTS = [
    "850315-01-1234", "850315011234", "801301-01-1234", "80/01/01-01-1234", "123456-12-5678", "012-3456789",
    "+60123456789", "60123456789", "+6012 3456789", "0123456789", "01234567890", "012--3456789", "015-1234567",
    "601231012345", "٠١٢٣٤٥٦٧٨٩٠١", "²", "①",
    "a@ex.com", "b.c+d@sub.example.my", "x_y@z", "q@@w.com", "a@b.c_d@e.fg", "%x@y.zz", ".a@b.co", "-", "--", "_",
    "a@b.co.%x@y.zz", "éa@x.com", "é.a@x.com", "a@x.comé", "@", "a@b.c-", "..", "+", "%", "a.a.a", ".co",
    "Ahmad", "ALI", "siti", "kuala lumpur", "Kuala  Lumpur", "KL", "Klang", "jb", "petaling jaya", "shah alam",
    "malay\u017fia", "\u212aL", "S\u0130T\u0130", "al\u0131", "\u017fiti", "\u00e9ali", "al\u00ed", "ali\u00b2", "ali_x", "ali\u0301", "ali\u200d", "zainab",
    "\u0660\u0661-0102", "12\u0660101011234", "6\u0660123456789", "a+60123456789", "\u00e9+60123456789", "_0123456789", "01\u0661 345 6789",
    " ", " ", " ", " ", " ", "\u001c", "\n", ".", ",", "中", "\U0001f600", "x", "7", "१", "‿", "é",
]


def _random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def _frame(spark, texts):
    return spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "n int, text string")


def test_golden_scores(spark):
    rows = jury.redaction_jury(_frame(spark, [g[0] for g in GOLDEN]), "text").orderBy("n").collect()
    for row, (text, scores, winner) in zip(rows, GOLDEN):
        assert (row.score_a, row.score_b, row.score_c) == scores, text
        assert row.winning_tool == winner, text


def test_golden_masks(spark):
    rows = jury.redact_pii(_frame(spark, [text for text, _ in MASKED]), "text").orderBy("n").collect()
    assert [row.redacted for row in rows] == [masked for _, masked in MASKED]


def test_matches_python_on_unicode(spark):
    texts = _random_texts(6000, seed=7) + ["", None]
    rows = jury.redaction_jury(_frame(spark, texts), "text").orderBy("n").collect()
    for row, text in zip(rows, texts):
        sanitized, winner, counts = plain.jury(text)
        assert [row[c] for c in COUNTS] == counts, repr(text)
        assert row.winning_tool == winner, repr(text)
        assert row.sanitized == sanitized, repr(text)


def test_each_detector_alone_matches_python(spark):
    texts = _random_texts(2500, seed=11)
    expected = {
        "A": lambda text: plain.by_patterns(plain.STRICT, text),
        "B": plain.by_words,
        "C": lambda text: plain.by_patterns(plain.LOOSE, text),
    }
    for detector in DETECTORS:
        out = jury.detector_output(_frame(spark, texts), detector, "text").orderBy("n").collect()
        for row, text in zip(out, texts):
            got = row.redacted, [row.count_id, row.count_phone, row.count_email]
            assert got == expected[detector.name](text), (detector.name, text)


def test_strict_functions_agree(spark):
    texts = _random_texts(2500, seed=13) + ["", None]
    frame = jury.redact_pii(_frame(spark, texts), "text").withColumn("found", has_strict_pii(F.col("text")))
    for row in jury.detect_pii_counts(frame, "text").orderBy("n").collect():
        masked, counts = plain.by_patterns(plain.STRICT, row.text) if row.text else (row.text, [0, 0, 0])
        assert row.redacted == masked
        assert [row.count_id, row.count_phone, row.count_email] == counts
        assert row.found == (masked != row.text)


def test_findings_are_the_matches(spark):
    texts = _random_texts(1500, seed=17)
    patterns_of = {
        ("A", "id"): fv.STRICT_ID, ("A", "phone"): fv.STRICT_PHONE, ("A", "email"): fv.STRICT_EMAIL,
        ("C", "id"): fv.LOOSE_ID, ("C", "phone"): fv.LOOSE_PHONE, ("C", "email"): fv.LOOSE_EMAIL,
    }
    expected = {
        (n, tool, kind, i, match)
        for n, text in enumerate(texts)
        for (tool, kind), pattern in patterns_of.items()
        for i, match in enumerate(plain.hits(pattern, text))
    }
    for n, text in enumerate(texts):
        for kind, terms in (("name", fv.NAMES), ("location", fv.LOCATIONS)):
            pattern = r"(?i)\b(?:" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b"
            expected |= {(n, "B", kind, i, match) for i, match in enumerate(plain.hits(pattern, text))}
    found = jury.findings(_frame(spark, texts), ["n"], "text").collect()
    assert {(r.n, r.tool, r.kind, r.pos, r["match"]) for r in found} == expected
    assert len(found) == len(expected)


def test_masking_strict_twice_changes_nothing_more(spark, sf_dir):
    from verification import tables

    once = jury.redact_pii(tables.prompts(spark, sf_dir), out="once")
    assert jury.redact_pii(once, "once", "twice").filter("NOT (once <=> twice)").count() == 0


def test_score_is_sum_and_winner_is_best(spark, sf_dir):
    from verification import tables

    judged = jury.redaction_jury(tables.prompts(spark, sf_dir))
    wrong_sum = " OR ".join(f"score_{t} <> {t}_id + {t}_phone + {t}_email" for t in "abc")
    best = "CASE winning_tool WHEN 'A' THEN score_a WHEN 'B' THEN score_b ELSE score_c END"
    assert judged.filter(wrong_sum).count() == 0
    assert judged.filter(f"{best} <> greatest(score_a, score_b, score_c)").count() == 0
    assert judged.filter((jury.winner_score() > 0) != ~F.col("sanitized").eqNullSafe(F.col("prompt"))).count() == 0


def test_long_runs_stay_linear(spark):
    texts = ["a." * 150_000 + "@", "a" * 300_000, "-" * 300_000 + "@", "1-" * 100_000, "a@" * 100_000, ".%" * 100_000 + "@x"]
    started = time.time()
    rows = jury.redaction_jury(_frame(spark, texts), "text").select("n", "score_a", "score_c").orderBy("n").collect()
    assert time.time() - started < 30
    assert [(r.score_a, r.score_c) for r in rows] == [(0, 0)] * len(texts)


def test_a_fourth_detector_is_only_data(spark):
    plate = PatternDetector("D", (PatternRule("plate", "id", r"\b[A-Z]{3}\s?\d{4}\b", "[REDACTED_PLATE]"),))
    out = jury.redaction_jury(_frame(spark, ["Car WXY 1234 and ABC9876", "ali"]), "text", (*DETECTORS, plate))
    first, second = out.orderBy("n").collect()
    assert (first.winning_tool, first.sanitized, first.d_id) == ("D", "Car [REDACTED_PLATE] and [REDACTED_PLATE]", 2)
    assert (second.winning_tool, second.sanitized) == ("B", "[REDACTED_NAME]")


def test_overlapping_word_lists_are_counted_one_after_the_other(spark):
    lists = DictionaryDetector(
        "B",
        (WordList("name", "id", ("jaya",), "[N]"), WordList("location", "phone", ("petaling jaya", "kl"), "[L]")),
    )
    assert DICTIONARY.independent and not lists.independent
    row = jury.detector_output(_frame(spark, ["Petaling Jaya and KL"]), lists, "text").first()
    assert (row.redacted, row.count_id, row.count_phone) == ("Petaling [N] and [L]", 1, 1)
    found = jury.findings(_frame(spark, ["Petaling Jaya and KL"]), ["n"], "text", [lists]).collect()
    assert [(r.kind, r["match"]) for r in found] == [("name", "Jaya"), ("location", "KL")]


def test_pattern_translation_rejects_what_it_cannot_do():
    with pytest.raises(ValueError):
        patterns.spark_regex(r"\Bx")
    with pytest.raises(ValueError):
        patterns.term_regex(["-dash"])
    assert patterns.literal_replacement("$1\\") == "\\$1\\\\"
    assert all(rule.slot in ("id", "phone", "email") for rule in STRICT_RULES)


def test_weights_and_consensus(spark):
    frame = _frame(spark, ["ID 850315-01-1234", "ID 123456-12-5678", "ali in kl"])
    weighted = jury.redaction_jury(frame, "text", weights={"C": {"id": 5}}).orderBy("n").collect()
    assert [r.winning_tool for r in weighted] == ["C", "C", "B"]
    votes = jury.consensus(frame, "text").orderBy("n").collect()
    assert [(r.votes_id, r.agreed_id) for r in votes] == [(2, True), (1, False), (0, False)]
    assert (votes[2].votes_name, votes[2].votes_location, votes[2].agreed_name) == (1, 1, False)


def test_texts_without_listed_words_are_told_by_one_scan(spark):
    """The fast scan and the one for hits agree, for odd letters and gaps and for very long texts."""
    terms = [["ali", "kl", "İsa", "o'neil's bar"], ["Kuala Lumpur", "ski", "köln", "s_1"]]
    made = ["", " ", "ali", "Ali.", "alias", "xali", "_kl", "kl", "Kl", "sKI", "ſki", "İsa", "isa", "ALİ", "alı", "KÖLN", "o'neil's bars", "o'neil's bar",
            "O'NEIL", "kuala  lumpur", "kuala\nlumpur", "in kuala lumpur", "\U0001d400li ali\U0001d400", "\U0001f600ali", "é-s_1", "éali", "x\nali\n", "alı ski\n", None, "word " * 200_000, "word " * 200_000 + "kl", "w" * 1_000_000]
    df = spark.createDataFrame([(text,) for text in made], "body string")
    hits = F.col("body").rlike(patterns.whole_words(*terms))
    rows = df.select("body", hits.alias("hits"), F.col("body").rlike(patterns.without_terms(*terms)).alias("free")).collect()
    assert [r.body[:20] for r in rows if r.body is not None and r.hits == r.free] == []
    assert {r.hits for r in rows} == {True, False, None} and sum(bool(r.hits) for r in rows) > 10


def test_word_lists_are_scanned_for_hits_only_where_there_are_some(spark, sf_dir):
    united = jury.jury_union(spark.createDataFrame([("no such word",)], "prompt string"))
    plan = united._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\A[^") == 1
