"""Word lists read from tables: the same hits as lists compiled into an expression."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.operators import dictionaries, jury, term_chunks
from veilwork.operators.detectors import DICTIONARY, LOOSE, STRICT, DictionaryDetector, WordList
from veilwork.operators.vector_detectors import VectorRule
from veilwork.sources.reference_data import term_table
from verification import tables

TERMS = {
    "city": ["New York", "new york city", "York", "la", "Köln", "o'neil's bar", "x-1", "a  b"],
    "name": ["York", "ali", "Ali Baba", "BABA", "o'neil", "ÉMILE", "s_1", "1"],
}


def rows_of(terms):
    return [(kind, term) for kind, listed in terms.items() for term in listed]


def plain_hits(text, listed):
    pattern = "|".join(re.escape(t) for t in sorted(listed, key=len, reverse=True))
    return [m.span() for m in re.finditer(rf"(?i)(?<!\w)(?:{pattern})(?!\w)", text or "")]


def texts(count, seed):
    rng = random.Random(seed)
    parts = ["new", "New", "YORK", "york", "city", "la", "köln", "KÖLN", "o'neil", "O'Neil's", "bar", "x", "1", "-", "a", "b", "Ali", "baba", "émile", "s_1", "é"]
    gaps = [" ", " ", " ", "  ", "-", ", ", "", "\n", "'"]
    made = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(20))) for _ in range(count)]
    return made + [None, "", " ", "new york city", "New York City hall, new york", "ali " * 5000]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_hits_equal_plain_search_broadcast_or_shuffled(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = list(enumerate(texts(300, 1)))
        df = spark.createDataFrame(rows, "n int, body string").repartition(3)
        more = [("city", None), (None, "ali"), ("city", "NEW YORK"), ("rare", "no such words here at all")]
        terms = dictionaries.stored_terms(term_table(spark, rows_of(TERMS) + more))
        assert terms.longest == 6 and terms.table.count() == len(rows_of(TERMS)) + 1
        found = dictionaries.term_hits(df, ["n"], "body", terms)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold != "-1")
        hits = {(r.n, r.kind): [(h.start, h.end) for h in r.hits] for r in found.collect()}
        expected = {(n, kind): plain_hits(text, listed) for n, text in rows for kind, listed in TERMS.items()}
        assert hits == {k: v for k, v in expected.items() if v}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jury_with_a_table_equals_the_jury_with_lists(spark, sf_dir):
    lists = dictionaries.TableDictionary("B", tuple(VectorRule(w.kind, w.slot, w.mask) for w in DICTIONARY.lists))
    terms = dictionaries.stored_terms(term_table(spark, rows_of({"name": fv.NAMES, "location": fv.LOCATIONS})))
    made = ["Ahmad of Kuala Lumpur", "kl, KLANG and klangs", None, "", "petaling  jaya, Petaling Jaya", "Ali@ex.com Siti"] * 40
    df = spark.createDataFrame(list(enumerate(made)), "k int, prompt string")
    placed = dictionaries.with_term_places(df, ["k"], "prompt", terms, lists)
    tabled = jury.redaction_jury(placed, detectors=[STRICT, lists, LOOSE])
    listed = jury.redaction_jury(df)
    assert sorted(map(str, tabled.select(*listed.columns).collect())) == sorted(map(str, listed.collect()))
    found = jury.findings(placed, ["k"], detectors=[lists])
    assert sorted(map(str, found.collect())) == sorted(map(str, jury.findings(df, ["k"], detectors=[DICTIONARY]).collect()))
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = dictionaries.term_counts(documents, ["doc_id"], "text", terms).groupBy("kind").agg(F.sum("n").alias("n"))
    by_lists = jury.detector_output(documents, DICTIONARY, "text").agg(F.sum("count_id").alias("name"), F.sum("count_phone").alias("location")).first()
    assert {r.kind: r.n for r in counted.collect()} == {k: v for k, v in by_lists.asDict().items() if v}


def test_a_hundred_thousand_terms(spark, sf_dir):
    """Far more terms than an expression can hold; of them, the words of the documents are found as by an expression."""
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = [r.w for r in documents.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).filter("length(w) > 5").groupBy("w").count().orderBy("w").limit(40).collect()]
    many = spark.range(100_000).select(F.lit("many").alias("kind"), F.concat(F.lit("zq "), F.col("id").cast("string")).alias("term"))
    some = spark.createDataFrame([("many", w) for w in words], "kind string, term string")
    terms = dictionaries.stored_terms(many.unionByName(some))
    assert terms.table.count() == 100_040
    counted = dictionaries.term_counts(documents, ["doc_id"], "text", terms)
    compiled = DictionaryDetector("L", (WordList("many", "id", tuple(words), "[M]"),))
    by_list = jury.detector_output(documents, compiled, "text").filter("count_id > 0")
    assert {r.doc_id: r.n for r in counted.collect()} == {r.doc_id: r.count_id for r in by_list.collect()}


def test_terms_in_two_kinds_are_masked_once(spark):
    lists = dictionaries.TableDictionary("T", (VectorRule("name", "id", "[N]"), VectorRule("city", "phone", "[C]")))
    terms = dictionaries.stored_terms(term_table(spark, rows_of(TERMS)))
    df = spark.createDataFrame([(1, "York and new york city"), (1, None), (None, "ali")], "k int, prompt string")
    rows = jury.redaction_jury(dictionaries.with_term_places(df, ["k"], "prompt", terms, lists), detectors=[lists]).collect()
    assert sorted((str(r.prompt), str(r.sanitized), r.t_id, r.t_phone) for r in rows if r.prompt != None) == [  # noqa: E711
        ("York and new york city", "[N] and [C]", 2, 2), ("ali", "[N]", 1, 0),
    ]


def test_odd_lists(spark):
    df = spark.createDataFrame([(1, "a b")], "k int, prompt string")
    none = dictionaries.stored_terms(term_table(spark, []))
    assert none.longest == 0 and dictionaries.term_counts(df, ["k"], "prompt", none).count() == 0
    with pytest.raises(ValueError, match="word character"):
        dictionaries.stored_terms(term_table(spark, [("x", "ends with a dash-")]))
    empty = spark.createDataFrame([], "k int, prompt string")
    assert dictionaries.term_counts(empty, ["k"], "prompt", dictionaries.stored_terms(term_table(spark, [("x", "a")]))).count() == 0


def test_a_long_list_is_met_without_moving_windows(spark, monkeypatch):
    """Chunks find what the broadcast list finds, for odd letters, equal and null keys too; only texts and packed fingerprints move."""
    monkeypatch.setattr(term_chunks, "CHUNK_BYTES", 400)
    odd = ["ΟΔΟΣ ΟΔΟΣ'α οδος", "İstanbul la İ", "Σ Σ1 \U0001f600 ali", "Ɤ ali ɤ", "ΑΣ York", "Ünal ünal ÜNAL"]
    rows = [*enumerate([*texts(120, 3), *odd]), (5, "ali new york"), (5, "ali new york"), (None, "la york"), (None, "york ali baba")]
    listed = [*rows_of(TERMS), ("odd", "ΟΔΟΣ"), ("odd", "οδος'α"), ("odd", "İstanbul"), ("odd", "i"), ("odd", "Σ1"), ("odd", "ας york"), ("odd", "ɤ"), ("odd", "ünal Ünal")]
    df = spark.createDataFrame(rows, "n int, body string").select("n", F.lit("x").alias("a b"), "body")
    terms = dictionaries.stored_terms(term_table(spark, listed))
    found = {}
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            hits = dictionaries.term_hits(df, ["n", "a b"], "body", terms)
            plan = hits._jdf.queryExecution().executedPlan().toString()
            found[threshold] = sorted(map(str, hits.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found["-1"] == found["10485760"] and any("odd" in row for row in found["-1"])
    assert "_salt" not in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_fingerprints_that_clash_make_no_hits():
    asked = pa.table({"chunk": pa.array([3], pa.int32()), "prints": [np.array([7, 9], np.uint32).tobytes()]})
    terms = pa.table({"print": pa.array([9, 9, 8]), "kind": ["a", "b", "a"], "window": ["la", "york", "x"]})
    answers = term_chunks._answered(asked, terms)
    assert answers.to_pylist() == [{"chunk": 3, "kind": "a", "window": "la"}, {"chunk": 3, "kind": "b", "window": "york"}]
    rows = pa.table({"k": ["r"], "size": [4], "words": [["york"]], "gaps": [["", ""]], "given": pa.array([None], pa.list_(pa.string()))})
    hits = term_chunks._looked_up(1, ["k"])(rows, answers)
    assert hits.to_pylist() == [{"k": "r", "kind": "b", "hits": [{"token": 0, "tokens": 1, "start": 0, "end": 4}]}]
