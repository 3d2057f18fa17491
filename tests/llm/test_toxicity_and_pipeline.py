import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import clashing, documents, near_groups, words
from veilwork.llm import queries, toxicity
from veilwork.llm.work import written


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    found = written(queries.queries()["op2_toxicity"](spark, folder), "test-scores")
    return found, spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_rows_are_predicted(scored):
    found, labels = scored
    rows = found.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = Counter((r.toxic, r.predicted) for r in rows if r.held_out)
    assert unseen[1, 1] / max(1, unseen[1, 0] + unseen[1, 1]) >= 0.7
    assert unseen[0, 1] / max(1, unseen[0, 0] + unseen[0, 1]) <= 0.03


def test_odd_texts_are_scored(spark):
    model = toxicity.Model(["idiot", "lowei*"], None, None)
    docs = clashing(documents(spark, [(None, None), (1, ""), (1, ""), (2, "x" * 50_000)]))
    rows = model.score(docs).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.0}
    assert model.score(docs.limit(0)).count() == 0


def test_features(spark):
    texts = ["You idiot, you!", "The idiots met at idiotville", "Such 1d10t talk", "loweiheit da", "", "WHAT? NO!"]
    rows = toxicity.with_features(documents(spark, list(enumerate(texts))).select("doc_id", "text"), "text", ["idiot", "lowei*"]).collect()
    rates = {r.doc_id: dict(zip(toxicity.FEATURES, r.rates, strict=True)) for r in rows}
    assert rates[0]["lexicon_words"] == 1 and rates[0]["nearness"] == 1 and rates[0]["exclamations"] == pytest.approx(1 / 3)
    assert rates[1]["lexicon_words"] == 0
    assert rates[2]["obfuscation"] > 0 and rates[2]["obfuscated_lexicon"] > 0
    assert rates[3]["lexicon_words"] == 1 and set(rates[4].values()) == {0.0}
    assert rates[5]["capitals"] == 1 and rates[5]["questions"] == 0.5


def test_spaced_words_are_undone_without_a_full_stop(spark):
    texts = ["such an i-d-i-o-t", "such an i_d_i_o_t", "such an i~d~i~o~t", "such an i.d.i.o.t"]
    rows = toxicity.with_features(documents(spark, list(enumerate(texts))).select("doc_id", "text"), "text", ["idiot"]).collect()
    assert all(r.rates[toxicity.FEATURES.index("obfuscated_lexicon")] > 0 for r in rows)


def test_without_two_kinds_of_labels_all_scores_are_0(spark):
    docs = documents(spark, [(i, "the cat") for i in range(30)])
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    clean = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    for labels in (none, clean, clean.limit(0)):
        assert toxicity.fit(docs, labels).trees is None


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The result of every stage over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(written(stage(spark, results[-1], sf_dir), "test-stage"))
    return results


def test_stages_keep_the_columns(stages):
    for result in stages[1:-1]:
        assert result.dtypes == stages[0].dtypes


def test_each_stage_against_plain_python(spark, sf_dir, stages):
    docs, passed, cut, single, mixed, coded = stages
    kept = {r.doc_id for r in queries.queries()["op8_quality_rules"](spark, sf_dir).collect() if r.kept}
    assert {r.doc_id for r in passed.collect()} == kept
    before = {r.doc_id: r for r in passed.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        lines = iter(before[i].text.split("\n"))
        assert r.text == "" or all(line in lines for line in r.text.split("\n"))  # lines only go
        assert r.n_chars == len(r.text)
    groups = near_groups([(i, r.text) for i, r in after.items()], corpus_pipeline.NEAR)
    assert sorted(r.doc_id for r in single.collect()) == sorted({g for g in groups.values()})
    sizes = {r.doc_id: len(words(r.text)) for r in single.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= set(sizes)
    total = sum(sizes.values())
    assert abs(sum(sizes[i] * n for i, n in times.items()) - total) <= 0.1 * total
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    found = coded.collect()
    assert Counter(r.doc_id for r in found) == times
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in found)


def test_run_is_the_stages(spark, sf_dir, stages):
    result = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.n_tokens) for r in result.collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1].collect())


def test_odd_rows_pass_through_all_stages(spark, sf_dir):
    good = "the cat and the dog went to the house by the sea and it was {} as before and so on"
    rows = [(None, None, None), (1, "", "a"), (2, good.format("red"), None), (2, good.format("red"), None), (3, good.format("x " * 3000), "b")]
    docs = clashing(documents(spark, rows))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test-odd")
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {2, 3}
    empty = documents(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.agg(F.count("*")).first()[0] == 0
