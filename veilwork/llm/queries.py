"""The queries of this package: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import (
    bpe,
    collocations,
    exact_index,
    fill_middle,
    line_templates,
    mixing,
    near_duplicates,
    pseudonyms,
    quality,
    secret_scan,
    sharding,
    toxicity,
    warc,
)
from veilwork.llm.work import fresh_path, reachable

_QUERIES = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return function(spark, sf_dir)

    _QUERIES[function.__name__] = run
    return run


def queries():
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    tokenizer = bpe.Tokenizer(spark, _vocabulary())
    return tokenizer.encode(docs.select("doc_id", "text"), "text", decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op2_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return model.score(docs).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op3_mixing(spark, sf_dir):
    return mixing.allocate(_table(spark, sf_dir, "documents"))


@query
def op7_near_duplicates(spark, sf_dir):
    return near_duplicates.groups(_table(spark, sf_dir, "documents"), percent=85)


@query
def op8_quality_rules(spark, sf_dir):
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


@query
def op4_secrets(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda span: span.getField("kind"))
    counts = [
        F.size(F.filter(kinds, lambda kind: kind == k)).cast("long").alias(f"n_{form[0]}")  # noqa: B023
        for k, form in enumerate(secret_scan.FORMS)
    ]
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


# The key of these checks only; a deployment brings its own.
_CHECK_KEY = "key of the checks"


@query
def op5_pseudonyms(spark, sf_dir):
    done = pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), _CHECK_KEY)
    return done.select(F.col("row.doc_id").alias("doc_id"), *[f"n_{kind}" for kind in pseudonyms.KINDS], "text")


@query
def op6_warc(spark, sf_dir):
    path = fresh_path(spark, "archive")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query
def op9_line_templates(spark, sf_dir):
    done = line_templates.drop_recurring(_table(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


@query
def op10_exact_index(spark, sf_dir):
    return exact_index.groups(_table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark, sf_dir):
    return collocations.mine(_table(spark, sf_dir, "documents"))


@query
def op12_fill_middle(spark, sf_dir):
    cut = fill_middle.transform(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    output = F.col("output")
    return cut.select(
        F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(output, F.col("form")), 256).alias("restored_sha256"),
    )


@query
def op13_hash_tree(spark, sf_dir):
    return sharding.placements(_table(spark, sf_dir, "documents"))
