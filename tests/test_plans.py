"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from veilwork.operators import integrity, jury, policy, reports
from veilwork.operators.detectors import STRICT
from verification import catalogue, tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = [
    "redaction_jury", "sanitize_end_to_end", "verify_disposition", "generate_gate", "jury_events", "denied_events",
    "corpus_jury", "corpus_findings", "pii_findings", "jury_vector_detector", "jury_union", "pii_finding_spans", "audit_signed", "tampered_ids", "verified_export", "event_log_json",
]


@pytest.mark.parametrize("name", NARROW)
def test_row_work_is_not_shuffled(spark, sf_dir, name):
    plan = _plan(catalogue.queries()[name](spark, sf_dir))
    assert not re.search(r"Exchange (?!.*Broadcast)(hash|range|Round|Single)", plan)


# Detectors that are functions over Arrow batches; see test_spans_and_vectors.
VECTORS = ["jury_vector_detector", "vector_findings"]


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if not n.startswith("stream_") and n not in VECTORS])
def test_no_python_and_no_cross_joins(spark, sf_dir, name):
    plan = _plan(catalogue.queries()[name](spark, sf_dir))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_filters_do_not_repeat_the_patterns(spark, sf_dir):
    judged = jury.redaction_jury(tables.prompts(spark, sf_dir))
    whole = _plan(judged).count("regexp_extract_all")
    filtered = _plan(judged.filter((jury.winner_score() > 0) & (F.col("winning_tool") == "B")))
    assert filtered.count("regexp_extract_all") <= whole
    decided = _plan(policy.authorized(tables.prompts(spark, sf_dir)))
    assert decided.count("Contains(") <= 21


def test_winner_report_does_not_mask(spark, sf_dir):
    plan = _plan(reports.tool_win_rate(jury.redaction_jury(tables.prompts(spark, sf_dir))))
    assert "regexp_replace" not in plan


def test_scans_read_only_what_is_needed(spark, sf_dir):
    documents = tables.table(spark, sf_dir, "documents")
    plan = _plan(jury.redaction_jury(documents, "text").select("doc_id", "winning_tool"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    requests = documents.select(F.col("source").alias("role"), F.col("text").alias("prompt"))
    assert "regexp" not in _plan(policy.sanitize_disposition(requests))


def test_generated_methods_can_be_compiled_by_the_jit(spark, sf_dir):
    # HotSpot leaves methods over 8000 bytes of bytecode interpreted.
    debug = spark._jvm.org.apache.spark.sql.execution.debug
    package = getattr(getattr(debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("redaction_jury", "sanitize_end_to_end", "jury_events", "generate_gate", "gate_denied_events", "tampered_ids", "corpus_jury", "authorized_prompts", "policy_matrix"):
            stages = package.codegenStringSeq(catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan())
            for i in range(stages.size()):
                size = int(re.search(r"ByteCodeStats\((-?\d+)", str(stages.apply(i)._3().toString())).group(1))
                assert 0 < size < 8000, (name, size)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_integrity_joins_only_the_keyring(spark, sf_dir):
    plan = _plan(integrity.integrity_rollup(tables.checked(spark, sf_dir)))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["recent_events_100", "audit_log_view", "reliability_view"])
def test_top_rows_are_taken_from_stored_signatures(spark, sf_dir, name):
    plan = _plan(catalogue.queries()[name](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan and "sha2(" not in plan


def test_the_report_of_a_day_reads_its_partitions(spark, sf_dir):
    plan = _plan(catalogue.queries()["audit_summary_stored"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_dedup_reduces_before_the_shuffle(spark, sf_dir):
    plan = _plan(catalogue.queries()["audit_dedup"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2 and "SortAggregate" not in plan


def test_nothing_in_the_library_falls_back_to_local_folders():
    import pathlib

    import veilwork

    root = pathlib.Path(veilwork.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            text = file.read_text()
            assert "mkdtemp" not in text and ".rdd" not in text, file


def test_one_tool_runs_only_its_own_patterns(spark, sf_dir):
    prompts = tables.prompts(spark, sf_dir)
    whole = _plan(jury.scores_only(prompts)).count("regexp_extract_all")
    strict = _plan(jury.scores_only(prompts, detectors=[STRICT]).select("score_a"))
    assert "ahmad" not in strict and strict.count("regexp_extract_all") < whole
