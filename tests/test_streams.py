import pytest
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.operators import events, gate, integrity
from veilwork.plans import requests as flows
from veilwork.session import fresh_path
from veilwork.sources import audit_table
from veilwork.streaming import jobs
from verification import seeds, tables

KEPT = ["prompt_id", "code", "sanitized", "winning_tool", "score_a", "score_b", "score_c"]


def _same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The events table as six files that arrive in another order than that of time."""
    folder = fresh_path(spark, "event-parts")
    source = tables.table(spark, sf_dir, "events")
    for start in (20, 0, 25, 10, 5, 15):
        days = F.dayofmonth("ts") - 1
        source.filter((days >= start) & (days < start + 5)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _stream(spark, folder, per_batch=None):
    reader = spark.readStream.schema(tables.EVENTS_SCHEMA)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def test_sanitize_and_gate_equal_batch(spark, parts):
    for seed, work in (
        ("prompts", lambda df: flows.sanitize(df).select(*KEPT)),
        ("lines", lambda df: gate.generate_gate(tables.derived(spark, seeds.GATE_LINES, prompts=df)).select("line_id", "reason", "code")),
    ):
        live = work(tables.derived(spark, seeds.PROMPTS, events=_stream(spark, parts, 2)))
        batch = work(tables.derived(spark, seeds.PROMPTS, events=spark.read.parquet(parts)))
        assert _same(jobs.run_once(spark, live, f"test-{seed}"), batch)


def test_no_first_occurrence_is_dropped(spark, parts):
    live = jobs.deduplicated(tables.with_copies(tables.derived(spark, seeds.AUDIT_SEED, events=_stream(spark, parts, 1))))
    out = jobs.run_once(spark, live, "test-dedup")
    batch = events.deduplicate(tables.with_copies(tables.derived(spark, seeds.AUDIT_SEED, events=spark.read.parquet(parts))))
    assert _same(out, batch)


def test_windows_equal_batch_and_the_last_ones_are_there(spark, parts):
    live = tables.derived(spark, seeds.AUDIT_SEED, events=_stream(spark, parts, 1))
    seed = tables.derived(spark, seeds.AUDIT_SEED, events=spark.read.parquet(parts))
    counted = jobs.counted_once(spark, jobs.counts_per_step(live), "test-rolling")
    assert _same(counted, jobs.counts_per_step(seed))
    rolled = jobs.rolled(counted)
    kept = seed.filter(F.col("event_type").isin(fv.DENIED, fv.REDACTED))
    last = rolled.agg(F.max("window_start")).first()[0]
    assert last == kept.agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz")).first()[0]
    redacted = F.col("event_type") == fv.REDACTED
    total = lambda name: F.sum(F.when(redacted, F.col(name)).otherwise(0).cast("bigint"))
    direct = kept.groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(
        F.count_if(~redacted).alias("blocked"), total("count_id").alias("malaysian_ic"), total("count_email").alias("emails"))
    assert _same(rolled, direct.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "blocked", "malaysian_ic", "emails"))
    intents = jobs.counted_once(spark, jobs.intents_per_window(live), "test-intents")
    assert intents.count() > 0 and _same(intents, jobs.intents_per_window(seed))


def test_events_of_the_missing_hour_keep_their_window(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = ["2024-03-10 02:30:00", "2024-03-10 03:30:00"]
        rows = spark.createDataFrame([(t, fv.DENIED, 0, 0) for t in times], "t string, event_type string, count_id int, count_email int")
        steps = jobs.counts_per_step(rows.withColumn("ts", F.col("t").cast("timestamp_ntz"))).collect()
        assert sorted(str(r.step_start) for r in steps) == ["2024-03-10 02:00:00", "2024-03-10 03:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_restart_continues_without_repeats(spark, sf_dir):
    folder, out = fresh_path(spark, "restart-in"), fresh_path(spark, "restart-out")
    source = tables.table(spark, sf_dir, "events")
    for rest in (0, 1):
        source.filter(F.col("event_id") % 2 == rest).write.mode("append").parquet(folder)
        live = flows.sanitize(tables.derived(spark, seeds.PROMPTS, events=_stream(spark, folder))).select(*KEPT)
        jobs.append_to_files(live, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    written = spark.read.parquet(f"{out}/rows")
    assert written.count() == source.count() == written.select("prompt_id").distinct().count()


def test_live_audit_rows_are_signed_and_stored(spark, parts):
    live = tables.derived(spark, seeds.PROMPTS, events=_stream(spark, parts, 2))
    live = live.withColumn("request_id", F.concat(F.lit("req-"), F.col("prompt_id").cast("string")))
    signed = integrity.sign(flows.sanitize_audit(flows.sanitize(live)), tables.keys(spark), "k1")
    folder = fresh_path(spark, "live-audit")
    jobs.append_audit_events(signed, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    stored = audit_table.read_events(spark, f"{folder}/rows")
    assert stored.count() > 0
    assert integrity.integrity_rollup(integrity.verify(stored, tables.keys(spark))).first().integrity_ok
    batch = tables.derived(spark, seeds.PROMPTS, events=spark.read.parquet(parts))
    assert stored.count() == flows.sanitize(batch).filter("code = 200 AND sanitized <> prompt").count()
