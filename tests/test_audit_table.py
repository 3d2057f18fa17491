"""The stored audit table: newest partitions, one reading for the report, compaction."""

import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.operators import integrity, reports
from veilwork.plans import audit_report
from veilwork.session import fresh_path
from veilwork.sources import audit_table
from veilwork.streaming import jobs
from verification import seeds, tables


def _same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def _events(spark, rows):
    """Audit rows of (id, ts)."""
    frame = spark.createDataFrame(rows, "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    seed = tables.audit_seed(spark, "/root/testdata/sf0.001").drop("id", "ts").limit(1)
    return integrity.sign(frame.join(F.broadcast(seed)), tables.keys(spark), "k1")


def _files(path):
    """Data files per date, of those that are read."""
    found = {}
    for file in path:
        date = re.search(r"event_date=([^/]+)/", file)[1]
        found[date] = found.get(date, 0) + 1
    return found


def test_recent_events_read_the_last_partitions_only(spark):
    rows = [(k, f"2024-02-{1 + k // 30:02d} 12:00:{k % 30:02d}") for k in range(600)]
    # Twenty equal times on both sides of a midnight.
    rows += [(1000 + k, "2024-02-19 23:59:59") for k in range(20)] + [(2000 + k, "2024-02-20 00:00:00") for k in range(20)]
    path = fresh_path(spark, "recent")
    audit_table.append_events(_events(spark, rows), path)
    for n in (1, 20, 60, 75, 90, 100, 300, 640, 1000):
        newest = audit_table.read_newest(spark, path, n)
        got = [(r.id, str(r.ts)) for r in reports.recent_events(newest, n).collect()]
        assert got == sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:n]
    plan = reports.recent_events(audit_table.read_newest(spark, path, 100))._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    # The last two days hold 50 rows each.
    assert re.search(r"event_date#\d+ >= 2024-02-19", filters)


def test_recent_events_of_small_tables_and_rows_without_a_time(spark):
    path = fresh_path(spark, "recent-odd")
    audit_table.append_events(_events(spark, [(1, "2024-02-01 00:00:00"), (2, None), (3, None)]), path)
    assert audit_table.stored_dates(spark, path) == ["2024-02-01"]
    assert [r.id for r in reports.recent_events(audit_table.read_newest(spark, path, 100)).collect()] == [1, 3, 2]
    only = fresh_path(spark, "recent-no-time")
    audit_table.append_events(_events(spark, [(2, None)]), only)
    assert audit_table.read_newest(spark, only, 5).count() == 1


def _scans(df):
    """File scans in the executed plan; a reused exchange counts nothing."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"Scan parquet", final)), final


def test_the_report_reads_the_table_once(spark, sf_dir):
    path = fresh_path(spark, "report")
    audit_table.append_events(tables.tampered(spark, sf_dir), path)
    stored = audit_table.read_events(spark, path)
    report = audit_report.audit_report(stored, tables.keys(spark), tables.AS_OF, hours=240)
    scans, plan = _scans(report)
    assert scans == 1, plan
    assert "ReusedExchange" in plan
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)
    summary = reports.audit_summary(stored, tables.AS_OF, 240)
    section = integrity.integrity_section(integrity.verify(stored, tables.keys(spark)))
    assert _same(report, summary.unionByName(section))


def test_the_report_of_empty_clean_and_repeated_rows(spark, sf_dir):
    signed = tables.signed(spark, sf_dir)
    told = lambda df, **more: sorted(tuple(r) for r in audit_report.audit_report(df, tables.keys(spark), tables.AS_OF, **more).collect())
    nothing = [("blocked", "total_blocked", 0), ("integrity", "ok", 1), ("integrity", "tampered_rows", 0),
               ("pii_redacted", "emails", 0), ("pii_redacted", "malaysian_ic", 0)]
    assert told(signed.limit(0)) == nothing
    assert ("integrity", "ok", 1) in told(signed)
    bad = signed.withColumn("signature", F.lit(None).cast("string")).filter("id < 3")
    thrice = bad.unionByName(bad).unionByName(bad)
    expected = [("tampered_id", str(i), 1) for i in sorted([0, 1, 2] * 3)]
    assert [r for r in told(thrice) if r[0] == "tampered_id"] == expected
    assert [r for r in told(thrice, shown=4) if r[0] == "tampered_id"] == expected[:4]
    with_jury = told(signed, hours=10_000, event_types=(fv.REDACTED, fv.JURY_REDACTED))
    assert dict((r[1], r[2]) for r in with_jury)["emails"] > dict((r[1], r[2]) for r in told(signed, hours=10_000))["emails"]


def _appended(spark, sf_dir, path, parts):
    signed = tables.signed(spark, sf_dir).filter(F.dayofmonth("ts") < 4)
    for part in parts:
        audit_table.append_events(signed.filter(F.pmod(F.xxhash64("id"), F.lit(8)) == part), path)
    return signed


def test_compaction_keeps_rows_and_running_readers(spark, sf_dir):
    path = fresh_path(spark, "compact")
    signed = _appended(spark, sf_dir, path, range(6))
    begun = audit_table.read_events(spark, path)
    before = begun.count()
    many = _files(begun.inputFiles())
    assert audit_table.compact(spark, path) == sum(many.values())
    now = audit_table.read_events(spark, path)
    few = _files(f for f in now.inputFiles() if "_compacted" in f)
    assert set(few) == set(many) and all(few[d] < many[d] for d in few)
    assert _same(now, begun) and now.count() == before  # the reader that began before, and the new one
    assert audit_table.compact(spark, path) == 0
    # New files are read beside the version, and compacted with it.
    _appended(spark, sf_dir, path, range(6, 8))
    whole = signed.withColumn("event_date", F.to_date("ts"))
    columns = now.columns
    assert _same(audit_table.read_events(spark, path), whole.select(*columns))
    held = audit_table.read_events(spark, path)
    assert audit_table.compact(spark, path, few_files=1) > 0
    assert _same(audit_table.read_events(spark, path), whole.select(*columns))
    assert held.filter("id >= 0").count() == whole.count()  # versions of the manifest before are still there
    root = path.removeprefix("file://")
    left = [f for f in os.listdir(f"{root}/event_date=2024-01-01") if f.endswith(".parquet")]
    assert len(left) == 2  # what the first compaction had replaced is gone, the two newer files wait
    _appended(spark, sf_dir, path, [0])
    _appended(spark, sf_dir, path, [1])
    assert audit_table.compact(spark, path, few_files=1) > 0
    assert not os.path.exists(f"{root}/_compacted/version=0/event_date=2024-01-01")
    assert audit_table.read_events(spark, path).count() == whole.count() + signed.filter("pmod(xxhash64(id), 8) < 2").count()


def test_compacted_tables_are_still_pruned_by_date(spark, sf_dir):
    path = fresh_path(spark, "compact-pruned")
    _appended(spark, sf_dir, path, range(6))
    audit_table.compact(spark, path)
    since = audit_table.read_events(spark, path, since=datetime(2024, 1, 3))
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*event_date#\d+ >= 2024-01-03", plan)) == 2
    assert since.count() == audit_table.read_events(spark, path).filter("event_date >= DATE '2024-01-03'").count()
    newest = audit_table.read_newest(spark, path, 10)
    assert [r.id for r in reports.recent_events(newest, 10).collect()] == [
        r.id for r in reports.recent_events(audit_table.read_events(spark, path), 10).collect()
    ]


def test_files_of_a_stream_are_compacted_and_kept(spark, sf_dir):
    folder = fresh_path(spark, "compact-stream")
    source = fresh_path(spark, "compact-source")
    tables.table(spark, sf_dir, "events").filter("day(ts) < 3").repartition(6).write.parquet(source)
    live = spark.readStream.schema(tables.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    signed = tables.sign_rotated(spark, tables.derived(spark, seeds.AUDIT_SEED, events=live))
    jobs.append_audit_events(signed, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    path = f"{folder}/rows"
    before = audit_table.read_events(spark, path).collect()
    assert audit_table.compact(spark, path) > 0
    assert sorted(map(str, audit_table.read_events(spark, path).collect())) == sorted(map(str, before))
    assert audit_table.compact(spark, path) == 0
    assert spark.read.parquet(path).count() == len(before)  # the sink's own files are all there


def test_a_version_that_lost_rows_is_not_published(spark, sf_dir, monkeypatch):
    path = fresh_path(spark, "compact-lost")
    _appended(spark, sf_dir, path, range(6))
    before = audit_table.read_events(spark, path).count()
    calls = []
    original = type(spark.range(0)).count

    def counting(self):
        calls.append(1)
        return original(self) - (len(calls) == 1)

    monkeypatch.setattr(type(spark.range(0)), "count", counting)
    with pytest.raises(ValueError, match="another number of rows"):
        audit_table.compact(spark, path)
    monkeypatch.undo()
    assert audit_table.read_events(spark, path).count() == before
