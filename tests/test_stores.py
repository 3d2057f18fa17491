"""Outputs of streams that are stored batch by batch: the same as batch results, after failures too."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from veilwork.operators import events, gate, integrity
from veilwork.session import fresh_path
from veilwork.sources.files import Files, Manifests
from veilwork.streaming import jobs, stores
from verification import seeds, tables

NIGHT = "2024-01-03 00:00:00"


def _same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The events table as five files that arrive in another order than that of time."""
    folder = fresh_path(spark, "store-parts")
    source = tables.table(spark, sf_dir, "events")
    for start in (18, 0, 24, 6, 12):
        days = F.dayofmonth("ts") - 1
        source.filter((days >= start) & (days < start + 6)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _stream(spark, folder, sql, **views):
    reader = spark.readStream.schema(tables.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1)
    live = tables.derived(spark, seeds.PROMPTS if sql is seeds.GATE_LINES else seeds.AUDIT_SEED, events=reader.parquet(folder))
    return tables.derived(spark, sql, prompts=live) if sql is seeds.GATE_LINES else live


def _gate_lines(spark, folder):
    prompts = tables.derived(spark, seeds.PROMPTS, events=spark.read.parquet(folder))
    return tables.derived(spark, seeds.GATE_LINES, prompts=prompts)


class Broken(Exception):
    pass


def _fail_once(monkeypatch, owner, name, when):
    """Let ``owner.name`` raise the first time ``when`` holds for its arguments, after it has done its work."""
    real, done = getattr(owner, name), []

    def broken(*args, **named):
        result = real(*args, **named)
        if not done and when(*args):
            done.append(1)
            raise Broken("stopped in the middle of a batch")
        return result

    monkeypatch.setattr(owner, name, broken)
    return done


def test_gate_outputs_equal_batch_after_a_stop_in_the_middle_of_a_batch(spark, parts, monkeypatch):
    lines = _stream(spark, parts, seeds.GATE_LINES)
    folder = fresh_path(spark, "gate-restart")
    run = lambda: stores.gate_outputs(lines, f"{folder}/out", f"{folder}/checkpoint", tables.keys(spark), "k1").awaitTermination()
    read = lambda name: stores.read_gate_output(lines, f"{folder}/out", name, tables.keys(spark), "k1")
    stopped = _fail_once(monkeypatch, stores.BatchOutputs, "write", lambda self, name, rows, batch: batch == 2 and name == stores.REJECTED)
    with pytest.raises(Exception, match="middle of a batch"):
        run()
    assert stopped
    # What the stopped batch has written is not seen.
    seen = read(stores.FORWARDED).select("line_id").distinct().count(), read(stores.REJECTED).count(), read(stores.AUDIT).count()
    assert stores.BatchOutputs(spark, f"{folder}/out").last_done() == 1
    run()
    batch = gate.generate_gate(_gate_lines(spark, parts))
    forwarded, rejected = gate.split(batch)
    assert seen[0] < forwarded.count() and seen[1] < rejected.count()
    assert _same(read(stores.FORWARDED), forwarded) and _same(read(stores.REJECTED), rejected)
    audit = read(stores.AUDIT)
    assert integrity.integrity_rollup(integrity.verify(audit, tables.keys(spark))).first().integrity_ok
    assert _same(audit.drop("signature", "key_id", "payload_version"), events.gate_denied_events(rejected)) and audit.count() > seen[2]
    # Started again without new input, nothing is added.
    run()
    assert read(stores.FORWARDED).count() == forwarded.count()


def test_a_batch_stopped_after_its_mark_is_not_stored_again(spark, parts, monkeypatch):
    lines = _stream(spark, parts, seeds.GATE_LINES)
    folder = fresh_path(spark, "gate-marked")
    run = lambda: stores.gate_outputs(lines, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    _fail_once(monkeypatch, stores.BatchOutputs, "mark_done", lambda self, batch: batch == 1)
    with pytest.raises(Exception, match="middle of a batch"):
        run()
    run()
    forwarded, _ = gate.split(gate.generate_gate(_gate_lines(spark, parts)))
    assert _same(stores.read_gate_output(lines, f"{folder}/out", stores.FORWARDED), forwarded)


def test_outputs_before_any_batch_are_empty(spark, parts):
    lines = _stream(spark, parts, seeds.GATE_LINES)
    assert stores.read_gate_output(lines, fresh_path(spark, "none"), stores.AUDIT).count() == 0


def _copied(spark, folder):
    seed = tables.derived(spark, seeds.AUDIT_SEED, events=spark.read.parquet(folder))
    return tables.with_copies(seed)


@pytest.mark.parametrize("stop", [None, "write", "mark_done"])
def test_events_are_stored_once_without_state(spark, parts, monkeypatch, stop):
    live = tables.with_copies(_stream(spark, parts, seeds.AUDIT_SEED))
    folder = fresh_path(spark, "dedup-keys")
    run = lambda: stores.deduplicated_outputs(live, f"{folder}/out", f"{folder}/checkpoint")
    if stop:
        _fail_once(monkeypatch, stores.BatchOutputs, stop, lambda *args: args[-1] == 2)
        with pytest.raises(Exception, match="middle of a batch"):
            run().awaitTermination()
    query = run()
    query.awaitTermination()
    assert all(not progress.stateOperators for progress in query.recentProgress)
    assert _same(stores.read_deduplicated(live, f"{folder}/out"), events.deduplicate(_copied(spark, parts)))


def test_copies_in_later_batches_late_rows_and_rows_without_id_or_time(spark):
    folder, out = fresh_path(spark, "late-in"), fresh_path(spark, "late-out")
    schema = "request_id string, ts timestamp_ntz, message string"

    def arrive(*rows):
        cast = F.col("ts").cast("timestamp_ntz")
        spark.createDataFrame(rows, "request_id string, ts string, message string").withColumn("ts", cast).coalesce(1).write.mode("append").parquet(folder)
        live = spark.readStream.schema(schema).parquet(folder)
        stores.deduplicated_outputs(live, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
        return sorted((r.request_id or "-", str(r.ts), r.message) for r in stores.read_deduplicated(live, f"{out}/rows").collect())

    a, b = ("a", NIGHT, "x"), ("b", None, "y")
    first = arrive(a, a, b, b, (None, NIGHT, "n"), (None, NIGHT, "n"))
    assert first == [("-", NIGHT, "n"), ("-", NIGHT, "n"), ("a", NIGHT, "x"), ("b", "None", "y")]
    assert arrive(a, b) == first  # copies of what an earlier batch has stored
    old = ("c", "2001-01-01 00:00:00", "late")
    assert arrive(old, ("a", NIGHT, "another event")) == sorted([*first, old, ("a", NIGHT, "another event")])
    assert arrive(old) == sorted([*first, old, ("a", NIGHT, "another event")])


def test_a_batch_reads_only_the_keys_of_its_dates(spark, parts):
    live = tables.with_copies(_stream(spark, parts, seeds.AUDIT_SEED))
    folder = fresh_path(spark, "dedup-pruned")
    stores.deduplicated_outputs(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    dates = [r[0] for r in _copied(spark, parts).filter(F.dayofmonth("ts") == 3).select(F.to_date("ts").cast("string")).distinct().collect()]
    known = stores.known_keys(spark, f"{folder}/out", dates, 99)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*key_date", plan)
    assert {str(r.key_date) for r in known.collect()} == {str(d) for d in dates}
    many = [d for d in dates for _ in range(stores.MOST_DATES + 1)]
    assert stores.known_keys(spark, f"{folder}/out", many, 99).count() == known.count()


COUNTED = [(jobs.counts_per_step, ["step_start"]), (jobs.intents_per_window, ["window_start", "window_end", "intent"])]


@pytest.mark.parametrize("counts, keys", COUNTED)
def test_window_store_equals_batch_and_files_do_not_grow(spark, parts, monkeypatch, counts, keys):
    folder = fresh_path(spark, "windows")
    live = _stream(spark, parts, seeds.AUDIT_SEED)
    run = lambda: stores.window_outputs(live, counts, keys, f"{folder}/out", f"{folder}/checkpoint")
    # Stopped once after the manifest of a batch, before the query has noted the batch as done.
    _fail_once(monkeypatch, Manifests, "publish", lambda self, number, content: number == 2)
    with pytest.raises(Exception, match="middle of a batch"):
        run()[0].awaitTermination()
    query, store = run()
    query.awaitTermination()
    seed = tables.derived(spark, seeds.AUDIT_SEED, events=spark.read.parquet(parts))
    assert _same(store.read(), counts(seed))
    assert _same(store.read("2024-01-10"), counts(seed.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))))
    assert all(not progress.stateOperators for progress in query.recentProgress)
    dates = counts(seed).select(F.to_date(keys[0])).distinct().count()

    def folders():
        root = folder.removeprefix("file://") + "/out/data"
        return sum(name.startswith("event_date") for _, names, _ in os.walk(root) for name in names)

    # The same events again, ten times: every date has its current version and the one before, no more.
    for k in range(10):
        store.add(counts(seed), 100 + k)
        assert folders() <= 2 * dates
    assert len(store.manifests.numbers()) == 2
    sums = [F.sum(name) for name in store.sums]
    assert [11 * n for n in counts(seed).agg(*sums).first()] == list(store.read().agg(*sums).first())
    store.add(counts(seed), 105)  # an old batch once more
    assert [11 * n for n in counts(seed).agg(*sums).first()] == list(store.read().agg(*sums).first())


def test_a_reader_that_has_begun_sees_one_version(spark, parts):
    seed = tables.derived(spark, seeds.AUDIT_SEED, events=spark.read.parquet(parts))
    counted = jobs.counts_per_step(seed)
    store = stores.WindowStore(spark, fresh_path(spark, "readers"), counted.schema, ["step_start"])
    assert store.read().count() == 0
    store.add(counted, 0)
    begun = store.read()
    store.add(counted, 1)
    assert _same(begun, counted)
    total = lambda df: df.agg(F.sum("blocked")).first()[0]
    assert total(store.read()) == 2 * total(counted)
    store.add(counted.limit(0), 2)  # a batch without events
    assert total(store.read()) == 2 * total(counted)


def test_current_leaves_the_schema_of_the_caller_alone(spark, parts):
    counts = jobs.counts_per_step(_stream(spark, parts, seeds.AUDIT_SEED))
    before = counts.schema.fieldNames()
    jobs.counted_once(spark, counts, "schema-kept")
    assert counts.schema.fieldNames() == before


def test_small_files_appear_whole(spark):
    files = Files(spark, fresh_path(spark, "files"))
    assert files.names() == [] and not files.exists("a")
    files.put("a/b", "é1")
    files.put("a/b", json.dumps({"x": 1}))
    assert files.names("a") == ["b"] and json.loads(files.read("a/b")) == {"x": 1}
    manifests = Manifests(files)
    assert manifests.last() == (-1, {})
    for number in (0, 9, 10):
        manifests.publish(number, {"n": number})
    assert manifests.last() == (10, {"n": 10})
    files.delete("a")
    assert not files.exists("a/b")
