"""What streams leave behind, stored batch by batch and without a state store.

Each function here starts a query that handles a batch as a whole: it computes the batch once, writes
what comes of it under the number of the batch, and at last marks the batch as done.  A batch that is
repeated after a failure writes the same places again, or is left alone if it was done.  Readers take
only what is marked, so they see all outputs of a batch or none.

Output folder and checkpoint belong together: batches are told by the numbers the checkpoint counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.operators import events, gate, integrity
from veilwork.sources.audit_table import PARTITION
from veilwork.sources.files import Files, Manifests, discard, written_once

DONE = "_done"


def _start(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str):
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


class BatchOutputs:
    """Named outputs of a stream below ``path``, one folder per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def last_done(self) -> int:
        """The number of the last batch that is done, -1 at first.  Batches come in order."""
        done = [int(name) for name in self.files.names(DONE) if name.isdigit()]
        return max(done, default=-1)

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def mark_done(self, batch: int) -> None:
        self.files.put(f"{DONE}/{batch:020d}", "")
        for name in self.files.names(DONE):
            if name.isdigit() and int(name) < batch:
                self.files.delete(f"{DONE}/{name}")

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """All rows of an output, of the batches that are done."""
        last = self.last_done()
        if last < 0:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(stored).parquet(f"{self.path}/{name}")
        return rows.filter(F.col("batch") <= last).drop("batch")


# --- the gate and its outputs -----------------------------------------------------------------

FORWARDED, REJECTED, AUDIT = "forwarded", "rejected", "audit"


def _gate_parts(lines: DataFrame) -> dict[str, DataFrame]:
    forwarded, rejected = gate.split(lines)
    return {FORWARDED: forwarded, REJECTED: rejected, AUDIT: events.gate_denied_events(rejected)}


def gate_outputs(lines: DataFrame, path: str, checkpoint: str, keyring: DataFrame | None = None, key_id: str | None = None):
    """Start a query that stores what the gate lets through, what it rejects, and the audit rows.

    ``lines`` are forwarding requests with ``value``, ``ts``, ``request_id`` and ``user_role``.  The
    three outputs of a batch are read by ``read_gate_output`` and become visible together.  With a
    keyring, audit rows are signed.
    """
    outputs = BatchOutputs(lines.sparkSession, path)

    def store(rows: DataFrame, batch: int) -> None:
        if batch <= outputs.last_done():
            return
        decided, staged = written_once(gate.generate_gate(rows), "gate")
        for name, part in _gate_parts(decided).items():
            signed = integrity.sign(part, keyring, key_id) if name == AUDIT and keyring is not None else part
            outputs.write(name, signed, batch)
        outputs.mark_done(batch)
        discard(rows.sparkSession, staged)

    return _start(lines, store, checkpoint)


def read_gate_output(
    lines: DataFrame, path: str, name: str, keyring: DataFrame | None = None, key_id: str | None = None
) -> DataFrame:
    """One of ``FORWARDED``, ``REJECTED`` and ``AUDIT``, as ``gate_outputs`` of the same arguments stores it."""
    part = _gate_parts(gate.generate_gate(lines))[name]
    if name == AUDIT and keyring is not None:
        part = integrity.sign(part, keyring, key_id)
    return BatchOutputs(lines.sparkSession, path).read(name, part.schema)


# --- events once, told by a table of keys -----------------------------------------------------

KEY_BUCKETS = 16
# The date of events without a time.
NO_DATE = "0001-01-01"
_KEYS = "key_one bigint, key_two bigint, key_batch bigint, key_date date, key_bucket int"
_KEY = ["key_date", "key_bucket", "key_one", "key_two"]
# So many dates are named in a filter; beyond, their range is.
MOST_DATES = 1000


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    one, two = events.key_hash(events.copy_key(rows))
    date = F.coalesce(F.to_date("ts"), F.lit(NO_DATE).cast("date"))
    keyed = rows.select("*", one.alias("key_one"), two.alias("key_two"), date.alias("key_date"))
    return keyed.withColumn("key_bucket", F.pmod("key_one", F.lit(buckets)).cast("int"))


def known_keys(spark: SparkSession, path: str, dates: list[str], batch: int) -> DataFrame:
    """The keys of earlier batches on ``dates`` (``yyyy-mm-dd``); only the partitions of these dates are read."""
    keys = spark.read.schema(_KEYS).parquet(f"{path}/keys")
    if len(dates) <= MOST_DATES:
        of_dates = F.col("key_date").isin([F.lit(date).cast("date") for date in dates])
    else:
        of_dates = F.col("key_date").between(F.lit(min(dates)).cast("date"), F.lit(max(dates)).cast("date"))
    return keys.filter(of_dates & (F.col("key_batch") < batch)).select(*_KEY)


def deduplicated_outputs(stream: DataFrame, path: str, checkpoint: str, buckets: int = KEY_BUCKETS):
    """Start a query that stores one row of each event, whenever its copies arrive.

    Copies are told as in ``operators.events.deduplicate``; the first to arrive stays and rows
    without a request id pass.  No state store is used, and nothing is forgotten: the keys
    of all events are files, partitioned by the date of the event and a part of its hash,
    and a batch meets only the keys of its own dates.  Keys that a failed attempt of the
    same batch has left are not looked at.
    """
    spark = stream.sparkSession
    outputs, files = BatchOutputs(spark, path), Files(spark, path)

    def store(rows: DataFrame, batch: int) -> None:
        if batch <= outputs.last_done():
            return
        named = _keyed(rows.filter(F.col("request_id").isNotNull()), buckets)
        # Each task keeps one copy of an event before rows move.
        arrived, staged = written_once(named.dropDuplicates(["key_one", "key_two"]), "arrived")
        dates = [row[0] for row in arrived.select(F.col("key_date").cast("string")).distinct().collect()]
        used = [staged]
        if dates and files.exists("keys"):
            arrived, staged = written_once(arrived.join(known_keys(spark, path, dates, batch), _KEY, "left_anti"), "fresh")
            used.append(staged)
        unnamed = rows.filter(F.col("request_id").isNull())
        outputs.write("rows", arrived.select(*rows.columns).unionByName(unnamed), batch)
        kept = arrived.select("key_one", "key_two", F.lit(batch).cast("long").alias("key_batch"), "key_date", "key_bucket")
        kept.hint("rebalance", "key_date", "key_bucket").write.mode("append").partitionBy("key_date", "key_bucket").parquet(f"{path}/keys")
        outputs.mark_done(batch)
        discard(spark, *used)

    return _start(stream, store, checkpoint)


def read_deduplicated(stream: DataFrame, path: str) -> DataFrame:
    """What ``deduplicated_outputs`` of the same stream has stored."""
    return BatchOutputs(stream.sparkSession, path).read("rows", stream.schema)


# --- counts per time window -------------------------------------------------------------------


class WindowStore:
    """Counts per time window below ``path``: one current version of each date, and the one before.

    Counts of a batch are added to those of the dates it has events of, which are written as a new
    version; a manifest then names it.  Folders that neither the current nor the previous manifest
    names are deleted, so a reader that has begun may finish, and files do not grow with
    the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.files = Files(spark, path)
        self.manifests = Manifests(self.files)
        self.sums = [name for name in schema.fieldNames() if name not in keys]

    def _folder(self, version: int) -> str:
        return f"data/version={version}"

    def _read(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/{self._folder(v)}/{PARTITION}={date}" for date, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, since: str | None = None) -> DataFrame:
        """The counts as of the last batch that is done; of dates from ``since`` (``yyyy-mm-dd``) on."""
        _, versions = self.manifests.last()
        return self._read({d: v for d, v in versions.items() if since is None or d >= since})

    def add(self, counts: DataFrame, batch: int) -> None:
        """Add the counts of a batch; one that has been added already is left alone."""
        number, versions = self.manifests.last()
        if batch <= number:
            return
        dated = counts.select(*self.schema.fieldNames()).withColumn(PARTITION, F.to_date(self.keys[0]))
        added, staged = written_once(dated, "window-counts")
        dates = [str(row[0]) for row in added.select(PARTITION).distinct().collect()]
        before = self._read({d: v for d, v in versions.items() if d in dates})
        both = added.drop(PARTITION).unionByName(before).groupBy(*self.keys)
        merged = both.agg(*[F.sum(name).cast(self.schema[name].dataType).alias(name) for name in self.sums])
        merged = merged.withColumn(PARTITION, F.to_date(self.keys[0])).hint("rebalance", PARTITION)
        if dates:
            merged.write.mode("overwrite").partitionBy(PARTITION).parquet(f"{self.path}/{self._folder(batch)}")
        self.manifests.publish(batch, versions | dict.fromkeys(dates, batch))
        discard(self.spark, staged)
        self._clean()

    def _clean(self) -> None:
        *old, previous, last = [-1, -1, *self.manifests.numbers()]
        named = {(d, v) for n in (previous, last) if n >= 0 for d, v in self.manifests.read(n).items()}
        for number in (n for n in old if n >= 0):
            for date, version in self.manifests.read(number).items():
                if (date, version) not in named:
                    self.files.delete(f"{self._folder(version)}/{PARTITION}={date}")
                    if not any(name.startswith(PARTITION) for name in self.files.names(self._folder(version))):
                        self.files.delete(self._folder(version))
            self.manifests.forget(number)


def window_outputs(
    stream: DataFrame, counts: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str
) -> tuple:
    """Start a query that adds the counts of each batch to a ``WindowStore``; returns the query and the store.

    ``counts`` makes counts out of events, as ``jobs.counts_per_step`` does; ``keys`` are their columns
    that are not summed, the time of the window first.  No state is kept besides the store, and
    late events count in their window.
    """
    store = WindowStore(stream.sparkSession, path, counts(stream).schema, keys)
    query = _start(stream, lambda rows, batch: store.add(counts(rows), batch), checkpoint)
    return query, store
