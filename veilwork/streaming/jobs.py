"""The same work on arriving data.

Requests are handled by the batch functions of ``plans`` and ``operators``,
which take streaming input as it is.  This module adds what needs state: removal
of repeated events and counts over time windows.  Neither has a watermark, since a
watermark drops events that arrive late and holds the last windows back; state
is a hash per event or a row per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork import fixed_values as fv
from veilwork.operators.events import copy_key, key_hash
from veilwork.session import fresh_path
from veilwork.sources.audit_table import PARTITION

COUNTED = ("blocked", "malaysian_ic", "emails")


def deduplicated(events: DataFrame) -> DataFrame:
    """One row of each event, whenever its copies arrive.

    Copies are told as in ``operators.events.deduplicate``; the first to arrive stays
    and rows without a request id pass.  The keys, 16 bytes each, are kept for good:
    no event is ever dropped for being late.
    """
    named = events.filter(F.col("request_id").isNotNull())
    one, two = key_hash(copy_key(events))
    once = named.select("*", one.alias("_one"), two.alias("_two")).dropDuplicates(["_one", "_two"])
    return once.select(*events.columns).unionByName(events.filter(F.col("request_id").isNull()))


def counts_per_step(events: DataFrame, step: str = "1 hour") -> DataFrame:
    """Blocked requests and redacted ids and e-mails per step of time.

    On a stream, each batch updates all steps it has events of, however old.
    """
    kept = events.filter(F.col("event_type").isin(fv.DENIED, fv.REDACTED))
    redacted = F.col("event_type") == fv.REDACTED
    amount = lambda name: F.sum(F.when(redacted, F.col(name)).otherwise(0).cast("bigint"))
    counted = kept.groupBy(F.window("ts", step)).agg(
        F.count_if(~redacted).alias("blocked"),
        amount("count_id").alias("malaysian_ic"),
        amount("count_email").alias("emails"),
    )
    return counted.select(F.col("window.start").alias("step_start"), *COUNTED)


def rolled(steps: DataFrame, length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Rolling windows from the counts of steps: those few rows are copied, not every event."""
    return (
        steps.groupBy(F.window("step_start", length, step))
        .agg(*[F.sum(name).alias(name) for name in COUNTED])
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *COUNTED)
    )


def intents_per_window(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Forbidden intents counted per time window."""
    denied = events.filter((F.col("event_type") == fv.DENIED) & (F.col("forbidden_intents") != ""))
    listed = denied.select("ts", F.explode(F.split("forbidden_intents", ";")).alias("intent"))
    counted = listed.groupBy(F.window("ts", length), "intent").agg(F.count("*").alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "intent", "n"
    )


def keep_current(counts: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the whole present result of a streaming aggregate below ``path``.

    The result (one row per window and group) is written anew with each batch, in a
    folder named by the batch: a repeated batch writes the same rows to the same
    place.  Every event counts, late ones too, and no window waits to be closed.
    """

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = counts.writeStream.outputMode("complete").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, counts: DataFrame, path: str) -> DataFrame:
    """The result as of the last batch that ``keep_current`` has written."""
    # A new schema: ``add`` would change the one that ``counts`` goes on using.
    schema = T.StructType([*counts.schema.fields, T.StructField("batch", T.LongType())])
    stored = spark.read.schema(schema).parquet(path)
    last = stored.agg(F.max("batch")).first()[0]
    return stored.filter(F.col("batch") == F.lit(last)).drop("batch")


def counted_once(spark: SparkSession, counts: DataFrame, label: str) -> DataFrame:
    """Run a streaming aggregate to the end of its present input and read its result."""
    folder = fresh_path(spark, label)
    keep_current(counts, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return current(spark, counts, f"{folder}/rows")


def append_to_files(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None):
    """Start a query that appends to Parquet files and stops when the input is used up.

    Progress and state are kept in ``checkpoint``; started again with the same
    folders it goes on where it stopped and writes every row once.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_audit_events(signed: DataFrame, path: str, checkpoint: str):
    """As ``append_to_files``, into an audit table partitioned by event date."""
    return append_to_files(signed.withColumn(PARTITION, F.to_date("ts")), path, checkpoint, [PARTITION])


def run_once(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to the end of its present input and read what it wrote."""
    folder = fresh_path(spark, label)
    query = append_to_files(stream, f"{folder}/rows", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
