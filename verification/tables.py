"""Driver tables and the tables derived from them, as DataFrames."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions.canonical import keyring
from veilwork.operators import integrity
from veilwork.schemas import ADDED_LATER
from veilwork.session import declare_shared_folder, fresh_path
from veilwork.sources import audit_table
from verification import seeds

# Keys of these checks only; a deployment brings its own.
KEYS = {"k1": b"fixture key one", "k2": b"fixture key two, after rotation"}
ROTATED = "2024-01-15 00:00:00"
AS_OF = datetime(2024, 1, 31)

_folder: str | None = None

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Run a seed query with the given DataFrames as its views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, seeds.PROMPTS, events=table(spark, sf_dir, "events"))


def audit_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, seeds.AUDIT_SEED, events=table(spark, sf_dir, "events"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, seeds.REQUEST_LINES, prompts=prompts(spark, sf_dir))


def gate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, seeds.GATE_LINES, prompts=prompts(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a request id."""
    request_id = F.concat(F.lit("req-"), F.col("prompt_id").cast("string"))
    return prompts(spark, sf_dir).withColumn("request_id", request_id)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its file."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet")
    return reader.parquet(sf_dir)


def keys(spark: SparkSession) -> DataFrame:
    return keyring(spark, KEYS)


def sign_rotated(spark: SparkSession, unsigned: DataFrame) -> DataFrame:
    """Rows signed with one key before the rotation and another after."""
    return integrity.sign(unsigned, keys(spark), rotated_key(), integrity.PAYLOAD_V1)


def rotated_key():
    return F.when(F.col("ts") < F.lit(ROTATED).cast("timestamp_ntz"), "k1").otherwise("k2")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed rows as the audit table stores them."""
    path = fresh_path(spark, "audit")
    audit_table.append_events(signed(spark, sf_dir), path)
    return audit_table.read_events(spark, path)


def stored_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stored rows, those of the newest dates that hold the recent events."""
    path = fresh_path(spark, "audit")
    audit_table.append_events(signed(spark, sf_dir), path)
    return audit_table.read_newest(spark, path, fv.RECENT_EVENTS)


def mixed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both payload versions, those of the first without key id and version, some of them edited."""
    seed = audit_seed(spark, sf_dir)
    old = integrity.sign(seed.filter("id % 2 = 0"), keys(spark), "k1", integrity.PAYLOAD_V1)
    old = old.withColumns({"key_id": F.lit(None).cast("string"), "payload_version": F.lit(None).cast("int")})
    path = fresh_path(spark, "audit-mixed")
    audit_table.append_events(old, path)
    audit_table.append_events(integrity.sign(seed.filter("id % 2 = 1"), keys(spark), rotated_key()), path)
    rows = audit_table.read_events(spark, path)
    counts = F.when(F.col("id") % 89 == 0, F.lit("{}")).otherwise(F.col("tool_a_counts"))
    return rows.withColumns(
        {
            "id": F.when(F.col("id") % 83 == 0, F.col("id") + 1_000_000_000).otherwise(F.col("id")),
            "tool_a_counts": counts,
            "message": F.when(F.col("id") % 97 == 0, F.concat("message", F.lit(" (edited)"))).otherwise(F.col("message")),
        }
    )


def tamper(rows: DataFrame) -> DataFrame:
    """Signed rows of which some are edited and some lose their signature."""
    edited = F.when(F.col("id") % 97 == 0, F.concat("message", F.lit(" (edited)"))).otherwise(F.col("message"))
    unsigned = F.when(F.col("id") % 101 != 0, F.col("signature"))
    return rows.withColumns({"message": edited, "signature": unsigned})


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_rotated(spark, audit_seed(spark, sf_dir))


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper(signed(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verify(tampered(spark, sf_dir), keys(spark))


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit seed as a table from before the jury; ids do not clash."""
    older = audit_seed(spark, sf_dir).withColumn("id", -F.col("id") - 1)
    return older.drop(*ADDED_LATER)


def with_copies(seed: DataFrame) -> DataFrame:
    """Audit rows, some without a request id, with every denial stored twice and a second event of some requests."""
    once = seed.withColumn("request_id", F.when(F.col("id") % 10 != 0, F.col("request_id")))
    copies = once.filter(F.col("event_type") == "SECURITY_DENIED")
    second = once.filter(F.col("id") % 7 == 0).withColumn("message", F.concat("message", F.lit(" again")))
    return once.unionByName(copies).unionByName(second)


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_copies(audit_seed(spark, sf_dir))


def use_local_folder(spark: SparkSession) -> None:
    """Where no shared folder is set, give a session of one process a temporary one."""
    master = spark.sparkContext.master
    if not spark.conf.get("spark.checkpoint.dir", None) and (master == "local" or master.startswith("local[")):
        global _folder
        _folder = _folder or tempfile.mkdtemp(prefix="veilwork-checks-")
        declare_shared_folder(_folder)
