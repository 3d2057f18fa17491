"""Session settings, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this package is written for. None of them depends on
# the machine: partition counts are left to AQE and to the cluster's defaults.
RECOMMENDED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_declared_folder: str | None = None


def build_session(app_name: str = "veilwork", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the recommended settings; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def declare_shared_folder(path: str) -> None:
    """Name the work folder of sessions that have no ``spark.checkpoint.dir`` (tests, one machine)."""
    global _declared_folder
    _declared_folder = path.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or else the declared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _declared_folder
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def fits_broadcast(df: DataFrame) -> bool:
    """True if the plan's own estimate of ``df`` is below ``spark.sql.autoBroadcastJoinThreshold``.

    No job runs; a table of unknown size does not fit.
    """
    session = df.sparkSession._jsparkSession.sessionState().conf()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= session.autoBroadcastJoinThreshold()


def _salt(facts: DataFrame, salts: int) -> Column:
    """A number from the content of the row; columns that cannot be hashed take no part."""
    hashed = [f.name for f in facts.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in hashed]), F.lit(salts)).cast("int")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str,
    extra_condition=None,
    small: bool | None = None,
    salts: int = 64,
) -> DataFrame:
    """Join ``facts.<on>`` to ``lookup.<on>``, keeping only columns the join type keeps.

    A lookup whose estimated bytes are below the broadcast threshold, or that the
    caller knows to be local and small, is broadcast and the facts do not move.
    Any other is joined by shuffle; because one key may hold a large share of
    the facts, each fact row takes one of ``salts`` sub-keys from its content and
    the lookup is repeated once per sub-key, which splits every hot key into
    ``salts`` parts and still matches each pair exactly once.  A recomputed task
    gives its rows the same sub-keys again.  Rows that are copies in every column
    stay together; AQE splits their partition by the tasks that wrote it.
    """
    left, right = facts.alias("facts"), lookup.alias("lookup")
    condition = F.col(f"facts.{on}") == F.col(f"lookup.{on}")
    if extra_condition is not None:
        condition = condition & extra_condition
    if small if small is not None else fits_broadcast(lookup):
        return left.join(F.broadcast(right), condition, how)
    salted = facts.withColumn("_salt", _salt(facts, salts))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = condition & (F.col("facts._salt") == F.col("lookup._salt"))
    return salted.alias("facts").join(repeated.alias("lookup"), condition, how).drop("_salt")
