"""Tables that an operator writes between two steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None


def reachable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package from where it is now."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session of one process (master ``local`` or ``local[n]``) may do
    without the setting; it gets a temporary folder of that process.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="veilwork-llm-")
    return _local_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of any executor, and
    the work above is done once however often the result is used.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hinted(table: DataFrame, most_rows: int) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``most_rows`` rows.

    A larger one is joined by a shuffle, with the same result.
    """
    return F.broadcast(table) if table.count() <= most_rows else table


def small(table: DataFrame, most_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its files hold at most ``most_bytes`` bytes, and shuffled beyond."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return F.broadcast(table) if files.getContentSummary(path).getLength() <= most_bytes else table
