"""The audit table: Parquet files partitioned by event date.

Appends leave many small files.  ``compact`` writes those of a date anew as few, in a hidden folder,
and then names the new version and the files it stands for in a manifest: ``read_events`` reads the version
instead of these files, from one moment to the next.  The files themselves are deleted one
compaction later, so that readers that have begun may finish.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions.times import at
from veilwork.schemas import AUDIT_EVENT, SIGNED_WITH
from veilwork.sources.files import Files, Manifests

PARTITION = "event_date"
COMPACTED = "_compacted"
# Files of a date that are few enough to be left alone.
FEW_FILES = 4

_STORED = T.StructType(AUDIT_EVENT.fields + SIGNED_WITH.fields + [T.StructField(PARTITION, T.DateType())])


def append_events(signed: DataFrame, path: str) -> None:
    """Append signed rows below ``path``.

    Rows are rebalanced by date first: small dates share a file, and a date
    with very many rows is split over several tasks.
    """
    dated = signed.withColumn(PARTITION, F.to_date("ts"))
    dated.hint("rebalance", PARTITION).write.mode("append").partitionBy(PARTITION).parquet(path)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """The files as they were appended."""
    return spark.read.schema(_STORED).parquet(path)


def _versions(spark: SparkSession, path: str, versions: dict[str, int]) -> DataFrame:
    """The compacted files of the given dates."""
    hidden = f"{path.rstrip('/')}/{COMPACTED}"
    folders = [f"{hidden}/version={version}/{PARTITION}={date}" for date, version in sorted(versions.items())]
    return spark.read.schema(_STORED).option("basePath", hidden).parquet(*folders).select(*_STORED.fieldNames())


def _current(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    rows = _raw(spark, path)
    covered = [name for entry in manifest.values() for name in entry["covers"]]
    if covered:
        # Spark leaves such files out when it lists them, without reading a row.
        rows = rows.filter(~F.col("_metadata.file_name").isin(covered)).select(*_STORED.fieldNames())
    if manifest:
        rows = rows.unionByName(_versions(spark, path, {date: entry["version"] for date, entry in manifest.items()}))
    return rows


def read_events(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The audit table in today's schema, files of any age, compacted or not.

    ``since`` reads only the partitions of its date and later, and in those
    only later rows.
    """
    events = _current(spark, path, Manifests(Files(spark, path)).last()[1])
    return events if since is None else from_time(events, since)


def stored_dates(spark: SparkSession, path: str) -> list[str]:
    """The dates (``yyyy-mm-dd``) that the table may have rows of, from the newest on."""
    names = Files(spark, path).names()
    dates = [name.removeprefix(f"{PARTITION}=") for name in names if name.startswith(f"{PARTITION}=")]
    return sorted((date for date in dates if date[:1].isdigit()), reverse=True)


def read_newest(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The rows of the newest dates that together hold at least ``rows`` rows; all, if there are fewer.

    As dates follow times, the latest ``rows`` events are among them, ties over midnight included.
    Twice as many dates are tried each time; counting them reads file footers only.
    """
    events, dates, tried = read_events(spark, path), stored_dates(spark, path), 1
    while dates:
        newest = events.filter(F.col(PARTITION) >= F.lit(dates[min(tried, len(dates)) - 1]).cast("date"))
        if newest.count() >= rows:
            return newest
        if tried >= len(dates):
            break
        tried *= 2
    return events


def compact(spark: SparkSession, path: str, few_files: int = FEW_FILES) -> int:
    """Write the files of every date that has more than ``few_files`` uncompacted ones as few; returns their number.

    New rows may be appended meanwhile; they stay files of their own until the next compaction.  Only
    one compaction of a table may run at a time.  A stream's file sink keeps a list of its
    files, so those are never deleted, only no longer read by ``read_events``.
    """
    files = Files(spark, path)
    manifests = Manifests(files)
    number, manifest = manifests.last()
    covered = {name for entry in manifest.values() for name in entry["covers"]}
    by_date: dict[str, list[str]] = defaultdict(list)
    for file in _raw(spark, path).inputFiles():
        folder, name = unquote(file).split("/")[-2:]
        if folder.startswith(f"{PARTITION}=") and name not in covered:
            by_date[folder.removeprefix(f"{PARTITION}=")].append(file)
    chosen = {date: found for date, found in by_date.items() if len(found) > few_files}
    if not chosen:
        return 0
    small = spark.read.schema(_STORED).option("basePath", path).parquet(*[f for found in chosen.values() for f in found])
    known = {date: manifest[date]["version"] for date in chosen if date in manifest}
    rows = small.unionByName(_versions(spark, path, known)) if known else small
    new = f"{path.rstrip('/')}/{COMPACTED}/version={number + 1}"
    rows.hint("rebalance", PARTITION).write.mode("overwrite").partitionBy(PARTITION).parquet(new)
    if spark.read.schema(_STORED).parquet(new).count() != rows.count():
        raise ValueError(f"the compacted version {number + 1} has another number of rows than its files")
    entries = {
        date: {"version": number + 1, "covers": sorted(manifest.get(date, {"covers": []})["covers"] + [unquote(f).split("/")[-1] for f in found])}
        for date, found in chosen.items()
    }
    manifests.publish(number + 1, manifest | entries)
    _delete_replaced(files, manifests)
    return sum(map(len, chosen.values()))


def _delete_replaced(files: Files, manifests: Manifests) -> None:
    """Delete what the manifest before the current one had already replaced."""
    *old, previous, last = [-1, *manifests.numbers()]
    if previous < 0:
        return
    now, before = manifests.read(last), manifests.read(previous)
    if not files.exists("_spark_metadata"):
        for date, entry in before.items():
            gone = set(entry["covers"])
            for name in gone & set(files.names(f"{PARTITION}={date}")):
                files.delete(f"{PARTITION}={date}/{name}")
    for number in (n for n in old if n >= 0):
        for date, entry in manifests.read(number).items():
            if entry["version"] not in (now[date]["version"], before[date]["version"]):
                files.delete(f"{COMPACTED}/version={entry['version']}/{PARTITION}={date}")
        manifests.forget(number)


def from_time(events: DataFrame, since: datetime) -> DataFrame:
    """Rows at or after ``since``, with the partition filter it implies."""
    out = events.filter(F.col("ts") >= at(since))
    return out.filter(F.col(PARTITION) >= F.lit(since.date())) if PARTITION in events.columns else out


def export_rows(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Write report or evidence rows, all of them, to a new folder."""
    rows.write.mode("errorifexists").format(format).save(path)
