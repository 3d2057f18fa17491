"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when identical after every run of white space is one space.

1. Fingerprints: one narrow row per document (id, 64-bit key, SHA-256).
2. Directory: the top bits of the key address a slot.  Starting from one bucket,
   the directory doubles: a bucket with more keys than ``capacity`` is split by
   one more bit, until it fits or the directory has its full depth.
3. Owners: each bucket, a range of keys, belongs to one task, which reads its
   entries in order of key.  Texts with equal keys form a chain and are compared
   byte by byte; each different text gets an entry of its own.  Copies are merged
   before they are sent, batch by batch, so a text that a third of all rows share
   does not reach its owner once per row.
4. The index is written to the shared folder; documents look up their entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import SPACES, whole
from veilwork.llm.work import written

# Address bits of the directory: at most 65,536 slots, which is what the driver broadcasts.
DEPTH = 16
# Keys that a bucket holds before it is split
CAPACITY = 256

_ENTRY = "bucket int, key bigint, chain int, text_sha256 string, keep_id bigint, group_size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACES, " ")


def directory(keys: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """``slot`` -> ``bucket`` (its first slot) and ``bits`` (how many address bits it uses).

    ``keys`` has one row per distinct ``key``.  For every prefix of every length
    the keys below it are counted; a slot belongs to its shortest prefix that is
    not overfull.  At most ``2 ** depth`` rows.
    """
    slots = keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("load"))
    slots = written(slots, "slots")
    shift = lambda slot: F.expr(f"shiftright({slot}, {depth} - bits) * shiftleft(1, {depth} - bits)")
    levels = slots.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("bucket", shift("slot"))
    full = levels.groupBy("bits", "bucket").agg(F.sum("load").alias("total"))
    fitting = levels.join(full.hint("merge"), ["bits", "bucket"]).filter((F.col("total") <= capacity) | (F.col("bits") == depth))
    least = F.min(F.struct("bits", "bucket")).alias("least")
    return fitting.groupBy("slot").agg(least).select("slot", "least.bucket", "least.bits")


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def _merge_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each batch: one row per key and text, with its smallest id and count."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        merged = table.group_by(["bucket", "key", "body"]).aggregate([("doc_id", "min"), ([], "count_all")])
        merged = merged.select(["bucket", "key", "body", "doc_id_min", "count_all"])
        yield from merged.rename_columns(["bucket", "key", "body", "doc_id", "n"]).combine_chunks().to_batches()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the key ranges of one task; rows come sorted by bucket and key.

    Memory holds one batch and the different texts of one key.
    """
    current, chain, done = None, [], []

    def close():
        for place, (body, smallest, count) in enumerate(chain):
            digest = hashlib.sha256(body.encode()).hexdigest()
            done.append((*current, place, digest, smallest, count))
        if len({entry[3] for entry in done[-len(chain):]}) < len(chain):
            raise ValueError("two different texts share a key and a SHA-256")

    names = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for bucket, key, body, smallest, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, key) != current:
                if chain:
                    close()
                current, chain = (bucket, key), []
            for link in chain:
                if link[0] == body:
                    link[1] = smallest if link[1] is None else link[1] if smallest is None else min(link[1], smallest)
                    link[2] += count
                    break
            else:
                chain.append([body, smallest, count])
        if done:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*done, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            done.clear()
    if chain:
        close()
        columns = [pa.array(values, kind) for values, kind in zip(zip(*done, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def build(df: DataFrame, fingerprints: DataFrame, doc_id: str, text: str, capacity: int, depth: int) -> DataFrame:
    """The index: one entry per different text, written to the shared folder."""
    keys = fingerprints.select("key").distinct()
    slots = F.broadcast(written(directory(keys, capacity, depth), "directory"))
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("body"))
    rows = rows.withColumn("key", F.xxhash64("body")).withColumn("slot", _slot(F.col("key"), depth))
    rows = rows.join(slots, "slot").select("bucket", "key", "body", "doc_id")
    merged = rows.mapInArrow(_merge_copies, "bucket int, key bigint, body string, doc_id bigint, n bigint")
    # A bucket is a range of keys that no other task holds.
    owned = merged.repartition("bucket").sortWithinPartitions("bucket", "key")
    return written(owned.mapInArrow(_own, _ENTRY), "index")


def groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, depth: int = DEPTH
) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    A null text is the empty text.  The row with the smallest id stays; a null id
    is above every id, and where all ids of a group are null, ``keep_id`` is null
    and all its rows stay.  Rows that repeat the smallest id all stay, as they
    cannot be told apart.  Other columns of ``df`` are not read.  An empty table
    gives an empty result.
    """
    body = normalised(F.col(f"`{text}`"))
    prints = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("body"))
    prints = prints.select("doc_id", F.xxhash64("body").alias("key"), F.sha2("body", 256).alias("text_sha256"))
    prints = written(prints, "fingerprints")
    index = build(df, prints, doc_id, text, capacity, depth).drop("bucket", "chain")
    found = prints.join(index, ["key", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
