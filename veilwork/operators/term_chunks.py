"""Hits of a long list of terms, found chunk by chunk.

Windows of all texts are many times the texts, so they are not shuffled.  Texts are dealt once into chunks
of bounded size; a chunk asks for its different windows by 32-bit fingerprints, packed per bucket of
fingerprints; a bucket answers with the terms that have them; and the chunk looks its windows up in the
answers by the whole term, so fingerprints that clash cost a row and never make a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text of a chunk, and what is cut into windows at a time, in bytes.
CHUNK_BYTES = 8_000_000
_PIECE_BYTES = 1_000_000
_MOST_BUCKETS = 2048

HIT = pa.struct([(name, pa.int32()) for name in ("token", "tokens", "start", "end")])
HITS = "array<struct<token:int,tokens:int,start:int,end:int>>"

# Texts of these characters alone have the same words, at the same places, in lower case.  Others (a
# capital sigma, a dotted capital i, rare scripts) bring their windows as Spark's lower() makes them.
_EVEN = r"^[\x00-\x{12f}\x{131}-\x{36f}\x{400}-\x{4ff}\x{2000}-\x{206f}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{1f300}-\x{1faff}]*+$"

_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)


def _powers(base: int, count: int) -> np.ndarray:
    made = np.full(count, base, np.uint64)
    made[0] = 1
    return np.cumprod(made)


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits for each stretch of ``data``; equal stretches have equal ones."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_ODD, len(data) + 1)[:-1], out=sums[1:])
    found = (sums[end] - sums[start]) * _powers(pow(_ODD, -1, 2**64), len(data) + 1)[start]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return (found >> np.uint64(32)).astype(np.uint32)


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins (and the end)."""
    texts = texts.cast(pa.large_string())
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(buffer or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as strings."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at]))


class _Windows:
    """The windows of some rows: ``row``, ``token``, ``tokens``, ``start`` and ``end`` in code points, and their bytes."""

    def __init__(self, rows: pa.RecordBatch, longest: int):
        words, gaps, given = rows.column("words"), rows.column("gaps"), rows.column("given")
        count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        owner = np.repeat(np.arange(len(count)), count)
        nth = np.arange(first[-1]) - first[owner]
        # Each row has one gap more than words; the last one is no part of a window.
        before = gaps.flatten().take(pa.array(np.arange(first[-1]) + owner))
        word = words.flatten()
        self.data, ends = _parts(pc.binary_join_element_wise(before, word, ""))
        end = ends[1:]
        start = end - pc.binary_length(word).to_numpy(zero_copy_only=False)
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        origin = points[ends[:-1]][first[owner]] if len(owner) else np.zeros(0, np.int64)
        made = []
        for n in range(1, longest + 1):
            at = np.flatnonzero(nth + n <= count[owner])
            last = at + n - 1
            made.append((owner[at], nth[at], np.full(len(at), n), points[start[at]] - origin[at], points[end[last]] - origin[at], start[at], end[last]))
        self.row, self.token, self.tokens, self.start, self.end, self._from, self._to = (np.concatenate(x) for x in zip(*made, strict=True))
        if given.null_count < len(given):
            self._replace(given)

    def _replace(self, given: pa.Array) -> None:
        """Rows that bring their windows have them in the order of ``tokens``, then ``token``."""
        has = given.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(has[self.row])
        at = at[np.lexsort((self.token[at], self.tokens[at], self.row[at]))]
        more, ends = _parts(given.flatten())
        self._from[at], self._to[at] = len(self.data) + ends[:-1], len(self.data) + ends[1:]
        self.data = np.concatenate([self.data, more])

    def fingerprints(self) -> np.ndarray:
        return fingerprints(self.data, self._from, self._to)

    def texts(self) -> pa.Array:
        return _gathered(self.data, self._from, self._to)


def _pieces(table: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of bounded size and the number of the first."""
    batch = table.combine_chunks().to_batches()
    if not batch:
        return
    batch, sizes = batch[0], table.column("size").to_numpy().tolist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > _PIECE_BYTES:
            yield start, batch.slice(start, row - start)
            start, held = row, 0
        held += size
    yield start, batch.slice(start)


def _asked(longest: int, buckets: int):
    """chunk -> chunk, bucket, prints: the different fingerprints of its windows, per bucket."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        met = [np.unique(_Windows(piece, longest).fingerprints()) for _, piece in _pieces(rows)]
        prints = np.unique(np.concatenate(met))
        bucket = prints % buckets
        order = np.argsort(bucket, kind="stable")
        prints, bucket = prints[order], bucket[order]
        at, first = np.unique(bucket, return_index=True)
        parts = [part.tobytes() for part in np.split(prints, first[1:])] if len(at) else []
        return pa.table({
            "chunk": pa.array(np.full(len(at), key[0].as_py()), pa.int32()), "bucket": pa.array(at, pa.int32()), "prints": pa.array(parts, pa.binary()),
        })

    return ask


def _printed(buckets: int):
    """kind, window -> bucket, print, kind, window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _parts(batch.column("window"))
            prints = fingerprints(data, ends[:-1], ends[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints % buckets, pa.int32()), pa.array(prints.astype(np.int64)), batch.column("kind"), batch.column("window")],
                names=["bucket", "print", "kind", "window"],
            )

    return work


def _answered(asked: pa.Table, terms: pa.Table) -> pa.Table:
    """The terms of a bucket for each chunk that has their fingerprints."""
    prints = terms.column("print").to_numpy().astype(np.uint32)
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    chunks, found = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for chunk, packed in zip(asked.column("chunk").to_pylist(), asked.column("prints").to_pylist(), strict=True):
        wanted = np.sort(np.frombuffer(packed, np.uint32))
        place = np.searchsorted(wanted, prints)
        hit = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == prints) if len(wanted) else place[:0]
        chunks.append(np.full(len(hit), chunk, np.int32))
        found.append(order[hit])
    at = pa.array(np.concatenate(found))
    return pa.table({"chunk": pa.array(np.concatenate(chunks)), "kind": terms.column("kind").take(at), "window": terms.column("window").take(at)})


def _first_and_longest(segment: np.ndarray, token: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Of hits in order of segment, token and falling length, those that none kept before overlaps."""
    place = segment * (int((token + tokens).max()) + 1) + token
    after = np.searchsorted(place, place + tokens)
    if (after == np.arange(1, len(after) + 1)).all():
        return np.arange(len(after))
    kept, at, jumps = [], 0, after.tolist()
    while at < len(jumps):
        kept.append(at)
        at = jumps[at]
    return np.array(kept)


def _same_rows(rows: pa.Table, key: list[str]) -> np.ndarray:
    """For each row the first row with an equal key."""
    seen: dict[str, int] = {}
    keys = zip(*[rows.column(name).to_pylist() for name in key], strict=True)
    return np.array([seen.setdefault(repr(k), at) for at, k in enumerate(keys)], np.int64)


def _looked_up(longest: int, key: list[str]):
    """The hits of a chunk's rows per key and kind."""

    def look_up(rows: pa.Table, terms: pa.Table) -> pa.Table:
        names = [*key, "kind", "hits"]
        none = pa.table([*rows.select(key).slice(0, 0).columns, pa.array([], pa.string()), pa.array([], pa.list_(HIT))], names=names)
        if not rows.num_rows or not terms.num_rows:
            return none
        kinds = pc.dictionary_encode(terms.column("kind").combine_chunks())
        listed = pc.dictionary_encode(terms.column("window").cast(pa.large_string()).combine_chunks())
        window, kind = listed.indices.to_numpy(), kinds.indices.to_numpy().astype(np.int64)
        order = np.argsort(window, kind="stable")
        kind, first = kind[order], np.searchsorted(window[order], np.arange(len(listed.dictionary) + 1))
        owner, made = _same_rows(rows, key), []
        for begin, piece in _pieces(rows):
            windows = _Windows(piece, longest)
            found = pc.index_in(windows.texts(), value_set=listed.dictionary).fill_null(-1).to_numpy()
            at = np.flatnonzero(found >= 0)
            many = np.diff(first)[found[at]]
            each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            of_kind = kind[np.repeat(first[found[at]], many) + each]
            at = np.repeat(at, many)
            made.append((owner[begin + windows.row[at]], of_kind, windows.token[at], windows.tokens[at], windows.start[at], windows.end[at]))
        row, of_kind, token, tokens, start, end = (np.concatenate(x) for x in zip(*made, strict=True))
        if not len(row):
            return none
        order = np.lexsort((end, start, -tokens, token, of_kind, row))
        row, of_kind, token, tokens, start, end = (x[order] for x in (row, of_kind, token, tokens, start, end))
        opens = np.concatenate([[True], (row[1:] != row[:-1]) | (of_kind[1:] != of_kind[:-1])])
        segment = np.cumsum(opens) - 1
        kept = _first_and_longest(segment, token, tokens)
        # The first hit of every segment is kept, so no segment is empty.
        heads = np.flatnonzero(opens)
        bounds = np.searchsorted(segment[kept], np.arange(len(heads) + 1)).astype(np.int32)
        hits = pa.StructArray.from_arrays([pa.array(x[kept], pa.int32()) for x in (token, tokens, start, end)], fields=list(HIT))
        columns = [*[rows.column(name).take(pa.array(row[heads])) for name in key], kinds.dictionary.take(pa.array(of_kind[heads]))]
        return pa.table([*columns, pa.ListArray.from_arrays(pa.array(bounds), hits)], names=names)

    return look_up


def chunked_hits(
    df: DataFrame, key: list[str], text: str, terms: DataFrame, longest: int, token: str, windows: Column
) -> DataFrame:
    """``key``, ``kind`` and ``hits`` of the first and longest hits.

    ``terms`` has ``kind`` and ``window``, each once; ``token`` is the expression of a word; ``windows`` makes
    the array of a row's windows, by number of words, of its columns ``_words`` and ``_gaps``.
    """
    rows = df.filter(F.col(text) != "").select(*[F.col(f"`{name}`").alias(f"_key_{i}") for i, name in enumerate(key)], F.col(f"`{text}`").alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks = int(size // CHUNK_BYTES) + 1
    buckets = min(chunks, _MOST_BUCKETS)
    keys = [f"_key_{i}" for i in range(len(key))]
    # Both uses read the same exchange.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    even = F.col("_text").rlike(_EVEN)
    based = dealt.select("*", even.alias("_even"), F.when(even, F.lower("_text")).otherwise(F.col("_text")).alias("_base"))
    cut = based.select(
        *keys, "chunk", "_even", F.octet_length("_text").cast("long").alias("size"),
        F.regexp_extract_all("_base", F.lit(token), F.lit(0)).alias("_words"), F.split("_base", token, -1).alias("_gaps"),
    )
    cut = cut.select(*keys, "chunk", "size", F.col("_words").alias("words"), F.col("_gaps").alias("gaps"), F.when(~F.col("_even"), windows).alias("given"))
    asked = cut.groupBy("chunk").applyInArrow(_asked(longest, buckets), "chunk int, bucket int, prints binary")
    listed = terms.select("kind", "window").mapInArrow(_printed(buckets), "bucket int, print bigint, kind string, window string")
    answers = asked.groupBy("bucket").cogroup(listed.groupBy("bucket")).applyInArrow(_answered, "chunk int, kind string, window string")
    types = [df.schema[name].dataType.simpleString() for name in key]
    schema = ", ".join([*[f"{k} {kind}" for k, kind in zip(keys, types, strict=True)], "kind string", f"hits {HITS}"])
    found = cut.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_looked_up(longest, keys), schema)
    return found.select(*[F.col(k).alias(name) for k, name in zip(keys, key, strict=True)], "kind", "hits")
