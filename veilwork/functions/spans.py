"""Places of hits in a text, as Column expressions over arrays.

A span is a struct with ``start`` and ``end`` in code points, from 0, the end not included.
Work per text grows with its length and its hits, not with their product: sums and maxima run
over blocks, and a text is cut from blocks of itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries of an array that one running value goes over, and characters of a block of text.
_ENTRIES = 64
_CHARS = 16_384

SPAN = "struct<start:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(count: Column) -> Column:
    """0 to ``count - 1``; nothing where that is 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of an array of ints, what ``combine`` makes of each entry and all before it (a sum, a maximum).

    ``combine`` must be associative and leave 0 as it is for the numbers given.
    """
    total = lambda block: F.aggregate(block, F.lit(0), combine)

    def of(entries: Column) -> Column:
        count = F.ceil(F.size(entries) / F.lit(float(_ENTRIES))).cast("int")
        return let(
            F.transform(numbers(count), lambda b: F.slice(entries, b * _ENTRIES + 1, F.lit(_ENTRIES))),
            lambda blocks: let(
                F.aggregate(
                    F.transform(blocks, total), F.array(F.lit(0)),
                    lambda done, t: F.concat(done, F.array(combine(F.element_at(done, -1), t))),
                ),
                lambda before: F.flatten(F.transform(blocks, lambda block, b: F.transform(
                    block, lambda _, i: combine(F.get(before, b), total(F.slice(block, F.lit(1), i + 1)))
                ))),
            ),
        )

    return let(values, of)


def _sum(x: Column, y: Column) -> Column:
    return x + y


def matches(text: Column, regex: str, hit_group: int = 0) -> Column:
    """Spans of the hits of a Java expression; of ``hit_group`` 2 the part behind group 1.

    The parts between hits and the hits themselves, taken by two scans, tell where each begins.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(regex), F.lit(hit_group)) if hit_group else None

    def of(hits: Column) -> Column:
        parts = F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(parts, hits, lambda part, hit: F.length(part) + F.length(hit))
        sizes = F.transform(hits if kept is None else kept, lambda hit: F.length(hit))
        return F.zip_with(
            running(steps, _sum), sizes, lambda end, size: F.struct((end - size).alias("start"), end.alias("end"))
        )

    return F.when(text.rlike(regex), let(found, of)).otherwise(F.array().cast(f"array<{SPAN}>"))


def union(hits: Column) -> Column:
    """Overlapping spans of ``hits`` (start, end, order, mask) made one.

    A joined span goes from the first start to the last end and has the mask of the hit that
    starts first; of those, of the longest, then the one of the lowest ``order``.  Spans that only touch
    stay apart.
    """
    ranked = F.sort_array(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (-h["end"]).alias("until"), h["order"].alias("order"), h["mask"].alias("mask")
    )))

    def of(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: -s["until"]), lambda x, y: F.greatest(x, y))

        def joined(reach: Column) -> Column:
            opens = lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1))
            last = lambda firsts, j: F.coalesce(F.get(firsts, j + 1), F.size(spans)) - 1
            return let(F.filter(numbers(F.size(spans)), opens), lambda firsts: F.transform(firsts, lambda i, j: F.struct(
                F.get(spans, i)["start"].alias("start"),
                F.get(reach, last(firsts, j)).alias("end"),
                F.get(spans, i)["mask"].alias("mask"),
            )))

        return let(ends, joined)

    return let(ranked, of)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, mask) replaced by its mask; spans are in order and do not overlap."""
    count = F.floor(F.length(text) / F.lit(_CHARS)).cast("int") + 1
    blocks = F.transform(numbers(count), lambda b: F.substring(text, b * _CHARS + 1, F.lit(_CHARS)))

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / F.lit(_CHARS)).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(end / F.lit(_CHARS)).cast("int") - first + 1), "")
        return F.substring(near, start - first * _CHARS + 1, end - start)

    def of(pieces: Column, places: Column) -> Column:
        before = lambda j: F.coalesce(F.get(places, j - 1)["end"], F.lit(0))
        shown = F.transform(places, lambda s, j: F.concat(between(pieces, before(j), s["start"]), s["mask"]))
        return F.concat(F.array_join(shown, ""), between(pieces, before(F.size(places)), F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, lambda s: let(blocks, lambda b: of(b, s)))).otherwise(text)
