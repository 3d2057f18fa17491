"""Detectors whose hits come from a function over Arrow batches.

For what no pattern can tell, such as a checksum.  The function gets a batch of texts and gives
the places of its hits; counts, masks, scores and findings are then made as for any other
detector.  Only the text column goes through Python, and only texts that pass the guard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import spans
from veilwork.operators.detectors import Detector

PLACES = "array<struct<rule:int,start:int,end:int>>"


@dataclass(frozen=True)
class VectorRule:
    """One kind of hit, the count slot it belongs to and the mask that replaces it."""

    kind: str
    slot: str
    mask: str


# Of a batch of texts: the text, the rule, the first byte and the byte behind the last of each hit,
# in order and without overlaps.  Bytes are those of ``texts``' UTF-8 data from the first text on.
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _batch_function(find: Finder):
    def hits_of(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        _, offsets, buffer = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        owner, rule, start, end = find(data, ends)
        # Code points before each byte, counted from the beginning of its text.
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        first = points[ends[owner]]
        fields = [pa.array(v, pa.int32()) for v in (rule, points[start] - first, points[end] - first)]
        bounds = np.searchsorted(owner, np.arange(len(ends))).astype(np.int32)
        places = pa.StructArray.from_arrays(fields, names=["rule", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(bounds), places)

    return F.arrow_udf(hits_of, PLACES)


class PlacedDetector(Detector):
    """A detector that knows the places of its hits: counts, matches and masks are made from them.

    Subclasses add the places, as ``rule``, ``start`` and ``end``, by ``_with_places``.
    """

    name: str
    rules: tuple[VectorRule, ...]

    @property
    def steps(self) -> tuple[VectorRule, ...]:
        return self.rules

    @property
    def _places(self) -> str:
        return f"_{self.name.lower()}_places"

    def working_columns(self) -> list[str]:
        return [*self.hit_columns(), self._places]

    def _with_places(self, df: DataFrame, text: str) -> DataFrame:
        raise NotImplementedError

    def _of_rule(self, number: int) -> Column:
        return F.filter(self._places, lambda hit: hit["rule"] == number)

    def with_counts(self, df: DataFrame, text: str) -> DataFrame:
        counts = [F.size(self._of_rule(k)).alias(name) for k, name in enumerate(self.hit_columns())]
        return self._with_places(df, text).select("*", *counts)

    def with_matches(self, df: DataFrame, text: str) -> DataFrame:
        """Add the matched texts of every rule as arrays."""
        found = self._with_places(df, text)
        cut = lambda hit: F.substring(F.col(text), hit["start"] + 1, hit["end"] - hit["start"])
        matched = [F.transform(self._of_rule(k), cut).alias(n) for k, n in enumerate(self.hit_columns())]
        return found.select("*", *matched).drop(self._places)

    def with_spans(self, df: DataFrame, text: str) -> DataFrame:
        """Add the places of every rule's hits as arrays."""
        found = self._with_places(df, text)
        place = lambda hit: F.struct(hit["start"].alias("start"), hit["end"].alias("end"))
        places = [F.transform(self._of_rule(k), place).alias(n) for k, n in enumerate(self.hit_columns())]
        return found.select("*", *places).drop(self._places)

    @property
    def rounds(self) -> int:
        return 1  # all rules are masked in one pass

    def found_before(self, number: int) -> str:
        return " + ".join(self.hit_columns())

    def masked(self, number: int, text: Column) -> Column:
        masks = F.array(*[F.lit(rule.mask) for rule in self.rules])
        shown = F.transform(self._places, lambda hit: F.struct(
            hit["start"].alias("start"), hit["end"].alias("end"), hit["rule"].alias("order"), F.get(masks, hit["rule"]).alias("mask")
        ))
        return spans.masked(text, spans.union(shown))


@dataclass(frozen=True)
class VectorDetector(PlacedDetector):
    """Counts and masks the hits that ``find`` reports; ``guard`` names texts that can have any."""

    name: str
    rules: tuple[VectorRule, ...]
    find: Finder
    guard: str | None = None

    @property
    def guards(self) -> frozenset[str]:
        return frozenset([self.guard] if self.guard else [])

    def _with_places(self, df: DataFrame, text: str) -> DataFrame:
        possible = F.when(F.col(f"_{self.guard}"), F.col(text)) if self.guard else F.col(text)
        found = _batch_function(self.find)(possible)
        return df.select("*", F.coalesce(found, F.array().cast(PLACES)).alias(self._places))


def _digit_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of ASCII digits, where each run of them begins (and the end), and the text of each digit.

    Digits of a run follow each other or have one space or dash between them.
    """
    at = np.flatnonzero((data >= 48) & (data <= 57))
    owner = np.searchsorted(ends, at, side="right") - 1
    gap = np.diff(at)
    joined = (gap == 1) | ((gap == 2) & np.isin(data[np.minimum(at[:-1] + 1, len(data) - 1)], (32, 45)))
    joined &= owner[1:] == owner[:-1]
    limits = np.flatnonzero(np.append(np.append(True, ~joined), True)) if len(at) else np.zeros(1, np.int64)
    return at, limits, owner


# Digits of a payment card number, at least and at most.
CARD_DIGITS = (13, 19)


def find_cards(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 13 to 19 digits, not all the same, whose last digit is the checksum of the others (Luhn)."""
    at, limits, owner = _digit_runs(data, ends)
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    first, size = limits[:-1], np.diff(limits)
    digit = (data[at] - 48).astype(np.int64)
    from_end = np.repeat(limits[1:], size) - 1 - np.arange(len(at))
    doubled = digit * 2 - 9 * (digit > 4)
    sums = np.add.reduceat(np.where(from_end % 2 == 1, doubled, digit), first)
    varied = np.maximum.reduceat(digit, first) != np.minimum.reduceat(digit, first)
    good = np.flatnonzero((size >= CARD_DIGITS[0]) & (size <= CARD_DIGITS[1]) & (sums % 10 == 0) & varied)
    start, end = at[first[good]], at[limits[1:][good] - 1] + 1
    return owner[first[good]], np.zeros(len(good), np.int64), start, end


CARDS = VectorDetector("V", (VectorRule("card", "id", "[REDACTED_CARD]"),), find_cards, "long_number")
