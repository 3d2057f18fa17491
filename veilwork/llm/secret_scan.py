"""Secrets in texts: known forms, and strings of high entropy, without user functions.

Known forms are regular expressions.  Positions come from splitting the text at the
matches: the lengths of the pieces and of the matches add up to them.

Further candidates are runs of key characters.  A window slides over a candidate;
the counts of its characters are kept up to date by the character that enters and
the one that leaves, and with them the sum of c * log2(c), from which the Shannon
entropy of the window follows.  Each character class has its own least entropy.
Logarithms are whole numbers (scaled and rounded once), so that sums are exact.
Candidates on the allow list and those that overlap a known form are left out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import held, whole

# Known forms (fixed values): kind, pattern, group that counts, its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
FORMS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ENTROPY = "entropy"

WINDOW = 20
SCALE = 1 << 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


class CharacterClass(NamedTuple):
    name: str
    pattern: str
    least_bits: float

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c) of a window with enough entropy."""
        return math.floor((math.log2(WINDOW) - self.least_bits) * WINDOW * SCALE)


# The first class whose pattern the whole candidate matches holds.
CLASSES = (
    CharacterClass("digits", r"^[0-9]+$", 2.6),
    CharacterClass("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
    CharacterClass("letters", r"^[A-Za-z]+$", 4.15),
    CharacterClass("base64", r"^[A-Za-z0-9+/_-]+$", 3.7),
)
# Candidates that contain one of these are not secrets.
ALLOWED = r"(?i)example|placeholder|x{8}|0123456789|^[0-9]*9876543210[0-9]*$|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-|^[a-z]+([-_/][a-z]+)+$"

# c * log2(c) for counts up to the window and one beyond.
WEIGHTS = tuple(round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 2))

_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places: array of (match, start, end), from 0, end exclusive."""
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(state: Column, at: Column) -> Column:
        start = state.getField("at") + F.get(state.getField("pieces"), at)
        match = F.get(state.getField("found"), at)
        end = start + F.length(match)
        place = F.struct(match.alias("match"), start.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"), state.getField("pieces").alias("pieces"), state.getField("found").alias("found"),
            F.concat(state.getField("done"), F.array(place)).alias("done"),
        )

    none = F.expr("cast(array() as array<struct<match: string, start: int, end: int>>)")
    start = F.struct(F.lit(0).alias("at"), pieces.alias("pieces"), found.alias("found"), none.alias("done"))
    # A text without a match is searched once.
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, walk, lambda state: state.getField("done"))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _spans_of(kind: int, text: Column) -> Column:
    """Spans of a known form whose counting group is long enough."""
    _, pattern, group, least = FORMS[kind]
    placed = _matches(text, pattern)
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        placed = F.zip_with(placed, values, lambda p, v: F.struct(
            p.getField("start").alias("start"), p.getField("end").alias("end"), F.length(v).alias("n")))
    else:
        placed = F.transform(placed, lambda p: F.struct(
            p.getField("start").alias("start"), p.getField("end").alias("end"),
            (p.getField("end") - p.getField("start")).alias("n")))
    long_enough = F.filter(placed, lambda p: p.getField("n") >= least)
    spans = F.transform(long_enough, lambda p: F.struct(
        p.getField("start").alias("start"), F.lit(kind).alias("kind"), p.getField("end").alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _entropy_window(candidate: Column) -> Column:
    """The first and last character (from 0, end exclusive) of the windows with enough entropy, or null."""
    most = F.lit(None).cast("long")
    for kind in reversed(CLASSES):
        most = F.when(candidate.rlike(kind.pattern), F.lit(kind.most).cast("long")).otherwise(most)
    size = F.length(candidate)
    codes = F.transform(
        F.sequence(F.lit(1), size), lambda i: F.instr(F.lit(ALPHABET), F.substring(candidate, i, F.lit(1)))
    )
    weight = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])

    def slide(limit: Column, code: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            counts, total = state.getField("counts"), state.getField("total")
            enters = F.get(code, at)
            leaves = F.when(at >= WINDOW, F.get(code, at - WINDOW)).otherwise(F.lit(0))
            up = F.get(counts, enters - 1)
            down = F.when(leaves > 0, F.get(counts, leaves - 1)).otherwise(F.lit(0))
            # The same character entering and leaving changes nothing.
            change = F.when(enters == leaves, F.lit(0).cast("long")).otherwise(
                F.get(weight, up + 1) - F.get(weight, up)
                + F.when(leaves > 0, F.get(weight, down - 1) - F.get(weight, down)).otherwise(F.lit(0).cast("long"))
            )
            moved = F.transform(
                counts, lambda c, k: c + (k == enters - 1).cast("int") - (k == leaves - 1).cast("int")
            )
            after = total + change
            good = (at >= WINDOW - 1) & (after <= limit)
            return F.struct(
                moved.alias("counts"), after.alias("total"),
                F.when(good & state.getField("first").isNull(), at - (WINDOW - 1)).otherwise(state.getField("first")).alias("first"),
                F.when(good, at + 1).otherwise(state.getField("last")).alias("last"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), F.lit(len(ALPHABET))).alias("counts"), F.lit(0).cast("long").alias("total"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(code) - 1), start, step,
            lambda state: F.struct(state.getField("first").alias("first"), state.getField("last").alias("last")),
        )

    return _let(codes, lambda code: _let(most, lambda limit: slide(limit, code)))


def _entropy_spans(text: Column, base: Column) -> Column:
    candidates = F.filter(_matches(text, CANDIDATE), lambda p: ~p.getField("match").rlike(ALLOWED))
    free = F.filter(candidates, lambda p: ~F.exists(
        base, lambda b: (b.getField("start") < p.getField("end")) & (p.getField("start") < b.getField("end"))))
    windows = F.transform(free, lambda p: F.struct(
        p.getField("start").alias("at"), _entropy_window(p.getField("match")).alias("w")))
    good = F.filter(windows, lambda x: x.getField("w").getField("first").isNotNull())
    return F.transform(good, lambda x: F.struct(
        (x.getField("at") + x.getField("w").getField("first")).alias("start"), F.lit(len(FORMS)).alias("kind"),
        (x.getField("at") + x.getField("w").getField("last")).alias("end")))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(form[0]) for form in FORMS], F.lit(ENTROPY))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s.getField("kind")), s.getField("start").cast("string"), s.getField("end").cast("string"))), ",")


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row as a struct), ``base`` and ``added`` spans, and both as text.

    Spans are arrays of (start, kind, end), in code points from 0, end exclusive, by
    start, then kind; ``base_spans`` and ``spans`` are ``kind:start:end`` joined by
    commas.  A null or empty text has no spans.  Rows are scanned one by one: repeated
    rows get equal results, and an empty table gives an empty result.
    """
    body = whole(F.col("row").getField(text))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    step = held(packed, ["row"], body=body)
    forms = F.concat(*[_spans_of(kind, F.col("body")) for kind in range(len(FORMS))])
    step = held(step, ["row", "body"], base=F.sort_array(forms))
    none = F.expr(f"cast(array() as {_SPANS})")
    added = F.when(F.col("body").rlike(CANDIDATE), _entropy_spans(F.col("body"), F.col("base"))).otherwise(none)
    step = held(step, ["row", "base"], added=added)
    return step.select(
        "row", "base", "added",
        _told(F.col("base")).alias("base_spans"),
        _told(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
