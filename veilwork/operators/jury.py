"""The redaction jury: several detectors, one winner per row.

All steps are projections of the row itself: no shuffle, any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import masking, spans
from veilwork.functions.once import evaluated_once
from veilwork.operators.detectors import (
    DETECTORS,
    SLOTS,
    STRICT,
    with_counts,
    with_guards,
    with_mask,
    working_columns,
)


def detector_output(df: DataFrame, detector, text: str = "prompt") -> DataFrame:
    """One detector alone: ``redacted`` text and its three counts."""
    masked = with_mask(with_counts(df, text, [detector]), text, [detector], "redacted")
    counts = [f"{detector.slot_sum(slot)} AS count_{slot}" for slot in SLOTS]
    return masked.selectExpr("*", *counts).drop(*working_columns([detector]))


def _score_name(detector) -> str:
    return f"score_{detector.name.lower()}"


def _score(detector, weights) -> str:
    factors = (weights or {}).get(detector.name, {})
    terms = [f"({detector.slot_sum(slot)}) * {_number(factors.get(slot, 1))}" for slot in SLOTS]
    return " + ".join(terms) if factors else " + ".join(detector.hit_columns())


def _number(value: float) -> str:
    return f"{value}D" if isinstance(value, float) else str(int(value))


def _best(detectors) -> str:
    names = [_score_name(detector) for detector in detectors]
    return f"greatest({', '.join(names)})" if len(names) > 1 else names[0]


def _winner(text: str, detectors) -> str:
    wins = " ".join(f"WHEN {_score_name(d)} = {_best(detectors)} THEN '{d.name}'" for d in detectors[:-1])
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN NULL {wins} ELSE '{detectors[-1].name}' END"


def jury_scores(df: DataFrame, text: str = "prompt", detectors=DETECTORS, weights=None) -> DataFrame:
    """Counts ``<tool>_<slot>``, ``score_<tool>`` and ``winning_tool`` per row.

    The first detector with the highest score wins; null and empty texts have
    no winner.  ``weights`` maps detector name to a factor per slot.
    """
    slots = [f"{d.slot_sum(slot)} AS {d.name.lower()}_{slot}" for d in detectors for slot in SLOTS]
    scores = [f"{_score(d, weights)} AS {_score_name(d)}" for d in detectors]
    scored = with_counts(df, text, detectors).selectExpr("*", *slots, *scores)
    return scored.selectExpr("*", f"{_winner(text, detectors)} AS winning_tool")


def redaction_jury(df: DataFrame, text: str = "prompt", detectors=DETECTORS, weights=None) -> DataFrame:
    """The whole jury result: ``sanitized`` text, winner, scores and counts."""
    scored = jury_scores(df, text, detectors, weights)
    masked = with_mask(scored, text, detectors, "sanitized", chosen="winning_tool")
    return masked.drop(*working_columns(detectors))


def scores_only(df: DataFrame, text: str = "prompt", detectors=DETECTORS, weights=None) -> DataFrame:
    """As ``redaction_jury`` without the masked text."""
    return jury_scores(df, text, detectors, weights).drop(*working_columns(detectors))


def winner_count(slot: str, detectors=DETECTORS) -> Column:
    """The winning detector's count for a slot, 0 where there is no winner."""
    counts = " ".join(f"WHEN '{d.name}' THEN {d.name.lower()}_{slot}" for d in detectors)
    return F.expr(f"CASE winning_tool {counts} ELSE 0 END")


def winner_score(detectors=DETECTORS) -> Column:
    """The highest score of the row."""
    return F.expr(_best(detectors))


def was_masked(text: str = "prompt") -> Column:
    """The jury changed the text: judged by the text itself, whatever the scores and weights."""
    return ~F.col("sanitized").eqNullSafe(F.coalesce(F.col(text), F.lit("")))


def redacted_only(judged: DataFrame, text: str = "prompt") -> DataFrame:
    """Rows of ``redaction_jury`` results whose text was changed."""
    return judged.filter(was_masked(text) & F.col(text).isNotNull())


def consensus(df: DataFrame, text: str = "prompt", detectors=DETECTORS, needed: int = 2) -> DataFrame:
    """Per kind of data: how many detectors report it and whether enough agree.

    The dictionary detector reports names and locations, which no other
    detector looks for, so those count under their own kinds.
    """
    kinds: dict[str, list[str]] = {}
    for detector in detectors:
        for step in detector.steps:
            kinds.setdefault(step.kind, []).append(f"int({detector.hit_column(step.kind)} > 0)")
    votes = [f"{' + '.join(hits)} AS votes_{kind}" for kind, hits in kinds.items()]
    voted = with_counts(df, text, detectors).selectExpr("*", *votes).drop(*working_columns(detectors))
    return voted.selectExpr("*", *[f"votes_{kind} >= {needed} AS agreed_{kind}" for kind in kinds])


def redact_pii(df: DataFrame, text: str = "prompt", out: str = "redacted") -> DataFrame:
    """Strict masks only."""
    return df.select("*", masking.redact_pii(F.col(text)).alias(out))


def detect_pii_counts(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Strict counts only; 0 on null."""
    counts = [f"{STRICT.slot_sum(slot)} AS count_{slot}" for slot in SLOTS]
    return with_counts(df, text, [STRICT]).selectExpr("*", *counts).drop(*working_columns([STRICT]))


def _inputs(detectors) -> list[str]:
    return [name for detector in detectors for name in detector.inputs()]


def _tagged_spans(order: int, detector, step) -> Column:
    """The spans of one step of a detector with what a hit needs to be told and masked."""
    found = F.coalesce(F.col(detector.hit_column(step.kind)), F.array().cast(f"array<{spans.SPAN}>"))
    return F.transform(
        found,
        lambda span: F.struct(
            span["start"].alias("start"), span["end"].alias("end"), F.lit(order).alias("order"),
            F.lit(detector.name).alias("tool"), F.lit(step.kind).alias("kind"), F.lit(step.mask).alias("mask"),
        ),
    )


def _with_all_spans(df: DataFrame, text: str, detectors) -> DataFrame:
    """Add ``_hits``: the spans of all hits of all detectors with ``order``, ``tool``, ``kind`` and ``mask``."""
    found = with_guards(df, text, detectors)
    for detector in detectors:
        found = detector.with_spans(found, text)
    steps = [(detector, step) for detector in detectors for step in detector.steps]
    tagged = [_tagged_spans(order, detector, step) for order, (detector, step) in enumerate(steps)]
    return evaluated_once(found, df.columns, [F.concat(*tagged).alias("_hits")])


def jury_union(df: DataFrame, text: str = "prompt", detectors=DETECTORS) -> DataFrame:
    """The masks of all detectors together, instead of the winner's alone.

    All hits are those in the original text.  Overlapping hits become one masked stretch, with the
    mask of the hit that starts first (then of the longest, then of the first detector), so no
    stretch is masked twice and nothing found by any detector is left.  Adds ``sanitized``, ``hits``,
    ``masked_spans`` and ``masked_chars``; a null text stays null, without hits.
    """
    found = _with_all_spans(df, text, detectors).select("*", spans.union(F.col("_hits")).alias("_spans"))
    found = evaluated_once(found, [*df.columns, "_hits"], ["_spans"])
    length = F.aggregate("_spans", F.lit(0), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        *[F.col(f"`{name}`") for name in df.columns],
        spans.masked(F.col(text), F.col("_spans")).alias("sanitized"),
        F.size("_hits").alias("hits"),
        F.size("_spans").alias("masked_spans"),
        length.alias("masked_chars"),
    )


def finding_spans(df: DataFrame, key: list[str], text: str = "prompt", detectors=DETECTORS) -> DataFrame:
    """One row per hit: key, detector, kind, and its place in the text in code points (end not included)."""
    found = _with_all_spans(df.select(*key, text, *_inputs(detectors)), text, detectors)
    return found.select(*key, F.inline("_hits")).select(*key, "tool", "kind", "start", "end")


def findings(df: DataFrame, key: list[str], text: str = "prompt", detectors=DETECTORS) -> DataFrame:
    """One row per hit: key, detector, kind, position among its hits, matched text."""
    found = with_guards(df.select(*key, text, *_inputs(detectors)), text, detectors)
    for detector in detectors:
        found = detector.with_matches(found, text)
    hits = [_tagged(detector, step.kind) for detector in detectors for step in detector.steps]
    return found.select(*key, F.inline(F.concat(*hits)))


def _tagged(detector, kind: str) -> Column:
    """Matches as structs with their detector, kind and position."""
    matches = F.coalesce(F.col(detector.hit_column(kind)), F.expr("array()"))
    return F.transform(
        matches,
        lambda match, position: F.struct(
            F.lit(detector.name).alias("tool"),
            F.lit(kind).alias("kind"),
            position.alias("pos"),
            match.alias("match"),
        ),
    )
