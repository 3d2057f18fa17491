"""Whole request flows, from body to response and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.operators import events, jury, policy
from veilwork.operators.detectors import DETECTORS, SLOTS
from veilwork.sources.reference_data import Policy


def reliability_summary(detectors=DETECTORS) -> Column:
    """The summary part of a response, from the jury columns of ``detectors``."""
    labels = {d.name: fv.SCORE_LABELS.get(d.name, f"Tool_{d.name}_Count") for d in detectors}
    scores = [F.col(f"score_{tool.lower()}").alias(label) for tool, label in labels.items()]
    counts = [
        F.struct(*[F.col(f"{tool.lower()}_{slot}").alias(slot) for slot in SLOTS]).alias(f"Tool_{tool}")
        for tool in labels
    ]
    return F.struct(
        F.col("winning_tool").alias("winning_tool"),
        F.struct(*scores).alias("tool_comparison"),
        F.struct(*counts).alias("detailed_counts"),
    )


def sanitize(
    requests: DataFrame, rules: Policy = Policy(), valid: str | None = None, detectors=DETECTORS, weights=None
) -> DataFrame:
    """Every request with its outcome and, where admitted, the jury's result.

    One pass: a request that is not admitted carries no text into the jury, so
    no pattern runs on it.  Batch and streaming input give the same rows.
    """
    decided = policy.sanitize_disposition(requests, rules, valid)
    admitted = decided.withColumn("_admitted", F.when(F.col("code") == 200, F.col("prompt")))
    judged = jury.redaction_jury(admitted, "_admitted", detectors, weights)
    return judged.select(
        *[F.col(name) for name in judged.columns if name not in ("_admitted", "status")],
        F.when(F.col("code") == 200, "sanitized").otherwise("denied").alias("status"),
    )


def sanitize_audit(sanitized: DataFrame, raw_text: bool = False, detectors=DETECTORS) -> DataFrame:
    """Audit rows of ``sanitize`` results of the same ``detectors``; needs ``ts`` and ``request_id``."""
    return events.jury_events(sanitized.filter(F.col("code") == 200), raw_text, detectors=detectors)


def verify(requests: DataFrame, rules: Policy = Policy(), valid: str | None = None) -> DataFrame:
    """Every verify request with its outcome."""
    return policy.verify_disposition(requests, rules, valid)


def verify_audit(verified: DataFrame, raw_text: bool = False) -> DataFrame:
    """Audit rows of ``verify`` results; needs ``ts`` and ``request_id``."""
    return events.denied_events(verified, raw_text)
