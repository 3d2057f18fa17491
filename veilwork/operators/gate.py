"""The last check before text may be forwarded: no strict personal data left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions.masking import has_strict_pii
from veilwork.functions.once import evaluated_once
from veilwork.sources.requests import is_text, json_body, written_text


def generate_gate(lines: DataFrame, value: str = "value") -> DataFrame:
    """Outcome per forwarding request.

    Adds ``sanitized_prompt``, ``provider``, ``model``, ``reason``, ``code`` and
    ``audit``.  The prompt must be a JSON string; a number or an object is as
    good as missing.  The provider has a default only where its key is absent.
    """
    body = lines.select(
        "*",
        json_body(F.col(value), "sanitized_prompt", "provider", "model").alias("_body"),
        F.json_object_keys(F.col(value)).alias("_keys"),
    )
    text_of = lambda name: written_text(F.col(value), name, F.col(f"_body.{name}"))
    has_provider = F.coalesce(F.array_contains("_keys", "provider"), F.lit(False))
    fields = body.select(
        *lines.columns,
        F.col("_body").isNotNull().alias("_valid"),
        F.when(is_text(F.col("_body.sanitized_prompt")), text_of("sanitized_prompt")).alias("sanitized_prompt"),
        F.when(has_provider, text_of("provider"))
        .when(F.col("_body").isNotNull(), F.lit(fv.DEFAULT_PROVIDER))
        .alias("provider"),
        text_of("model").alias("model"),
    )
    text = F.col("sanitized_prompt")
    reason = (
        F.when(~F.col("_valid"), "invalid_body")
        .when(text.isNull() | (text == ""), "missing_prompt")
        .when(has_strict_pii(text), "contains_pii")
        .otherwise("forward")
    )
    shown = [F.col(name) for name in ("sanitized_prompt", "provider", "model")]
    decided = evaluated_once(fields, lines.columns, [*shown, reason.alias("reason")])
    return decided.select(
        "*",
        F.when(F.col("reason") == "forward", 200).otherwise(400).alias("code"),
        (F.col("reason") == "contains_pii").alias("audit"),
    )


def split(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forwarded and rejected requests."""
    forward = F.col("reason") == "forward"
    return gated.filter(forward), gated.filter(~forward)
