"""Keeping expensive columns from being evaluated again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, keep: list[str], columns: list[Column | str]) -> DataFrame:
    """Select ``keep`` and ``columns`` so that later filters use finished values.

    Spark pushes a filter below a projection by repeating the projected
    expression inside the filter, and a filter does not share work between its
    terms.  A generator of exactly one element is a step filters on its output
    stay above, while filters on the kept columns still pass through it.
    """
    return df.select(*[F.col(f"`{name}`") for name in keep], F.inline(F.array(F.struct(*columns))))
