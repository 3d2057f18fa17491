"""Policies and keywords as tables or as Python values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork import fixed_values as fv


@dataclass(frozen=True)
class Policy:
    """Which intents each role may not show, and the phrases that show them."""

    role_intents: dict[str, list[str]] = field(default_factory=lambda: fv.ROLE_INTENTS)
    intent_keywords: dict[str, list[str]] = field(default_factory=lambda: fv.INTENT_KEYWORDS)

    @property
    def roles(self) -> list[str]:
        """Known roles; a role without any entry is unknown and denied."""
        return list(self.role_intents)

    @property
    def intents(self) -> list[str]:
        return list(dict.fromkeys(i for intents in self.role_intents.values() for i in intents))

    def roles_forbidding(self, intent: str) -> list[str]:
        return [role for role, intents in self.role_intents.items() if intent in intents]


def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table made of literals, so that the plan knows that it is small."""
    literals = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*literals)))


def role_table(spark: SparkSession, policy: Policy = Policy()) -> DataFrame:
    """One row per known role."""
    return _rows(spark, [(role,) for role in policy.roles], ["role"])


def policy_table(spark: SparkSession, policy: Policy = Policy()) -> DataFrame:
    """One row per role, forbidden intent and keyword; ``ord`` is policy order."""
    triples = [
        (role, intent, order, keyword)
        for role, intents in policy.role_intents.items()
        for order, intent in enumerate(intents)
        for keyword in policy.intent_keywords.get(intent, [])
    ]
    return _rows(spark, triples, ["role", "intent", "ord", "keyword"])


def term_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Word lists given in Python as a table (``kind``, ``term``); large ones are read from files instead."""
    return spark.createDataFrame(rows, "kind string, term string")


def read_policy(roles: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables ``(role, intent, ord)`` and ``(intent, keyword)`` as role and policy tables.

    Both stay tables, of any size.  A role whose intent is NULL, or has no
    keyword, is known and forbids nothing.
    """
    known = roles.select("role").distinct()
    rules = roles.filter(F.col("intent").isNotNull()).join(keywords, "intent")
    return known, rules.select("role", "intent", "ord", "keyword")
