"""The summary over an audit table, with its integrity check, in one reading of the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions.once import evaluated_once
from veilwork.functions.times import at
from veilwork.operators import integrity, reports

_FACT = ["section", "item", "id", "value"]


def _facts(checked: DataFrame, as_of: datetime, hours: int, event_types) -> DataFrame:
    """What each row adds to the report, summed per section, item and tampered id.

    A row adds few facts and sums are formed in each task, so what is shuffled is small but for the
    ids of tampered rows.
    """
    recent = F.col("ts") >= at(reports.window_start(as_of, hours))
    denied = recent & (F.col("event_type") == fv.DENIED)
    redacted = recent & F.col("event_type").isin(list(event_types))

    def fact(section: str, item, value, id_=None):
        columns = (F.lit(section), item, F.lit(None) if id_ is None else id_, value)
        types = ("string", "string", "bigint", "bigint")
        return F.struct(*[c.cast(t).alias(name) for c, t, name in zip(columns, types, _FACT, strict=True)])

    one = F.lit(1)
    intents = F.when(denied & (F.col("forbidden_intents") != ""), F.split("forbidden_intents", ";"))
    listed = F.concat(
        F.array(
            F.when(denied, fact("blocked", F.lit("total_blocked"), one)),
            F.when(redacted, fact("pii_redacted", F.lit("malaysian_ic"), F.coalesce("count_id", F.lit(0)))),
            F.when(redacted, fact("pii_redacted", F.lit("emails"), F.coalesce("count_email", F.lit(0)))),
            F.when(~F.col("valid"), fact("tampered_id", F.col("id"), one, F.col("id"))),
        ),
        F.transform(F.coalesce(intents, F.array().cast("array<string>")), lambda intent: fact("intent", intent, one)),
    )
    rows = evaluated_once(checked, [], [F.array_compact(listed).alias("facts")]).select(F.inline("facts"))
    return rows.groupBy("section", "item", "id").agg(F.sum("value").alias("value"))


def audit_report(
    events: DataFrame, keyring: DataFrame, as_of: datetime, hours: int = fv.REPORT_HOURS, key_id: str | None = None,
    event_types=(fv.REDACTED,), shown: int = fv.TAMPERED_SHOWN,
) -> DataFrame:
    """Rows ``(section, item, value)`` of the window ending at ``as_of``.

    Totals and intents are of the window; integrity is of the whole table.  All parts read the same
    shuffle of sums: filters stay above it, so Spark takes it for one and reads and verifies
    the table once.
    """
    checked = integrity.verify(events, keyring, key_id)
    sums = _facts(checked, as_of, hours, event_types)
    told = lambda: evaluated_once(sums, [], _FACT)
    zeros = events.sparkSession.range(1).selectExpr(
        "stack(3, 'blocked', 'total_blocked', 0L, 'pii_redacted', 'malaysian_ic', 0L, 'pii_redacted', 'emails', 0L)"
        " AS (section, item, value)"
    )
    counted = told().filter("section <> 'tampered_id'").select("section", "item", "value")
    totals = counted.unionByName(zeros).groupBy("section", "item").agg(F.sum("value").alias("value"))
    bad = told().filter("section = 'tampered_id'")
    rollup = bad.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n")).selectExpr(
        "stack(2, 'integrity', 'ok', cast(n = 0 AS bigint), 'integrity', 'tampered_rows', n) AS (section, item, value)"
    )
    # An id stands there as often as rows have it.
    copies = F.explode(F.sequence(F.lit(1), F.least("value", F.lit(shown)).cast("int")))
    first = bad.orderBy(F.col("id").asc_nulls_first()).limit(shown).select("*", copies).orderBy(F.col("id").asc_nulls_first()).limit(shown)
    first = first.select("section", "item", F.lit(1).cast("bigint").alias("value"))
    return totals.unionByName(rollup).unionByName(first)
