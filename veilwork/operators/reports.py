"""Reports over the audit table and over jury results.

All groupings have few groups and are reduced inside each task first, so only
a handful of rows per task is shuffled however the input is skewed.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.schemas import TOOL_COUNTS
from veilwork.sources.audit_table import from_time


def window_start(as_of: datetime, hours: int = fv.REPORT_HOURS) -> datetime:
    """Start of a reporting window that ends at ``as_of``."""
    return as_of - timedelta(hours=hours)


def _long_sum(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0))


def blocked_count(events: DataFrame, since: datetime) -> DataFrame:
    """Denied requests since ``since``."""
    denied = from_time(events, since).filter(F.col("event_type") == fv.DENIED)
    return denied.agg(F.count("*").alias("total_blocked"))


def pii_totals(events: DataFrame, since: datetime, event_types=(fv.REDACTED,), phones: bool = False) -> DataFrame:
    """Redacted ids and e-mails since ``since``, 0 where there are none.

    ``event_types`` may add the jury's events and ``phones`` the phone total.
    """
    kept = from_time(events, since).filter(F.col("event_type").isin(list(event_types)))
    totals = [_long_sum("count_id").alias("malaysian_ic"), _long_sum("count_email").alias("emails")]
    return kept.agg(*totals, *([_long_sum("count_phone").alias("phones")] if phones else []))


def intent_frequency(events: DataFrame, since: datetime | None = None) -> DataFrame:
    """Forbidden intents by frequency; ties in the order they were first seen."""
    denied = events.filter((F.col("event_type") == fv.DENIED) & (F.col("forbidden_intents") != ""))
    if since is not None:
        denied = from_time(denied, since)
    listed = denied.select("ts", "id", F.posexplode(F.split("forbidden_intents", ";")).alias("pos", "intent"))
    counted = listed.groupBy("intent").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "id", "pos")).alias("_first")
    )
    ordered = counted.orderBy(F.col("n").desc(), "_first", "intent")
    return ordered.select("intent", "n", F.col("_first.id").alias("first_seen_id"))


def audit_summary(events: DataFrame, as_of: datetime, hours: int = fv.REPORT_HOURS, event_types=(fv.REDACTED,)) -> DataFrame:
    """Blocked requests, redaction totals and intents of a window, as ``(section, item, value)``.

    The totals are one conditional aggregate over one filtered scan.
    """
    since = window_start(as_of, hours)
    kinds = [fv.DENIED, *event_types]
    recent = from_time(events, since).filter(F.col("event_type").isin(kinds))
    redacted = F.col("event_type").isin(list(event_types))
    of_redacted = lambda name: F.coalesce(
        F.sum(F.when(redacted, F.col(name).cast("bigint"))), F.lit(0)
    )
    totals = recent.agg(
        F.count_if(F.col("event_type") == fv.DENIED).alias("blocked"),
        of_redacted("count_id").alias("ids"),
        of_redacted("count_email").alias("emails"),
    )
    as_rows = totals.selectExpr(
        "stack(3, 'blocked', 'total_blocked', blocked,"
        " 'pii_redacted', 'malaysian_ic', ids, 'pii_redacted', 'emails', emails) AS (section, item, value)"
    )
    intents = intent_frequency(events, since).select(
        F.lit("intent").alias("section"), F.col("intent").alias("item"), F.col("n").alias("value")
    )
    return as_rows.unionByName(intents)


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def token_usage(events: DataFrame) -> DataFrame:
    """Tokens reported in usage messages, by role."""
    tokens = F.regexp_extract("message", r"'total_tokens': (\d+)", 1).try_cast("bigint")
    usage = events.filter(F.col("event_type") == fv.TOKEN_USAGE).select("user_role", tokens.alias("tokens"))
    return usage.groupBy("user_role").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens")
    )


RECENT_COLUMNS = [
    "id", "ts", "event_type", "request_id", "user_role", "endpoint", "message", "count_id",
    "count_phone", "count_email", "winning_tool", "tool_a_counts", "tool_b_counts", "tool_c_counts", "signature",
]


def recent_events(events: DataFrame, n: int = fv.RECENT_EVENTS) -> DataFrame:
    """The latest events, newest first; equal times by descending id."""
    return events.select(*RECENT_COLUMNS).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def latest_event(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """The newest row by time, then id, of one event type or of all."""
    kept = events if event_type is None else events.filter(F.col("event_type") == event_type)
    return kept.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(1)


def sample_events(events: DataFrame, event_type: str, n: int = 5) -> DataFrame:
    """A few events of a type, the oldest first; equal times by id."""
    return events.filter(F.col("event_type") == event_type).orderBy("ts", "id").limit(n)


def audit_log_view(events: DataFrame) -> DataFrame:
    """The audit log as shown to people."""
    shown = recent_events(events)
    tool = F.col("winning_tool")
    count = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    return shown.select(
        "id",
        "ts",
        "event_type",
        "user_role",
        F.when(F.coalesce(tool, F.lit("")) == "", "N/A").otherwise(F.concat(F.lit("Tool "), tool)).alias("winner"),
        F.concat(
            F.lit("ID: "), count("count_id"), F.lit(", Phone: "), count("count_phone"),
            F.lit(", Email: "), count("count_email"),
        ).alias("items_detected"),
        F.concat(
            F.coalesce(F.substring(F.nullif("signature", F.lit("")), 1, fv.SIGNATURE_PREVIEW_CHARS), F.lit("N/A")),
            F.lit("..."),
        ).alias("signature_preview"),
    )


def reliability_view(events: DataFrame) -> DataFrame:
    """Per-tool detections of those recent events that have a winner."""

    def detections(column: str) -> Column:
        counts = F.from_json(F.col(column), TOOL_COUNTS)
        has_keys = F.coalesce(F.size(F.json_object_keys(F.col(column))), F.lit(0)) > 0
        part = lambda name: F.coalesce(counts[name], F.lit(0)).cast("string")
        return F.when(has_keys, F.concat(part("id"), F.lit(" ID, "), part("phone"), F.lit(" Phone"))).otherwise("-")

    judged = recent_events(events).filter(F.coalesce("winning_tool", F.lit("")) != "")
    return judged.select(
        "id",
        detections("tool_a_counts").alias("tool_a"),
        detections("tool_b_counts").alias("tool_b"),
        detections("tool_c_counts").alias("tool_c"),
        F.concat(F.lit("Tool "), "winning_tool").alias("winner"),
    )


# The tools of the reports below, where no others are given.
TOOLS = tuple(fv.SCORE_LABELS)

# --- metrics over jury results -------------------------------------------------


def tool_win_rate(judged: DataFrame) -> DataFrame:
    """Wins per tool and the number of rows that have a winner."""
    wins = judged.filter(F.col("winning_tool").isNotNull()).groupBy("winning_tool").agg(F.count("*").alias("wins"))
    # At most one row per tool reaches this point.
    total = F.sum("wins").over(Window.partitionBy(F.lit(1)))
    return wins.select("winning_tool", "wins", total.alias("judged_rows"))


def tool_avg_detections(judged: DataFrame, tools=TOOLS) -> DataFrame:
    """Detections per tool as sum and row count; divide for the average."""
    rows = judged.filter(F.col("winning_tool").isNotNull())
    totals = rows.agg(F.count("*").alias("n"), *[_long_sum(f"score_{t.lower()}").alias(f"hits_{t}") for t in tools])
    listed = ", ".join(f"'{t}', hits_{t}, n" for t in tools)
    return totals.selectExpr(f"stack({len(tools)}, {listed}) AS (tool, detections, judged_rows)")


def tool_agreement(judged: DataFrame, tools=TOOLS) -> DataFrame:
    """How the tools' scores compare pairwise: -1, 0 or 1 per pair."""
    low = [t.lower() for t in tools]
    pairs = [(x, y) for i, x in enumerate(low) for y in low[i + 1 :]]
    sign = lambda x, y: F.signum(F.col(f"score_{x}") - F.col(f"score_{y}")).cast("int")
    rows = judged.filter(F.col("winning_tool").isNotNull())
    return rows.groupBy(*[sign(x, y).alias(f"{x}_vs_{y}") for x, y in pairs]).agg(F.count("*").alias("n"))


def tool_by_input_type(judged: DataFrame, *columns: str, tools=TOOLS) -> DataFrame:
    """Rows, detections and wins per tool for each input type, with subtotals.

    ``level`` tells subtotals (columns rolled up) from rows whose type is NULL.
    """
    wins = [F.count_if(F.col("winning_tool") == t).alias(f"wins_{t.lower()}") for t in tools]
    hits = [_long_sum(f"score_{t.lower()}").alias(f"hits_{t.lower()}") for t in tools]
    return judged.rollup(*columns).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *hits, *wins
    )


def tool_by_role(judged: DataFrame, tools=TOOLS) -> DataFrame:
    """Wins per role, one column per tool."""
    pivot = judged.groupBy("role").pivot("winning_tool", list(tools)).agg(F.count(F.lit(1)))
    return pivot.select("role", *[F.coalesce(F.col(t), F.lit(0)).alias(f"wins_{t.lower()}") for t in tools])


def tool_trend_daily(judged: DataFrame, tools=TOOLS) -> DataFrame:
    """Wins and detections per day and tool."""
    rows = judged.filter(F.col("winning_tool").isNotNull())
    scores = [F.col(f"score_{t.lower()}") for t in tools]
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    day = F.window("ts", "1 day")["start"].cast("date").alias("day")
    return rows.groupBy(day, "winning_tool").agg(
        F.count("*").alias("wins"), F.sum(score.cast("bigint")).alias("detections")
    )
