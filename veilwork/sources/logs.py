"""Structured log lines: one JSON object per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions.times import iso_time
from veilwork.schemas import LOG_RECORD


def event_log_json(events: DataFrame, logger: str = "app") -> DataFrame:
    """Events as log lines in column ``line``; absent optional keys are left out."""
    level = F.when(F.col("event_type") == fv.DENIED, "WARNING").otherwise("INFO")
    exception = [F.col("exception")] if "exception" in events.columns else []
    record = F.struct(
        F.concat(iso_time(F.col("ts")), F.lit("Z")).alias("timestamp"),
        level.alias("level"),
        F.col("message"),
        F.lit(logger).alias("logger"),
        F.col("event_type"),
        F.col("request_id"),
        F.col("user_role"),
        F.col("endpoint"),
        *exception,
    )
    return events.select(F.to_json(record).alias("line"))


def read_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines as columns; unreadable lines have NULL everywhere."""
    return lines.select(F.from_json(F.col(line), LOG_RECORD).alias("_r")).select("_r.*")


def incident_log_filter(
    lines: DataFrame,
    request_ids: list[str] | None = None,
    event_types: list[str] | None = None,
    roles: list[str] | None = None,
) -> DataFrame:
    """Log records of the given requests, event types and roles."""
    records = read_log_lines(lines)
    for column, wanted in (("request_id", request_ids), ("event_type", event_types), ("user_role", roles)):
        if wanted is not None:
            records = records.filter(F.col(column).isin(wanted))
    return records


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Append log lines as text files."""
    lines.select("line").write.mode("append").text(path)
