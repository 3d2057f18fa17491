"""Times without a zone, always UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """A literal of the type the audit table stores, so that filters on it reach the files."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def iso_time(ts: Column) -> Column:
    """ISO text of a timestamp without zone; the fraction, of six digits, only where there is one.

    Built from the value's own text: a formatter would go through the time zone of
    the session, which has no such hour where clocks are put forward.
    """
    text = F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def utc_time(seconds: Column) -> Column:
    """Seconds since 1970 as a UTC timestamp without zone, whatever the zone of the session."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = F.floor(seconds)
    micros = F.round((seconds - whole) * 1_000_000).cast("bigint")
    return start + F.make_dt_interval(secs=whole.cast("decimal(18,6)") + micros / F.lit(1_000_000).cast("decimal(18,6)"))


def parsed_time(text: Column) -> Column:
    """ISO text, with ``Z`` or without, as a timestamp without zone; NULL where it is none."""
    return F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz")
