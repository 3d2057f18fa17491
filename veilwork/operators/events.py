"""Audit events: building, filtering, schema evolution, duplicates.

Every builder returns the unsigned audit columns; ``integrity.sign`` adds the
signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions import canonical, masking
from veilwork.operators import jury
from veilwork.functions.once import evaluated_once
from veilwork.functions.times import parsed_time, utc_time
from veilwork.operators.detectors import DETECTORS, SLOTS
from veilwork.schemas import ADDED_LATER, AUDIT_COLUMNS, AUDIT_EVENT, SIGNED_WITH


# Token counts of an answer, in the order of the message.
USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens")


def event_id(*fields: Column) -> Column:
    """A repeatable 63-bit id from all given fields; NULL differs from every text.

    The id tells events apart, it does not order them: order is by time, then id.
    """
    told = [F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields]
    digest = F.sha2(F.concat_ws("\u001f", *told), 256)
    part = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 31).bitwiseOR(F.shiftright(part(9), 1))


def _audit_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the unsigned audit columns; those not named get their defaults."""
    defaults = {
        "count_id": F.lit(0),
        "count_email": F.lit(0),
        "count_phone": F.lit(0),
        "metadata": F.lit("{}"),
    }
    typed = {}
    for field in AUDIT_EVENT.fields:
        if field.name not in ("id", "signature"):
            typed[field.name] = columns.get(field.name, defaults.get(field.name, F.lit(None))).cast(field.dataType)
    named = [value.alias(name) for name, value in typed.items()]
    if "id" in columns:
        return df.select(columns["id"].cast("bigint").alias("id"), *named)
    # The id is made of finished values, not of their expressions once more.
    rows = evaluated_once(df, [], named)
    return rows.select(event_id(*[F.col(name) for name in typed]).alias("id"), *typed)


def counts_json(prefix: str) -> Column:
    """The three counts of a tool as stored JSON text."""
    parts: list[Column] = []
    for i, slot in enumerate(SLOTS):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{slot}": '), F.col(f"{prefix}_{slot}").cast("string")]
    return F.concat(*parts, F.lit("}"))


def denied_events(verified: DataFrame, raw_text: bool = False) -> DataFrame:
    """Audit rows of denied verify requests (``verify_disposition`` with ``audit``).

    The message names role and prompt.  By default the prompt is masked in it;
    ``raw_text`` stores it as received.
    """
    shown = F.col("prompt") if raw_text else masking.redact_pii(F.col("prompt"))
    return _audit_row(
        verified.filter("audit"),
        ts=F.col("ts"),
        event_type=F.lit(fv.DENIED),
        request_id=F.col("request_id"),
        user_role=F.col("role"),
        endpoint=F.lit(fv.VERIFY_ENDPOINT),
        message=F.format_string(fv.DENIED_MESSAGE, F.col("role"), shown),
        forbidden_intents=F.col("forbidden_intents"),
    )


def jury_events(judged: DataFrame, raw_text: bool = False, prompt: str = "prompt", detectors=DETECTORS) -> DataFrame:
    """Audit rows of prompts the jury changed (``redaction_jury`` output of ``detectors``).

    The sample in the metadata is the first 200 characters, of the masked text
    by default and of the prompt as received with ``raw_text``.  The metadata has
    the scores of all detectors; the columns of single tools are filled for those
    of A, B and C that take part.
    """
    sample = F.substring(F.col(prompt if raw_text else "sanitized"), 1, fv.SAMPLE_CHARS)
    scores = []
    for place, detector in enumerate(detectors):
        scores += [F.lit((", " if place else "{") + f'"{detector.name}": '), F.col(f"score_{detector.name.lower()}")]
    metadata = F.concat(
        F.lit('{"original_prompt_sample": '),
        canonical.json_string(sample),
        F.lit(', "tool_scores": '),
        *[part.cast("string") for part in scores],
        F.lit("}}"),
    )
    named = {d.name for d in detectors}
    tools = {f"tool_{t.lower()}_counts": counts_json(t.lower()) for t in fv.SCORE_LABELS if t in named}
    masked = evaluated_once(judged, [c for c in judged.columns if c != "sanitized"], [F.col("sanitized")])
    return _audit_row(
        masked.filter(jury.was_masked(prompt)),
        ts=F.col("ts"),
        event_type=F.lit(fv.JURY_REDACTED),
        request_id=F.col("request_id"),
        user_role=F.col("role"),
        endpoint=F.lit(fv.SANITIZE_ENDPOINT),
        message=F.concat(F.lit(fv.JURY_MESSAGE_PREFIX), F.col("winning_tool")),
        count_id=jury.winner_count("id", detectors),
        count_email=jury.winner_count("email", detectors),
        count_phone=jury.winner_count("phone", detectors),
        winning_tool=F.col("winning_tool"),
        metadata=metadata,
        **tools,
    )


def gate_denied_events(gated: DataFrame) -> DataFrame:
    """Audit rows of forwarding requests rejected for personal data."""
    return _audit_row(
        gated.filter("audit"),
        ts=F.col("ts"),
        event_type=F.lit(fv.DENIED),
        request_id=F.col("request_id"),
        user_role=F.col("user_role"),
        endpoint=F.lit(fv.GENERATE_ENDPOINT),
        message=F.lit(fv.GATE_DENIED_MESSAGE),
    )


def token_events(responses: DataFrame) -> DataFrame:
    """Audit rows for model answers that report token usage.

    ``usage`` (a map of name to number) or, without it, the columns of
    ``USAGE_FIELDS`` that the table has are the usage; the message shows all of
    them that are not NULL.  Answers without any have no row.
    """
    if "usage" in responses.columns:
        shown = F.transform(
            F.map_entries("usage"),
            lambda e: F.when(e["value"].isNotNull(), F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))),
        )
    else:
        present = [name for name in USAGE_FIELDS if name in responses.columns]
        shown = F.array(*[F.concat(F.lit(f"'{name}': "), F.col(name).cast("string")) for name in present])
    parts = responses.withColumn("_usage", F.array_join(F.array_compact(shown), ", "))
    return _audit_row(
        parts.filter(F.col("_usage") != ""),
        ts=F.col("ts"),
        event_type=F.lit(fv.TOKEN_USAGE),
        request_id=F.col("request_id"),
        user_role=F.col("user_role"),
        endpoint=F.lit(fv.GENERATE_ENDPOINT),
        message=F.concat(F.lit(fv.TOKEN_USAGE_PREFIX), F.lit("{"), F.col("_usage"), F.lit("}")),
    )


def priority_events(df: DataFrame) -> DataFrame:
    """Events the audit table takes from the log."""
    return df.filter(F.col("event_type").isin(fv.PRIORITY_EVENTS))


def log_to_audit(records: DataFrame) -> DataFrame:
    """Priority log records as audit rows.

    Optional columns ``count_*``, ``forbidden_intents`` and ``metadata`` are
    taken where present and defaulted where absent or NULL.  Records as
    ``logs.read_log_lines`` gives them have their time as text in ``timestamp``,
    others may have seconds since 1970 in ``created``; both are read as UTC.
    """
    if "ts" not in records.columns:
        source = parsed_time(F.col("timestamp")) if "timestamp" in records.columns else utc_time(F.col("created"))
        records = records.withColumn("ts", source)
    kept = {"id", "ts", "event_type", "request_id", "user_role", "endpoint", "message"}
    columns = {name: F.col(name) for name in kept if name in records.columns}
    for name in ("count_id", "count_email", "count_phone"):
        if name in records.columns:
            columns[name] = F.coalesce(F.col(name), F.lit(0))
    if "forbidden_intents" in records.columns:
        columns["forbidden_intents"] = F.nullif(F.col("forbidden_intents"), F.lit(""))
    if "metadata" in records.columns:
        columns["metadata"] = F.coalesce(F.col("metadata"), F.lit("{}"))
    return _audit_row(priority_events(records), **columns)


def missing_columns(df: DataFrame) -> list[str]:
    """Audit columns the table does not have yet."""
    return [name for name in AUDIT_COLUMNS if name not in df.columns]


def to_audit_schema(df: DataFrame) -> DataFrame:
    """An audit table of any age in today's columns; the added ones read as NULL."""
    absent = missing_columns(df)
    unknown = set(absent) - set(ADDED_LATER)
    if unknown:
        raise ValueError(f"not an audit table, it lacks {sorted(unknown)}")
    types = {field.name: field.dataType for field in AUDIT_EVENT.fields}
    types |= {field.name: field.dataType for field in SIGNED_WITH.fields}
    absent += [name for name in SIGNED_WITH.fieldNames() if name not in df.columns]
    return df.select(
        *[
            (F.lit(None) if name in absent else F.col(name)).cast(types[name]).alias(name)
            for name in [*AUDIT_COLUMNS, *SIGNED_WITH.fieldNames()]
        ]
    )


def audit_schema_union(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Rows of an older and a newer audit table in one schema."""
    return newer.unionByName(older, allowMissingColumns=True)


# Columns in which copies of one event may differ.
NOT_COMPARED = ("id", "signature", "key_id", "payload_version", "event_date")


def copy_key(df: DataFrame) -> list[str]:
    """The columns that tell events apart: all but those written when a row is stored."""
    return [name for name in df.columns if name not in NOT_COMPARED]


def key_hash(names: list[str]) -> list[Column]:
    """128 bits of the named columns, in which NULL differs from every value."""
    marks = [F.col(name).isNull() for name in names]
    return [F.xxhash64(F.lit(seed), *[F.col(name) for name in names], *marks) for seed in (1, 2)]


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each event, the earliest by time and id.

    Copies agree in everything a row says; two events of one request stay two.
    Rows without a request id cannot be told to be copies and stay.  Each task keeps
    the first copy of an event before rows are shuffled, so an event with very many
    copies arrives as one row per task.
    """
    named = df.filter(F.col("request_id").isNotNull())
    one, two = key_hash(copy_key(df))
    keyed = named.select("*", one.alias("_one"), two.alias("_two"))
    first = F.row_number().over(Window.partitionBy("_one", "_two").orderBy("ts", "id"))
    kept = keyed.withColumn("_place", first).filter("_place = 1").drop("_one", "_two", "_place")
    return kept.unionByName(df.filter(F.col("request_id").isNull()))
