"""Signing audit rows and finding rows that changed afterwards.

Signing and checking are projections of the row plus a broadcast of the
keyring, one row per key: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions import canonical
from veilwork.functions.times import at, iso_time
from veilwork.session import lookup_join

# Rows signed before key ids and tool counts were covered, and those with them.
PAYLOAD_V1, PAYLOAD_V2 = 1, 2


def with_payload(df: DataFrame, version: int | Column = PAYLOAD_V1) -> DataFrame:
    """Add ``_payload``, the signed text of a row: canonical JSON of its fields.

    Signing and verifying share it, so they cannot disagree.  Version 2 also
    covers the id, the key id and the three tool counts.  The version may differ
    from row to row; one that is not known has no payload.
    """
    intents = F.split(F.nullif(F.col("forbidden_intents"), F.lit("")), ";")
    members = {
        **{name: F.coalesce(F.col(name), F.lit(0)) for name in ("count_email", "count_id", "count_phone")},
        **{
            name: F.col(name)
            for name in ("endpoint", "event_type", "message", "request_id", "user_role", "winning_tool")
        },
        "forbidden_intents": F.coalesce(intents, F.array().cast("array<string>")),
        "metadata": canonical.json_value(F.col("metadata")),
        "ts": iso_time(F.col("ts")),
    }
    added = {name: F.col(name) for name in ("id", "key_id", "tool_a_counts", "tool_b_counts", "tool_c_counts")}

    def told(fields: dict[str, Column]) -> Column:
        ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
        return F.to_json(ordered, {"ignoreNullFields": "false"})

    if isinstance(version, int):
        if version not in (PAYLOAD_V1, PAYLOAD_V2):
            raise ValueError(f"unknown payload version {version}")
        text = told(members if version == PAYLOAD_V1 else members | added)
    else:
        text = F.when(version == PAYLOAD_V1, told(members)).when(version == PAYLOAD_V2, told(members | added))
    written = df.select("*", text.alias("_json"))
    return written.select(*df.columns, canonical.ascii_json(F.col("_json")).alias("_payload"))


def _with_signature(rows: DataFrame, keyring: DataFrame, version: int | Column, out: str) -> DataFrame:
    # The keyring is one local row per key.
    joined = lookup_join(with_payload(rows, version), keyring, "key_id", "left", small=True)
    signature = canonical.hmac_sha256(F.col("facts._payload"), F.col("lookup.ipad"), F.col("lookup.opad"))
    return joined.select(*[F.col(f"facts.{name}") for name in rows.columns], signature.alias(out))


def sign(df: DataFrame, keyring: DataFrame, key_id: str | Column, version: int = PAYLOAD_V2) -> DataFrame:
    """Add ``key_id``, ``payload_version`` and ``signature`` to unsigned audit rows.

    ``key_id`` is one key's name, or a column where keys have been rotated.
    """
    key = key_id if isinstance(key_id, Column) else F.lit(key_id)
    unsigned = df.drop("signature").withColumns({"key_id": key, "payload_version": F.lit(version)})
    return _with_signature(unsigned, keyring, version, "signature")


def verify(df: DataFrame, keyring: DataFrame, key_id: str | None = None, version: int = PAYLOAD_V1) -> DataFrame:
    """Add ``expected_signature`` and ``valid``.

    A missing signature, an unknown key and a wrong signature are all invalid.
    ``key_id`` and ``version`` hold for rows that store none, as rows from before
    they were stored.
    """
    stored = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    rows = df.withColumns(
        {
            "key_id": F.coalesce(stored("key_id", "string"), F.lit(key_id).cast("string")),
            "payload_version": F.coalesce(stored("payload_version", "int"), F.lit(version)),
        }
    )
    checked = _with_signature(rows, keyring, F.col("payload_version"), "expected_signature")
    matches = F.col("signature") == F.col("expected_signature")
    return checked.withColumn("valid", F.coalesce(matches, F.lit(False)))


def tampered(verified: DataFrame, since=None) -> DataFrame:
    """Invalid rows, of the whole table or from ``since`` on."""
    bad = verified.filter(~F.col("valid"))
    return bad if since is None else bad.filter(F.col("ts") >= at(since))


def tampered_id_set(verified: DataFrame) -> DataFrame:
    """Ids of invalid rows, rebalanced by id.

    Results built from the same set read this shuffle again, so that the
    signatures of the table are computed once for all of them.  Only ids move,
    and partitions are sized at run time, whatever number of copies an id has.
    """
    return tampered(verified).select("id").hint("rebalance", "id")


def integrity_rollup(verified: DataFrame) -> DataFrame:
    """One row: is everything valid, how many rows are not, their first and last id."""
    return _rollup(tampered(verified).select("id"))


def _rollup(bad_ids: DataFrame) -> DataFrame:
    return bad_ids.agg(
        (F.count("*") == 0).alias("integrity_ok"),
        F.count("*").alias("tampered_rows"),
        F.min("id").alias("first_tampered_id"),
        F.max("id").alias("last_tampered_id"),
    )


def tampered_preview(verified: DataFrame, n: int = fv.TAMPERED_SHOWN) -> DataFrame:
    """The first tampered ids, as many as the summary shows; ``tampered`` has all."""
    return _first_ids(tampered(verified).select("id"), n)


def _first_ids(bad_ids: DataFrame, n: int) -> DataFrame:
    return bad_ids.orderBy("id").limit(n)


def integrity_section(verified: DataFrame, n: int = fv.TAMPERED_SHOWN) -> DataFrame:
    """The integrity part of a summary as ``(section, item, value)``.

    Ok flag, number of tampered rows, and the first tampered ids.
    """
    bad_ids = tampered_id_set(verified)
    rows = _rollup(bad_ids).selectExpr(
        "stack(2, 'integrity', 'ok', cast(integrity_ok AS bigint),"
        " 'integrity', 'tampered_rows', tampered_rows) AS (section, item, value)"
    )
    shown = _first_ids(bad_ids, n).selectExpr(
        "'tampered_id' AS section", "cast(id AS string) AS item", "cast(1 AS bigint) AS value"
    )
    return rows.unionByName(shown)


def tamper_timeline(verified: DataFrame, every: str = "1 day") -> DataFrame:
    """Tampered rows per period, role and endpoint with the counts they report."""
    period = F.window(F.col("ts"), every)["start"].alias("period")
    return (
        tampered(verified)
        .groupBy(period, "user_role", "endpoint")
        .agg(
            F.count("*").alias("tampered_rows"),
            F.sum(F.col("count_id").cast("bigint")).alias("ids"),
            F.sum(F.col("count_phone").cast("bigint")).alias("phones"),
            F.sum(F.col("count_email").cast("bigint")).alias("emails"),
        )
    )


def signature_discrepancies(verified: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Rows whose stored signature is not the recomputed one.

    With a separate signature store ``(id, signature)`` the comparison is with
    the store, joined on the row id; rows the store lacks, or holds with another
    signature as well, are reported too.
    """
    if store is None:
        compared = verified.select("id", F.col("signature").alias("stored_signature"), "expected_signature")
        differs = ~F.col("stored_signature").eqNullSafe(F.col("expected_signature"))
        return compared.filter(F.col("stored_signature").isNull() | differs)
    # One row per id, so that copies in the store do not multiply rows.
    kept = store.groupBy("id").agg(F.min("signature").alias("_low"), F.max("signature").alias("_high"))
    compared = verified.select("id", "expected_signature").join(kept, "id", "left")
    low_fits, high_fits = [F.col(name).eqNullSafe(F.col("expected_signature")) for name in ("_low", "_high")]
    return compared.filter(F.col("_low").isNull() | ~(low_fits & high_fits)).select(
        "id", F.when(low_fits, F.col("_high")).otherwise(F.col("_low")).alias("stored_signature"), "expected_signature"
    )


def verified_export(verified: DataFrame) -> DataFrame:
    """Valid rows as stored, for hand-over."""
    return verified.filter("valid").drop("expected_signature", "valid")
