"""Canonical JSON and HMAC-SHA256 as Column expressions.

The canonical form has sorted keys, no spaces, ASCII characters only and ISO
times, and its bytes are those of the usual sorted compact JSON encoders, so
signatures can be checked outside Spark.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64  # bytes per SHA-256 block


def ascii_json(text: Column) -> Column:
    """Escape every character outside printable ASCII in written JSON, lower-case hex.

    JSON writers already escape control characters, all but DEL, so texts that
    need nothing, nearly all, are told apart without a regular expression.
    """
    tokens = F.regexp_extract_all(
        text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\.|[^\\\x20-\x7e]+|[\x20-\x5b\x5d-\x7e]+"), F.lit(0)
    )

    def escape(token: Column) -> Column:
        utf16 = F.lower(F.hex(F.encode(token, "UTF-16BE")))
        return (
            F.when(token.startswith("\\u"), F.lower(token))
            .when(token.rlike(r"^[\x20-\x7e]"), token)
            .otherwise(F.regexp_replace(utf16, "(.{4})", r"\\u$1"))
        )

    needs_work = (
        (F.octet_length(text) != F.length(text))
        | F.contains(text, F.lit("\\u"))
        | F.contains(text, F.lit("\x7f"))
    )
    return F.when(needs_work, F.array_join(F.transform(tokens, escape), "")).otherwise(text)


def json_string(text: Column) -> Column:
    """A JSON string literal, or ``null``."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    literal = F.substring(wrapped, 6, 1 << 30)
    return F.when(text.isNull(), F.lit("null")).otherwise(ascii_json(F.rtrim(literal, F.lit("}"))))


def json_value(text: Column) -> Column:
    """JSON text as a value that is written with keys sorted at every level.

    Missing, empty and unreadable text count as ``{}``.
    """
    return F.coalesce(F.try_parse_json(F.nullif(text, F.lit(""))), F.parse_json(F.lit("{}")))


def sorted_json(text: Column) -> Column:
    """JSON text in canonical form."""
    return ascii_json(F.to_json(json_value(text)))


def _pads(key: bytes) -> tuple[bytearray, bytearray]:
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key)


def keyring(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """Signing keys as a table ``(key_id, ipad, opad)``, one row per key.

    Joining it keeps key bytes out of query plans and lets a table hold rows
    signed with several keys.
    """
    if not keys:
        raise ValueError("at least one signing key is needed")
    rows = [(key_id, *_pads(key)) for key_id, key in keys.items()]
    return spark.createDataFrame(rows, "key_id string, ipad binary, opad binary")


def hmac_sha256(message: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 in lower-case hex; NULL where the key is unknown."""
    inner = F.unhex(F.sha2(F.concat(ipad, message.cast("binary")), 256))
    return F.sha2(F.concat(opad, inner), 256)
