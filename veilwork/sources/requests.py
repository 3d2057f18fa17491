"""Request lines: JSON bodies to rows, and request identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.schemas import REQUEST


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body per line."""
    return spark.read.text(path)


def stream_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_request_lines``, for files that keep arriving."""
    return spark.readStream.text(path)


# Standard JSON only: no single quotes, raw control characters or other leniencies.
_STRICT = {
    "allowSingleQuotes": "false",
    "allowUnquotedControlChars": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
}


# Name of the element put behind a body, which shows that nothing in the body has ended the array early.
_SEAL = "_seal"


def _sealed(value: Column, schema: str) -> Column:
    """``value`` read as ``schema`` (the fields of a struct), or NULL unless all of it is one JSON value.

    The reader stops behind the first value, so the text is read as an array of two: itself and
    a seal, the hash of the text.  A text that closes the array itself (``{...}] ...``) would
    have to hold its own hash to be taken for whole.
    """
    seal = F.sha2(value, 256)
    body = F.concat(F.lit("["), value, F.lit(f', {{"{_SEAL}":"'), seal, F.lit('"}]'))
    read = F.from_json(body, f"array<struct<{schema}, {_SEAL}: string>>", _STRICT)
    whole = (F.size(read) == 2) & (F.get(read, F.lit(1))[_SEAL] == seal)
    return F.when(whole, F.get(read, F.lit(0)))


def json_body(value: Column, *fields: str) -> Column:
    """The fields of a JSON object as variants, or NULL where the text is anything else.

    Text before or after the object makes it invalid.  Of a repeated key the last value
    counts.  An object without keys is as good as none.
    """
    whole = _sealed(value, ", ".join(f"{name}: variant" for name in fields))
    return F.when(F.coalesce(F.size(F.json_object_keys(value)), F.lit(0)) > 0, whole)


def written_text(value: Column, name: str, field: Column) -> Column:
    """The variant ``field``, key ``name`` of the body ``value``, as text.

    A variant drops the fraction of a number like 1.0, so such numbers are read from the body again.
    """
    kind = F.schema_of_variant(field)
    number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    again = _sealed(value, f"{name}: string")[name]
    return F.when(number, again).otherwise(F.try_variant_get(field, "$", "string"))


def is_text(field: Column) -> Column:
    """The variant is a JSON string."""
    return F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))


def _filled(value: Column, name: str, field: Column) -> Column:
    """The variant as text; NULL for the values that count as empty: null, false, 0, "", [] and {}."""
    kind = F.schema_of_variant(field)
    number = F.try_variant_get(field, "$", "double")
    empty = (
        (kind == "VOID")
        | ((kind == "BOOLEAN") & (F.try_variant_get(field, "$", "string") == "false"))
        | (~kind.isin("STRING", "BOOLEAN") & (number == 0))
        | F.to_json(field).isin("[]", "{}")
    )
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    shown = F.when(nested, F.to_json(field)).otherwise(written_text(value, name, field))
    return F.when(~F.coalesce(empty, F.lit(False)), shown)


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``role``, ``prompt`` and ``valid``; fields of invalid bodies are NULL.

    Values that count as empty (null, false, 0, empty lists and objects) are NULL
    too, so that no check takes them for a prompt.
    """
    parsed = lines.select("*", json_body(F.col(value), *REQUEST.fieldNames()).alias("_body"))
    fields = [_filled(F.col(value), n, F.col(f"_body.{n}")).alias(n) for n in REQUEST.fieldNames()]
    return parsed.select(*lines.columns, F.col("_body").isNotNull().alias("valid"), *fields)


def with_request_identity(df: DataFrame, source_key: list[str], endpoint: str, live: bool = False) -> DataFrame:
    """Add ``request_id``, ``user_role`` and ``endpoint``.

    Batch ids are a hash of the source key, so a rerun or a retried task gives
    the same id; live requests may have random ones.
    """
    hashed = F.sha2(F.concat_ws("\u001f", *[F.col(k).cast("string") for k in source_key]), 256)
    return df.select(
        "*",
        (F.uuid() if live else hashed).alias("request_id"),
        F.col("role").alias("user_role"),
        F.lit(endpoint).alias("endpoint"),
    )
