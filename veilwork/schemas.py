"""Schemas of the tables and messages the jobs read and write."""

from pyspark.sql import types as T

REQUEST = T.StructType([T.StructField("role", T.StringType()), T.StructField("prompt", T.StringType())])

TOOL_COUNTS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("phone", T.IntegerType()),
        T.StructField("email", T.IntegerType()),
    ]
)

LOG_RECORD = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "timestamp",
            "level",
            "message",
            "logger",
            "event_type",
            "request_id",
            "user_role",
            "endpoint",
            "exception",
        )
    ]
)

AUDIT_EVENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("user_role", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("count_id", T.IntegerType()),
        T.StructField("count_email", T.IntegerType()),
        T.StructField("count_phone", T.IntegerType()),
        T.StructField("forbidden_intents", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("winning_tool", T.StringType()),
        T.StructField("tool_a_counts", T.StringType()),
        T.StructField("tool_b_counts", T.StringType()),
        T.StructField("tool_c_counts", T.StringType()),
    ]
)

# How a stored row was signed.
SIGNED_WITH = T.StructType(
    [T.StructField("key_id", T.StringType()), T.StructField("payload_version", T.IntegerType())]
)

# Columns that older audit tables lack; they read as NULL.
ADDED_LATER = ["signature", "winning_tool", "tool_a_counts", "tool_b_counts", "tool_c_counts"]
AUDIT_COLUMNS = AUDIT_EVENT.fieldNames()
UNSIGNED_COLUMNS = [name for name in AUDIT_COLUMNS if name != "signature"]
