"""The jury over stored text collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.operators import jury
from veilwork.operators.detectors import DETECTORS


def texts(documents: DataFrame, conversations: DataFrame, pages: DataFrame) -> DataFrame:
    """All texts as ``(collection, row_key, text)``."""
    turn = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parts = [
        documents.select(F.lit("documents").alias("collection"), F.col("doc_id").cast("string").alias("row_key"), "text"),
        conversations.select(F.lit("conversations").alias("collection"), turn.alias("row_key"), "text"),
        pages.select(F.lit("pages").alias("collection"), F.col("page_id").cast("string").alias("row_key"), F.col("html").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def corpus_jury(corpus: DataFrame, text: str = "text", detectors=DETECTORS) -> DataFrame:
    """The jury on every text; only whole texts are read and written."""
    return jury.redaction_jury(corpus, text, detectors)


def corpus_findings(corpus: DataFrame, key: list[str], text: str = "text", detectors=DETECTORS) -> DataFrame:
    """Every hit in every text."""
    return jury.findings(corpus, key, text, detectors)
