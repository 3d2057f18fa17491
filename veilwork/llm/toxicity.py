"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The trees see rates only: words of a lexicon, their nearness to second-person
words, capitals, punctuation, and obfuscated spelling (digits or symbols between
letters, lexicon words that appear once those are undone).  The lexicon is a short
fixed list and what the labelled rows add to it: words and word beginnings that
occur in many toxic texts and hardly in others.

Labels are learned from at most ``SAMPLE`` rows.  One part of them gives the lexicon
and the trees, the other the calibration of the trees' margin to a probability.
Every text is scored, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.arrow import pieces
from veilwork.llm.text import whole, words
from veilwork.llm.work import written

# Labelled rows that are learned from at most, and entries that they add to the lexicon at most.
SAMPLE = 8_000
ENTRIES = 400
LEAST_TEXTS = 6
LEAST_SHARE = 0.75
LEAST_WORDS = 4
BEGINNINGS = (4, 5, 6)

# Insults and second-person words (fixed values).
INSULTS = (
    "idiot moron stupid scum trash loser pathetic disgusting clown worthless "
    "dumm dummkopf abschaum trottel crétin abruti ordure imbécile basura estúpido"
).split()
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro"
).split()

FEATURES = (
    "lexicon_rate", "lexicon_words", "nearness", "capitals", "exclamations", "questions", "symbols",
    "obfuscation", "obfuscated_lexicon", "log_words",
)
_NEAR = 48  # characters to each side of a lexicon word
_PLAIN = str.maketrans("013457@$!|+", "oieastasilt")
_BETWEEN = re.compile(r"(?<=\w)[*._\-~]+(?=\w)")
_SECOND = re.compile(r"\b(?:" + "|".join(SECOND_PERSON) + r")\b")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Lexicon:
    """Finds whole words and word beginnings (entries that end in ``*``) in lower-case texts."""

    def __init__(self, entries: list[str]):
        self.automaton = ahocorasick.Automaton()
        for entry in entries:
            word = entry.removesuffix("*")
            open_end = entry.endswith("*") or self.automaton.get(word, (0, False))[1]
            self.automaton.add_word(word, (len(word), open_end))
        self.automaton.make_automaton()

    def starts(self, text: str) -> list[int]:
        found = set()
        for end, (length, open_end) in self.automaton.iter(text):
            start = end - length + 1
            if start and text[start - 1].isalpha():
                continue
            if open_end or end + 1 == len(text) or not text[end + 1].isalpha():
                found.add(start)
        return sorted(found)


def _rates(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The features of each text; a text without words has zeros."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[ends[1:]] - total[ends[:-1]]).astype(float)

    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    # Bytes of other letters start with 0xC3-0xF4; following bytes (below 0xC0) do not count.
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC3)
    first = ~space
    first[1:] &= space[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    first[at] = ~space[at]
    n_words = np.maximum(counted(first), 1)
    part = letter | ((data >= 0x80) & (data < 0xC0))
    odd = ((data >= 48) & (data <= 57)) | np.isin(data, np.frombuffer(b"@$*!|", np.uint8))
    inside = odd.copy()
    inside[:1] = False
    inside[-1:] = False
    known = part | odd
    inside[1:-1] &= known[:-2] & known[2:] & (part[:-2] | part[2:])
    obfuscated = counted(inside)
    result = np.zeros((len(texts), len(FEATURES)))
    result[:, 3] = counted(upper) / np.maximum(counted(letter), 1)
    result[:, 4] = counted(data == 33) / n_words
    result[:, 5] = counted(data == 63) / n_words
    result[:, 6] = counted(np.isin(data, np.frombuffer(b"#$%&*|<>", np.uint8))) / n_words
    result[:, 7] = obfuscated / n_words
    result[:, 9] = np.log1p(counted(first))
    for row, text in enumerate(texts.to_pylist()):
        text = text.lower()
        hits = lexicon.starts(text)
        if hits:
            near = sum(bool(_SECOND.search(text[max(0, h - _NEAR) : h + _NEAR])) for h in hits)
            result[row, 0] = len(hits) / n_words[row]
            result[row, 1] = min(len(hits), 20)
            result[row, 2] = near / len(hits)
        if obfuscated[row] or _BETWEEN.search(text):
            plain = _BETWEEN.sub("", text.translate(_PLAIN))
            result[row, 8] = max(0, len(lexicon.starts(plain)) - len(hits)) / n_words[row]
    return result


def with_features(df: DataFrame, text: str, entries: list[str]) -> DataFrame:
    """``df`` without ``text`` and with ``rates`` (array of double, in the order of ``FEATURES``)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for batch in rows:
            for piece in pieces(batch, pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)):
                rates = _rates(piece.column(piece.num_columns - 1), lexicon)
                ends = np.arange(0, rates.size + 1, len(FEATURES), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rates.ravel()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], lists], names=[*piece.schema.names[:-1], "rates"])

    kept = [c for c in df.columns if c != text]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept) + "rates array<double>"
    return df.select(*[F.col(f"`{c}`") for c in kept], whole(text).alias("_text")).mapInArrow(batches, schema)


def learned_entries(rows: DataFrame) -> list[str]:
    """Words and beginnings of words typical of toxic texts, at most ``ENTRIES`` (``rows``: text, toxic).

    A beginning counts only if different words start with it.
    """
    bare = F.transform(words(whole("text")), lambda w: F.regexp_replace(F.lower(w), r"^\P{L}+|\P{L}+$", ""))
    each = rows.select("toxic", F.explode(F.array_distinct(bare)).alias("word")).filter(F.length("word") >= 3)
    begun = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
    each = each.select("toxic", "word", F.explode(F.array_compact(F.array("word", *begun))).alias("entry"))
    by_word = each.groupBy("entry", "word").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    counted = by_word.groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("words"))
    typical = counted.filter(
        (F.col("toxic") >= LEAST_TEXTS)
        & (F.col("toxic") >= F.lit(LEAST_SHARE) * F.col("n"))
        & (~F.col("entry").endswith("*") | (F.col("words") >= LEAST_WORDS))
    )
    best = typical.orderBy(F.desc("toxic"), "entry").limit(ENTRIES)
    return [row["entry"] for row in best.collect()]


class Model:
    def __init__(self, entries: list[str], trees: GBTClassificationModel | None, scale: IsotonicRegressionModel | None):
        self.entries, self.trees, self.scale = entries, trees, scale

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` without ``text`` and with ``score``; null and empty texts are scored too.

        A column of ``df`` named ``score`` is replaced.  Rows are scored one by one, so
        repeated rows get equal scores; an empty table gives an empty result.

        Without labels to learn from, every score is 0.
        """
        names = [c for c in df.columns if c not in (text, "score")]
        # Own names inside, so that no column of ``df`` can clash.
        inner = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("_body"))
        rated = with_features(inner, "_body", self.entries)
        outer = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
        if self.trees is None:
            return rated.select(*outer, F.lit(0.0).alias("score"))
        vectors = rated.withColumn("_features", array_to_vector("rates")).drop("rates")
        margins = self.trees.transform(vectors).withColumn("_margin", vector_to_array("_raw").getItem(1))
        scored = self.scale.transform(margins)
        return scored.select(*outer, F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """A model learned from at most ``sample`` rows of ``labels`` (doc_id, toxic) that are not held out.

    The rows are those with the smallest hashes of their ids, so reruns agree.  A
    document labelled several times is toxic if any label says so; null labels and
    labels without a document are left out.  With labels of one value only, all scores
    are 0.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = usable.orderBy(order, "doc_id").limit(sample)  # a bounded number of narrow rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(rows.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)) == 0), "labelled")
    if rows.groupBy("calibrates").agg(F.countDistinct("toxic").alias("n")).filter("n = 2").count() < 2:
        return Model(list(INSULTS), None, None)
    entries = [*dict.fromkeys([*INSULTS, *learned_entries(rows.filter(~F.col("calibrates")))])]
    rated = written(with_features(rows.select("toxic", "calibrates", "text"), "text", entries), "rated")
    rated = rated.select(F.col("toxic").cast("double").alias("toxic"), "calibrates", array_to_vector("rates").alias("_features"))
    trees = GBTClassifier(
        featuresCol="_features", labelCol="toxic", predictionCol="_label", maxIter=20, maxDepth=3, stepSize=0.3, seed=seed
    )
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(rated.filter(~F.col("calibrates")))
    margins = trees.transform(rated.filter("calibrates")).withColumn("_margin", vector_to_array("_raw").getItem(1))
    scale = IsotonicRegression(featuresCol="_margin", labelCol="toxic", predictionCol="_score").fit(margins)
    return Model(entries, trees, scale)
