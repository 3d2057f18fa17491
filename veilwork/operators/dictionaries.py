"""Word lists that are tables, of any size.

A list compiled into one expression grows with the list; a table is met by a join instead.  Every
text gives its windows: runs of as many words as the longest term has, with what stands between
them.  Windows in lower case are joined with the terms in lower case, so each text meets
only terms it holds.  The result is the same as that of the compiled form: whole words, any
case, of overlapping terms of a kind the one that begins first and then the longest.

The terms are broadcast if their stored bytes are below the session's threshold, and nothing but hits is
then shuffled.  Larger lists are met chunk by chunk (``term_chunks``), so that texts and not their windows are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import patterns as rx
from veilwork.functions import spans
from veilwork.functions.once import evaluated_once
from veilwork.operators.term_chunks import HITS, chunked_hits
from veilwork.operators.vector_detectors import PLACES, PlacedDetector, VectorRule
from veilwork.session import fits_broadcast, lookup_join
from veilwork.sources.files import written_once

_TOKEN = f"{rx.WORD}+"


@dataclass(frozen=True)
class Terms:
    """A stored list: ``table`` has ``kind`` and ``window`` (a term in lower case), each once."""

    table: DataFrame
    longest: int


def stored_terms(terms: DataFrame) -> Terms:
    """Terms (``kind``, ``term``) made ready for joining, and stored, so that their size is known.

    A null kind or term is no term; terms equal but for case are one.  A term must begin
    and end with a word character.
    """
    given = terms.select("kind", F.lower("term").alias("window")).filter("kind IS NOT NULL AND window IS NOT NULL").distinct()
    table, _ = written_once(given.withColumn("tokens", F.size(F.regexp_extract_all("window", F.lit(_TOKEN), F.lit(0)))), "terms")
    fits = F.col("window").rlike(f"(?s)^{rx.WORD}(?:.*{rx.WORD})?$")
    seen = table.agg(F.max("tokens"), F.min(F.when(~fits, F.col("window")))).first()
    if seen[1] is not None:
        raise ValueError(f"dictionary term {seen[1]!r} must begin and end with a word character")
    return Terms(table.select("kind", "window"), seen[0] or 0)


def _window_text(i: Column, n: int) -> Column:
    """The window of ``n`` words from word ``i`` on, in lower case."""
    parts = [F.get("_words", i)]
    for k in range(1, n):
        parts += [F.get("_gaps", i + k), F.get("_words", i + k)]
    return F.lower(F.concat(*parts))


def _texts_of_length(n: int) -> Column:
    return F.transform(spans.numbers(F.size("_words") - (n - 1)), lambda i: _window_text(i, n))


def _windows(df: DataFrame, key: list[str], text: str, longest: int) -> DataFrame:
    """``key``, ``token`` (the number of the first), ``tokens``, ``start``, ``end``, ``window``."""
    words = F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0)).alias("_words")
    gaps = F.split(F.col(text), _TOKEN, -1).alias("_gaps")
    cut = evaluated_once(df.filter(F.col(text) != "").select(*key, text), key, [words, gaps])
    steps = F.zip_with(
        F.slice("_gaps", F.lit(1), F.size("_words")), F.col("_words"), lambda gap, word: F.length(gap) + F.length(word)
    )
    placed = evaluated_once(cut, [*key, "_words", "_gaps"], [spans.running(steps, lambda x, y: x + y).alias("_ends")])

    def of_length(n: int) -> Column:
        def window(i: Column) -> Column:
            return F.struct(
                i.alias("token"), F.lit(n).alias("tokens"),
                (F.get("_ends", i) - F.length(F.get("_words", i))).alias("start"), F.get("_ends", i + (n - 1)).alias("end"),
                _window_text(i, n).alias("window"),
            )

        return F.transform(spans.numbers(F.size("_words") - (n - 1)), window)

    return placed.select(*key, F.inline(F.concat(*[of_length(n) for n in range(1, longest + 1)])))


def _first_and_longest(hits: Column) -> Column:
    """Of hits in order of place (the longer first), those that none before overlaps."""
    kept = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("free"), F.array().cast(HITS).alias("kept")),
        lambda seen, hit: F.when(
            hit["token"] >= seen["free"],
            F.struct((hit["token"] + hit["tokens"]).alias("free"), F.concat(seen["kept"], F.array(hit)).alias("kept")),
        ).otherwise(seen),
    )
    return kept["kept"]


def term_hits(df: DataFrame, key: list[str], text: str, terms: Terms) -> DataFrame:
    """One row per text and kind that has hits: ``key``, ``kind``, ``hits`` (in order, with ``start`` and ``end``).

    ``key`` tells rows apart.  Null and empty texts have no hits.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key).schema.fields)
    if not terms.longest:
        return df.sparkSession.createDataFrame([], f"{schema}, kind string, hits {HITS}")
    if not fits_broadcast(terms.table):
        texts = F.concat(*[_texts_of_length(n) for n in range(1, terms.longest + 1)])
        return chunked_hits(df, key, text, terms.table, terms.longest, _TOKEN, texts)
    windows = _windows(df, key, text, terms.longest)
    met = lookup_join(windows, terms.table, "window", "inner", small=True)
    hit = F.struct("facts.token", (-F.col("facts.tokens")).alias("shorter"), "facts.start", "facts.end")
    found = met.select(*[F.col(f"facts.`{name}`") for name in key], "lookup.kind", hit.alias("_hit"))
    # A text's hits are fewer than its words.
    grouped = found.groupBy(*key, "kind").agg(F.sort_array(F.collect_list("_hit")).alias("_hits"))
    ordered = F.transform("_hits", lambda h: F.struct(
        h["token"].alias("token"), (-h["shorter"]).alias("tokens"), h["start"].alias("start"), h["end"].alias("end")
    ))
    return grouped.select(*key, "kind", _first_and_longest(ordered).alias("hits"))


def term_counts(df: DataFrame, key: list[str], text: str, terms: Terms) -> DataFrame:
    """``key``, ``kind``, ``n`` hits and ``chars`` in them, for texts and kinds that have hits."""
    chars = F.aggregate("hits", F.lit(0), lambda total, hit: total + hit["end"] - hit["start"])
    return term_hits(df, key, text, terms).select(*key, "kind", F.size("hits").alias("n"), chars.alias("chars"))


@dataclass(frozen=True)
class TableDictionary(PlacedDetector):
    """A detector whose hits ``with_term_places`` has put beside the text.

    ``rules`` name the kinds of the table, with the slot and the mask of each.  All hits are those in
    the original text; a word that is in two kinds' terms counts for both and is masked
    as the first.
    """

    name: str
    rules: tuple[VectorRule, ...]

    def inputs(self) -> list[str]:
        return [f"{self.name.lower()}_term_places"]

    def _with_places(self, df: DataFrame, text: str) -> DataFrame:
        return df.select("*", F.coalesce(F.col(self.inputs()[0]), F.array().cast(PLACES)).alias(self._places))



def with_term_places(df: DataFrame, key: list[str], text: str, terms: Terms, detector: TableDictionary) -> DataFrame:
    """``df`` with the places of the detector's terms in ``<name>_term_places``, for the jury.

    Only hits and keys are joined back; ``key`` tells rows apart.
    """
    kinds = {rule.kind: number for number, rule in enumerate(detector.rules)}
    number = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in kinds.items()])
    hits = term_hits(df, key, text, terms).filter(F.col("kind").isin(list(kinds))).withColumn("_rule", number)
    places = F.transform("hits", lambda hit: F.struct(F.col("_rule").alias("rule"), hit["start"].alias("start"), hit["end"].alias("end")))
    column = detector.inputs()[0]
    by_row = hits.groupBy(*key).agg(F.flatten(F.collect_list(places)).alias(column))
    found, stored = df.alias("rows"), by_row.alias("found")
    same = [F.col(f"rows.`{name}`").eqNullSafe(F.col(f"found.`{name}`")) for name in key]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return found.join(stored, condition, "left").select(*[F.col(f"rows.`{name}`") for name in df.columns], F.col(f"found.{column}"))
