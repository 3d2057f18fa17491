"""Detectors as data: pattern rules or word lists, compiled to columns.

A further detector is a further entry in the list given to the jury; it needs
no code of its own.  What no pattern can tell is in ``vector_detectors``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions import patterns as rx
from veilwork.functions.masking import GUARDS, LOOSE_RULES, STRICT_RULES, PatternRule
from veilwork.functions.once import evaluated_once
from veilwork.functions.spans import matches

SLOTS = ("id", "phone", "email")


class Detector:
    """A named sequence of steps, each with a kind, a count slot and a mask."""

    name: str
    guards: frozenset[str] = frozenset()

    @property
    def steps(self) -> tuple:
        raise NotImplementedError

    def hit_column(self, kind: str) -> str:
        return f"_{self.name.lower()}_{kind}"

    def hit_columns(self, slot: str | None = None) -> list[str]:
        return [self.hit_column(step.kind) for step in self.steps if slot in (None, step.slot)]

    def inputs(self) -> list[str]:
        """Columns it reads beside the text."""
        return []

    def working_columns(self) -> list[str]:
        """What ``with_counts`` adds."""
        return self.hit_columns()

    @property
    def rounds(self) -> int:
        """How many masking passes there are."""
        return len(self.steps)

    def found_before(self, number: int) -> str:
        """SQL text of the hits that pass ``number`` and those before it replace."""
        return " + ".join(self.hit_columns()[: number + 1])

    def masked(self, number: int, text: Column) -> Column:
        """What pass ``number`` makes of the text the passes before it have left."""
        return self.steps[number].masked(text)

    def slot_sum(self, slot: str) -> str:
        """SQL text of the count a slot holds."""
        return " + ".join(self.hit_columns(slot)) or "0"


@dataclass(frozen=True)
class PatternDetector(Detector):
    """Counts every rule on the original text, masks one rule after the other."""

    name: str
    rules: tuple[PatternRule, ...]

    @property
    def steps(self) -> tuple[PatternRule, ...]:
        return self.rules

    @property
    def guards(self) -> frozenset[str]:
        return frozenset(rule.guard for rule in self.rules if rule.guard)

    def _where_possible(self, rule: PatternRule, found: Column) -> Column:
        return F.when(F.col(f"_{rule.guard}"), found) if rule.guard else found

    def with_counts(self, df: DataFrame, text: str) -> DataFrame:
        hits = [self._where_possible(rule, rule.hits(F.col(text))) for rule in self.rules]
        counts = [F.coalesce(n, F.lit(0)).alias(name) for n, name in zip(hits, self.hit_columns())]
        return df.select("*", *counts)

    def with_matches(self, df: DataFrame, text: str) -> DataFrame:
        """Add the matched texts of every rule as arrays."""
        matches = [self._where_possible(rule, rule.matches(F.col(text))) for rule in self.rules]
        return df.select("*", *[m.alias(name) for m, name in zip(matches, self.hit_columns())])

    def with_spans(self, df: DataFrame, text: str) -> DataFrame:
        """Add the places of every rule's hits in the text as arrays."""
        places = [self._where_possible(rule, matches(F.col(text), rule.regex, rule.hit_group)) for rule in self.rules]
        return df.select("*", *[p.alias(name) for p, name in zip(places, self.hit_columns())])


@dataclass(frozen=True)
class WordList:
    kind: str
    slot: str
    terms: tuple[str, ...]
    mask: str

    @property
    def regex(self) -> str:
        return rx.whole_words(self.terms)

    def masked(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.regex), F.lit(rx.literal_replacement(self.mask)))


@dataclass(frozen=True)
class DictionaryDetector(Detector):
    """Case-insensitive whole-word lists, masked one list after the other.

    Lists that share no word (and no word with a mask) cannot hit overlapping
    text, so one scan with a group per list counts them all.  Other lists are
    counted on the text the earlier lists have already masked.
    """

    name: str
    lists: tuple[WordList, ...]

    @property
    def steps(self) -> tuple[WordList, ...]:
        return self.lists

    @property
    def independent(self) -> bool:
        seen: set[str] = rx.words_of(word_list.mask for word_list in self.lists)
        for word_list in self.lists:
            words = rx.words_of(word_list.terms)
            if words & seen:
                return False
            seen |= words
        return True

    @property
    def one_scan(self) -> bool:
        return self.independent and len(self.lists) == 2

    def _free(self, text: str) -> Column:
        """True where no list has a hit, told by one scan that is much faster than those for hits."""
        return F.col(text).rlike(rx.without_terms(*[word_list.terms for word_list in self.lists]))

    def _with_found(self, df: DataFrame, text: str, group: int) -> DataFrame:
        scan = rx.whole_words(*[word_list.terms for word_list in self.lists])
        found = F.when(~self._free(text), F.regexp_extract_all(F.col(text), F.lit(scan), F.lit(group)))
        return df.select("*", F.coalesce(found, F.expr("array()")).alias("_found"))

    def with_counts(self, df: DataFrame, text: str) -> DataFrame:
        if self.one_scan:
            # Group 1 of a hit is empty when the hit belongs to the second list.
            first, second = self.hit_columns()
            df = self._with_found(df, text, 1).selectExpr("*", f"size(array_remove(_found, '')) AS {first}")
            return df.selectExpr("*", f"size(_found) - {first} AS {second}").drop("_found")
        current = F.col(text)
        for word_list, name in zip(self.lists, self.hit_columns()):
            hits = F.regexp_count(current, F.lit(word_list.regex))
            df = df.select("*", F.coalesce(hits, F.lit(0)).alias(name))
            current = word_list.masked(current)
        return df

    def with_matches(self, df: DataFrame, text: str) -> DataFrame:
        """Add the matched words of every list as arrays."""
        if self.one_scan:
            # Which list a hit belongs to is decided on the hit, not by a second scan.
            first, second = self.hit_columns()
            regex = self.lists[0].regex
            return (
                self._with_found(df, text, 0)
                .select(
                    "*",
                    F.filter("_found", lambda hit: hit.rlike(regex)).alias(first),
                    F.filter("_found", lambda hit: ~hit.rlike(regex)).alias(second),
                )
                .drop("_found")
            )
        current = F.col(text)
        for word_list, name in zip(self.lists, self.hit_columns()):
            df = df.select("*", F.regexp_extract_all(current, F.lit(word_list.regex), F.lit(0)).alias(name))
            current = word_list.masked(current)
        return df

    def with_spans(self, df: DataFrame, text: str) -> DataFrame:
        """Add the places of every list's words in the text as arrays, each list looked for by itself."""
        free = f"_{self.name.lower()}_free"
        places = [F.when(~F.col(free), matches(F.col(text), word_list.regex)) for word_list in self.lists]
        found = df.select("*", self._free(text).alias(free))
        return found.select("*", *[p.alias(name) for p, name in zip(places, self.hit_columns())]).drop(free)


STRICT = PatternDetector("A", STRICT_RULES)
DICTIONARY = DictionaryDetector(
    "B",
    (
        WordList("name", "id", tuple(fv.NAMES), fv.MASK_NAME),
        WordList("location", "phone", tuple(fv.LOCATIONS), fv.MASK_LOCATION),
    ),
)
LOOSE = PatternDetector("C", LOOSE_RULES)
DETECTORS = (STRICT, DICTIONARY, LOOSE)


def with_guards(df: DataFrame, text: str, detectors) -> DataFrame:
    """Add one boolean column per guard the detectors use."""
    names = sorted({guard for detector in detectors for guard in detector.guards})
    return df.select("*", *[GUARDS[name](F.col(text)).alias(f"_{name}") for name in names])


def working_columns(detectors) -> list[str]:
    """What ``with_counts`` adds for all detectors."""
    return [name for detector in detectors for name in detector.working_columns()]


def with_counts(df: DataFrame, text: str, detectors=DETECTORS) -> DataFrame:
    """Add the hit columns of every detector, each evaluated once per row."""
    kept = df.columns
    df = with_guards(df, text, detectors)
    for detector in detectors:
        df = detector.with_counts(df, text)
    return evaluated_once(df, kept, working_columns(detectors))


def with_mask(df: DataFrame, text: str, detectors, out: str, chosen: str | None = None) -> DataFrame:
    """Add column ``out``: the text as masked by the detector chosen for the row.

    Round ``k`` applies the ``k``-th step of each row's detector, so only one
    detector's replacements run on a row.  A step is skipped while neither it
    nor an earlier step has hits, as the text is then still the original.
    """
    rounds = max(detector.rounds for detector in detectors)
    between = [f"_{out}_{k}" for k in range(rounds - 1)]
    current = text
    for k, name in enumerate([*between, out]):
        branches = F
        for detector in detectors:
            if k < detector.rounds:
                applies = f"{detector.found_before(k)} > 0"
                if chosen:
                    applies = f"{chosen} = '{detector.name}' AND {applies}"
                branches = branches.when(F.expr(applies), detector.masked(k, F.col(current)))
        df = df.select("*", branches.otherwise(F.col(current)).alias(name))
        current = name
    return df.drop(*between)
