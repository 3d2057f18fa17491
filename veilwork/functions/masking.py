"""Counting, masking and extracting pattern hits as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions import patterns as rx


def long_number_guard(text: Column) -> Column:
    """True where nine digits follow each other with at most separators between.

    Every number pattern of detectors A and C needs that much, so one scan rules
    out all four on texts without long numbers.
    """
    return text.rlike(rf"\p{{Nd}}(?:[-/{rx.SPACE_CHARS}]*+\p{{Nd}}){{8}}")


def at_sign_guard(text: Column) -> Column:
    """True where the text has an at sign."""
    return F.contains(text, F.lit("@"))


GUARDS: dict[str, Callable[[Column], Column]] = {
    "long_number": long_number_guard,
    "at_sign": at_sign_guard,
}


@dataclass(frozen=True)
class PatternRule:
    """One kind of hit of one detector.

    ``pattern`` has Python's meaning.  ``scan`` may give a faster Java expression
    with the same hits; if ``hit_group`` is 2, its group 1 is text in front of the
    hit that is kept.  ``slot`` names the count column.
    """

    kind: str
    slot: str
    pattern: str
    mask: str
    guard: str | None = None
    scan: str | None = None
    hit_group: int = 0

    @property
    def regex(self) -> str:
        return self.scan or rx.spark_regex(self.pattern)

    @property
    def replacement(self) -> str:
        kept = "$1" if self.hit_group == 2 else ""
        return kept + rx.literal_replacement(self.mask)

    def hits(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.regex))

    def masked(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.regex), F.lit(self.replacement))

    def matches(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.regex), F.lit(self.hit_group))


# The local part of an e-mail always runs up to its at sign, so only the first
# position of a run of local-part characters (or the end of the previous hit)
# can start one. Saying so keeps long runs without an at sign linear.
_STRICT_LOCAL = "[a-zA-Z0-9_.+-]"
_STRICT_EMAIL_SCAN = rf"(?:(?<!{_STRICT_LOCAL})|\G){_STRICT_LOCAL}++@[a-zA-Z0-9-]++\.[a-zA-Z0-9.-]+"

# The loose form starts at the first word boundary of the run instead; group 1
# takes the characters of the run that lie before that boundary.
_LOOSE_LOCAL = "[a-zA-Z0-9._%+-]"
_LOOSE_EMAIL_SCAN = (
    rf"(?:(?<!{_LOOSE_LOCAL})|\G)((?:(?<={rx.WORD})[a-zA-Z0-9_]|{rx.NOT_AFTER_WORD}[.%+-])*+)"
    rf"({_LOOSE_LOCAL}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}){rx.NOT_BEFORE_WORD}"
)

# Number patterns end in a digit, so the last boundary is "no word character
# follows".  They begin with a digit, after which the first boundary is looked
# for, or with a plus sign, which has a boundary only after a word character.
_STRICT_ID_SCAN = (
    rf"\p{{Nd}}(?<!{rx.WORD}\p{{Nd}})\p{{Nd}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"
    rf"-?\p{{Nd}}{{2}}-?\p{{Nd}}{{4}}{rx.NOT_BEFORE_WORD}"
)
_LOOSE_ID_SCAN = (
    rf"\p{{Nd}}(?<!{rx.WORD}\p{{Nd}})\p{{Nd}}(?:[-/]?\p{{Nd}}{{2}}){{3}}[-/]?\p{{Nd}}{{4}}{rx.NOT_BEFORE_WORD}"
)
_PREFIX = rf"(?:\+(?<={rx.WORD}\+)|{rx.NOT_AFTER_WORD})6?01"
_STRICT_PHONE_SCAN = rf"(?=[+60]){_PREFIX}[0-46-9]-*+[0-9]{{7,8}}{rx.NOT_BEFORE_WORD}"
_GAP = rf"[-{rx.SPACE_CHARS}]?"
_LOOSE_PHONE_SCAN = (
    rf"(?=[+0-9])(?:{_PREFIX}\p{{Nd}}{_GAP}\p{{Nd}}{{3,4}}{_GAP}\p{{Nd}}{{3,4}}"
    rf"|{rx.NOT_AFTER_WORD}[0-9]{{10,11}}){rx.NOT_BEFORE_WORD}"
)

STRICT_RULES = (
    PatternRule("id", "id", fv.STRICT_ID, fv.MASK_ID, "long_number", _STRICT_ID_SCAN),
    PatternRule("phone", "phone", fv.STRICT_PHONE, fv.MASK_PHONE, "long_number", _STRICT_PHONE_SCAN),
    PatternRule("email", "email", fv.STRICT_EMAIL, fv.MASK_EMAIL, "at_sign", _STRICT_EMAIL_SCAN),
)
LOOSE_RULES = (
    PatternRule("id", "id", fv.LOOSE_ID, fv.MASK_ID, "long_number", _LOOSE_ID_SCAN),
    PatternRule("phone", "phone", fv.LOOSE_PHONE, fv.MASK_PHONE, "long_number", _LOOSE_PHONE_SCAN),
    PatternRule("email", "email", fv.LOOSE_EMAIL, fv.MASK_EMAIL, "at_sign", _LOOSE_EMAIL_SCAN, 2),
)


def redact_pii(text: Column) -> Column:
    """Text with strict ids, phones and e-mails masked, in that order."""
    by_guard = {"long_number": text, "at_sign": text, "both": text}
    for rule in STRICT_RULES:
        by_guard[rule.guard] = rule.masked(by_guard[rule.guard])
        by_guard["both"] = rule.masked(by_guard["both"])
    number, at_sign = long_number_guard(text), at_sign_guard(text)
    return (
        F.when(number & at_sign, by_guard["both"])
        .when(number, by_guard["long_number"])
        .when(at_sign, by_guard["at_sign"])
        .otherwise(text)
    )


def has_strict_pii(text: Column) -> Column:
    """True where ``redact_pii`` would change the text."""
    number_rules = [rule for rule in STRICT_RULES if rule.guard == "long_number"]
    email_rules = [rule for rule in STRICT_RULES if rule.guard == "at_sign"]
    numbers = text.rlike("|".join(f"(?:{rule.regex})" for rule in number_rules))
    emails = text.rlike("|".join(f"(?:{rule.regex})" for rule in email_rules))
    return F.coalesce(
        (long_number_guard(text) & numbers) | (at_sign_guard(text) & emails), F.lit(False)
    )
