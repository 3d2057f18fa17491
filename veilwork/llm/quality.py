"""Quality rules: a threshold table compiled into one projection.

Every rule compares two whole-number measures of a text, so it is exact on every
engine.  The table is data; ``verdict`` turns it into one boolean expression and
``measures`` computes all counts of a text in one pass over the row.  There are
no user functions and no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.text import held, whole, without_spaces, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is that it for on with as this be are was not at by from an "
    "der die und das ist den von mit dem im zu auf für ein eine nicht auch sich des "
    "de la le et les en du une un dans pour est sur au que qui il elle avec par "
    "el los las no una con se es del al para como lo su"
).split()


class Rule(NamedTuple):
    """Reject if ``scale * (measure + grace)`` is below ``least`` or above ``most`` times ``per``.

    ``per`` is another measure, or None for 1.  ``grace`` keeps a rate from being
    judged on texts too short to have one.
    """

    name: str
    measure: str
    per: str | None = None
    scale: int = 1
    least: int | None = None
    most: int | None = None
    grace: int = 0


BASE_RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("repeated_windows", "n_repeat_words", per="n_words", scale=100, most=20),
)

DEFAULT_RULES = (
    Rule("word_length", "word_chars", per="n_words", least=2, most=12),
    Rule("symbols", "n_symbols", per="n_words", scale=100, most=10),
    Rule("stop_words", "n_stop_words", per="n_words", scale=100, least=5, grace=2),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", scale=100, most=40),
)


def _breach(rule: Rule) -> Column:
    value = (F.col(rule.measure) + F.lit(rule.grace)) * F.lit(rule.scale)
    unit = F.col(rule.per) if rule.per else F.lit(1)
    low = value < unit * F.lit(rule.least) if rule.least is not None else F.lit(False)
    high = value > unit * F.lit(rule.most) if rule.most is not None else F.lit(False)
    return low | high


def breached(rules) -> Column:
    """True if any rule of the table rejects the measures of the row."""
    result = F.lit(False)
    for rule in rules:
        result = result | _breach(rule)
    return result


def measures(df: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """``df``'s columns as one struct ``row``, and the measures of ``text`` beside it.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_lines`` (lines with a word), ``n_dup_lines`` (such lines equal to an
    earlier one), ``n_stop_words``, ``n_repeat_words`` (words inside 5-word
    windows that occur twice or more, first occurrence included); all long.

    A null text has the measures of the empty text (all 0).  The input columns
    are kept inside the struct, so none of their names can clash.
    """
    body = whole(F.col("row").getField(text))
    step = held(
        df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")),
        ["row"],
        word=words(body),
        line=F.filter(F.split(body, "\n", -1), lambda x: without_spaces(x) != ""),
        word_chars=F.length(without_spaces(body)).cast("long"),
        n_symbols=(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    )
    counts = ["row", "word_chars", "n_symbols"]
    step = held(
        step,
        counts,
        n_words=F.size("word").cast("long"),
        n_lines=F.size("line").cast("long"),
        n_dup_lines=(F.size("line") - F.size(F.array_distinct("line"))).cast("long"),
        n_stop_words=F.size(F.filter("word", lambda w: F.lower(w).isin(list(stop_words)))).cast("long"),
        window=F.when(
            F.size("word") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("word") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("word", i, WINDOW)),
            ),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    counts += ["n_words", "n_lines", "n_dup_lines", "n_stop_words"]
    # Only texts with a repeated window are sorted: equal windows become neighbours.
    step = held(
        step,
        counts,
        placed=F.when(
            F.size(F.array_distinct("window")) < F.size("window"),
            F.sort_array(F.transform("window", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    step = held(
        step,
        counts,
        start=F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size("placed") - 1),
                    lambda k: F.coalesce(_key("placed", k) == _key("placed", k - 1), F.lit(False))
                    | F.coalesce(_key("placed", k) == _key("placed", k + 1), F.lit(False)),
                ),
                lambda k: F.get("placed", k).getField("i"),
            )
        ),
    )
    # A window covers five words, or as many as lie before the next such window.
    covered = F.aggregate(
        F.zip_with(
            F.slice("start", 1, F.size("start") - 1),
            F.slice("start", 2, F.size("start") - 1),
            lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"),
        ),
        F.lit(WINDOW).cast("long"),
        lambda total, gap: total + gap,
    )
    repeated = F.when(F.size("start") > 0, covered).otherwise(F.lit(0).cast("long"))
    return step.select(*counts, F.coalesce(repeated, F.lit(0).cast("long")).alias("n_repeat_words"))


def _key(array: str, position: Column) -> Column:
    return F.when(position >= 0, F.get(array, position).getField("h"))


def judge(df: DataFrame, text: str = "text", rules=DEFAULT_RULES, base_rules=BASE_RULES) -> DataFrame:
    """``row`` (the input row as a struct), its measures, ``base_failed`` and ``kept``.

    ``kept`` is false where a base rule or a rule of the table rejects the text.
    Rows are judged one by one: repeated rows get equal results, an empty table
    gives an empty result, and a null or empty text fails the base rules.
    """
    judged = measures(df, text).withColumn("base_failed", breached(base_rules))
    return judged.withColumn("kept", ~(F.col("base_failed") | breached(rules)))


def passing(df: DataFrame, text: str = "text", rules=DEFAULT_RULES, base_rules=BASE_RULES) -> DataFrame:
    """The rows of ``df`` whose text no rule rejects, with the columns of ``df``."""
    kept = judge(df, text, rules, base_rules).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
