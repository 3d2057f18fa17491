"""Words and lines as Column builders shared by the operators of this package.

A word is a longest run of characters other than space and U+0009-U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_BREAKS = "\t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of ``text``, in order."""
    return F.array_remove(F.split(F.translate(text, _BREAKS, " " * len(_BREAKS)), " "), "")


def without_spaces(text: Column) -> Column:
    return F.translate(text, " " + _BREAKS, "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def held(df: DataFrame, keep: list[Column | str], **columns: Column) -> DataFrame:
    """Select ``keep`` and ``columns`` behind a generator of exactly one element.

    The optimizer would otherwise copy an expression into every place that uses
    it, also into the body of a lambda function that runs once per word.
    """
    named = [column.alias(name) for name, column in columns.items()]
    return df.select(*keep, F.inline(F.array(F.struct(*named))))
