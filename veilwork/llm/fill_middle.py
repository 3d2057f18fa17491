"""Fill-in-the-middle: cut texts at unit boundaries and set their middle last.

A unit is a word with the white space before it, or the white space at the end of
a text.  Texts are looked at eight bytes at a time (SWAR, SIMD within a register):

1. Mark: a batch's UTF-8 bytes are viewed as ``uint64`` words.  Additions that do not
   carry from one byte into the next leave the top bit of every byte that is white
   space; a byte that is none and has one behind it ends a unit, as does a text's
   last byte.
2. Rank: ``bitwise_count`` per word and a running sum tell how many units end before
   any byte.
3. Select: the word that holds the end of the k-th unit is searched in the running
   sum; inside the word, a multiplication gives the running count of its eight bytes,
   and the marked byte is the first that has reached the rest of k.

Code points are counted in the same way, by marking bytes that continue none.
Rows are independent: there is no shuffle, and a batch is worked on in pieces of 4 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.arrow import pieces
from veilwork.llm.text import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM_PERCENT = 50
SPM_PERCENT = 80

_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_TOP = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)


def _each(byte: int) -> np.uint64:
    return np.uint64(byte) * _ONES


def _at_least(low: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of every byte whose seven low bits are at least ``byte``."""
    return low + _each(0x80 - byte)


def space_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is U+0020 or U+0009 to U+000D."""
    low = words & _LOW
    control = _at_least(low, 0x09) & ~_at_least(low, 0x0E)
    blank = _at_least(low, 0x20) & ~_at_least(low, 0x21)
    return (control | blank) & ~words & _TOP


def point_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that begins a code point (all but 10xxxxxx)."""
    return ~(words & ~(words << np.uint64(1))) & _TOP


class Marks:
    """Marked bytes of a buffer, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before position ``at`` are marked."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        below = (np.uint64(1) << shift) - np.uint64(1)
        inside = np.append(self.words, np.uint64(0))[word] & below
        return self.before[word] + np.bitwise_count(inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The position of the marked byte ``number``, counted from 1; there must be one."""
        word = np.searchsorted(self.before, number, side="left") - 1
        wanted = (number - self.before[word]).astype(np.uint64)
        running = (self.words[word] >> np.uint64(7)) * _ONES  # byte k: marked bytes up to k
        short = ~(((running | _TOP) - wanted * _ONES)) & _TOP  # bytes that have not reached it
        return (word << 3) + np.bitwise_count(short)


def unit_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words with a mark at each byte that ends a unit of a text; ``ends`` are the bounds of the texts."""
    words = np.zeros(len(data) // 8 + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    spaces = space_marks(words)
    following = np.zeros_like(spaces)
    following[:-1] = (spaces[:-1] >> np.uint64(8)) | (spaces[1:] << np.uint64(56))
    marks = ~spaces & following & _TOP
    last = ends[1:][np.diff(ends) > 0] - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
    return marks


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Count units, cut, and set the parts of every text of a piece."""
    texts = batch.column("_text")
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffer or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    marks = Marks(unit_ends(data, ends))
    base = marks.rank(ends)
    n = np.diff(base)
    h = [batch.column(f"_h{k}").to_numpy() for k in range(1, 5)]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    marked = np.zeros(len(texts), bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, sentinel).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= FORM_PERCENT)
    spm = h[3] % 100 < SPM_PERCENT

    def position(units: np.ndarray) -> np.ndarray:
        at = ends[:-1].copy()
        some = units > 0
        at[some] = marks.select(base[:-1][some] + units[some]) + 1
        return at

    first, second = position(np.minimum(one, two)), position(np.maximum(one, two))
    words = np.zeros(len(data) // 8 + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    points = Marks(point_marks(words))
    seen = points.rank(first)
    prefix_chars, middle_chars = seen - points.rank(ends[:-1]), points.rank(second) - seen
    raw, made = data.tobytes(), []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    rows = zip(ends[:-1].tolist(), first.tolist(), second.tolist(), ends[1:].tolist(), plain.tolist(), spm.tolist(), strict=True)
    for a, b, c, d, same, suffix_first in rows:
        if same:
            made.append(raw[a:d])
        elif suffix_first:
            made.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            made.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"), pa.array(n), pa.array(form.tolist(), pa.string()),
            pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain),
            pa.array(made, pa.binary()).cast(pa.string()),
        ],
        names=["row", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
        for piece in pieces(batch, sizes):
            yield _cut(piece)


def transform(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, keep: list[str] | None = None
) -> DataFrame:
    """Per row: ``row`` (a struct of the columns ``keep``, all by default), ``n`` units, ``form``,
    ``prefix_chars``, ``middle_chars``, ``output``.

    The draws are the SHA-256 of ``seed:doc_id``, so reruns agree and rows with equal ids and
    texts have equal results; a null id is the empty one.  A null or empty text, and one that
    contains a sentinel, stays as it is (form ``plain``, no counts).  An empty table gives an
    empty result.  Columns of any name and type pass through ``row``.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]
    kept = F.struct(*[F.col(f"`{name}`") for name in (keep if keep is not None else df.columns)])
    rows = df.select(kept.alias("row"), whole(F.col(f"`{text}`")).alias("_text"), digest.alias("_digest"))
    rows = rows.select("row", "_text", *draws)
    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        _transformed, f"row {row}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    A text with a sentinel in it is never cut, and none arises where parts meet, so the
    three sentinels of a cut text are those that were set.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
