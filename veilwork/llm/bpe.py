"""Byte-pair encoding and decoding, exact, one prefix at a time.

The encoding of every prefix of a word ends in exactly one token.  So a word is
encoded from left to right: an automaton over the vocabulary, whose suffix links
lead from each state to its next shorter suffix, names all tokens that end at the
current symbol; the one that may follow the last token of the prefix before it
is stored, and back-pointers give the ids.  Whether one token may follow another
is a test on the pair alone: undo the later of their merges step by step and see
that no earlier merge would have joined across the seam.  The work is linear in
the length of a word, however long it is.

Letters, numbers and cases are those of Python's Unicode tables (15.1 with Python
3.13); a character that a later version of Unicode added counts as neither letter
nor number.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.arrow import pieces
from veilwork.llm.text import whole

# Unicode white space (fixed values); str.isspace() also counts U+001C-U+001F.
_WHITE = "\t-\r \x85\xa0  -     　"
_NOT_WHITE = re.compile(f"[^{_WHITE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")

# How words are cut into pieces (fixed values).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

CACHED_CHUNKS = 350_000
CACHED_PAIRS = 250_000
CACHED_LENGTH = 64


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def _kind(char: str) -> str:
    return "L" if char.isalpha() else unicodedata.category(char)[0].replace("L", "P")


def _pieces(chunk: str) -> Iterator[str]:
    """The matches of ``PIECES``, one after another, in a run without white space."""
    start = 0
    while start < len(chunk):
        end = next((start + len(s) for s in SUFFIXES if chunk.startswith(s, start)), 0)
        if not end:
            kind, end = _kind(chunk[start]), start + 1
            if kind == "L":
                while end < len(chunk) and _kind(chunk[end]) == "L":
                    end += 1
            elif kind != "N":
                while end < len(chunk) and _kind(chunk[end]) not in "LN":
                    end += 1
        yield chunk[start:end]
        start = end


class Vocabulary:
    """A vocabulary with word ends, from the JSON of the ``tokenizers`` library.

    Its ids must rise with the rank of the merges, and every merge must join
    tokens that exist before it, as in every vocabulary made by BPE training.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        size = max(ids.values()) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[int, int] = {}
        rank = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole_id = ids[a + b]
            if not max(ids[a], ids[b], rank) < whole_id:
                raise ValueError(f"the merge of {a!r} and {b!r} is out of order")
            rank = whole_id
            self.left[whole_id], self.right[whole_id] = ids[a], ids[b]
            self.joined[ids[a] << 16 | ids[b]] = whole_id
        symbols = _byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + suffix] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if pattern["pattern"]["Regex"] != PIECES:
            raise ValueError(f"pieces other than {PIECES} are not known")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len)[::-1])) + ")")
        self._memo: dict[int, bool] = {}
        self._build(size)

    def _build(self, size: int) -> None:
        """The automaton: states are the prefixes of all reachable tokens."""
        spelled: dict[int, tuple[int, ...]] = {}
        reachable = set()
        for token in [*sorted({*self.inner, *self.final}), *sorted(self.joined.values())]:
            a, b = self.left[token], self.right[token]
            if a == token:
                spelled[token] = (token,)
                reachable.add(token)
            else:
                spelled[token] = spelled[a] + spelled[b]
                if a in reachable and b in reachable and self._may_follow(a, b, token):
                    reachable.add(token)
        self.step: dict[int, int] = {}
        ends: list[int] = [-1]
        parents: list[tuple[int, int]] = [(0, 0)]
        for token in sorted(reachable):
            state = 0
            for symbol in spelled[token]:
                key = state << 16 | symbol
                if key not in self.step:
                    self.step[key] = len(ends)
                    ends.append(-1)
                    parents.append((state, symbol))
                state = self.step[key]
            ends[state] = token
        depth = [0] * len(ends)
        for state in range(1, len(ends)):
            depth[state] = depth[parents[state][0]] + 1
        self.suffix = [0] * len(ends)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(ends)
        for state in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, symbol = parents[state]
            if parent:
                self.suffix[state] = self._next(self.suffix[parent], symbol)
            own = ((ends[state], depth[state]),) if ends[state] >= 0 else ()
            self.ending[state] = own + self.ending[self.suffix[state]]

    def _next(self, state: int, symbol: int) -> int:
        while (found := self.step.get(state << 16 | symbol)) is None:
            if state == 0:
                return 0
            state = self.suffix[state]
        return found

    def _may_follow(self, a: int, b: int, before: int = 1 << 30) -> bool:
        """True if the symbols of ``a`` and ``b`` together are encoded as ``a``, ``b``.

        Only merges with an id below ``before`` count.
        """
        left, right, joined = self.left, self.right, self.joined
        while True:
            merge = joined.get(a << 16 | b)
            if merge is not None and merge < before:
                return False
            if a > b and right[a] != a or left[b] == b:
                if right[a] == a:
                    return True
                before, a = min(before, a), right[a]
            else:
                # At equal rank the left one of two overlapping merges comes first.
                before, b = min(before, b + 1), left[b]

    def encode_word(self, symbols: list[int]) -> list[int]:
        step, suffix, ending, memo = self.step, self.suffix, self.ending, self._memo
        last = [0] * (len(symbols) + 1)
        width = last.copy()
        state = 0
        for end, symbol in enumerate(symbols, 1):
            following = step.get(state << 16 | symbol)
            while following is None:
                if state == 0:
                    following = 0
                    break
                state = suffix[state]
                following = step.get(state << 16 | symbol)
            state = following
            for token, length in ending[state]:
                start = end - length
                if start:
                    pair = last[start] << 16 | token
                    fits = memo.get(pair)
                    if fits is None:
                        fits = self._may_follow(last[start], token)
                        if len(memo) < CACHED_PAIRS:
                            memo[pair] = fits
                    if not fits:
                        continue
                last[end], width[end] = token, length
                break
        ids = []
        end = len(symbols)
        while end:
            ids.append(last[end])
            end -= width[end]
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a lower-case run without white space."""
        return [i for piece in _pieces(chunk) for i in self.encode_piece(piece)]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        symbols = [*map(self.inner.__getitem__, data)]
        symbols[-1] = self.final[data[-1]]
        return self.encode_word(symbols)


class _Chunks(dict):
    """Chunk -> its ids as bytes; keeps what comes first, up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.marks = {mark: array("i", vocabulary.encode_chunk(mark)).tobytes() for mark in ".,!?;:"}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = array("i", self.vocabulary.encode_piece(chunk)).tobytes()
        elif chunk[-1] in self.marks and chunk[:-1].isalpha():
            # Letters and one mark are two pieces; the letters have an entry of their own.
            return self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = array("i", self.vocabulary.encode_chunk(chunk)).tobytes()
        if len(self) < CACHED_CHUNKS and len(chunk) <= CACHED_LENGTH:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.names = _token_names(source)
        self.chunks = _Chunks(self.vocabulary)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        # str.lower() treats a final sigma by its place in the word; one by one it does not.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        parts = _NOT_WHITE.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def ids(self, text: str) -> np.ndarray:
        if "<|" not in text:
            return np.frombuffer(self._plain(text), np.int32)
        data = []
        for part in self.vocabulary.specials.split(text):
            special = self.vocabulary.special.get(part)
            data.append(self._plain(part) if special is None else array("i", [special]).tobytes())
        return np.frombuffer(b"".join(data), np.int32)


def _token_names(source: str) -> dict[int, str]:
    """Id -> token; without a decoder, a text is its tokens joined by spaces."""
    spec = json.loads(source)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


_encoders: dict[int, Encoder] = {}


def _encoder(source) -> Encoder:
    """The encoder of a broadcast vocabulary, built once per Python worker."""
    if source.id not in _encoders:
        _encoders.clear()
        _encoders[source.id] = Encoder(source.value)
    return _encoders[source.id]


_known_names: dict[int, dict[int, str]] = {}


def _names(source) -> dict[int, str]:
    if source.id not in _known_names:
        _known_names.clear()
        _known_names[source.id] = _token_names(source.value)
    return _known_names[source.id]


def _in_pieces(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.RecordBatch]:
    """The batches in pieces bounded by the size of their last column."""
    for batch in batches:
        sizes = size(batch.column(batch.num_columns - 1)).fill_null(0)
        yield from pieces(batch, sizes.to_numpy(zero_copy_only=False))


class Tokenizer:
    """Encodes and decodes columns with the vocabulary in the file at ``path``.

    The driver reads the file (a few MB) and broadcasts it.
    """

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as file:
            self.source = spark.sparkContext.broadcast(_Source(file.read()))

    def encode(
        self, df: DataFrame, text: str | Column, ids: str = "ids", decoded: str | None = None
    ) -> DataFrame:
        """``df`` with the column ``ids`` (array of int): the whole text, null as empty, encoded.

        With ``decoded``, a column of that name holds the ids decoded again, as
        ``decode`` does, in the same pass.  Every row is encoded on its own.  Columns
        of ``df`` with the new names are replaced.  An empty table gives an empty one.
        """
        source = self.source

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(source.value)
            for batch in _in_pieces(rows, pc.binary_length):
                found = [encoder.ids(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
                made = {ids: lists}
                if decoded:
                    names = encoder.names
                    texts = [" ".join(map(names.__getitem__, row.tolist())) for row in found]
                    made[decoded] = pa.array(texts, pa.string())
                kept = list(batch.columns[:-1])
                yield pa.RecordBatch.from_arrays([*kept, *made.values()], names=[*batch.schema.names[:-1], *made])

        new = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
        return _mapped(df, whole(text), new, batches)

    def decode(self, df: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """``df`` with the column ``text``: the tokens of ``ids`` in one text; null ids give the empty text."""
        source = self.source

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = _names(source.value)
            for batch in _in_pieces(rows, pc.list_value_length):
                lists = batch.column(batch.num_columns - 1)
                values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
                found, start = [], 0
                for length in np.nan_to_num(ends).astype(int):
                    found.append(" ".join(map(names.__getitem__, values[start : start + length].tolist())))
                    start += length
                kept = list(batch.columns[:-1])
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string())], names=[*batch.schema.names[:-1], text])

        return _mapped(df, F.col(f"`{ids}`"), {text: "string"}, batches)


class _Source:
    """The text of a vocabulary file with a name for the cache of a worker."""

    def __init__(self, value: str):
        self.value = value
        self.id = hash(value)


def _mapped(df: DataFrame, argument: Column, new: dict[str, str], batches) -> DataFrame:
    """``df`` with the columns ``new`` (name -> type) that ``batches`` makes of ``argument``."""
    kept = [c for c in df.columns if c not in new]
    # Own names inside, so that no column of ``df`` can clash.
    inner = [f"_{i}" for i in range(len(kept))]
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(inner, kept, strict=True)]
    schema = ", ".join(fields + [f"`{name}` {kind}" for name, kind in new.items()])
    columns = [F.col(f"`{c}`").alias(n) for n, c in zip(inner, kept, strict=True)]
    return df.select(*columns, argument.alias("argument")).mapInArrow(batches, schema).toDF(*kept, *new)
