"""Hashed word shingles and MinHash signatures of Arrow text columns, with NumPy.

Words are runs of bytes other than space and U+0009-U+000D, with A-Z in lower case.
All work is done on the bytes of a whole piece of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequence(seed: int, count: int) -> np.ndarray:
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(steps + np.uint64(seed))


_BYTE = _sequence(1, 256)
_PLACE = _sequence(2, WIDTH) | np.uint64(1)
_BASE = int(_sequence(3, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_COUNT, _STEP, _LINE = (_sequence(6, 3) | np.uint64(1)).tolist()


def _table(*codes: int) -> bytes:
    """A translation of bytes to 1 if they are among ``codes``, and to 0 otherwise."""
    return bytes(code in codes for code in range(256))


_FILLED = _table(*set(range(256)) - {32, *range(9, 14)})
_DIGIT = _table(*range(48, 58))
_CAPITAL = _table(*range(65, 91))
# Bytes outside words count nothing in the hash of a word.
_EXACT = np.where(np.frombuffer(_FILLED, bool), _BYTE, np.uint64(0))
_LOWERED = _EXACT[97:123] - _EXACT[65:91]
# Powers are kept up to this number.
_KEPT = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers of ``base``, from the zeroth on."""
    if count <= _KEPT and base in _kept:
        return _kept[base][:count]
    made = np.full(max(count, 1) if count > _KEPT else _KEPT, base, np.uint64)
    made[0] = 1
    made = np.multiply.accumulate(made)
    if count <= _KEPT:
        _kept[base] = made
    return made[:count]


class Words:
    """The words of an Arrow text column: its bytes, where each word starts, and the first word of each text (and the end)."""

    def __init__(self, texts: pa.Array):
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.bytes = (data or pa.py_buffer(b""))[ends[0] : ends[-1]].to_pybytes()
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = ends - ends[0]
        filled = self._among(_FILLED)
        first = filled.copy()
        first[1:] &= ~filled[:-1]
        at = self.ends[:-1][self.ends[:-1] < len(self.data)]
        first[at] = filled[at]
        self.starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, self.ends)

        terms = _EXACT[self.data]
        terms *= _powers(_BASE, len(self.data))
        self.sums = np.add.reduceat(terms, self.starts) if len(self.starts) else np.empty(0, np.uint64)

    def _among(self, table: bytes) -> np.ndarray:
        return np.frombuffer(self.bytes.translate(table), bool)

    def _words_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def _hashed(self, sums: np.ndarray) -> np.ndarray:
        # A word counts from its own start: the powers up to there are taken out.
        return mixed(sums * _powers(_INVERSE, len(self.data))[self.starts])

    def exact(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        return self._hashed(self.sums)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word with A-Z in lower case."""
        capitals = np.flatnonzero(self._among(_CAPITAL))
        if not len(capitals):
            return self._hashed(self.sums)
        change = _LOWERED[self.data[capitals] - 65] * _powers(_BASE, len(self.data))[capitals]
        words = self._words_at(capitals)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        sums = self.sums.copy()
        sums[words[first]] += np.add.reduceat(change, first)
        return self._hashed(sums)

    def lines(self, leading: int, field: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Each line with a word, and the position of the first line of each text (and the end).

        A line has its ``place`` among all lines of its text, 64-bit hashes ``leaf`` (of the number of
        words and the leading ones) and ``line``, and ``n_words``; a word with a digit counts as ``field``.
        ``token`` has the hashes of the words of all lines, each with its place in its line.
        """
        if not len(self.starts):
            found = dict.fromkeys(("place", "leaf", "line", "n_words"), np.empty(0, np.int64))
            return found | {"token": np.empty(0, np.uint64)}, np.zeros(len(self.bounds), np.int64)
        hashes = self.exact()
        hashes[self._words_at(np.flatnonzero(self._among(_DIGIT)))] = Words(pa.array([field])).exact()[0]
        breaks = np.flatnonzero(self.data == 10)
        row = np.searchsorted(breaks, self.starts)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        n_words = np.diff(np.append(first, len(row)))
        at = np.arange(len(row)) - np.repeat(first, n_words)
        tokens = mixed(hashes + at.astype(np.uint64) * np.uint64(_STEP))
        counted = n_words.astype(np.uint64) * np.uint64(_COUNT)
        line = mixed(np.add.reduceat(tokens, first) + counted + np.uint64(_LINE))
        leaf = mixed(np.add.reduceat(np.where(at < leading, tokens, np.uint64(0)), first) + counted)
        place = row[first] - np.searchsorted(breaks, self.ends[:-1])[text[first]]
        found = {"place": place, "leaf": leaf.view(np.int64), "line": line.view(np.int64), "n_words": n_words, "token": tokens}
        return found, np.searchsorted(first, self.bounds)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and the position of the first word of each text (and the end)."""
    words = Words(texts)
    return words.hashes(), words.bounds


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, one after another, and their bounds.

    A text of fewer than five words has its whole sequence as one shingle; a text
    without words has none.
    """
    hashes, bounds = words.hashes(), words.bounds
    counts = np.diff(bounds)
    made, owner = [], []
    if len(hashes) >= WIDTH:
        rows = len(hashes) - WIDTH + 1
        total = sum(hashes[k : k + rows] * _PLACE[k] for k in range(WIDTH))
        text = np.repeat(np.arange(len(counts)), counts)
        inside = text[:rows] == text[WIDTH - 1 :]
        made.append(mixed(total[inside]))
        owner.append(text[:rows][inside])
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(WIDTH - 1):
            has = counts[short] > k
            total[has] += hashes[bounds[short[has]] + k] * _PLACE[k]
        made.append(mixed(total + counts[short].astype(np.uint64)))
        owner.append(short)
    if not made:
        return np.empty(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    values, owners = np.concatenate(made), np.concatenate(owner)
    if len(made) > 1:
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    limits = np.searchsorted(owners, np.arange(len(counts) + 1))
    for start, end in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        values[start:end].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """The MinHash signature (``size`` values of 32 bits) of each non-empty set, in order."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    result = np.empty((len(starts), size), np.uint32)
    if len(starts):
        flips, factors = _sequence(4, size), _sequence(5, size) | np.uint64(1)
        hashed = np.empty_like(values)
        for k in range(size):
            np.bitwise_xor(values, flips[k], out=hashed)
            np.multiply(hashed, factors[k], out=hashed)
            result[:, k] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return result
