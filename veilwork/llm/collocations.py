"""Phrases whose words stand together more often than their parts would, per language.

Texts (A-Z in lower case) are cut into pieces at punctuation and line ends, pieces into
words.  Every word of a piece is a suffix: it and the words behind it, up to the longest
phrase.  How often a phrase occurs is the number of suffixes that begin with it.

1. Words are counted.  No part of a frequent phrase is rarer than the phrase, so only
   frequent words matter further on.
2. Routes: suffixes go to the task of their first word.  A word that would fill more than
   half a route takes several, dealt by its second and third word; its pairs of words are
   then counted in parts and added up.  Within a task's buffer, equal suffixes are sent
   once with their number, so a passage that a third of all rows share is not sent per
   row.  What is sent are blocks: the suffixes of a route, as numbers of the words listed
   in the block.
3. Owners sort the suffix pointers of a route by multikey three-way quicksort, word by word:
   pointers smaller than, equal to and greater than the pivot's word; the equal ones go on
   with the next word until the longest phrase.  The weight of an equal partition is the
   count of its phrase.  A partition lighter than the least count is abandoned at
   once, as nothing below it can be frequent.
4. Frequent phrases are scored at every cut from the counts of both sides, those that a
   longer phrase nearly always contains are dropped, and each language keeps its best.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.arrow import pieces
from veilwork.llm.shingles import word_hashes
from veilwork.llm.text import whole
from veilwork.llm.work import written

LONGEST = 4
LEAST = 30
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
NO_LANG = "und"

BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"

# Suffixes of a route, about, and the number of routes; routes of one task at most.
ROUTE_SUFFIXES = 1_000_000
LEAST_ROUTES, MOST_ROUTES = 256, 1 << 20
ROUTES_PER_TASK = 8
# Suffixes, and different words, that a task holds before it sends what it has.
BUFFER_SUFFIXES = 1_000_000
BUFFER_WORDS = 500_000
# Partitions of pointers below this size are sorted at once.
SMALL = 4096

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Of all words of all texts, in order: the word, the number of its piece, the number of its text."""
    _, offsets, buffer = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffer or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KIND[data]
    filled = kind == 0
    begins = np.zeros(len(data) + 1, bool)  # a text begins here, or the data end
    begins[ends] = True
    before = np.ones(len(data), bool)
    before[1:] = ~filled[:-1]
    behind = np.ones(len(data), bool)
    behind[:-1] = ~filled[1:]
    starts = np.flatnonzero(filled & (before | begins[:-1]))
    sizes = np.flatnonzero(filled & (behind | begins[1:])) + 1 - starts
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)[filled]
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(lower))
    text = np.searchsorted(ends, starts, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + text if len(starts) else text
    return found.dictionary_encode(), piece, text


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        sizes = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False)
        for piece in pieces(batch, sizes):
            words, run, text = words_of(piece.column("body"))
            langs = piece.column("lang").dictionary_encode()
            yield words, run, langs.indices.to_numpy()[text], langs.dictionary


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per language, added up in the task as far as its buffer reaches."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
    held = schema.empty_table()

    def merged(table: pa.Table) -> pa.Table:
        return table.group_by(["lang", "word"]).aggregate([("f", "sum")]).rename_columns(schema.names).cast(schema)

    for words, _, lang, names in _read(batches):
        key, n = np.unique(lang.astype(np.int64) * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
        place, word = np.divmod(key, max(1, len(words.dictionary)))
        held = pa.concat_tables([held, pa.table([names.take(pa.array(place)), words.dictionary.take(pa.array(word)), n], schema)])
        if held.num_rows > BUFFER_WORDS:
            held = merged(held)
            if held.num_rows > BUFFER_WORDS // 2:
                yield from held.combine_chunks().to_batches()
                held = schema.empty_table()
    if held.num_rows:
        yield from merged(held).combine_chunks().to_batches()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    return _mixed(np.array([zlib.crc32(lang.encode()) + 1 for lang in langs.to_pylist()], np.uint64))


def _batch(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _sender(routes: int, spread: dict[tuple[str, str], int], longest: int):
    """A function from texts to blocks: lang, route, words, codes, counts."""
    names = ["lang", "route", "words", "codes", "counts"]
    types = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    heavy_langs = pa.array([lang for lang, _ in spread], pa.string())
    heavy_words = pa.array([word for _, word in spread], pa.string())

    def suffixes(held: list[tuple], word_number: np.ndarray, lang_number: np.ndarray) -> np.ndarray:
        """A column per suffix of at least two words: its language and its words, 0 behind the end of the piece."""
        word_at, lang_at, parts = 0, 0, []
        for words, run, lang, lang_names in held:
            number = word_number[word_at : word_at + len(words.dictionary)][words.indices.to_numpy()]
            word_at, lang_at = word_at + len(words.dictionary), lang_at + len(lang_names)
            part = np.zeros((longest + 1, len(number)), np.int32)
            part[0] = lang_number[lang_at - len(lang_names) : lang_at][lang]
            part[1] = number
            for step in range(1, longest):
                part[1 + step, :-step] = np.where(run[step:] == run[:-step], number[step:], 0)
            parts.append(part[:, part[2] > 0])
        return np.concatenate(parts, axis=1)

    def routed(table: np.ndarray, vocabulary: pa.Array, langs: pa.Array) -> np.ndarray:
        """The language and route of each suffix as one number, ``lang * routes + route``."""
        # Numbers for routing; that different words may have equal ones does no harm.
        word_hash = np.append(np.zeros(1, np.uint64), word_hashes(vocabulary)[0])
        route = _mixed(_lang_hashes(langs)[table[0]] ^ (word_hash[table[1]] * np.uint64(0x9E3779B97F4A7C15)))
        if spread:
            ways = np.ones((len(langs), len(vocabulary) + 1), np.uint64)
            known = pc.index_in(heavy_words, value_set=vocabulary).to_pylist()
            known_langs = pc.index_in(heavy_langs, value_set=langs).to_pylist()
            for word, lang, count in zip(known, known_langs, spread.values(), strict=True):
                if word is not None and lang is not None:
                    ways[lang, word + 1] = count
            third = word_hash[table[3]] if longest > 2 else np.uint64(0)
            route += _mixed(word_hash[table[2]] * np.uint64(0xD6E8FEB86659FD93) + third) % ways[table[0], table[1]]
        return table[0].astype(np.int64) * routes + (route % np.uint64(routes)).astype(np.int64)

    def counted(group: np.ndarray, words: np.ndarray, base: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal suffixes once, in order of group and words: their groups, words and numbers."""
        key, reach, levels = group, groups, []
        for column in words:
            if reach * base >= 1 << 62:
                different, key = np.unique(key, return_inverse=True)
                reach = len(different)
                levels.append(different)
            else:
                levels.append(None)
            key, reach = key * base + column, reach * base
        key = np.sort(key)
        limits = np.flatnonzero(np.append(np.append(True, key[1:] != key[:-1]), True))
        key, columns = key[limits[:-1]], []
        for different in reversed(levels):
            key, column = np.divmod(key, base)
            columns.append(column.astype(np.int32))
            if different is not None:
                key = different[key]
        return key, np.stack(columns[::-1]), np.diff(limits)

    def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # One numbering of words and languages for the whole buffer; 0 is the end of a piece.
        every = pa.concat_arrays([words.dictionary for words, *_ in held]).dictionary_encode()
        langs = pa.concat_arrays([lang_names for *_, lang_names in held]).dictionary_encode()
        vocabulary, lang_list = every.dictionary, langs.dictionary.to_pylist()
        table = suffixes(held, every.indices.to_numpy() + 1, langs.indices.to_numpy())
        held.clear()
        if not table.shape[1]:
            return
        group = routed(table, vocabulary, langs.dictionary)
        group, table, n = counted(group, table[1:], len(vocabulary) + 1, len(lang_list) * routes)
        n = n.astype("<u4")
        limits = np.flatnonzero(np.append(np.append(True, group[1:] != group[:-1]), True)).tolist()
        place = np.zeros(len(vocabulary) + 1, np.int32)  # of a word in the list of its block
        made: list[tuple] = []
        lists: list[np.ndarray] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), vocabulary.take(pa.array(np.concatenate(lists) - 1)))
            lang, way, codes, counts = zip(*made, strict=True)
            return _batch([lang, way, pc.binary_join(listed, " "), codes, counts], types, names)

        for a, b in zip(limits[:-1], limits[1:], strict=True):
            codes = table[:, a:b]
            used = np.sort(codes, axis=None)
            used = used[np.append(used[0] > 0, used[1:] != used[:-1])]
            place[used] = np.arange(1, len(used) + 1)
            codes = place[codes].astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes()
            lang, way = divmod(int(group[a]), routes)
            made.append((lang_list[lang], way, codes, n[a:b].tobytes()))
            lists.append(used)
            size += 8 * len(used) + len(codes)
            if size > 4_000_000:
                yield batch()
                made, lists, size = [], [], 0
        if made:
            yield batch()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in _read(batches):
            held.append(part)
            size += len(part[0])
            if size >= BUFFER_SUFFIXES:
                yield from blocks(held)  # which empties ``held``
                size = 0
        if held:
            yield from blocks(held)

    return send


def _runs(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``keys``: the sorting order, where each different key begins in it (and the end), and their weights."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    limits = np.flatnonzero(np.append(np.append(True, ordered[1:] != ordered[:-1]), True))
    return order, limits, np.add.reduceat(weights[order], limits[:-1])


def quicksort(columns: np.ndarray, weights: np.ndarray, least: int, parts_of: set[int]) -> Iterator[tuple]:
    """Multikey three-way quicksort of suffix pointers.

    ``columns[d]`` is the word number of every suffix at depth ``d`` (0: none), ``weights`` its
    number of places.  Yields (words, weight, partial) for each beginning of two and more words
    that weighs at least ``least``.  Of first words in ``parts_of`` only a part of the
    suffixes may be here: their pairs are all given, with the mark ``partial``.
    """
    longest = len(columns)
    shared = np.isin(columns[0], list(parts_of))
    # First words of which only a part is here are never abandoned for being few here.
    stack = [(np.flatnonzero(columns[0] == word), 1, (word,)) for word in np.unique(columns[0][shared]).tolist()]
    stack.append((np.flatnonzero(~shared), 0, ()))
    while stack:
        pointers, depth, path = stack.pop()
        in_parts = depth == 1 and path[0] in parts_of
        if not in_parts and weights[pointers].sum() < least:
            continue  # abandoned: no equal partition in here can be heavy enough
        keys = columns[depth][pointers]
        if in_parts or len(pointers) <= SMALL:
            order, limits, sums = _runs(keys, weights[pointers])
            wanted = np.arange(len(sums)) if in_parts else np.flatnonzero(sums >= least)
            equal = [(pointers[order[limits[k] : limits[k + 1]]], int(sums[k])) for k in wanted.tolist()]
        else:
            sample = keys[:: max(1, len(keys) // 63)]
            pivot = np.partition(sample, len(sample) // 2)[len(sample) // 2]
            stack.append((pointers[keys < pivot], depth, path))
            stack.append((pointers[keys > pivot], depth, path))
            same = pointers[keys == pivot]
            equal = [(same, int(weights[same].sum()))]
        for same, weight in equal:
            word = int(columns[depth][same[0]])
            if word == 0 or (weight < least and not in_parts):
                continue
            if depth:
                yield (*path, word), weight, in_parts
            if depth + 1 < longest and weight >= least:
                stack.append((same, depth + 1, (*path, word)))


def _owner(spread: dict[tuple[str, str], int], longest: int, least: int):
    """A function from the blocks of whole routes, which come in order of route, to phrases."""
    names = ["lang", "phrase", "words", "f", "partial"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]

    def phrases(lang: str, blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        listed = pc.split_pattern(pa.array([words for words, _, _ in blocks], pa.string()), " ")
        every = listed.flatten().dictionary_encode()
        numbers, at, columns, weights = every.indices.to_numpy(), 0, [], []
        sizes = pc.list_value_length(listed).to_pylist()
        for size, (_, codes, counts) in zip(sizes, blocks, strict=True):
            n = np.frombuffer(counts, "<u4").astype(np.int64)
            wide = len(codes) // (longest * len(n))
            codes = np.frombuffer(codes, f"<u{wide}").reshape(longest, len(n))
            known = np.append(np.int32(0), numbers[at : at + size] + 1).astype(np.int32)
            at += size
            columns.append(known[codes])
            weights.append(n)
        heavy = pa.array([word for where, word in spread if where == lang], pa.string())
        parts_of = {k + 1 for k in pc.index_in(heavy, value_set=every.dictionary).to_pylist() if k is not None}
        found = quicksort(np.concatenate(columns, axis=1), np.concatenate(weights), least, parts_of)
        while made := list(islice(found, 100_000)):
            paths, f, partial = zip(*made, strict=True)
            ends = np.cumsum([0, *map(len, paths)]).astype(np.int32)
            words = every.dictionary.take(pa.array(np.fromiter(chain.from_iterable(paths), np.int64) - 1))
            phrase = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ")
            yield _batch([[lang] * len(made), phrase, np.diff(ends), f, partial], types, names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            sizes = pc.binary_length(batch.column("codes")).to_numpy()
            for part in pieces(batch, sizes):
                for lang, route, *block in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (lang, route) != current:
                        if held:
                            yield from phrases(current[0], held)
                        current, held = (lang, route), []
                    held.append(block)
        if held:
            yield from phrases(current[0], held)

    return own


def frequent(df: DataFrame, lang: str, text: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases (``lang``, ``phrase``, ``words``, ``f``) of one to ``longest`` words that occur at least
    ``least`` times, and the number ``n`` of all words per language.  Both are written tables."""
    spark = df.sparkSession
    rows = df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), whole(F.col(f"`{text}`")).alias("body")
    )
    counted = rows.mapInArrow(_count_words, "lang string, word string, f bigint")
    words = written(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    routes = min(MOST_ROUTES, max(LEAST_ROUTES, math.ceil(total / ROUTE_SUFFIXES)))
    # Words that would fill half a route: fewer than twice the routes, as their counts sum up to the total.
    half = total / routes / 2
    heavy = words.filter((F.col("f") >= least) & (F.col("f") > half)).collect()
    spread = {(r["lang"], r["word"]): math.ceil(r["f"] / half) for r in heavy}
    sent = rows.mapInArrow(
        _sender(routes, spread, longest), "lang string, route int, words string, codes binary, counts binary"
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), routes // ROUTES_PER_TASK)
    dealt = sent.repartition(tasks, "route").sortWithinPartitions("route", "lang")
    found = dealt.mapInArrow(
        _owner(spread, longest, least), "lang string, phrase string, words int, f bigint, partial boolean"
    )
    found = written(found, "phrases")
    added = found.filter("partial").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    whole_counts = found.filter("not partial").drop("partial").unionByName(added).unionByName(single)
    return written(whole_counts.filter(F.col("f") >= least), "frequent"), totals


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _scored(counts: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a`` and its lowest cut: ``l``, ``r``, ``score``."""
    many = counts.filter("words > 1").withColumnRenamed("f", "a")
    cuts = many.select("*", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k",
        _part(F.col("w"), F.lit(1), F.col("k")).alias("first"),
        _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _covers(counts: DataFrame, longest: int) -> DataFrame:
    """``lang``, ``phrase`` and ``over``: the count of its most frequent longer phrase."""
    many = counts.filter("words > 2").withColumn("w", F.split("phrase", " "))
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    starts = F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start")
    parts = many.select("lang", "w", "words", "f", size).select("lang", "w", "f", "size", starts)
    parts = parts.select("lang", _part(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), "f")
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("over"))


def mine(
    df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
    covered_percent: int = COVERED_PERCENT, top: int | None = TOP,
) -> DataFrame:
    """Per language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a``, ``l`` and ``r`` count the phrase and both sides of its lowest-scoring cut (ties: the
    shortest first part), ``n`` all words of the language; the score is
    ``floor(2000000 a / (l + r))``.  A phrase that a longer frequent one contains with at least
    ``covered_percent`` of its count is dropped.  Ranks go by score and count, both from the
    highest, and phrase in byte order; ``top`` ends them (None: all).

    A null language is ``und``; null, empty and blank texts have no words.  Repeated rows count
    as often as they stand there.  Other columns are not read.  An empty table, or one
    without a phrase frequent enough, gives an empty result.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    counts, totals = frequent(df, lang, text, longest, least)
    scored = written(_scored(counts), "scored")
    kept = scored.join(_covers(counts, longest), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("over").isNull() | (F.lit(100) * F.col("over") < F.lit(covered_percent) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)  # Spark keeps the best of each task before it shuffles
    ranked = ranked.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
