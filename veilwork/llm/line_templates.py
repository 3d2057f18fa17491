"""Line dedup by a tree of line templates.

Every line with a word goes down a tree of fixed depth: first by its number of
words, then by its leading words; a word with a digit is a variable field there.
The lines of one leaf are generalised together: a word that few other lines of the
leaf have at its place is a variable field as well, provided that enough of the
line stays fixed.  Lines that agree in all fixed words share a template.

Few is a share: the words of a line that are shared most, as many as have to stay
fixed, tell how many different lines its template has, and a word is fixed if more
than half as many lines hold it.  So values from a finite list are a variable field
on a table of any size.

A template recurs if at least ``min_groups`` groups of near copies contain it; a text
that is no near copy is a group of its own.  Sequences of lines recur in fewer groups
if they are long (``runs``).  Only the groups decide what counts once: versions of one text that
are no near copies lose the passages they share, as unrelated texts do.  All lines of
a recurring template or sequence are dropped from all documents.

One pass over the texts gives the 64-bit hashes of their lines and what near copies are
found by; lines travel as these hashes.  Words are compared only in leaves with two or more
different lines, and each of those lines is read from one text.  The lists of those leaves,
of the lines to read, of templates and of dropped lines per text are broadcast up to a number of bytes of their files; beyond it, texts are shuffled to meet them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm import near_duplicates
from veilwork.llm.arrow import pieces
from veilwork.llm.shingles import Words, mixed
from veilwork.llm.text import WORD, held, whole
from veilwork.llm.work import discard, small, written

LEADING = 3
FIXED_PERCENT = 70
MIN_GROUPS = 5
# Sequences of lines of more words than the first number recur in as many groups as the second.
RUNS = ((50, 2), (30, 3))
# Texts are near copies from this similarity on, in percent of their shingles.
NEAR = 80
FIELD = "<*>"
# Tables of larger files are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 4_000_000
# The lines of a leaf are compared in one place if they have up to so many words together.
LEAF_TOKENS = 20_000
# What is kept of each line; ``n_words`` counts its words.
_LINE = pa.struct([("place", pa.int32()), ("leaf", pa.int64()), ("line", pa.int64()), ("n_words", pa.int64())])
_DESCRIBED = f"{near_duplicates.DESCRIBED}, shown array<struct<place: int, leaf: bigint, line: bigint, n_words: bigint>>"


def _described(leading: int):
    """The description of near copies, with the lines of each text."""

    def lines(words: Words) -> dict[str, pa.Array]:
        found, bounds = words.lines(leading, FIELD)
        columns = [pa.array(found[f.name], f.type) for f in _LINE]
        return {"shown": pa.ListArray.from_arrays(
            pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_LINE)))}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return near_duplicates.describe(batches, lines)

    return work


def _open_lines(bodies: DataFrame, placed: DataFrame) -> DataFrame:
    """``line`` and its ``text``, once for each line that shares its leaf with other lines."""
    shared = placed.groupBy("leaf").agg(F.min("line").alias("least"), F.max("line").alias("most"))
    shared = small(written(shared.filter("least < most").select("leaf"), "leaves"), BROADCAST_BYTES)
    # Each line is read from one text only.
    where = placed.join(shared, "leaf", "left_semi").groupBy("line").agg(F.min(F.struct("key", "place")).alias("first"))
    where = where.groupBy(F.col("first.key").alias("key")).agg(
        F.collect_list(F.struct("line", F.col("first.place").alias("place"))).alias("wanted"))
    found = bodies.join(small(written(where, "wanted"), BROADCAST_BYTES), "key")
    cut = held(found, ["wanted"], text=F.split("body", "\n", -1)).select("text", F.inline("wanted"))
    return cut.select("line", F.get("text", F.col("place")).alias("text")).distinct()  # copies of the text repeat it


def _tokens(leading: int):
    """line, text -> leaf, line, token: one token for each word, of the word, its place and the leaf."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                found, _ = Words(piece.column(1)).lines(leading, FIELD)  # each text is one line
                n_words, leaf = found["n_words"], found["leaf"]
                tokens = mixed(found["token"] ^ np.repeat(leaf.view(np.uint64), n_words))
                ends = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64)))],
                    names=["leaf", "line", "token"])

    return work


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in pieces that hold all lines of their leaves; rows come sorted by leaf."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        leaf = rows.column("leaf").to_numpy()
        last = int(np.searchsorted(leaf, leaf[-1]))
        if last:
            yield rows.slice(0, last)
        rest = rows.slice(last)
    if rest is not None:
        yield rest


def _agreed(fixed_percent: int):
    """leaf, line, token -> line, template, for rows sorted by leaf."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _complete(batches):
            rows = rows.combine_chunks()
            tokens = rows.column("token")
            values = pc.list_flatten(tokens).to_numpy().view(np.uint64)
            size = pc.list_value_length(tokens).to_numpy().astype(np.int64)
            _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
            n = counts[which]
            fixed = np.flatnonzero(n > 1)
            owner, n, values = np.repeat(np.arange(len(size)), size)[fixed], n[fixed], values[fixed]
            n_fixed = np.bincount(owner, minlength=len(size))
            known = (n_fixed > 0) & (n_fixed * 100 >= size * fixed_percent)
            must = np.maximum(np.ceil(size * fixed_percent / 100).astype(np.int64), 1)
            least = np.zeros(len(size), np.int64)
            first = np.cumsum(n_fixed) - n_fixed
            least[known] = n[np.lexsort((-n, owner))][(first + must - 1)[known]]
            stay = n * 2 > least[owner]
            total = size.astype(np.uint64)
            np.add.at(total, owner[stay], mixed(values[stay]))
            yield pa.RecordBatch.from_arrays(
                [pc.filter(rows.column("line"), pa.array(known)).combine_chunks(), pa.array(mixed(total)[known].view(np.int64))],
                names=["line", "template"])

    return work


def _agreed_in_large(lines: DataFrame, fixed_percent: int) -> DataFrame:
    """The same for leaves of any size: words meet under their token."""
    tokens = lines.select("line", F.size("token").alias("size"), F.explode("token").alias("token"))
    # Stored, so that the join with it can split a leaf word that very many lines have.
    fixed = written(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "fixed")
    # One row per fixed word; the words of one line meet again under their line.
    known = tokens.join(fixed, "token").groupBy("line", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "token")), asc=False).alias("fixed")
    )
    known = known.filter(F.size("fixed") * F.lit(100) >= F.col("size") * F.lit(fixed_percent))
    must = F.ceil(F.col("size") * F.lit(fixed_percent) / F.lit(100)).cast("int")
    least = F.get(F.col("fixed.n"), F.greatest(must, F.lit(1)) - 1)
    known = held(known, ["line", "size", "fixed"], least=least)
    stay = F.filter("fixed", lambda x: x.getField("n") * 2 > F.col("least")).getField("token")
    return known.select("line", F.xxhash64("size", F.sort_array(stay)).alias("template"))


def _generalised(bodies: DataFrame, placed: DataFrame, leading: int, fixed_percent: int) -> DataFrame:
    """``line`` -> ``template`` for the lines that share a leaf with other lines.

    A word is fixed if another line of the leaf has it at its place, and more than half as many
    lines have it as have the least shared of the words that must stay.  Leaves of up to
    ``LEAF_TOKENS`` words are compared in one place each, the words of larger ones are shuffled.
    """
    lines = _open_lines(bodies, placed).mapInArrow(_tokens(leading), "leaf bigint, line bigint, token array<bigint>")
    lines = written(lines, "lines")
    large = lines.groupBy("leaf").agg(F.sum(F.size("token")).alias("n")).filter(F.col("n") > LEAF_TOKENS).select("leaf")
    large = small(written(large, "large"), BROADCAST_BYTES)
    dealt = lines.join(large, "leaf", "left_anti").repartition("leaf").sortWithinPartitions("leaf")
    found = dealt.mapInArrow(_agreed(fixed_percent), "line bigint, template bigint")
    return found.union(_agreed_in_large(lines.join(large, "leaf", "left_semi"), fixed_percent))


def _sequences(lines: DataFrame, more_than: int) -> DataFrame:
    """The shortest sequences of more than so many words from each line on, and up to each line.

    ``lines`` are those that other groups have; a sequence has no other line in between.
    Every line of a longer sequence that two texts share is in one of these.
    """
    ordered = Window.partitionBy("key").orderBy("at")
    lines = lines.withColumn("run", F.col("at") - F.row_number().over(ordered))
    lines = lines.withColumn("end", F.sum("n_words").over(Window.partitionBy("key", "run").orderBy("at")))
    lines = lines.withColumn("start", F.col("end") - F.col("n_words"))
    onward = Window.partitionBy("key", "run").orderBy("start").rangeBetween(0, more_than)
    back = Window.partitionBy("key", "run").orderBy("end").rangeBetween(-more_than, 0)
    made = []
    for reach, first, last in ((onward, F.col("at"), F.col("at") + F.size("part") - 1),
                               (back, F.col("at") - F.size("part") + 1, F.col("at"))):
        found = lines.withColumns({"part": F.collect_list("template").over(reach), "words": F.sum("n_words").over(reach)})
        made.append(found.filter(F.col("words") > more_than).select(
            "key", "group", first.alias("first"), last.alias("last"), F.xxhash64("part").alias("sequence")))
    return made[0].union(made[1])


def recurring(
    bodies: DataFrame, leading: int = LEADING, min_groups: int = MIN_GROUPS, fixed_percent: int = FIXED_PERCENT, runs=RUNS
) -> DataFrame:
    """``key``, ``place`` of the lines that recur in different groups of near copies.

    ``bodies`` has ``key`` (the SHA-256 of the text) and ``body``.
    """
    texts = bodies.select(F.col("key").alias("text_key"), F.col("body").alias("text"))
    described = written(texts.mapInArrow(_described(leading), _DESCRIBED), "described")
    rows = F.transform("shown", lambda x, i: F.struct(i.alias("at"), *[x.getField(f.name).alias(f.name) for f in _LINE]))
    # One narrow row per line with a word; ``at`` counts them.  Copies of a text repeat its rows.
    placed = described.select(F.col("text_key").alias("key"), F.inline(rows))
    templates = written(_generalised(bodies, placed, leading, fixed_percent), "templates")
    lines = placed.withColumn("number", F.xxhash64("key")).join(small(templates, BROADCAST_BYTES), "line", "left")
    lines = lines.select("key", "number", "place", "at", "n_words", F.coalesce("template", F.col("line")).alias("template"))
    lines = written(lines, "named")
    several = lines.groupBy("template").agg(F.min("number").alias("least"), F.max("number").alias("most"))
    several = written(several.filter("least < most").select("template"), "several")
    shared = written(lines.join(small(several, BROADCAST_BYTES), "template", "left_semi").distinct(), "shared")
    discard(templates, lines, several)
    numbered = described.drop("shown").withColumn("doc_id", F.xxhash64("text_key"))
    alike = near_duplicates.components_of(texts, numbered, NEAR)
    alike = written(alike.select(F.col("doc_id").alias("number"), F.col("component_id").alias("group")).distinct(), "alike")
    grouped = written(shared.join(small(alike, BROADCAST_BYTES), "number").drop("number"), "grouped")
    discard(shared, alike, described)
    spread = grouped.groupBy("template").agg(F.countDistinct("group").alias("groups")).filter("groups > 1")
    spread = written(spread, "spread")
    repeated = written(grouped.join(spread, "template"), "repeated")
    discard(grouped, spread)
    dropped = repeated.filter(F.col("groups") >= min_groups).select("key", "at")
    for more_than, least in runs:
        sequences = written(_sequences(repeated, more_than), "sequences")
        found = sequences.groupBy("sequence").agg(F.countDistinct("group").alias("n")).filter(F.col("n") >= least)
        found = sequences.join(written(found, "found"), "sequence", "left_semi")
        dropped = dropped.union(found.select("key", F.explode(F.sequence("first", "last")).alias("at")))
    return repeated.join(dropped.distinct(), ["key", "at"], "left_semi").select("key", "place")


def drop_recurring(df: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``row`` (the input row as a struct), ``text`` without dropped lines, ``n_lines``, ``n_dropped``.

    ``n_lines`` counts lines with a word; lines without one are never dropped.  A
    text without dropped lines stays as it is, a null text stays null, and a text of
    which all lines are dropped becomes empty.  The decision depends on texts only,
    so repeated rows get equal results, whatever their other columns hold.  An
    empty table gives an empty result.  ``settings`` are those of ``recurring``.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    body = whole(F.col("row").getField(text))
    packed = packed.select("row", F.unhex(F.sha2(body, 256)).alias("key"))
    bodies = df.select(whole(text).alias("body")).select("body", F.unhex(F.sha2("body", 256)).alias("key"))
    dropped = recurring(bodies, **settings)
    # One entry per text: its dropped places as flags, so that each line is looked up at once.
    flags = dropped.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    flags = flags.withColumn("runs", F.transform(
        F.sequence(F.lit(0), F.size("places") - 1),
        lambda i: F.get("places", i) - F.coalesce(F.when(i > 0, F.get("places", i - 1)), F.lit(-1)) - 1,
    ))
    flags = held(flags, ["key"], flag=F.flatten(F.transform(
        "runs", lambda run: F.concat(F.array_repeat(F.lit(False), run), F.array(F.lit(True))))))
    joined = packed.join(small(written(flags, "dropped"), BROADCAST_BYTES), "key", "left")
    cut = held(joined, ["row", "flag"], line=F.split(whole(F.col("row").getField(text)), "\n", -1))
    kept = F.array_join(F.filter("line", lambda x, i: ~F.coalesce(F.get("flag", i), F.lit(False))), "\n")
    filled = F.size(F.filter("line", lambda x: x.rlike(WORD))).cast("long")
    gone = F.coalesce(F.size(F.filter("flag", lambda x: x)), F.lit(0)).cast("long")
    return cut.select(
        "row",
        F.when(F.col("flag").isNull(), F.col("row").getField(text)).otherwise(kept).alias("text"),
        filled.alias("n_lines"),
        gone.alias("n_dropped"),
    )


def without_recurring_lines(df: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``df`` with its columns, and recurring lines dropped from ``text``."""
    done = drop_recurring(df, text, **settings)
    return done.select(
        *[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns]
    )
