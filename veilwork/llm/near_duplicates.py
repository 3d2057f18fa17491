"""Near duplicates by an inverted join on MinHash signature coordinates.

1. Sets: each text gives its set of hashed 5-word shingles, a digest of that set and
   a signature of ``COORDINATES`` values.  Texts with the same set form a class; from
   here on, classes are joined, so a text that a third of all rows share is one entry.
2. Postings: a class with too few live values (those that another class has as well) among
   its first ones leaves.  The others are posted under each (coordinate, value).  Values that only one class has cannot collide and are left out; a class with
   fewer live values than ``matches`` cannot be linked and leaves.  Of the others only a prefix is posted:
   their rarest values, so many that two classes with enough collisions must meet
   in one of them.  Passages shared by very many texts are thus not posted by texts
   that have anything else.
3. Clusters: classes that meet in a posting list belong to one cluster (connected
   components over list heads, not pairs).
4. Blocks: a cluster is cut into blocks of bounded size.  A task holds one block,
   counts collisions with the prefix lists, skips pairs that are connected already,
   and confirms the rest on full shingle sets.  It returns at most one link per
   class.  Between the blocks of a large cluster, first one pivot per block is
   compared with all classes, then every class that is not connected with the
   largest component of its cluster.

``matches`` is chosen so that a pair at the threshold itself misses it with a
probability below ``MISS``; links are exact (full sets), and no pair is left out for
the size of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.arrow import pieces
from veilwork.llm.components import components
from veilwork.llm.shingles import Words, shingle_sets, signatures
from veilwork.llm.text import whole
from veilwork.llm.work import hinted, written

COORDINATES = 64
MISS = 1e-7
BROADCAST_ROWS = 1_000_000
# So many live values are asked of a class at the first look, which leaves out as many coordinates as it can.
SPARE = 8
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000
# What ``describe`` gives of each text.
DESCRIBED = "text_key binary, n_shingles bigint, set_key binary, signature array<int>"
# Text that is hashed at a time; a single longer text is a piece of its own.
_PIECE = 1_000_000


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions to ask for so that a pair at the threshold reaches them but for ``miss``."""
    share, below = percent / 100, 0.0
    for count in range(coordinates + 1):
        below += math.comb(coordinates, count) * share**count * (1 - share) ** (coordinates - count)
        if below > miss:
            return max(1, count)
    return coordinates


def describe(batches: Iterator[pa.RecordBatch], more=None) -> Iterator[pa.RecordBatch]:
    """text_key, text, others -> others, text_key, n_shingles, set_key, signature, and the columns that ``more`` makes of the words."""
    for batch in batches:
        for piece in pieces(batch, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), _PIECE):
            words = Words(piece.column(1))
            values, bounds = shingle_sets(words)
            added = more(words) if more else {}
            sizes = np.diff(bounds)
            found = signatures(values, bounds, COORDINATES)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, COORDINATES, 0))]).astype(np.int32)
            keys = [
                hashlib.blake2b(values[s:e].tobytes(), digest_size=16).digest()
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            ]
            coordinates = pa.array(found.ravel().view(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.columns[2:], piece.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), coordinates), *added.values(),
                ],
                names=[*piece.schema.names[2:], "text_key", "n_shingles", "set_key", "signature", *added],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, text -> class, shingles."""
    for batch in batches:
        for piece in pieces(batch, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), _PIECE):
            values, bounds = shingle_sets(Words(piece.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["class", "shingles"])


def _tokens(classes: DataFrame, coordinates: int) -> DataFrame:
    """``class``, ``token``: the first so many values of the signatures, with their coordinates."""
    tokens = classes.select("class", F.posexplode(F.slice("signature", 1, coordinates)).alias("at", "value"))
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return tokens.select("class", token.alias("token"))


def _live(tokens: DataFrame) -> DataFrame:
    live = written(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "live")
    return hinted(live, BROADCAST_ROWS)


def _prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """``class`` -> ``prefix``: its rarest live values, for classes that have enough live values."""
    # First, by narrow counts: which classes have as many of their first values alive as they must.
    spare = min(SPARE, matches)
    first = _tokens(classes, COORDINATES - matches + spare)
    alive = first.join(_live(first), "token").groupBy("class").agg(F.count("*").alias("alive"))
    alive = written(alive.filter(F.col("alive") >= spare).select("class"), "alive")
    tokens = _tokens(classes.join(hinted(alive, BROADCAST_ROWS), "class", "left_semi"), COORDINATES)
    posted = tokens.join(_live(tokens), "token")
    lists = posted.groupBy("class").agg(F.collect_list(F.struct("n", "token")).alias("live"))
    lists = lists.filter(F.size("live") >= matches)
    ordered = F.sort_array("live").getField("token")
    return lists.select("class", F.slice(ordered, 1, F.size("live") - (matches - 1)).alias("prefix"))


class _Members:
    """The classes of a block in memory, with posting lists over their prefixes."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.signature = np.array([r["signature"] for r in rows], np.int32)
        self.sizes = np.array([len(r["shingles"]) for r in rows])
        self.lists = defaultdict(list)
        self.root = {r["label"]: r["label"] for r in rows}

    def find(self, label: int) -> int:
        while self.root[label] != label:
            self.root[label] = self.root[self.root[label]]
            label = self.root[label]
        return label

    def post(self, at: int) -> None:
        for token in self.rows[at]["prefix"]:
            self.lists[token].append(at)

    def collisions(self, row: dict, matches: int, percent: int) -> np.ndarray:
        """Members that share a value of the prefixes, enough of all values and are alike in size."""
        met = [self.lists[token] for token in row["prefix"] if token in self.lists]
        if not met:
            return np.empty(0, np.int64)
        met = np.unique(np.concatenate(met))
        size = len(row["shingles"])
        alike = self.sizes[met]
        met = met[(100 * np.minimum(alike, size) >= percent * np.maximum(alike, size))]
        counts = (self.signature[met] == np.array(row["signature"], np.int32)).sum(axis=1)
        met, counts = met[counts >= matches], counts[counts >= matches]
        return met[np.argsort(-counts, kind="stable")]

    def linked(self, row: dict, at: int, percent: int) -> bool:
        mine, other = row["shingles"], self.rows[at]["shingles"]
        both = len(np.intersect1d(mine, other, assume_unique=True))
        return 100 * both >= percent * (len(mine) + len(other) - both)


def _read_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    shingles = batch.column(names.index("shingles"))
    values = shingles.values.to_numpy(zero_copy_only=False)
    ends = shingles.offsets.to_numpy()
    rest = batch.drop_columns(["shingles"]).to_pylist()
    for row, start, end in zip(rest, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        row["shingles"] = values[start:end]
        yield row


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys; rows come sorted by them."""
    current, rows = None, []
    for batch in batches:
        for piece in pieces(batch, 8 * pc.list_value_length(batch.column("shingles")).to_numpy(zero_copy_only=False)):
            for row in _read_rows(piece):
                key = tuple(row[k] for k in keys)
                if key != current and rows:
                    yield rows
                    rows = []
                current = key
                rows.append(row)
    if rows:
        yield rows


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pivot", pa.bool_())])
_LINKS_DDL = "a bigint, b bigint, pivot boolean"


def _packed(links: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(v, f.type) for v, f in zip(zip(*links, strict=True), _LINKS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_LINKS)


def _within_blocks(matches: int, percent: int):
    """(class, smallest class that links inside its block connect it with); (x, x, true) names the pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["cluster", "block"]):
            members, degree = _Members(rows), defaultdict(int)
            for at, row in enumerate(rows):
                for other in members.collisions(row, matches, percent).tolist():
                    mine, theirs = members.find(row["label"]), members.find(rows[other]["label"])
                    if mine != theirs and members.linked(row, other, percent):
                        members.root[max(mine, theirs)] = min(mine, theirs)
                        degree[at] += 1
                        degree[other] += 1
                members.post(at)
            links = [(r["class"], members.find(r["label"]), False) for r in rows if members.find(r["label"]) != r["class"]]
            if rows[0]["blocks"] > 1:
                pivot = rows[max(range(len(rows)), key=lambda at: (degree[at], -at))]["class"]
                links.append((pivot, pivot, True))
            if links:
                yield _packed(links)

    return work


def _against_probes(matches: int, percent: int):
    """Pairs of labels that links between the probes of a group and the members of its block connect."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["cluster", "target", "chunk"]):
            members, links = _Members(rows), []
            for at, row in enumerate(rows):
                if not row["probe"]:
                    members.post(at)
            for row in rows:
                if not row["probe"]:
                    continue
                for other in members.collisions(row, matches, percent).tolist():
                    mine, theirs = members.find(row["label"]), members.find(rows[other]["label"])
                    if mine != theirs and members.linked(row, other, percent):
                        members.root[max(mine, theirs)] = min(mine, theirs)
                        links.append((row["label"], rows[other]["label"], False))
            if links:
                yield _packed(links)

    return work


def _relabelled(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``members`` with labels that the pairs connect made equal."""
    found = components(pairs).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return members.join(found, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def _probed(members: DataFrame, probes: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs of labels from links of ``probes`` with the members of all other blocks of their cluster.

    Members of a block meet the probes of a cluster in chunks, so a task holds one
    block and one chunk.
    """
    chunk = F.floor((F.row_number().over(Window.partitionBy("cluster", "block").orderBy("class")) - 1) / F.lit(BLOCK_CLASSES))
    probes = written(probes.withColumn("chunk", F.col("block") + F.col("blocks") * chunk), "probes")  # of one block each
    # One row per large cluster, so that a cluster with very many members is not one key of a join.
    last = hinted(written(probes.groupBy("cluster").agg(F.collect_set("chunk").alias("chunks")), "chunks"), BROADCAST_ROWS)
    sent = probes.withColumn("target", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.filter("target <> block").withColumn("probe", F.lit(True))
    met = members.join(last, "cluster").withColumn("chunk", F.explode("chunks")).drop("chunks")
    met = met.filter(F.col("chunk") % F.col("blocks") != F.col("block"))
    met = met.withColumns({"target": F.col("block"), "probe": F.lit(False)})
    columns = ["cluster", "target", "chunk", "probe", "class", "label", "signature", "prefix", "shingles"]
    both = sent.select(*columns).unionByName(met.select(*columns)).repartition("cluster", "target", "chunk")
    sorted_rows = both.sortWithinPartitions("cluster", "target", "chunk", "probe", "class")
    return sorted_rows.mapInArrow(_against_probes(matches, percent), _LINKS_DDL)


def connected(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``class`` -> ``label``: the smallest class that links connect it with, where that is another one.

    ``classes``: class, text_key, n_shingles, signature; ``texts``: text_key, text.
    """
    matches = least_matches(percent)
    prefixes = written(_prefixes(classes, matches), "prefixes")
    posted = prefixes.select("class", F.explode("prefix").alias("token"))
    heads = posted.groupBy("token").agg(F.min("class").alias("head"), F.count("*").alias("n")).filter("n > 1")
    meetings = posted.join(heads, "token").select(F.col("class").alias("a"), F.col("head").alias("b"))
    clusters = components(meetings).select(F.col("node").alias("class"), F.col("label").alias("cluster"))
    near = clusters.join(prefixes, "class").join(classes, "class")
    near = written(near.select("class", "cluster", "prefix", "signature", "n_shingles", "text_key"), "near")
    wanted = hinted(written(near.select("class", "text_key"), "wanted"), BROADCAST_ROWS // 10)
    found = texts.join(wanted, "text_key").groupBy("class").agg(F.first("text").alias("text"))
    sets = found.select("class", "text").mapInArrow(_full_sets, "class bigint, shingles array<bigint>")
    load = near.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    load = load.select("cluster", F.greatest(
        F.ceil(F.col("n") / F.lit(BLOCK_CLASSES)), F.ceil(F.col("s") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    members = near.join(sets, "class").join(load, "cluster").select(
        "cluster", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"),
        "class", F.col("class").alias("label"), "signature", "prefix", "shingles",
    )
    members = written(members, "members")
    blocked = members.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "class")
    inside = written(blocked.mapInArrow(_within_blocks(matches, percent), _LINKS_DDL), "links")
    stars = inside.filter("not pivot").select(F.col("a").alias("class"), F.col("b").alias("label"))
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return stars
    known = large.drop("label").join(stars, "class", "left").withColumn("label", F.coalesce("label", "class"))
    known = written(known, "labelled")
    pivots = known.join(inside.filter("pivot").select(F.col("a").alias("class")), "class", "left_semi")
    across = written(_probed(known, pivots, matches, percent), "links").select("a", "b")
    joined = written(_relabelled(known, across), "labelled")
    counts = joined.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("cluster").agg(F.max(F.struct("n", "label")).getField("label").alias("most"))
    rest = joined.join(hinted(written(most, "most"), BROADCAST_ROWS), "cluster").filter("label <> most").drop("most")
    remaining = written(_probed(joined, rest, matches, percent), "links").select("a", "b")
    first = known.select("class", "label").union(stars.join(known, "class", "left_anti"))
    return _relabelled(first, across.union(remaining)).filter("class <> label").select("class", "label")


def _described(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts with their digest, and one narrow row per document with its set and signature."""
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole(text).alias("text"))
    texts = rows.select(F.unhex(F.md5("text")).alias("text_key"), "text", "doc_id")
    return texts.drop("doc_id"), written(texts.mapInArrow(describe, f"doc_id bigint, {DESCRIBED}"), "described")


def components_of(texts: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """The described rows with ``component_id``."""
    classes = described.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("smallest"), F.min("text_key").alias("text_key"),
        F.min("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
    )
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    labelled = classes.join(connected(classes, texts, percent), "class", "left").select(
        "set_key", "smallest", F.coalesce("label", F.col("class")).alias("label"))
    labelled = written(labelled, "labelled")
    # Stored, so that the join with them can split a component with very many classes.
    smallest = written(labelled.groupBy("label").agg(F.min("smallest").alias("component_id")), "smallest")
    found = written(labelled.join(smallest, "label").select("set_key", "component_id"), "found")
    result = described.drop("signature").join(found, "set_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.withColumn("component_id", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their shingle
    sets; ``component_id`` is the smallest id reachable over links.  Texts without
    words (null and empty ones too) have no shingles, are linked with nothing and keep
    their own id.  A null id is above every id; a component without any id has a null
    ``component_id``.  ``kept`` tells whether the id is that of the component, so rows
    that repeat an id and its text are kept together.  Other columns are not read; an
    empty table gives an empty result.
    """
    texts, described = _described(df, doc_id, text)
    return components_of(texts, described, percent).select("doc_id", "n_shingles", "component_id", "kept")


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``df`` that ``groups`` keeps, with its columns.

    The narrow list of the others is broadcast up to ``BROADCAST_ROWS`` rows and joined
    by a shuffle beyond.
    """
    texts, described = _described(df, doc_id, text)
    gone = components_of(texts, described, percent).filter("not kept")
    gone = hinted(written(gone.select(F.col("doc_id").alias("gone_id"), "text_key").distinct(), "gone"), BROADCAST_ROWS)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    row = F.col("row")
    packed = packed.select("row", F.unhex(F.md5(whole(row.getField(text)))).alias("key"))
    same = (F.col("key") == F.col("text_key")) & row.getField(doc_id).cast("long").eqNullSafe(F.col("gone_id"))
    return packed.join(gone, same, "left_anti").select(*[row.getField(c).alias(c) for c in df.columns])
