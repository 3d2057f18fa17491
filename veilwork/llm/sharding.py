"""Sharding by a hierarchical weighted hash tree.

The tree has regions, regions have racks, racks have shards; every node has a weight.
A key descends from the top: each child of the node draws an exponential waiting time
``-ln(u) / weight``, where ``u`` is a hash of the key and the child's name, and the
key goes to the child whose time is the shortest.  A child is so chosen with a
probability in proportion to its weight, by the key and the node alone.  When the
weight of one child changes, only its own draw does: keys move into it (or out of it),
never between its sisters, and nothing moves outside the parent.  So movement is
confined to the subtrees whose weights change.

A shard that is added stands as a region of its own, since a heavier old region would
also hand rows to its old shards: this way the added shard takes rows only into itself.

Assignment is a projection of the row.  Numbering the rows of a shard from 0 is done
without sorting a shard in one task: rows are ordered by a hash, counted per shard and
range of that hash, and numbered inside each range from the count of those before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.text import whole
from veilwork.llm.work import written

SHARDS = 24
RACKS_PER_REGION = 3
SHARDS_PER_RACK = 4
# Bytes a row takes beside its text.
ROW_BYTES = 8
# Rows of a shard in one range of hashes, about, and the bits of a hash that name a range.
ROWS_PER_RANGE = 50_000
LEAST_BITS, MOST_BITS = 8, 20

_DIGITS = 13  # hex digits of a draw: 52 bits, which a double holds exactly


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its name takes part in draws, its weight decides their odds."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def _shards(numbers) -> tuple[Node, ...]:
    return tuple(Node(f"shard{s}", 1, shard=s) for s in numbers)


def _group(name: str, children: tuple[Node, ...]) -> Node:
    return Node(name, sum(child.weight for child in children), children)


def even_tree(shards: int = SHARDS, racks: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK) -> Node:
    """``shards`` shards of equal weight in racks of ``per_rack`` and regions of ``racks`` racks."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    numbers = range(shards)
    made = [
        _group(f"rack{n // per_rack}", _shards(numbers[n : n + per_rack])) for n in range(0, shards, per_rack)
    ]
    regions = [_group(f"region{n // racks}", tuple(made[n : n + racks])) for n in range(0, len(made), racks)]
    return _group("all", tuple(regions))


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [leaf for child in node.children for leaf in leaves(child)]


def grown(tree: Node, weight: float = 1) -> Node:
    """``tree`` with one more shard, in a region of its own."""
    number = max(leaf.shard for leaf in leaves(tree)) + 1
    rack = _group(f"rack-of-{number}", (Node(f"shard{number}", weight, shard=number),))
    return _group(tree.name, (*tree.children, _group(f"region-of-{number}", (rack,))))


def reweighted(tree: Node, path: tuple[str, ...], weight: float) -> Node:
    """``tree`` with the weight of the node below ``path`` (names from the top) changed, and no other."""
    if not path:
        return replace(tree, weight=weight)
    if path[0] not in {child.name for child in tree.children}:
        raise ValueError(f"{tree.name} has no child {path[0]}")
    changed = tuple(reweighted(c, path[1:], weight) if c.name == path[0] else c for c in tree.children)
    return replace(tree, children=changed)


def _levels(tree: Node) -> list[list[Node]]:
    """The inner nodes of every level, from the top; each is addressed by its place in its level."""
    levels, current = [], [tree]
    while any(node.shard is None for node in current):
        if any(node.shard is not None for node in current):
            raise ValueError("all shards must lie at the same depth")
        levels.append(current)
        current = [child for node in current for child in node.children]
    return levels


def shard_of(key: Column, tree: Node) -> Column:
    """The shard number of a text key that is not null.

    One step per level: the children of the node reached so far draw, and the shortest time
    wins.  A step looks the children up in a literal table of its level, so only the nodes
    on a key's way draw for it.
    """
    levels = _levels(tree)
    reached = F.lit(0)
    for depth, nodes in enumerate(levels):
        place, rows = 0, []
        for node in nodes:
            children = []
            for child in node.children:
                if child.weight > 0:
                    # What the draw leads to: a place in the next level, or at last the shard.
                    leads_to = child.shard if depth == len(levels) - 1 else place
                    children.append(f"named_struct('name', '{child.name}|', 'weight', {float(child.weight)!r}D, 'next', {leads_to})")
                place += 1
            rows.append(f"array({', '.join(children)})")
        table = F.expr(f"array({', '.join(rows)})")
        times = F.transform(F.get(table, reached), lambda child: F.struct(_time(key, child).alias("time"), child["next"].alias("next")))
        reached = F.array_min(times)["next"]
    return reached


def _time(key: Column, child: Column) -> Column:
    """The waiting time of a child: exponential, its rate is the weight."""
    number = F.conv(F.substring(F.md5(F.concat(child["name"], key)), 1, _DIGITS), 16, 10).cast("double")
    return -F.log((number + F.lit(0.5)) / F.lit(float(1 << (4 * _DIGITS)))) / child["weight"]


def key_of(doc_id: Column) -> Column:
    """The key of a row: its id as text, the empty text where it is null."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def assign(df: DataFrame, tree: Node, doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """``df`` with a column ``name``: the shard of every row.  A projection; nothing moves."""
    return df.withColumn(name, shard_of(key_of(F.col(f"`{doc_id}`")), tree).cast("int"))


def placements(
    df: DataFrame, tree: Node | None = None, doc_id: str = "doc_id", text: str = "text",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``key``: the id and the tree decide, so rows with equal ids share a shard, whatever
    their texts.  ``size`` is the text's UTF-8 bytes plus 8 (a null text has none, but counts as
    empty for ``text_crc32``).  ``slot`` numbers the rows of a shard from 0 without gaps, in the
    order of a hash of id, size and checksum; rows equal in these three are counted before
    they are shuffled and take consecutive slots.  ``grown_shard`` is the shard with one
    more.  A null id has the key ``''``.  Other columns are not read; an empty table gives an
    empty result.
    """
    tree = tree or even_tree()
    body = F.col(f"`{text}`")
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole(body)).alias("text_crc32"),
    )
    merged = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = key_of(F.col("doc_id"))
    order = F.md5(F.concat_ws("|", key, F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    placed = merged.select(
        "*",
        shard_of(key, tree).cast("int").alias("shard"),
        shard_of(key, grown(tree)).cast("int").alias("grown_shard"),
        F.conv(F.substring(order, 1, 15), 16, 10).cast("long").alias("place"),
    )
    placed = written(placed, "placed")
    held = placed.agg(F.sum("n")).first()[0] or 0
    wanted = math.ceil(math.log2(max(1, held / (len(leaves(tree)) * rows_per_range))))
    span = 60 - min(MOST_BITS, max(LEAST_BITS, wanted))
    placed = placed.withColumn("part", F.shiftright("place", span))
    # Ranges per shard are a bounded number of rows, whatever the input.
    loads = placed.groupBy("shard", "part").agg(F.sum("n").alias("load"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = loads.select("shard", "part", F.coalesce(F.sum("load").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "part"])
    first = F.col("start") + F.col("ahead")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return numbered.select("*", first.alias("first"), copies.alias("copy")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("copy")).alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, tree: Node | None = None, doc_id: str = "doc_id") -> None:
    """Write whole rows below ``path`` in one folder per shard (``shard=n``).

    Rows are brought together by shard before they are written, and Spark splits a shard over
    as many files as its bytes ask for.
    """
    assign(df, tree or even_tree(), doc_id).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
