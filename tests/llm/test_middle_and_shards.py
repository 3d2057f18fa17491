"""Fill-in-the-middle and sharding against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from veilwork.llm import fill_middle, sharding

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = " \t\n\x0b\x0c\r\x08\x0e\x1f!aé€😀\x85\xa0<PSM>"


def plain_cut(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of one row."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    first, second = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    prefix, middle, suffix = "".join(units[:first]), "".join(units[first:second]), "".join(units[second:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def random_texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(count)]


@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_marks_rank_and_select(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    marks = fill_middle.Marks(fill_middle.unit_ends(data, ends))
    wanted = [
        int(ends[k]) + len(t[: m.end()].encode()) - 1 for k, t in enumerate(texts) for m in UNIT.finditer(t)
    ]
    assert marks.select(np.arange(1, len(wanted) + 1)).tolist() == wanted
    at = np.arange(len(data) + 1)
    assert marks.rank(at).tolist() == [sum(w < p for w in wanted) for p in at.tolist()]


def test_cut_texts_equal_plain_python_and_come_back(spark):
    texts = [None, "", " ", "\n\n", "x", "a<P>b c d", "<", "P>", "one two  three \n"]
    texts += random_texts(600, 5) + ["long " * 300_000 + "é" * 7, "y" * 1_000_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id at all"), (None, None), (3, "x"), (4, "x"), (4, "x")]
    df = clashing(documents(spark, rows)).repartition(3)
    done = fill_middle.transform(df)
    found = done.select("row.doc_id", "row.text", "row.u", "n", "form", "prefix_chars", "middle_chars", "output",
                        fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.u
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_cut_of_an_empty_table(spark):
    assert fill_middle.transform(documents(spark, [])).count() == 0


def test_cutting_moves_no_rows(spark, sf_dir):
    plan = fill_middle.transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def plain_shard(key, node):
    """The shard of ``key`` by descending ``node``."""
    import math

    while node.shard is None:
        draws = []
        for child in node.children:
            if child.weight > 0:
                number = int(hashlib.md5(f"{child.name}|{key}".encode()).hexdigest()[:13], 16)
                draws.append((-math.log((number + 0.5) / 2**52) / child.weight, child))
        node = min(draws, key=lambda d: d[0])[1]
    return node.shard


def shards_of(spark, tree, ids):
    rows = sharding.assign(spark.createDataFrame([(i,) for i in ids], "doc_id long"), tree).collect()
    return {r.doc_id: r.shard for r in rows}


def test_shards_by_plain_descent(spark):
    for tree in (sharding.even_tree(), sharding.even_tree(7, 2, 3), sharding.even_tree(1), sharding.grown(sharding.even_tree(5))):
        found = shards_of(spark, tree, [*range(300), None])
        assert found == {i: plain_shard("" if i is None else i, tree) for i in [*range(300), None]}


def test_an_added_shard_takes_rows_only_into_itself(spark):
    tree = sharding.even_tree()
    before = shards_of(spark, tree, range(6000))
    for _ in range(3):  # every time again, not only the first
        tree = sharding.grown(tree)
        number = max(leaf.shard for leaf in sharding.leaves(tree))
        after = shards_of(spark, tree, range(6000))
        moved = [i for i in before if before[i] != after[i]]
        assert {after[i] for i in moved} == {number}
        assert 0.6 < len(moved) * (number + 1) / 6000 < 1.4
        before = after


def test_movement_is_confined_to_subtrees_whose_weights_change(spark):
    tree = sharding.even_tree()
    before = shards_of(spark, tree, range(6000))
    rack = {leaf.shard for leaf in sharding.leaves(tree.children[0].children[1])}
    heavier = sharding.reweighted(tree, ("region0", "rack1", "shard5"), 2)
    after = shards_of(spark, heavier, range(6000))
    moved = {i for i in before if before[i] != after[i]}
    assert moved and all(before[i] in rack and after[i] == 5 for i in moved)
    # A lighter rack loses keys to the other racks of its region, and none of its own change places.
    region = {leaf.shard for leaf in sharding.leaves(tree.children[0])}
    after = shards_of(spark, sharding.reweighted(tree, ("region0", "rack1"), 1), range(6000))
    moved = {i for i in before if before[i] != after[i]}
    assert moved and all(before[i] in rack and after[i] in region - rack for i in moved)
    # A shard without weight is left by all its keys.
    after = shards_of(spark, sharding.reweighted(tree, ("region0", "rack1", "shard5"), 0), range(6000))
    assert 5 not in after.values()
    with pytest.raises(ValueError):
        sharding.reweighted(tree, ("region9",), 1)


def test_weights_decide_the_shares(spark):
    tree = sharding.even_tree(4, 2, 2)
    tree = sharding.reweighted(tree, ("region0", "rack0", "shard0"), 3)
    counts = [0] * 4
    for shard in shards_of(spark, tree, range(8000)).values():
        counts[shard] += 1
    assert abs(counts[0] - 3000) < 250 and abs(counts[1] - 1000) < 250


def test_placements_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, t) for k, t in enumerate(random_texts(400, 7))]
    rows += [(None, "a"), (None, None), (None, ""), (5, None), (5, ""), (6, "z" * 300_000)]
    rows += [(7, "copy")] * 500  # one id and text: over a third of all rows
    rng.shuffle(rows)
    df = clashing(documents(spark, rows)).repartition(5)
    found = sharding.placements(df).collect()
    told = sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()),
         plain_shard("" if i is None else i, sharding.even_tree()),
         plain_shard("" if i is None else i, sharding.grown(sharding.even_tree()))) for i, t in rows
    )
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in found) == told
    assert {r.law for r in found} == {"key"}
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    again = sharding.placements(df.repartition(2), rows_per_range=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sharding.placements(documents(spark, [])).count() == 0


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(random_texts(100, 9))]
    df = documents(spark, rows)
    tree = sharding.even_tree(3, 1, 1)
    sharding.write_shards(df, f"file://{tmp_path}/shards", tree)
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert sorted((r.doc_id, r.text) for r in back) == rows
    assert {r.doc_id: r.shard for r in back} == shards_of(spark, tree, range(100))
