"""Exact and near duplicates against plain Python."""

import hashlib
import random
import re

import pytest

from tests.llm.helpers import clashing, documents, near_groups
from veilwork.llm import components, exact_index, near_duplicates


def test_exact_groups_equal_plain_python(spark):
    texts = ["a b", "a  b", "a\tb", "A b", "", None, " ", "  ", "é", "x" * 40_000, "x" * 40_000, "a b "] * 3
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    found = exact_index.groups(clashing(documents(spark, rows)), capacity=1).collect()
    assert len(found) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    text_of = dict(rows)
    for r in found:
        text = norm(text_of[r.doc_id])
        group = groups[text]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), r.doc_id == min(group))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups_without_ids(spark):
    rows = [(None, "a"), (3, "a"), (None, "b"), (None, "b"), (5, "c"), (5, "c")]
    found = exact_index.groups(documents(spark, rows)).collect()
    told = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in found)
    assert told == [
        ("3", "3", 2, True), ("5", "5", 2, True), ("5", "5", 2, True),
        ("None", "3", 2, False), ("None", "None", 2, True), ("None", "None", 2, True),
    ]
    assert exact_index.groups(documents(spark, rows).limit(0)).count() == 0


def test_overfull_buckets_split(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) as key")
    slots = exact_index.directory(keys, capacity=100, depth=10)
    loads = keys.selectExpr("cast(shiftrightunsigned(key, 54) as int) as slot").join(slots, "slot").groupBy("bucket", "bits").count()
    rows = loads.collect()
    assert sum(r["count"] for r in rows) == 4000
    assert all(r["count"] <= 100 for r in rows) and {r.bits for r in rows} <= {5, 6, 7}


def test_a_chain_keeps_colliding_texts_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0, 0], pa.int32()), pa.array([7, 7, 7]), pa.array(["a", "b", "a"]), pa.array([4, 2, 3]), pa.array([1, 2, 1])],
        names=["bucket", "key", "body", "doc_id", "n"],
    )
    rows = [r for b in exact_index._own(iter([batch])) for r in b.to_pylist()]
    assert [(r["chain"], r["keep_id"], r["group_size"]) for r in rows] == [(0, 3, 2), (1, 2, 2)]


@pytest.fixture(scope="module")
def varied():
    """Groups of edited copies, exact copies, a shared passage, and unrelated texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.randint(1, 14)):
            text = base.copy()
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).replace(" ", rng.choice([" ", "\n"])))
    rows += [" ".join([word() for _ in range(rng.randint(5, 80))] + passage) for _ in range(60)]
    rows += ["", None, " ", "one", "One", "one two three four", "ONE two\tthree four", "one two three four five"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_equal_all_pairs(spark, varied, percent):
    found = near_duplicates.groups(clashing(documents(spark, varied)), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in found} == near_groups(varied, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_groups_over_many_blocks(spark, varied, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 3)
    found = near_duplicates.groups(documents(spark, varied), percent=80).collect()
    assert {r.doc_id: r.component_id for r in found} == near_groups(varied, 80)


def test_near_groups_without_ids_and_with_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (4, text + " x"), (4, text + " x"), (None, None), (9, "")]
    found = near_duplicates.groups(documents(spark, rows)).collect()
    told = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found)
    assert told == [("4", "4", True), ("4", "4", True), ("9", "9", True), ("None", "4", False), ("None", "None", True)]
    kept = near_duplicates.representatives(clashing(documents(spark, rows)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "9", "None"]
    assert near_duplicates.groups(documents(spark, rows).limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    edges = spark.createDataFrame(path + star + path[:3], "a long, b long")
    labels = {r.node: r.label for r in components.components(edges).collect()}
    assert labels == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_least_matches_leaves_hardly_a_link_out():
    import math

    for percent in (50, 80, 85, 95):
        m, p = near_duplicates.least_matches(percent), percent / 100
        below = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(m))
        assert below <= 1e-7
