import base64
import gzip
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from veilwork.llm import mixing, warc
from veilwork.llm.work import fresh_path


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Source -> target by sharing again and again until no share is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] > most * sizes[s] * total}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def _corpus():
    rows, n = [], 0
    for source, count, size in (("a", 400, 30), ("b", 60, 50), ("é", 40, 10), (None, 90, 20), ("zz", 5, 3), ("", 30, 8)):
        for i in range(count):
            n += 1
            rows.append((n, " ".join(f"w{n}x{k}" for k in range(1 + (i * 7) % size)), source))
    return rows + [(9001, None, "a"), (9002, "", None), (9003, " \n", "b")]


def test_targets_and_taken_words(spark):
    rows = _corpus()
    found = mixing.allocate(clashing(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    source_of = {i: s for i, _, s in rows}
    sizes = {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source], rel=1e-12)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    longest = {"a": 30, "b": 50, "é": 10, None: 20, "zz": 3, "": 8}
    for source, words in taken.items():
        assert abs(words - targets[source]) <= longest[source] / 2 + 1e-9
    copies = {r.taken // r.size for r in found if r.size and source_of[r.doc_id] == "a"}
    assert len(copies) <= 2  # certain whole copies and one more


def test_equal_rows_enter_as_far_as_they_fit(spark):
    """Sixty equal rows without an id among others: the target is met within half a document all the same."""
    text = " ".join(f"w{k}" for k in range(150))
    rows = [(None, text, "a")] * 60 + [(k, f"own {k} " * 20, "a") for k in range(10)]
    rows += [(100 + k, f"b {k} " * 300, "b") for k in range(40)] + [(300, "c", "c")]
    docs = documents(spark, rows)
    for seed in ("mix", "x", "y", "z"):
        found = mixing.allocate(clashing(docs).repartition(3), seed=seed).collect()
        assert len(found) == len(rows)
        taken, target = {}, {}
        for r in found:
            taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
            target[r.source_size] = r.target
            assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        longest = {9400: 150, 24000: 600, 1: 1}
        assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-9 for s in target)
        mixed = mixing.mix(clashing(docs), seed=seed).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()
        sizes = {"a": 9400, "b": 24000, "c": 1}
        assert {sizes[r.source]: r.n for r in mixed} == {s: n for s, n in taken.items() if n}


def test_reruns_agree_and_rows_are_the_mix(spark):
    docs = documents(spark, _corpus())
    first = {r.doc_id: r.taken for r in mixing.allocate(docs).collect()}
    assert first == {r.doc_id: r.taken for r in mixing.allocate(docs.repartition(7)).collect()}
    assert first != {r.doc_id: r.taken for r in mixing.allocate(docs, seed="other").collect()}
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert words == {i: n for i, n in first.items() if n}


def test_ties_nulls_and_empty_tables(spark):
    same = [(None, "a b c", "s")] * 40 + [(7, "a b", "t")] * 3
    found = mixing.allocate(documents(spark, same)).collect()
    assert len(found) == 43
    for size in (3, 2):  # rows that cannot be told apart enter as far as they fit
        of_size = [r for r in found if r.size == size]
        assert len({r.taken // size for r in of_size}) <= 2
        assert abs(sum(r.taken for r in of_size) - of_size[0].target) <= size / 2
    assert mixing.allocate(documents(spark, same).limit(0)).count() == 0
    assert mixing.mix(documents(spark, same).limit(0)).count() == 0
    assert mixing.allocate(documents(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


PAGES = "page_id long, url string, html string, extra string"


def _pages(spark):
    big = "é€😀\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [
        (1, "http://a/", "x", "e"), (2, "http://b/", "x", "e"), (3, None, "", "e"), (4, "http://c/", None, "e"), (5, "u\r\nWARC-Type: x", big, "e"),
        (6, "http://d/", big, "e"), (None, "http://e/", "x", "e"), (None, None, "only", "e"), (None, None, "only", "e"), (8, "http://f/", "twice", "e"),
        (8, "http://f/", "twice", "e"), (9, "http://g/", "0\r\n\r\n", "e"), (10, "http://h/", "y" * 200_001, "e"),
    ]
    return spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("d")).withColumn("first", F.lit(1)), rows


@pytest.mark.parametrize("segment", [1000, warc.SEGMENT_CHARS])
def test_archives_hold_what_was_written(spark, segment):
    pages, rows = _pages(spark)
    path = fresh_path(spark, "test-archive")
    warc.write(pages, path, segment_chars=segment, records_per_file=5)
    found = warc.read(spark, path).collect()
    assert len(found) == len(rows) and all(r.intact for r in found)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    told = sorted((str(r.page_id), r.payload_digest, r.payload_bytes, r.record_type, str(r.refers_to)) for r in found)
    groups = {}
    for page, _, html, _ in rows:
        groups.setdefault(html or "", []).append(page)
    expected = []
    for page, _, html, _ in rows:
        ids = [i for i in groups[html or ""] if i is not None]
        first = min(ids) if ids else None
        kind = "response" if page == first else "revisit"
        expected.append((str(page), digest(html), len((html or "").encode()), kind, str(first if kind == "revisit" else None)))
    assert told == sorted(expected)
    payloads = {r.page_id: r.payload for r in found if r.record_type == "response" and r.page_id}
    html_of = {p: (h or "").encode() for p, _, h, _ in rows}
    assert payloads == {p: html_of[p] for p in payloads}
    kinds = {r.kind for r in warc.records(spark, path).collect()}
    assert ("continuation" in kinds) and {"response", "revisit"} <= kinds


def test_pages_below_the_least_size_are_all_responses(spark):
    pages, rows = _pages(spark)
    path = fresh_path(spark, "test-archive")
    warc.write(pages, path, min_bytes=1_000_000)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}


def test_an_empty_table_gives_no_records(spark):
    pages, _ = _pages(spark)
    path = fresh_path(spark, "test-archive")
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_damage_is_told():
    part = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    assert warc._message([(2, part[20:]), (1, part[:20])], len(part))[1] == b"hello"
    with pytest.raises(ValueError, match="missing"):
        warc._message([(1, part[:20]), (3, part[20:])], len(part))
    with pytest.raises(ValueError, match="total length"):
        warc._message([(1, part)], len(part) + 1)
    with pytest.raises(ValueError):
        warc._message([(1, part.replace(b"5\r\n", b"4\r\n"))], None)


def _read_bytes(spark, data):
    import os

    folder = fresh_path(spark, "foreign").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.gz", "wb") as file:
        file.write(data)
    return warc.read(spark, f"file://{folder}").collect()


def _record(kind, block, number=1, **fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{number}>", f"Content-Length: {len(block)}"]
    lines = [line for line in lines if line.split(":")[0] not in fields]
    lines += [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


PAGE = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"


def test_foreign_archives_are_read(spark):
    """Other kinds of records are no pages; other headers, digests and members do no harm."""
    members = [
        _record("warcinfo", b"software: x\r\n"), _record("request", b"GET / HTTP/1.1\r\n\r\n", 2),
        _record("response", PAGE, 3, **{"WARC-Target-URI": "http://é/"}),
        _record("response", PAGE, 4, **{"WARC-Payload-Digest": "sha256:abc", "WARC-Page-ID": "17"}),
        _record("response", PAGE, 5, **{"WARC-Payload-Digest": "sha1:WRONG", "WARC-Page-ID": "18"}), _record("metadata", b"a: b", 6),
    ]
    found = _read_bytes(spark, b"".join(gzip.compress(m) for m in members))
    assert sorted((str(r.page_id), r.payload, r.intact) for r in found) == [
        ("17", b"hello", True), ("18", b"hello", False), ("None", b"hello", True),
    ]
    assert {r.url for r in found} == {"http://é/", None}


@pytest.mark.parametrize("harm", ["garbage", "no length", "bad length", "no id", "cut", "long", "short", "member cut", "not a header"])
def test_damaged_archives_end_no_job(spark, harm):
    good = _record("response", PAGE, 1, **{"WARC-Page-ID": "1"})
    last = _record("response", PAGE, 9, **{"WARC-Page-ID": "9"})
    bad = _record("response", PAGE, 2, **{"WARC-Page-ID": "2"})
    harmed = {
        "garbage": b"\x00garbage\r\n\r\n", "no length": _record("response", PAGE, 2, **{"WARC-Page-ID": "2", "Content-Length": None}),
        "bad length": bad.replace(f"Content-Length: {len(PAGE)}".encode(), b"Content-Length: many", 1),
        "no id": _record("response", PAGE, 2, **{"WARC-Page-ID": "2", "WARC-Record-ID": None}), "cut": bad[:-12],
        "long": bad.replace(f"Content-Length: {len(PAGE)}".encode(), b"Content-Length: 99999", 1),
        "short": bad.replace(f"Content-Length: {len(PAGE)}".encode(), b"Content-Length: 20", 1), "not a header": b"WARC/1.0 and no end",
    }
    if harm == "member cut":
        found = _read_bytes(spark, gzip.compress(good) + gzip.compress(bad)[:60])
    else:
        found = _read_bytes(spark, good + harmed[harm] + (last if harm not in ("cut", "not a header") else b""))
    told = {r.page_id: r.intact for r in found}
    assert told[1] is True
    assert told.get(2) in ((True,) if harm == "no id" else (None, False))
    if harm not in ("cut", "long", "member cut", "not a header"):
        assert told[9] is True


def test_many_members_are_unpacked_in_linear_time():
    member = gzip.compress(_record("response", PAGE))
    data, started = member * 30_000, time.time()
    assert len(warc._unpacked(data)) == 30_000 * len(_record("response", PAGE))
    assert time.time() - started < 20
    assert warc._unpacked(b"") == b"" and warc._unpacked(b"plain") == b"plain"


def test_base32_in_columns(spark):
    texts = ["", "a", "é" * 50, "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
