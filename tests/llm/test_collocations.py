"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing
from veilwork.llm import collocations

DOCUMENTS = "doc_id long, text string, lang string"


def plain_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def plain_mine(rows, longest=4, least=30, covered=80, top=2000):
    """The result for rows of (text, lang), by counting every phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in plain_words(text):
            n[lang] += len(piece)
            for size in range(1, longest + 1):
                for p in range(len(piece) - size + 1):
                    f[lang, tuple(piece[p : p + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    over = Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for p in range(len(words) - size + 1):
                part = lang, words[p : p + size]
                over[part] = max(over[part], a)
    ranked = {}
    for (lang, words), a in candidates.items():
        if 100 * over[lang, words] < covered * a or not over[lang, words]:
            score, _, left, right = min(
                (2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                for k in range(1, len(words))
            )
            ranked.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, place, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in ranked.items()
        for place, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def some_rows(count, seed):
    """Texts of few words, with a phrase that is common, odd separators and several languages."""
    rng = random.Random(seed)
    words = ["A", "b", "Cc", "d", "é", "😀", "New", "York", "City", "x-y", "(z)", "\x85", "\x1f"]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "? "]
    rows = []
    for _ in range(count):
        text = "".join(
            (w := rng.choice(words)) + (" york" if w == "New" else "") + rng.choice(ends) for _ in range(rng.randrange(30))
        )
        rows.append((text, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@given(st.lists(st.text(st.sampled_from("aB é.\n\t,😀\x0b\x85"), max_size=25), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_of_a_batch(texts):
    words, piece, text = collocations.words_of(pa.array(texts, pa.string()))
    found = {}
    for word, run, owner in zip(words.to_pylist(), piece.tolist(), text.tolist(), strict=True):
        found.setdefault((owner, run), []).append(word)
    expected = [(k, run) for k, t in enumerate(texts) for run in plain_words(t) if run]
    assert [(owner, run) for (owner, _), run in found.items()] == expected


@given(st.integers(2, 5), st.sampled_from([1, 2, 5, 40, 150]), st.booleans(), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_quicksort_counts_every_frequent_beginning(longest, least, parts, seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 5, (longest, 300)).astype(np.int32)
    table[2:, rng.random(300) < 0.2] = 0
    weights = rng.integers(1, 4, 300)
    counts = Counter()
    for column, weight in zip(table.T.tolist(), weights.tolist(), strict=True):
        words = column[: column.index(0)] if 0 in column else column
        for size in range(2, len(words) + 1):
            counts[tuple(words[:size])] += weight
    parts_of = {1, 3} if parts else set()
    small, collocations.SMALL = collocations.SMALL, 8  # so that both ways of dividing are taken
    try:
        found = {p: (w, part) for p, w, part in collocations.quicksort(table, weights, least, parts_of)}
    finally:
        collocations.SMALL = small
    in_parts = lambda p: len(p) == 2 and p[0] in parts_of
    assert found == {p: (w, in_parts(p)) for p, w in counts.items() if w >= least or in_parts(p)}


def test_mined_phrases_equal_plain_counting(spark):
    rows = some_rows(500, 1)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], DOCUMENTS)
    for settings_ in ({}, {"longest": 3, "least": 5}, {"least": 2, "top": 7}, {"longest": 2, "least": 1, "covered_percent": 0}):
        expected = plain_mine(rows, **{k.removesuffix("_percent"): v for k, v in settings_.items()})
        assert expected
        assert rows_of(collocations.mine(clashing(df).repartition(3), **settings_)) == expected


def test_odd_rows_and_hot_words(spark, monkeypatch):
    rows = [(None, "en"), ("", "en"), (" \t\n.", None), ("one", "fr"), ("w" * 500_000, "en"), ("a b " * 50_000, "en")]
    rows += [("the same passage stands in very many rows", "en")] * 400 + some_rows(60, 3)
    rows += [(f"the {k % 40} thing", "de") for k in range(300)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], DOCUMENTS)
    expected = plain_mine(rows)
    assert rows_of(collocations.mine(df)) == expected
    # The same with sent blocks of few suffixes and words that fill many routes.
    monkeypatch.setattr(collocations, "BUFFER_SUFFIXES", 500)
    monkeypatch.setattr(collocations, "BUFFER_WORDS", 20)
    monkeypatch.setattr(collocations, "LEAST_ROUTES", 4096)
    assert rows_of(collocations.mine(df.repartition(4))) == expected


def test_tables_without_phrases(spark):
    assert rows_of(collocations.mine(spark.createDataFrame([], DOCUMENTS))) == []
    assert rows_of(collocations.mine(spark.createDataFrame([(1, "a b c", "en"), (None, None, None)], DOCUMENTS))) == []


def test_scores_stay_exact_beyond_64_bits(spark):
    huge = 3 * 10**18
    counts = spark.createDataFrame(
        [("en", "a", 1, huge + 7), ("en", "b", 1, huge + 5), ("en", "a b", 2, huge + 1)],
        "lang string, phrase string, words int, f long",
    )
    row = collocations._scored(counts).first()
    assert (row.a, row.l, row.r, row.score) == (huge + 1, huge + 7, huge + 5, 2_000_000 * (huge + 1) // (2 * huge + 12))
