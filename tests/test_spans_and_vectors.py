"""Places of hits, the union of all masks, and detectors made of a function over Arrow batches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import plain
from veilwork import fixed_values as fv
from veilwork.functions import spans
from veilwork.operators import jury, vector_detectors
from veilwork.operators.detectors import DETECTORS
from veilwork.operators.vector_detectors import CARDS, VectorDetector, VectorRule
from veilwork.plans import requests as flows
from verification import catalogue

RULES = [
    ("A", "id", fv.STRICT_ID, fv.MASK_ID), ("A", "phone", fv.STRICT_PHONE, fv.MASK_PHONE), ("A", "email", fv.STRICT_EMAIL, fv.MASK_EMAIL),
    ("B", "name", "(?i)" + rf"\b(?:{'|'.join(fv.NAMES)})\b", fv.MASK_NAME),
    ("B", "location", "(?i)" + rf"\b(?:{'|'.join(sorted(fv.LOCATIONS, key=len, reverse=True))})\b", fv.MASK_LOCATION),
    ("C", "id", fv.LOOSE_ID, fv.MASK_ID), ("C", "phone", fv.LOOSE_PHONE, fv.MASK_PHONE), ("C", "email", fv.LOOSE_EMAIL, fv.MASK_EMAIL),
]
PARTS = [
    "850315-01-1234", "850315011234", "+60123456789", "012-3456789", "0123456789@x.com", "a.b@ex.org.", "Ali", "Ahmad", "kl",
    "Kuala Lumpur", "é", "😀", " ", " ", ", ", "-", "x", "601231012345", "4111 1111 1111 1111", "\n", "petaling jaya", "+a@b.cc",
]


def texts(count, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(count)]
    return made + [None, "", " ", "Ali " * 9000, "x" * 40_000 + "Ali" + "y@z.com" * 5]


def plain_spans(text):
    return sorted(
        (m.start(), m.end(), tool, kind) for tool, kind, pattern, _ in RULES for m in re.finditer(pattern, text or "")
    )


def plain_union(text):
    """(text, hits, spans, characters)"""
    if text is None:
        return None, 0, 0, 0
    hits = sorted(
        (m.start(), -m.end(), order, mask) for order, (*_, pattern, mask) in enumerate(RULES) for m in re.finditer(pattern, text)
    )
    joined = []
    for start, until, _, mask in hits:
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], -until)
        else:
            joined.append([start, -until, mask])
    shown, at = "", 0
    for start, end, mask in joined:
        shown, at = shown + text[at:start] + mask, end
    return shown + text[at:], len(hits), len(joined), sum(end - start for start, end, _ in joined)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts(300, 1))), "n int, prompt string").repartition(3).persist()


def test_places_of_all_hits(frame):
    found = {}
    for r in jury.finding_spans(frame, ["n"]).collect():
        found.setdefault(r.n, []).append((r.start, r.end, r.tool, r.kind))
    for row in frame.collect():
        assert sorted(found.get(row.n, [])) == plain_spans(row.prompt)


def test_union_of_all_masks(frame):
    for r in jury.jury_union(frame).collect():
        assert (r.sanitized, r.hits, r.masked_spans, r.masked_chars) == plain_union(r.prompt), r.prompt


def test_union_leaves_nothing_that_a_detector_finds(spark):
    """Seen in the text that remains; masks themselves hold no hit."""
    frame = spark.createDataFrame([(k, f"{p} or {q}") for k, p in enumerate(PARTS) for q in PARTS], "n int, prompt string")
    again = jury.finding_spans(jury.jury_union(frame).select("n", F.col("sanitized").alias("prompt")), ["n"])
    assert again.count() == 0


@given(st.lists(st.integers(0, 50), max_size=300))
@settings(max_examples=8, deadline=None)
def test_running_values(spark, numbers):
    frame = spark.createDataFrame([(numbers,)], "v array<int>")
    row = frame.select(
        spans.running(F.col("v"), lambda x, y: x + y).alias("s"), spans.running(F.col("v"), lambda x, y: F.greatest(x, y)).alias("m")
    ).first()
    assert row.s == np.cumsum(numbers).astype(int).tolist()
    assert row.m == (np.maximum.accumulate(numbers).tolist() if numbers else [])


def is_card(run):
    digits = [int(c) for c in run if c.isdigit()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    return sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_cards(text):
    return [m.span() for m in re.finditer(r"[0-9](?:[ -]?[0-9])*", text or "") if is_card(m[0])]


def card_texts(count, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(count):
        body = "".join(rng.choices("0123456789", k=rng.randrange(11, 20)))
        right = next(d for d in "0123456789" if is_card(body + d) or len(body) < 12 or d == "9")
        number = body + rng.choice([right, right, "0"])
        if rng.random() < 0.5:
            number = rng.choice(" -").join(number[k : k + 4] for k in range(0, len(number), 4))
        made.append(rng.choice(["", "é ", "😀", "no 5: "]) + number + rng.choice(["", " ", "x", "  12", "\n4"]))
    return made + ["", "4111 1111 1111 1111", "4111 1111 1111 1112", "0000 0000 0000 0000", "4111  1111 1111 1111 1111", "٤" * 16]


@given(st.lists(st.text(st.sampled_from("0123456789 -é😀x"), max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_cards_of_a_batch(made):
    made = [*made, "4111 1111 1111 1111", "😀4111111111111111"]
    raw = [t.encode() for t in made]
    owner, rule, start, end = vector_detectors.find_cards(
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    )
    begins = np.cumsum([0, *map(len, raw)])
    found = [(o, s - begins[o], e - begins[o]) for o, s, e in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]
    expected = [
        (k, len(t[:a].encode()), len(t[:b].encode())) for k, t in enumerate(made) for a, b in plain_cards(t)
    ]
    assert found == expected and not rule.any()


def test_vector_detector_in_the_jury(spark):
    made = [*card_texts(300, 3), None, "nothing", "Ali " * 30 + "4111111111111111", "4111 1111 1111 1111 Ali " * 2000]
    frame = spark.createDataFrame(list(enumerate(made)), "n int, prompt string").repartition(4)
    tools = [*DETECTORS, CARDS]
    found = {r.n: r for r in jury.redaction_jury(frame, detectors=tools).collect()}
    won = 0
    for n, text in enumerate(made):
        cards, r = plain_cards(text), found[n]
        sanitized, winner, counts = plain.jury(text)
        scores = [sum(counts[3 * k : 3 * k + 3]) for k in range(3)]
        assert (r.score_v, r.v_id, r.v_phone) == (len(cards), len(cards), 0)
        if text and len(cards) > max(scores):
            won += 1
            shown, at = "", 0
            for a, b in cards:
                shown, at = shown + text[at:a] + "[REDACTED_CARD]", b
            sanitized, winner = shown + text[at:], "V"
        assert (r.winning_tool, r.sanitized) == (winner, sanitized)
    assert won > 50
    matches = jury.findings(frame, ["n"], detectors=[CARDS]).collect()
    assert sorted((r.n, r.pos, r.match) for r in matches) == sorted(
        (n, k, text[a:b]) for n, text in enumerate(made) for k, (a, b) in enumerate(plain_cards(text))
    )
    assert jury.consensus(frame, detectors=tools).filter("votes_card = 1").count() == sum(bool(plain_cards(t)) for t in made)


def test_only_the_text_goes_through_python_and_only_for_that_detector(spark, sf_dir):
    plan = catalogue.queries()["jury_vector_detector"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one of each side of the union
    for call in re.findall(r"ArrowEvalPython \[.*?\], \[.*?\]", plan):
        assert call.count("hits_of") == 1
    assert "Exchange" not in plan
    native = jury.redaction_jury(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()


def test_several_rules_of_one_function_and_audit_rows(spark):
    """A detector of two kinds, as its audit rows report them."""

    def capitals_and_digits(data, ends):
        at = np.flatnonzero(((data >= 65) & (data <= 90)) | ((data >= 48) & (data <= 57)))
        owner = np.searchsorted(ends, at, side="right") - 1
        return owner, (data[at] < 65).astype(np.int64), at, at + 1

    both = VectorDetector("W", (VectorRule("capital", "id", "^"), VectorRule("digit", "phone", "#")), capitals_and_digits)
    frame = spark.createDataFrame([(1, "client", "éA1 b😀C")], "n int, role string, prompt string")
    frame = frame.withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "request_id": F.lit("r")})
    judged = jury.redaction_jury(frame, detectors=[*DETECTORS, both]).first()
    assert (judged.sanitized, judged.w_id, judged.w_phone, judged.winning_tool) == ("é^# b😀^", 2, 1, "W")
    done = flows.sanitize(frame, detectors=[*DETECTORS, both])
    row = flows.sanitize_audit(done, detectors=[*DETECTORS, both]).first()
    assert (row.winning_tool, row.count_id, row.count_phone) == ("W", 2, 1)


def test_batches_of_slices_and_nulls():
    places = vector_detectors._batch_function(vector_detectors.find_cards)
    texts_ = pa.array(["x", "4111111111111111", None, "é4111111111111111"]).slice(1)
    assert places.func(texts_).to_pylist() == [
        [{"rule": 0, "start": 0, "end": 16}], [], [{"rule": 0, "start": 1, "end": 17}],
    ]
