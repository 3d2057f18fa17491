import random
from collections import Counter

import pytest

from tests.llm.helpers import clashing, documents, words
from veilwork.llm import line_templates, quality


def plain_measures(text):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {i + k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_measures_equal_plain_python(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a " * 40, "x\ny\nx\n \n \nx", "é ß # | <é>\x0b\x0cz"]
    texts += [" ".join(rng.choice("ab#\n") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["w" * 30_000, " ".join(f"w{i % 7000}" for i in range(20_000))]
    docs = clashing(documents(spark, [*enumerate(texts), (0, None)]))
    rows = quality.judge(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        measured = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert measured == plain_measures(r.row.text), repr(r.row.text)[:80]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_rules_are_a_table(spark):
    docs = documents(spark, [(1, "the cat and the dog are in the house by the sea")])
    assert quality.passing(docs).count() == 1
    assert quality.passing(docs, rules=[quality.Rule("short", "n_words", most=5)]).count() == 0


def test_no_text_is_rejected_for_its_length_alone(spark):
    measures = dict(word_chars=5_000_000, n_symbols=0, n_lines=1, n_dup_lines=0, n_stop_words=500_000, n_repeat_words=0)
    row = spark.createDataFrame([(1_000_001, *measures.values())], ["n_words", *measures])
    assert not row.select(quality.breached(quality.BASE_RULES + quality.DEFAULT_RULES)).first()[0]


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(12))
    rows = [(i, f"{line()}\nPage {i} of this book was printed by hand\n{line()}") for i in range(20)]
    whole_copy = "\n".join(line() for _ in range(6))
    rows += [(100 + i, whole_copy) for i in range(30)]
    edited = whole_copy.split("\n")
    rows += [(200 + i, "\n".join([*edited[:5], f"{edited[5]} end{i}"])) for i in range(30)]
    rows += [(300 + i, f"{line()}\nThe words of a reader named {n} stay as they were said\n\n{line()}")
             for i, n in enumerate(["Ann", "Bo", "Cy", "Di", "Ed", "Flo"])]
    return rows


def test_boilerplate_goes_and_copies_stay(spark, lined):
    rows = line_templates.drop_recurring(clashing(documents(spark, lined))).collect()
    assert len(rows) == len(lined)
    for r in rows:
        if r.row.doc_id < 100:
            assert "Page" not in r.text and r.n_dropped == 1 and r.n_lines == 3
        elif r.row.doc_id < 300:
            assert r.text == r.row.text and r.n_dropped == 0
        else:  # the name is a variable field
            assert "reader" not in r.text and r.text.count("\n") == 2


def test_odd_texts_have_a_defined_result(spark, lined):
    odd = [(None, None), (901, ""), (902, "\n\n"), (902, "\n\n"), (903, "Page 7 of this book was printed by hand"), (904, "x" * 50_000)]
    docs = documents(spark, odd + lined)
    found = {r.doc_id: r.text for r in line_templates.without_recurring_lines(docs).collect()}
    assert found[None] is None and found[901] == "" and found[902] == "\n\n" and found[904] == "x" * 50_000
    assert found[903] == ""  # all its lines recur
    assert line_templates.without_recurring_lines(docs.limit(0)).count() == 0


def _prose(seed):
    rng = random.Random(seed)
    return lambda n=12: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def _kept(spark, rows):
    return {r.row.doc_id: r.text for r in line_templates.drop_recurring(documents(spark, rows)).collect()}


def test_blocks_of_several_lines_go(spark):
    line = _prose(11)
    block, footer = [line(6) for _ in range(3)], [line(6), line(6)]
    own = {i: [line(), line()] for i in range(24)}
    rows = [(i, "\n".join([own[i][0], *block, own[i][1]])) for i in range(12)]
    rows += [(i, "\n".join([*own[i], *footer])) for i in range(12, 24)]
    assert _kept(spark, rows) == {i: "\n".join(lines) for i, lines in own.items()}


def test_a_group_of_near_copies_counts_once(spark):
    line = _prose(12)
    common, rare, body = line(6), line(6), [line() for _ in range(20)]
    own = {i: [line(), line()] for i in range(8)}
    rows = [(i, "\n".join([own[i][0], common, own[i][1], rare if i < 3 else line(6)])) for i in range(8)]
    copies = [(100 + i, "\n".join([*body[:10], common, *body[10:], rare, f"{line(1)} end"])) for i in range(60)]
    found = _kept(spark, rows + copies)
    for i, text in rows + copies:  # common is in 8 texts and one group; rare in 3 and one
        assert found[i] == text.replace(f"{common}\n", "")


def test_values_from_finite_lists_are_variable_fields(spark):
    line = _prose(13)
    names, towns = [line(1) for _ in range(20)], [line(1) for _ in range(10)]
    own = {i: [line(), line()] for i in range(200)}
    said = "The order of user {} was sent from the city {} without any delay today"
    rows = [(i, "\n".join([a, said.format(names[i % 20], towns[i // 20]), b])) for i, (a, b) in own.items()]
    assert _kept(spark, rows) == {i: "\n".join(lines) for i, lines in own.items()}


def test_long_passages_go_from_two_texts(spark):
    line = _prose(14)
    long, middle = [line(20) for _ in range(3)], [line(18) for _ in range(2)]
    rows, left = [], {}
    for i in range(7):  # 60 words in two texts, 36 in three
        own, other = [line(25) for _ in range(4)], [line(18) for _ in range(2)]
        part = long if i < 2 else middle if i < 5 else other
        rows.append((i, "\n".join([*own[:2], *part, *own[2:]])))
        left[i] = "\n".join(own) if i < 5 else rows[-1][1]
    short = line(18)
    rows += [(10 + i, "\n".join([line(25), short, line(25)])) for i in range(4)]
    whole = [line(25) for _ in range(8)]  # near copies keep what they share
    rows += [(20 + i, "\n".join([*whole, line(5)])) for i in range(2)]
    left |= {i: text for i, text in rows if i >= 10}
    assert _kept(spark, rows) == left


@pytest.mark.parametrize("own_words", [60, 80, 100, 120, 140])
def test_a_shared_passage_goes_whatever_share_of_the_texts_it_is(spark, own_words):
    line = _prose(own_words)
    passage = [line(20) for _ in range(20)]
    own = {i: [line(own_words // 4) for _ in range(4)] for i in range(2)}
    rows = [(i, "\n".join([*lines[:2], *passage, *lines[2:]])) for i, lines in own.items()]
    assert _kept(spark, rows) == {i: "\n".join(lines) for i, lines in own.items()}


def test_lines_of_one_pass_equal_plain_python():
    import pyarrow as pa

    from veilwork.llm.shingles import Words

    rng = random.Random(15)
    texts = ["", " \n", "\n\n a", "x2 b\tC \r é", *("".join(rng.choice("abAB1 \n\t é") for _ in range(rng.randint(0, 200))) for _ in range(300))]
    found, bounds = Words(pa.array(texts)).lines(3, line_templates.FIELD)
    leaves, lines = {}, {}
    for i, text in enumerate(texts):
        cut = [["<*>" if any(c in "0123456789" for c in w) else w for w in words(x)] for x in text.split("\n")]
        cut = [(place, tuple(line)) for place, line in enumerate(cut) if line]
        mine = {name: found[name][bounds[i] : bounds[i + 1]].tolist() for name in ("place", "leaf", "line", "n_words")}
        assert mine["place"] == [place for place, _ in cut] and mine["n_words"] == [len(line) for _, line in cut]
        for (_, line), leaf, hashed in zip(cut, mine["leaf"], mine["line"], strict=True):
            assert leaves.setdefault((len(line), line[:3]), leaf) == leaf and lines.setdefault(line, hashed) == hashed
    assert len(set(leaves.values())) == len(leaves) and len(set(lines.values())) == len(lines)


def test_small_and_large_leaves_have_the_same_templates(spark):
    rng = random.Random(16)
    rows = [(leaf, 1000 * leaf + i, [100 * leaf + 10 * at + rng.choice([0, 0, 0, 1, i % 7]) for at in range(9)])
            for leaf in range(40) for i in range(rng.randint(1, 30))]
    lines = spark.createDataFrame(rows, "leaf bigint, line bigint, token array<bigint>")

    def classes(found):
        members = {}
        for r in found.collect():
            members.setdefault(r.template, set()).add(r.line)
        return {frozenset(x) for x in members.values()}

    dealt = lines.repartition(3, "leaf").sortWithinPartitions("leaf")
    small = classes(dealt.mapInArrow(line_templates._agreed(70), "line bigint, template bigint"))
    assert small and small == classes(line_templates._agreed_in_large(lines, 70))
