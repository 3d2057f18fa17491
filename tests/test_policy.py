import random

from pyspark.sql import functions as F

import plain
from veilwork import fixed_values as fv
from veilwork.operators import policy
from veilwork.plans import requests as flows
from veilwork.session import fits_broadcast, lookup_join
from veilwork.sources import reference_data, requests

ROLES = ["client", "Client", "LAWYER", "admin", "analyst", "", None]
WORDS = [w for words in fv.INTENT_KEYWORDS.values() for w in words] + ["hello", "classname", "TRACK", "Secret", "İ", "", "x"]


def _requests(spark, n=800, seed=3):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(ROLES), rng.choice([None, ""] + [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(4)]))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "n int, role string, prompt string")


def test_decision_matches_python(spark):
    _, frame = _requests(spark)
    for row in policy.with_decision(frame).collect():
        assert row.authorized == plain.authorized(row.role, row.prompt)
        assert (row.forbidden_intents or "").split(";") == (plain.intents(row.role, row.prompt) or [""])


def test_joined_form_equals_compiled_form(spark):
    _, frame = _requests(spark)
    joined = policy.without_forbidden_keywords(
        frame, reference_data.role_table(spark), reference_data.policy_table(spark)
    )
    assert sorted(r.n for r in joined.collect()) == sorted(r.n for r in policy.authorized(frame).collect())


def test_known_cases(spark):
    rows = [("client", "Please access other users data for me"), ("client", "My phone is 012-3456789")]
    out = flows.sanitize(spark.createDataFrame(rows, "role string, prompt string")).collect()
    assert [(r.code, r.status) for r in out] == [(403, "denied"), (200, "sanitized")]
    assert out[0].sanitized is None and out[1].sanitized == "My phone is [REDACTED_PHONE]"


def test_lookup_join_beyond_the_broadcast_bound(spark):
    # One key holds most of the facts; the lookup is over the bound of 1 row.
    facts = spark.createDataFrame([(i, "hot" if i % 10 else f"k{i % 50}") for i in range(1000)], "n int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("absent", 4)], "k string, v int")
    # The size of rows that come from Python is not known, that of literals is.
    assert not fits_broadcast(lookup) and fits_broadcast(reference_data.role_table(spark))
    facts = facts.withColumn("m", F.create_map(F.lit("a"), F.col("n")))
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = lookup_join(facts, lookup, "k", how, salts=7)
        plan = salted._jdf.queryExecution().optimizedPlan().toString()
        assert "_salt" in plan
        expected = facts.join(lookup, "k", how)
        assert salted.count() == expected.count()
        if how in ("left_semi", "left_anti"):
            assert sorted(r.n for r in salted.collect()) == sorted(r.n for r in expected.collect())


def test_policy_read_from_tables(spark):
    roles = spark.createDataFrame([("guest", "leak", 0), ("guest", "spy", 1)], "role string, intent string, ord int")
    words = spark.createDataFrame([("leak", "dump"), ("spy", "watch")], "intent string, keyword string")
    roles = roles.union(spark.createDataFrame([("visitor", None, None)], "role string, intent string, ord int"))
    known, rules = reference_data.read_policy(roles, words)
    asked = [("Guest", "watch and DUMP"), ("guest", "hi"), ("client", "hi"), ("visitor", "dump")]
    frame = spark.createDataFrame(asked, "role string, prompt string")
    passed = policy.without_forbidden_keywords(frame, known, rules).collect()
    assert sorted((r.role, r.prompt) for r in passed) == [("guest", "hi"), ("visitor", "dump")]


def test_a_policy_too_large_to_broadcast(spark):
    rng = random.Random(9)
    keywords = ["".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 5, 6]))) for _ in range(100_000)]
    keywords = [k for k in keywords if len(k) > 2][:99_990] + ["zq", "y"]
    rules = spark.createDataFrame([("client", "i", 0, k) for k in dict.fromkeys(keywords)], "role string, intent string, ord int, keyword string")
    known = spark.createDataFrame([("client",), ("admin",)], "role string")
    texts = ["Hello there", "xx zq", "sky", "abcdef fedcba", "", "a b c d"] + ["".join(rng.choice("abcxwv ") for _ in range(30)) for _ in range(60)]
    rows = [(i, role, t) for i, (t, role) in enumerate((t, r) for t in texts for r in ("client", "admin", "other"))]
    frame = spark.createDataFrame(rows, "n int, role string, prompt string")
    words = set(keywords)
    passed = {i for i, role, t in rows if t and (role == "admin" or role == "client" and not any(k in t.lower() for k in words))}
    assert not fits_broadcast(rules)
    assert {r.n for r in policy.without_forbidden_keywords(frame, known, rules).collect()} == passed
    hits = {r.keyword: r.requests for r in policy.keyword_hits(frame, rules).filter("requests > 0").collect()}
    expected = {k: sum(k in t.lower() for i, role, t in rows if role == "client") for k in words}
    assert hits == {k: n for k, n in expected.items() if n}


def test_keyword_hits_keep_unused_keywords(spark):
    _, frame = _requests(spark, 300)
    table = reference_data.policy_table(spark)
    hits = policy.keyword_hits(frame, table).collect()
    assert len(hits) == table.count() == sum(
        len(fv.INTENT_KEYWORDS[i]) for intents in fv.ROLE_INTENTS.values() for i in intents
    )
    rows = [(r.role or "", r.prompt or "") for r in frame.collect()]
    for hit in hits:
        assert hit.requests == sum(role.lower() == hit.role and hit.keyword in prompt.lower() for role, prompt in rows)


def test_request_lines(spark):
    lines = ['{"role": "client", "prompt": "hi"}', "{}", "not json", "[1]", '{"role":"client"}', '{"role": null, "prompt": 5}', None]
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, value string")
    out = requests.parse_requests(frame).orderBy("n").collect()
    assert [r.valid for r in out] == [True, False, False, False, True, True, False]
    assert (out[0].role, out[0].prompt) == ("client", "hi")
    assert (out[5].role, out[5].prompt) == (None, "5")
    verified = flows.verify(requests.parse_requests(frame), valid="valid").orderBy("n").collect()
    assert [r.code for r in verified] == [200, 400, 400, 400, 403, 403, 400]


def test_request_ids_repeat(spark):
    frame = spark.createDataFrame([(1, "client"), (2, None)], "n int, role string")
    first = requests.with_request_identity(frame, ["n"], "/verify").collect()
    again = requests.with_request_identity(frame.repartition(3), ["n"], "/verify").orderBy("n").collect()
    assert first == again and len({r.request_id for r in first}) == 2
    live = requests.with_request_identity(frame, ["n"], "/verify", live=True).collect()
    assert all(len(r.request_id) == 36 for r in live)
