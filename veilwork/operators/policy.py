"""Role policies: who may ask what.

Two forms of the same check.  The compiled form turns a small policy into one
boolean column per intent and never moves a row.  The joined form takes the
policy as a table of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions.once import evaluated_once
from veilwork.session import fits_broadcast, lookup_join
from veilwork.sources.files import written_once
from veilwork.sources.reference_data import Policy


def with_request_terms(df: DataFrame, role: str = "role", prompt: str = "prompt") -> DataFrame:
    """Add ``_role`` and ``_prompt``: lower case, NULL where empty."""
    return df.select(
        "*",
        F.lower(F.nullif(F.col(role), F.lit(""))).alias("_role"),
        F.lower(F.nullif(F.col(prompt), F.lit(""))).alias("_prompt"),
    )


def _complete_requests(df: DataFrame) -> DataFrame:
    """Requests with a role and a prompt; the test reaches the file scan."""
    return with_request_terms(df.filter((F.col("role") != "") & (F.col("prompt") != "")))


def role_known(df: DataFrame, roles: DataFrame, role: str = "role") -> DataFrame:
    """Add ``role_known``: the role has a policy (equi lookup on the role table)."""
    requests = df.withColumn("_role", F.lower(F.col(role)))
    known = roles.select(F.col("role").alias("_role"), F.lit(True).alias("_known")).distinct()
    joined = lookup_join(requests, known, "_role", "left")
    return joined.select(
        *[F.col(f"facts.{name}") for name in df.columns],
        F.coalesce(F.col("lookup._known"), F.lit(False)).alias("role_known"),
    )


# Keywords of a large policy are looked up by so many of their first characters.
GRAM = 8
# Characters of a prompt that are cut into pieces together.
_BLOCK = 256


def _identity(role: Column, prompt: Column) -> Column:
    """32 bytes that stand for a role and a prompt where only narrow rows are moved."""
    return F.unhex(F.sha2(F.concat_ws("\u001f", role, prompt), 256))


def _pieces(prompt: Column, longest: int) -> Column:
    """Of every place of a prompt, the ``longest`` characters from there on (fewer at the end).

    Places are taken block by block, so that the work grows with the length and not with its square.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(prompt) - 1) / F.lit(_BLOCK)).cast("int")),
        lambda b: F.substring(prompt, b * _BLOCK + 1, F.lit(_BLOCK + longest - 1)),
    )
    places = lambda block: F.sequence(F.lit(1), F.least(F.length(block), F.lit(_BLOCK)))
    return F.flatten(F.transform(
        blocks, lambda block: F.transform(places(block), lambda i: F.substring(block, i, F.lit(longest)))
    ))


def _broadcast_bytes(spark: SparkSession) -> int:
    bound = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return bound if bound > 0 else 0


def _large_matches(terms: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of ``terms`` (_role, _prompt, _id) and ``rules`` (_role, keyword, ...) with the keyword in the prompt, each once.

    Every place of a prompt gives the piece of text there, and pieces meet the keywords by
    role and first characters; the piece tells whether it begins with the whole keyword.  The
    prompt itself is never copied to its pieces nor shuffled.  Keywords are broadcast in as many
    parts as the session's bound in bytes asks for, each met in a reading of its own; only a session
    that forbids broadcasts shuffles the pieces.
    """
    spark = terms.sparkSession
    stored, _ = written_once(rules.filter(F.col("keyword").isNotNull()).distinct(), "rules")
    sizes = F.collect_set(F.least(F.length("keyword"), F.lit(GRAM)))  # at most one more than GRAM
    longest, lengths, blanks = stored.agg(F.max(F.length("keyword")), sizes, F.count_if(F.col("keyword") == "")).first()
    found = None
    if blanks:  # An empty keyword is in every prompt.
        met = lookup_join(terms.select("_id", "_role"), stored.filter(F.col("keyword") == ""), "_role", "inner")
        found = met.select("facts._id", *[F.col(f"lookup.`{name}`") for name in rules.columns])
    stored, lengths = stored.filter(F.col("keyword") != ""), sorted(n for n in lengths if n)
    if not lengths:
        schema = T.StructType([T.StructField("_id", T.BinaryType()), *rules.schema.fields])
        return found.distinct() if found else spark.createDataFrame([], schema)
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bound = _broadcast_bytes(spark)
    parts = -(-size // bound) if bound else 1
    gram = lambda text, n: F.concat_ws("\u001f", F.col("_role"), F.substring(text, 1, n))
    keyed = stored.withColumn("_gram", gram(F.col("keyword"), GRAM))
    pieces = evaluated_once(terms, ["_id", "_role"], [_pieces(F.col("_prompt"), longest).alias("_all")])
    pieces = pieces.select("_id", "_role", F.explode("_all").alias("_piece"))
    # A piece at the end of a prompt may be shorter than a length; it then gives the same text twice.
    grams = F.array_distinct(F.array(*[gram(F.col("_piece"), n) for n in lengths]))
    placed = pieces.select("_id", "_piece", F.explode(grams).alias("_gram"))
    if not bound:
        # Equal pieces of a prompt are one before they move.
        placed = placed.distinct()
    for part in range(parts):
        some = keyed if parts == 1 else keyed.filter(F.pmod(F.xxhash64("_gram"), F.lit(parts)) == part)
        met = lookup_join(
            placed, some, "_gram", "inner", F.startswith(F.col("facts._piece"), F.col("lookup.keyword")), small=bound > 0
        )
        pairs = met.select("facts._id", *[F.col(f"lookup.`{name}`") for name in rules.columns])
        found = found.unionByName(pairs) if found else pairs
    return found.distinct()


def without_forbidden_keywords(df: DataFrame, roles: DataFrame, policy: DataFrame) -> DataFrame:
    """Authorized requests by joins: role known, and no keyword of the role in the prompt.

    A small policy is broadcast.  With a larger one, what moves are the ids of denied
    requests; the requests themselves move once, to meet them, or not at all if the ids are few.
    """
    requests = _complete_requests(df)
    known = lookup_join(requests, roles.select(F.col("role").alias("_role")).distinct(), "_role", "left_semi")
    keywords = policy.select(F.col("role").alias("_role"), "keyword").distinct()
    if fits_broadcast(keywords):
        contained = F.contains(F.col("facts._prompt"), F.col("lookup.keyword"))
        return lookup_join(known, keywords, "_role", "left_anti", contained).drop("_role", "_prompt")
    named = known.withColumn("_id", _identity(F.col("_role"), F.col("_prompt")))
    denied = _large_matches(named.select("_id", "_role", "_prompt"), keywords).select("_id").distinct()
    return named.join(denied, "_id", "left_anti").select(*df.columns)


def keyword_hits(df: DataFrame, policy: DataFrame) -> DataFrame:
    """For every policy row, how many requests of its role contain its keyword.

    Keywords nobody used stay in the result with 0 requests.
    """
    requests = _complete_requests(df)
    rules = policy.withColumnRenamed("role", "_role")
    # Hits are counted per rule in each task before anything is shuffled.
    terms = evaluated_once(requests, [], [F.col("_role"), F.col("_prompt")])
    if fits_broadcast(rules):
        hits = lookup_join(terms, rules, "_role", "inner", F.contains(F.col("facts._prompt"), F.col("lookup.keyword")))
        counted = hits.groupBy("lookup._role", "lookup.intent", "lookup.keyword").agg(F.count("*").alias("n"))
    else:
        rules = rules.select("_role", "intent", "keyword")
        named = terms.withColumn("_id", _identity(F.col("_role"), F.col("_prompt")))
        times = named.groupBy("_id").agg(F.count("*").alias("times"))
        hits = _large_matches(named.select("_id", "_role", "_prompt"), rules).join(times, "_id")
        counted = hits.groupBy("_role", "intent", "keyword").agg(F.sum("times").alias("n"))
    zeros = rules.select("_role", "intent", "keyword", F.lit(0).cast("bigint").alias("n"))
    return (
        counted.unionByName(zeros)
        .groupBy(F.col("_role").alias("role"), "intent", "keyword")
        .agg(F.sum("n").alias("requests"))
    )


def with_decision(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add ``authorized`` and ``forbidden_intents`` (``;``-joined, NULL when none).

    Every keyword of an intent is looked for only where the role forbids it.
    """
    terms = with_request_terms(df)
    prompt, role = F.col("_prompt"), F.col("_role")
    flags = {intent: f"_intent_{i}" for i, intent in enumerate(policy.intents)}

    def shows(intent: str) -> Column:
        found = [F.contains(prompt, F.lit(k)) for k in policy.intent_keywords.get(intent, [])]
        any_found = reduce(lambda x, y: x | y, found, F.lit(False))
        applies = role.isin(policy.roles_forbidding(intent)) & prompt.isNotNull()
        return F.coalesce(applies & any_found, F.lit(False))

    flagged = terms.select("*", *[shows(intent).alias(name) for intent, name in flags.items()])
    listed = None
    for name, intents in policy.role_intents.items():
        joined = F.concat_ws(";", *[F.when(F.col(flags[i]), F.lit(i)) for i in intents])
        listed = F.when(role == name, joined) if listed is None else listed.when(role == name, joined)
    any_flag = reduce(lambda x, y: x | y, [F.col(name) for name in flags.values()], F.lit(False))
    known = role.isin(policy.roles) & prompt.isNotNull()
    decision = [
        F.coalesce(known & ~any_flag, F.lit(False)).alias("authorized"),
        F.nullif(listed, F.lit("")).alias("forbidden_intents"),
    ]
    return evaluated_once(flagged, df.columns, decision)


def intents_array(column: str = "forbidden_intents") -> Column:
    """The joined intents as an array, empty when there are none."""
    return F.when(F.col(column).isNull(), F.array().cast("array<string>")).otherwise(F.split(F.col(column), ";"))


def authorized(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Requests that may pass, by the compiled policy."""
    return with_decision(df, policy).filter("authorized").drop("authorized", "forbidden_intents")


def verify_disposition(df: DataFrame, policy: Policy = Policy(), valid: str | None = None) -> DataFrame:
    """Outcome of a verify request: ``status``, ``code`` and whether it is audited.

    A denial with intents is audited; an unknown role or empty prompt is denied
    without an audit row.
    """
    body_ok = F.col(valid) if valid else F.lit(True)
    intents = F.col("forbidden_intents").isNotNull()
    return with_decision(df, policy).select(
        "*",
        F.when(~body_ok, "denied").when(F.col("authorized"), "authorized").otherwise("denied").alias("status"),
        F.when(~body_ok, 400).when(F.col("authorized"), 200).otherwise(403).alias("code"),
        (body_ok & intents).alias("audit"),
    )


def sanitize_disposition(df: DataFrame, policy: Policy = Policy(), valid: str | None = None) -> DataFrame:
    """Outcome of a sanitize request before any detector runs; never audited."""
    body_ok = F.col(valid) if valid else F.lit(True)
    return with_decision(df, policy).select(
        "*",
        F.when(body_ok & F.col("authorized"), "sanitize").otherwise("denied").alias("status"),
        F.when(~body_ok, 400).when(F.col("authorized"), 200).otherwise(403).alias("code"),
    )
