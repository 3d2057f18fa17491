"""All registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.operators import detectors, dictionaries, events, gate, integrity, jury, policy, reports, vector_detectors
from veilwork.plans import audit_report, corpus
from veilwork.plans import requests as flows
from veilwork.schemas import UNSIGNED_COLUMNS
from veilwork.sources import audit_table, logs, reference_data
from veilwork.sources import requests as request_source
from veilwork.session import fresh_path
from veilwork.streaming import jobs, stores
from verification import seeds
from verification import tables as t
from verification.tables import AS_OF

JURY_COUNTS = [f"{tool}_{slot}" for tool in "abc" for slot in detectors.SLOTS]
JURY_SCORES = ["score_a", "score_b", "score_c"]

_QUERIES = {}


def query(function, name=None):
    def run(spark, d):
        t.use_local_folder(spark)
        return function(spark, d)

    _QUERIES[name or function.__name__] = run
    return run


def _judged(spark, d, *extra) -> DataFrame:
    return jury.redaction_jury(t.prompts(spark, d).select("prompt_id", "prompt", *extra))


# --- requests and policies -------------------------------------------------------


@query
def parse_requests(spark: SparkSession, d: str) -> DataFrame:
    return request_source.parse_requests(t.request_lines(spark, d)).select("line_id", "role", "prompt", "valid")


@query
def request_ids(spark, d):
    tagged = request_source.with_request_identity(t.prompts(spark, d), ["prompt_id", "ts"], fv.SANITIZE_ENDPOINT)
    return tagged.select("prompt_id", "request_id", "user_role", "endpoint")


@query
def policy_matrix(spark, d):
    return policy.keyword_hits(t.prompts(spark, d), reference_data.policy_table(spark))


@query
def role_known(spark, d):
    known = policy.role_known(t.prompts(spark, d), reference_data.role_table(spark))
    return known.select("prompt_id", "role", "role_known")


@query
def authorized_prompts(spark, d):
    passed = policy.without_forbidden_keywords(
        t.prompts(spark, d), reference_data.role_table(spark), reference_data.policy_table(spark)
    )
    return passed.select("prompt_id", "role", "prompt")


@query
def forbidden_intents(spark, d):
    return policy.with_decision(t.prompts(spark, d)).select("prompt_id", "authorized", "forbidden_intents")


@query
def verify_disposition(spark, d):
    parsed = request_source.parse_requests(t.request_lines(spark, d))
    return flows.verify(parsed, valid="valid").select("line_id", "status", "code", "audit")


@query
def sanitize_disposition(spark, d):
    parsed = request_source.parse_requests(t.request_lines(spark, d))
    return policy.sanitize_disposition(parsed, valid="valid").select("line_id", "status", "code")


# --- detectors and jury ----------------------------------------------------------


def _one_tool(detector):
    def run(spark, d):
        out = jury.detector_output(t.prompts(spark, d).select("prompt_id", "prompt"), detector)
        return out.select("prompt_id", "redacted", "count_id", "count_phone", "count_email")

    return run


query(_one_tool(detectors.STRICT), "tool_a")
query(_one_tool(detectors.DICTIONARY), "tool_b")
query(_one_tool(detectors.LOOSE), "tool_c")


@query
def jury_scores(spark, d):
    return jury.scores_only(t.prompts(spark, d)).select("prompt_id", *JURY_SCORES)


@query
def jury_winner(spark, d):
    return jury.scores_only(t.prompts(spark, d)).select("prompt_id", "winning_tool")


@query
def jury_output(spark, d):
    return _judged(spark, d).select("prompt_id", "sanitized")


@query
def redaction_jury(spark, d):
    return _judged(spark, d).select("prompt_id", "sanitized", "winning_tool", *JURY_SCORES, *JURY_COUNTS)


@query
def reliability_summary(spark, d):
    shaped = _judged(spark, d).select("prompt_id", flows.reliability_summary().alias("s"))
    flat = shaped.select("prompt_id", "s.winning_tool", "s.tool_comparison.*", "s.detailed_counts.*")
    nested = [
        F.col(f"Tool_{tool}.{slot}").alias(f"Tool_{tool}_{slot}") for tool in "ABC" for slot in detectors.SLOTS
    ]
    labels = [c for c in flat.columns if not c.startswith("Tool_") or c.endswith("_Count")]
    return flat.select(*labels, *nested)


@query
def redacted_only(spark, d):
    changed = jury.redacted_only(_judged(spark, d))
    return changed.select("prompt_id", "winning_tool", "sanitized")


@query
def redact_pii(spark, d):
    return jury.redact_pii(t.prompts(spark, d)).select("prompt_id", "redacted")


@query
def detect_pii_counts(spark, d):
    counted = jury.detect_pii_counts(t.prompts(spark, d))
    return counted.select("prompt_id", "count_id", "count_phone", "count_email")


@query
def pii_findings(spark, d):
    return jury.findings(t.prompts(spark, d), ["prompt_id"])


@query
def jury_weighted(spark, d):
    weights = {"A": {"id": 3, "phone": 2}, "B": {"id": 1}, "C": {"email": 2}}
    weighted = jury.redaction_jury(t.prompts(spark, d).select("prompt_id", "prompt"), weights=weights)
    return weighted.select("prompt_id", "winning_tool", "sanitized", *JURY_SCORES)


@query
def jury_consensus(spark, d):
    voted = jury.consensus(t.prompts(spark, d).select("prompt_id", "prompt"))
    return voted.drop("prompt")


def _card_texts(spark, d) -> DataFrame:
    derived = t.derived(spark, seeds.CARD_TEXTS, events=t.table(spark, d, "events"))
    keyed = derived.select(F.lit("cards").alias("collection"), F.col("text_id").cast("string").alias("row_key"), "text")
    documents = t.table(spark, d, "documents")
    return keyed.unionByName(
        documents.select(F.lit("documents").alias("collection"), F.col("doc_id").cast("string").alias("row_key"), "text")
    )


@query
def jury_vector_detector(spark, d):
    """The jury with a fourth detector that is a function over Arrow batches."""
    tools = [*detectors.DETECTORS, vector_detectors.CARDS]
    judged = jury.redaction_jury(_card_texts(spark, d), "text", tools)
    return judged.select(
        "collection", "row_key", "winning_tool", *JURY_SCORES, "score_v", F.col("v_id").alias("cards"),
        F.md5("sanitized").alias("sanitized_md5"),
    )


@query
def vector_findings(spark, d):
    found = jury.finding_spans(_card_texts(spark, d), ["collection", "row_key"], "text", [vector_detectors.CARDS])
    return found.select("collection", "row_key", "tool", "kind", "start", "end")


@query
def jury_table_dictionary(spark, d):
    """The jury with the word lists of its second detector read from a table."""
    rows = [(kind, term) for kind, terms in (("name", fv.NAMES), ("location", fv.LOCATIONS)) for term in terms]
    terms = dictionaries.stored_terms(reference_data.term_table(spark, rows))
    lists = dictionaries.TableDictionary("B", tuple(vector_detectors.VectorRule(w.kind, w.slot, w.mask) for w in detectors.DICTIONARY.lists))
    prompts = t.prompts(spark, d).select("prompt_id", "prompt")
    placed = dictionaries.with_term_places(prompts, ["prompt_id"], "prompt", terms, lists)
    judged = jury.redaction_jury(placed, detectors=[detectors.STRICT, lists, detectors.LOOSE])
    return judged.select("prompt_id", "sanitized", "winning_tool", *JURY_SCORES, *JURY_COUNTS)


@query
def dictionary_counts(spark, d):
    """All words and pairs of words of the conversations as two lists of terms, looked for in all documents."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+(?: [A-Za-z]+)?"), F.lit(0))
    terms = t.table(spark, d, "conversations").select(F.explode(words).alias("term"))
    terms = terms.select(F.when(F.contains("term", F.lit(" ")), "pair").otherwise("word").alias("kind"), "term")
    documents = t.table(spark, d, "documents").select("doc_id", "text")
    return dictionaries.term_counts(documents, ["doc_id"], "text", dictionaries.stored_terms(terms))


@query
def jury_union(spark, d):
    """All detectors' masks together, over prompts and documents."""
    prompts = t.prompts(spark, d).select(
        F.lit("prompts").alias("collection"), F.col("prompt_id").cast("string").alias("row_key"), F.col("prompt").alias("text")
    )
    documents = t.table(spark, d, "documents").select(
        F.lit("documents").alias("collection"), F.col("doc_id").cast("string").alias("row_key"), "text"
    )
    done = jury.jury_union(prompts.unionByName(documents), "text")
    return done.select(
        "collection", "row_key", "hits", "masked_spans", "masked_chars", F.md5("sanitized").alias("sanitized_md5")
    )


@query
def pii_finding_spans(spark, d):
    return jury.finding_spans(t.prompts(spark, d), ["prompt_id"])


@query
def sanitize_end_to_end(spark, d):
    parsed = request_source.parse_requests(t.request_lines(spark, d))
    done = flows.sanitize(parsed.select("line_id", "role", "prompt", "valid"), valid="valid")
    return done.select("line_id", "code", "status", "sanitized", "winning_tool", *JURY_SCORES, *JURY_COUNTS)


def _corpus(spark, d):
    return corpus.texts(*[t.table(spark, d, name) for name in ("documents", "conversations", "pages")])


@query
def corpus_jury(spark, d):
    judged = corpus.corpus_jury(_corpus(spark, d))
    return judged.select(
        "collection", "row_key", "winning_tool", *JURY_SCORES, *JURY_COUNTS, F.md5("sanitized").alias("sanitized_md5")
    )


@query
def corpus_findings(spark, d):
    return corpus.corpus_findings(_corpus(spark, d), ["collection", "row_key"])


# --- gate ------------------------------------------------------------------------


@query
def generate_gate(spark, d):
    decided = gate.generate_gate(t.gate_lines(spark, d).select("line_id", "value"))
    return decided.select("line_id", "sanitized_prompt", "provider", "model", "reason", "code", "audit")


@query
def gate_denied_events(spark, d):
    denied = events.gate_denied_events(gate.generate_gate(t.gate_lines(spark, d)))
    return denied.select("ts", "event_type", "request_id", "user_role", "endpoint", "message")


@query
def token_events(spark, d):
    usage = t.table(spark, d, "events").select(
        "ts",
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.lit("client").alias("user_role"),
        F.when(F.col("event_type") == "click", F.col("event_id") % 300).alias("prompt_tokens"),
        F.when(F.col("event_id") % 4 != 0, F.when(F.col("event_type") == "click", F.col("event_id") % 200)).alias("completion_tokens"),
        F.when(F.col("event_type") == "click", F.col("event_id") % 500).alias("total_tokens"),
    )
    return events.token_events(usage).select("ts", "event_type", "request_id", "user_role", "endpoint", "message")


# --- audit events and the audit table --------------------------------------------


@query
def denied_events(spark, d):
    denied = flows.verify_audit(flows.verify(t.requests(spark, d)), raw_text=True)
    return denied.drop("id")


@query
def jury_events(spark, d):
    return flows.sanitize_audit(flows.sanitize(t.requests(spark, d)), raw_text=True).drop("id")


# A fourth detector that outweighs the others where it finds something, and a slot that counts nothing.
ORDERS = detectors.PatternDetector("D", (detectors.PatternRule("order", "id", r"\bOrder \d+", "[REDACTED_ORDER]"),))
FOUR_TOOLS = [*detectors.DETECTORS, ORDERS]
FOUR_WEIGHTS = {"A": {"email": 0}, "C": {"email": 0}, "D": {"id": 5}}


@query
def jury_events_four_tools(spark, d):
    done = flows.sanitize(t.requests(spark, d), detectors=FOUR_TOOLS, weights=FOUR_WEIGHTS)
    return flows.sanitize_audit(done, detectors=FOUR_TOOLS).select(
        "request_id", "winning_tool", "count_id", "count_email", "message", "metadata", "tool_a_counts"
    )


@query
def priority_events(spark, d):
    return events.priority_events(t.audit_seed(spark, d)).select("id", "event_type")


@query
def log_to_audit(spark, d):
    records = t.audit_seed(spark, d).select(
        "id", "ts", "event_type", "request_id", "user_role", "endpoint", "message", "forbidden_intents", "count_id"
    )
    return events.log_to_audit(records)


@query
def event_log_json(spark, d):
    lines = logs.event_log_json(t.audit_seed(spark, d))
    # Parsed again, so that the check does not depend on JSON spacing.
    return logs.read_log_lines(lines).drop("exception")


@query
def incident_log_filter(spark, d):
    lines = logs.event_log_json(t.audit_seed(spark, d))
    kept = logs.incident_log_filter(lines, event_types=[fv.DENIED], roles=["client", "lawyer"])
    return kept.select("timestamp", "level", "request_id", "user_role", "message")


@query
def audit_schema_union(spark, d):
    both = events.audit_schema_union(t.legacy(spark, d), t.audit_seed(spark, d).withColumn("signature", F.lit(None).cast("string")))
    return events.to_audit_schema(both)


@query
def audit_dedup(spark, d):
    return events.deduplicate(t.duplicated(spark, d))


@query
def audit_signed(spark, d):
    return t.signed(spark, d).select("id", "key_id", "signature")


@query
def audit_signed_v2(spark, d):
    return integrity.sign(t.audit_seed(spark, d), t.keys(spark), t.rotated_key()).select("id", "key_id", "payload_version", "signature")


@query
def tampered_ids_mixed(spark, d):
    checked = integrity.verify(t.mixed_versions(spark, d), t.keys(spark), key_id="k1")
    return integrity.tampered(checked).select("id")


@query
def audit_round_trip(spark, d):
    path = fresh_path(spark, "audit")
    audit_table.append_events(t.signed(spark, d), path)
    stored = audit_table.read_events(spark, path, since=reports.window_start(AS_OF, 96))
    return stored.select(*UNSIGNED_COLUMNS, "signature", "key_id", "payload_version", "event_date")


@query
def audit_compacted(spark, d):
    """The audit table after appends of many small files were compacted, with one more append behind it."""
    path = fresh_path(spark, "audit-compacted")
    signed = t.signed(spark, d)
    parts = 9
    for part in range(parts):
        audit_table.append_events(signed.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part), path)
        if part == parts - 2:
            audit_table.compact(spark, path)
    return audit_table.read_events(spark, path).select(*UNSIGNED_COLUMNS, "signature", "key_id", "payload_version", "event_date")


@query
def tampered_ids(spark, d):
    return integrity.tampered(t.checked(spark, d)).select("id")


@query
def tampered_since(spark, d):
    return integrity.tampered(t.checked(spark, d), reports.window_start(AS_OF, 72)).select("id", "ts")


@query
def tampered_top10(spark, d):
    return integrity.tampered_preview(t.checked(spark, d))


@query
def integrity_rollup(spark, d):
    return integrity.integrity_rollup(t.checked(spark, d))


@query
def tamper_timeline(spark, d):
    return integrity.tamper_timeline(t.checked(spark, d))


@query
def signature_discrepancies(spark, d):
    store = t.signed(spark, d).select("id", "signature")
    return integrity.signature_discrepancies(t.checked(spark, d), store)


@query
def verified_export(spark, d):
    return integrity.verified_export(t.checked(spark, d)).select("id", "request_id", "message", "signature", "key_id")


# --- reports ---------------------------------------------------------------------


@query
def blocked_window(spark, d):
    return reports.blocked_count(t.audit_seed(spark, d), reports.window_start(AS_OF, 48))


@query
def pii_totals_window(spark, d):
    kinds = (fv.REDACTED, fv.JURY_REDACTED)
    return reports.pii_totals(t.audit_seed(spark, d), reports.window_start(AS_OF, 48), kinds, phones=True)


@query
def intent_frequency(spark, d):
    # Rows as they are built, with ids that are hashes of their fields.
    denied = flows.verify_audit(flows.verify(t.requests(spark, d)))
    return reports.intent_frequency(denied).select("intent", "n")


@query
def audit_summary_24h(spark, d):
    return reports.audit_summary(t.audit_seed(spark, d), AS_OF)


@query
def audit_summary_stored(spark, d):
    return reports.audit_summary(t.stored(spark, d), AS_OF)


@query
def audit_summary_hours(spark, d):
    return audit_report.audit_report(t.tampered(spark, d), t.keys(spark), AS_OF, hours=240)


@query
def events_by_type(spark, d):
    return reports.events_by_type(t.audit_seed(spark, d))


@query
def token_usage(spark, d):
    return reports.token_usage(t.audit_seed(spark, d))


@query
def recent_events_100(spark, d):
    return reports.recent_events(t.stored_newest(spark, d))


@query
def latest_jury_event(spark, d):
    built = flows.sanitize_audit(flows.sanitize(t.requests(spark, d)))
    return reports.latest_event(built, fv.JURY_REDACTED).select("ts", "request_id", "winning_tool", "message")


@query
def sample_jury_events(spark, d):
    built = flows.sanitize_audit(flows.sanitize(t.requests(spark, d)))
    return reports.sample_events(built, fv.JURY_REDACTED).select("ts", "request_id", "winning_tool", "tool_b_counts")


@query
def audit_log_view(spark, d):
    return reports.audit_log_view(t.stored_newest(spark, d))


@query
def reliability_view(spark, d):
    return reports.reliability_view(t.stored_newest(spark, d))


def _scores(spark, d):
    return jury.scores_only(t.prompts(spark, d))


@query
def tool_win_rate(spark, d):
    return reports.tool_win_rate(_scores(spark, d))


@query
def tool_avg_detections(spark, d):
    return reports.tool_avg_detections(_scores(spark, d))


@query
def tool_agreement(spark, d):
    return reports.tool_agreement(_scores(spark, d))


@query
def tool_by_role(spark, d):
    return reports.tool_by_role(_scores(spark, d))


@query
def tool_trend_daily(spark, d):
    return reports.tool_trend_daily(_scores(spark, d))


@query
def tool_by_input_type(spark, d):
    judged = jury.scores_only(t.table(spark, d, "documents").select("lang", "source", "text"), "text")
    return reports.tool_by_input_type(judged, "lang", "source")


# --- streams ---------------------------------------------------------------------


def _prompt_stream(spark, d):
    return t.derived(spark, seeds.PROMPTS, events=t.event_stream(spark, d))


def _audit_stream(spark, d):
    return t.derived(spark, seeds.AUDIT_SEED, events=t.event_stream(spark, d))


@query
def stream_sanitize(spark, d):
    done = flows.sanitize(_prompt_stream(spark, d))
    rows = done.select("prompt_id", "code", "sanitized", "winning_tool", *JURY_SCORES)
    return jobs.run_once(spark, rows, "stream-sanitize")


@query
def stream_gate(spark, d):
    lines = t.derived(spark, seeds.GATE_LINES, prompts=_prompt_stream(spark, d))
    decided = gate.generate_gate(lines).select("line_id", "reason", "code", "audit")
    return jobs.run_once(spark, decided, "stream-gate")


@query
def stream_audit_dedup(spark, d):
    rows = jobs.deduplicated(t.with_copies(_audit_stream(spark, d)))
    return jobs.run_once(spark, rows.select("request_id", "event_type", "ts", "user_role", "message"), "stream-dedup")


@query
def stream_blocked_24h(spark, d):
    return jobs.rolled(jobs.counted_once(spark, jobs.counts_per_step(_audit_stream(spark, d)), "stream-blocked"))


@query
def stream_intents_hourly(spark, d):
    return jobs.counted_once(spark, jobs.intents_per_window(_audit_stream(spark, d)), "stream-intents")


@query
def stream_gate_split(spark, d):
    """The gate's three outputs as stored by the stream: what passed, what was rejected, audit rows."""
    lines = t.derived(spark, seeds.GATE_LINES, prompts=_prompt_stream(spark, d))
    folder = fresh_path(spark, "gate-split")
    stores.gate_outputs(lines, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    parts = [
        stores.read_gate_output(lines, f"{folder}/out", name).select(F.lit(name).alias("output"), "request_id", *columns)
        for name, columns in (
            (stores.FORWARDED, ["provider", "reason", "code"]),
            (stores.REJECTED, ["provider", "reason", "code"]),
            (stores.AUDIT, [F.col("user_role").alias("provider"), F.col("event_type").alias("reason"), F.lit(400).alias("code")]),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def stream_audit_dedup_keys(spark, d):
    """As stream_audit_dedup, with the keys in files instead of a state store."""
    rows = t.with_copies(_audit_stream(spark, d))
    folder = fresh_path(spark, "dedup-keys")
    stores.deduplicated_outputs(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stores.read_deduplicated(rows, f"{folder}/out").select("request_id", "event_type", "ts", "user_role", "message")


def _windows(spark, stream, counts, keys, label):
    folder = fresh_path(spark, label)
    query, store = stores.window_outputs(stream, counts, keys, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return store.read()


@query
def stream_blocked_24h_store(spark, d):
    """As stream_blocked_24h, from a store of date versions."""
    return jobs.rolled(_windows(spark, _audit_stream(spark, d), jobs.counts_per_step, ["step_start"], "blocked-store"))


@query
def stream_intents_hourly_store(spark, d):
    keys = ["window_start", "window_end", "intent"]
    return _windows(spark, _audit_stream(spark, d), jobs.intents_per_window, keys, "intents-store")


def queries():
    return dict(_QUERIES)
