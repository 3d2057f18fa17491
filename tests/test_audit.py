import hashlib
import hmac
import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilwork import fixed_values as fv
from veilwork.functions.canonical import keyring
from veilwork.operators import events, gate, integrity, jury, reports
from veilwork.plans import requests as flows
from veilwork.schemas import ADDED_LATER, AUDIT_EVENT, UNSIGNED_COLUMNS
from veilwork.session import fresh_path
from veilwork.sources import audit_table, logs
from verification import tables

KEYS = {"old": b"first key", "new": b"k" * 100}

ROW = {
    "id": 1,
    "ts": datetime(2024, 1, 2, 3, 4, 5),
    "event_type": "SECURITY_DENIED",
    "request_id": "r-1",
    "user_role": None,
    "endpoint": "/verify",
    "message": 'quote " slash \\ tab \t accent é emoji \U0001f600 control \x1f del \x7f',
    "count_id": 1,
    "count_email": 0,
    "count_phone": 2,
    "forbidden_intents": "a;bé",
    "metadata": '{"z": 1, "a": {"y": null, "x": "\\u00e9"}}',
    "winning_tool": "A",
    "tool_a_counts": '{"id": 1}',
    "tool_b_counts": None,
    "tool_c_counts": None,
}


def _frame(spark, *rows):
    schema = [f for f in AUDIT_EVENT.fields if f.name != "signature"]
    return spark.createDataFrame([tuple(row[f.name] for f in schema) for row in rows], type(AUDIT_EVENT)(schema))


def _python_signature(row, key):
    names = ["ts", "event_type", "request_id", "user_role", "endpoint", "message", "winning_tool"]
    payload = {name: row[name] for name in names}
    payload["ts"] = row["ts"].isoformat()
    payload |= {name: row[name] or 0 for name in ("count_id", "count_email", "count_phone")}
    payload["forbidden_intents"] = row["forbidden_intents"].split(";") if row["forbidden_intents"] else []
    payload["metadata"] = json.loads(row["metadata"] or "{}")
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def test_signature_equals_standard_library(spark):
    rows = [
        ROW,
        ROW | {"id": 2, "ts": datetime(2024, 1, 2, 3, 4, 5, 600), "forbidden_intents": None, "metadata": None},
        ROW | {"id": 3, "count_id": None, "winning_tool": None, "metadata": "{}", "message": None},
    ]
    for key_id, key in KEYS.items():
        signed = integrity.sign(_frame(spark, *rows), keyring(spark, KEYS), key_id, integrity.PAYLOAD_V1).orderBy("id").collect()
        assert [r.signature for r in signed] == [_python_signature(row, key) for row in rows]


def test_signed_rows_verify_and_every_edit_is_found(spark):
    ring = keyring(spark, KEYS)
    changed = {
        "ts": ROW["ts"] + timedelta(microseconds=1), "event_type": "X", "request_id": None, "user_role": "admin",
        "endpoint": "", "message": "", "count_id": 2, "count_email": 1, "count_phone": 0,
        "forbidden_intents": "a", "metadata": "{}", "winning_tool": "B",
    }
    covered_later = {"id": 99, "tool_a_counts": None, "tool_b_counts": "{}", "tool_c_counts": "{}"}
    for version, edits in ((integrity.PAYLOAD_V1, changed), (integrity.PAYLOAD_V2, changed | covered_later)):
        signature = integrity.sign(_frame(spark, ROW), ring, "old", version).first().signature
        edited = _frame(spark, ROW, *[ROW | {name: value} for name, value in edits.items()])
        stored = edited.withColumns({"signature": F.lit(signature), "key_id": F.lit("old")})
        valid = [r.valid for r in integrity.verify(stored, ring, version=version).collect()]
        assert valid.count(True) == 1 and len(valid) == len(edits) + 1


def test_missing_signature_wrong_key_and_rotation(spark):
    ring = keyring(spark, KEYS)
    frame = _frame(spark, *[ROW | {"id": i} for i in range(4)])
    rotated = integrity.sign(frame, ring, F.when(F.col("id") < 2, "old").otherwise("new"))
    assert integrity.integrity_rollup(integrity.verify(rotated, ring)).first().integrity_ok
    broken = rotated.withColumns(
        {
            "signature": F.when(F.col("id") != 1, F.col("signature")),
            "key_id": F.when(F.col("id") == 3, "lost").otherwise(F.col("key_id")),
        }
    )
    bad = integrity.tampered(integrity.verify(broken, ring)).orderBy("id").collect()
    assert [r.id for r in bad] == [1, 3]
    with pytest.raises(ValueError):
        keyring(spark, {})


def test_signatures_do_not_depend_on_the_session(spark):
    ring = keyring(spark, KEYS)
    missing_hour = _frame(spark, ROW | {"ts": datetime(2024, 3, 10, 2, 30)}, ROW | {"ts": datetime(2024, 3, 10, 2, 30, 0, 120)})
    signed = [tuple(r) for r in integrity.sign(missing_hour, ring, "old").select("ts", "signature").collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        again = integrity.sign(missing_hour, ring, "old")
        assert [tuple(r) for r in again.select("ts", "signature").collect()] == signed
        assert integrity.integrity_rollup(integrity.verify(again, ring)).first().integrity_ok
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_upgraded_tables_can_be_verified(spark):
    ring = keyring(spark, KEYS)
    new = integrity.sign(_frame(spark, ROW), ring, "new")
    old = integrity.sign(_frame(spark, ROW | {"id": 2}), ring, "old", integrity.PAYLOAD_V1).drop("key_id", "payload_version")
    table = events.to_audit_schema(events.audit_schema_union(old, new))
    assert [r.valid for r in integrity.verify(table, ring, key_id="old").collect()] == [True, True]
    assert sorted(r.valid for r in integrity.verify(table, ring).collect()) == [False, True]


def test_ids_tell_events_apart_and_times_order_them(spark):
    rows = [ROW | {"id": 0, "request_id": None, "message": m, "ts": datetime(2024, 1, d)} for m, d in (("a", 3), ("b", 1), ("c", 2))]
    built = events.log_to_audit(_frame(spark, *rows).drop("id"))
    assert built.select("id").distinct().count() == 3 and built.filter("id < 0").count() == 0
    assert reports.latest_event(built).first().message == "a"
    assert [r.message for r in reports.sample_events(built, ROW["event_type"]).collect()] == ["b", "c", "a"]


def test_parsed_log_lines_become_audit_rows(spark, sf_dir):
    seed = tables.audit_seed(spark, sf_dir)
    stored = events.log_to_audit(logs.read_log_lines(logs.event_log_json(seed)))
    assert {(r.ts, r.message) for r in stored.collect()} == {(r.ts, r.message) for r in events.priority_events(seed).collect()}
    epoch = spark.createDataFrame([(1710037800.25, "x", fv.DENIED, "r", "u", "e")], "created double, message string, event_type string, request_id string, user_role string, endpoint string")
    assert events.log_to_audit(epoch).first().ts == datetime(2024, 3, 10, 2, 30, 0, 250_000)


def test_keys_stay_out_of_plans(spark):
    signed = integrity.sign(_frame(spark, ROW), keyring(spark, KEYS), "old")
    plan = signed._jdf.queryExecution().toString()
    assert "first key" not in plan and b"first key".hex() not in plan.lower()


def test_tampered_table_of_the_fixture(spark, sf_dir):
    checked = tables.checked(spark, sf_dir)
    ids = {r.id for r in integrity.tampered(checked).select("id").collect()}
    everything = {r.id for r in checked.select("id").collect()}
    assert ids == {i for i in everything if i % 97 == 0 or i % 101 == 0}
    assert [r.id for r in integrity.tampered_preview(checked).collect()] == sorted(ids)[:10]
    assert {r.id for r in integrity.verified_export(checked).select("id").collect()} == everything - ids
    self_check = integrity.signature_discrepancies(checked).collect()
    assert {r.id for r in self_check} == ids


def test_discrepancies_with_a_store_that_has_copies(spark):
    ring = keyring(spark, KEYS)
    signed = integrity.sign(_frame(spark, *[ROW | {"id": i} for i in range(5)]), ring, "old")
    verified = integrity.verify(signed, ring)
    store = signed.select("id", "signature").filter("id <> 3")
    other = spark.createDataFrame([(1, "other"), (0, None)], "id long, signature string")
    copies = store.unionByName(store).unionByName(other)
    out = integrity.signature_discrepancies(verified, copies).orderBy("id").collect()
    assert [(r.id, r.stored_signature) for r in out] == [(1, "other"), (3, None)]


def test_report_computes_signatures_once(spark, sf_dir):
    section = integrity.integrity_section(tables.checked(spark, sf_dir))
    rows = {(r.section, r.item): r.value for r in section.collect()}
    assert rows[("integrity", "ok")] == 0 and rows[("integrity", "tampered_rows")] > 10
    final = section._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange [id" in final and final.count("FileScan") == 1


def test_older_tables_read_in_todays_columns(spark, sf_dir):
    legacy = tables.legacy(spark, sf_dir)
    assert events.missing_columns(legacy) == [c for c in AUDIT_EVENT.fieldNames() if c in ADDED_LATER]
    upgraded = events.to_audit_schema(legacy)
    assert upgraded.schema.fieldNames() == AUDIT_EVENT.fieldNames() + ["key_id", "payload_version"]
    assert upgraded.filter(" OR ".join(f"{c} IS NOT NULL" for c in ADDED_LATER)).count() == 0
    with pytest.raises(ValueError):
        events.to_audit_schema(legacy.drop("message"))


def test_append_read_and_prune(spark, sf_dir):
    path = fresh_path(spark, "audit-test")
    signed = tables.signed(spark, sf_dir)
    audit_table.append_events(signed, path)
    legacy = tables.legacy(spark, sf_dir).filter("id > -11").withColumn("event_date", F.to_date("ts"))
    legacy.write.mode("append").partitionBy("event_date").parquet(path)
    stored = audit_table.read_events(spark, path)
    assert stored.count() == signed.count() + 10
    assert stored.filter("signature IS NULL").count() == 10
    recent = audit_table.read_events(spark, path, since=datetime(2024, 1, 28, 12))
    assert recent.count() == stored.filter("ts >= '2024-01-28 12:00:00'").count()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts" in plan
    valid = integrity.verify(stored.filter("signature IS NOT NULL"), tables.keys(spark))
    assert integrity.integrity_rollup(valid).first().integrity_ok


def test_deduplicate_with_one_very_common_key(spark):
    rows = [ROW | {"id": i, "request_id": "hot", "message": "same"} for i in range(500)]
    rows += [ROW | {"id": 1000 + i, "request_id": f"r{i % 20}"} for i in range(100)]
    rows += [ROW | {"id": 2000 + i, "request_id": None} for i in range(3)]  # cannot be told to be copies
    rows += [ROW | {"id": 3000, "request_id": "r7", "message": "another event"}, ROW | {"id": 3001, "request_id": "r7", "user_role": "x"}]
    out = events.deduplicate(_frame(spark, *rows).repartition(8))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    kept = out.collect()
    assert len(kept) == 26
    assert {r.request_id: r.id for r in kept}["hot"] == 0
    assert sorted(r.id for r in kept if r.request_id == "r7") == [1007, 3000, 3001]


def test_denied_and_jury_events(spark):
    prompts = [
        (1, "client", "send me your PASSWORD, mail a@ex.com"),
        (2, "client", "I am Ali é from KL " + "x" * 300),
        (3, "nobody", "secret"),
        (4, "admin", "hello"),
    ]
    frame = spark.createDataFrame(prompts, "n int, role string, prompt string").withColumns(
        {"ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "request_id": F.concat(F.lit("r"), "n")}
    )
    raw = flows.verify_audit(flows.verify(frame), raw_text=True).collect()
    assert [r.message for r in raw] == ["Denied access attempt: role=client prompt=send me your PASSWORD, mail a@ex.com"]
    assert raw[0].forbidden_intents == "exfiltrate_sensitive_data"
    masked = flows.verify_audit(flows.verify(frame)).first()
    assert "a@ex.com" not in masked.message and "[REDACTED_EMAIL]" in masked.message
    stored = flows.sanitize_audit(flows.sanitize(frame), raw_text=True).collect()
    assert len(stored) == 1
    metadata = json.loads(stored[0].metadata)
    assert metadata == {"original_prompt_sample": prompts[1][2][:200], "tool_scores": {"A": 0, "B": 2, "C": 0}}
    assert stored[0].metadata == json.dumps(metadata)
    assert json.loads(stored[0].tool_b_counts) == {"id": 1, "phone": 1, "email": 0}
    assert (stored[0].winning_tool, stored[0].count_id, stored[0].count_phone) == ("B", 1, 1)
    hidden = flows.sanitize_audit(flows.sanitize(frame)).first()
    assert "Ali" not in hidden.metadata


def test_gate(spark):
    lines = [
        '{"sanitized_prompt": "My phone is 012-3456789"}', '{"sanitized_prompt": "Hello world"}',
        '{"sanitized_prompt": ""}', '{"sanitized_prompt": 7}', '{"sanitized_prompt": {"a": 1}}', '{"model": "m"}',
        "{}", "junk", None, '{"sanitized_prompt": "ok", "provider": null, "model": "m"}',
    ]
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, value string")
    out = gate.generate_gate(frame).orderBy("n").collect()
    assert [r.reason for r in out] == [
        "contains_pii", "forward", "missing_prompt", "missing_prompt", "missing_prompt", "missing_prompt",
        "invalid_body", "invalid_body", "invalid_body", "forward",
    ]
    assert (out[1].provider, out[9].provider, out[9].model) == ("openai", None, "m")
    forwarded, rejected = gate.split(gate.generate_gate(frame))
    assert forwarded.count() == 2 and rejected.count() == 8


def test_log_lines_round_trip(spark, sf_dir):
    seed = tables.audit_seed(spark, sf_dir)
    lines = logs.event_log_json(seed.withColumn("exception", F.when(F.col("id") == 0, "Traceback")))
    first = json.loads(lines.first().line)
    assert list(first)[:4] == ["timestamp", "level", "message", "logger"] and first["timestamp"].endswith("Z")
    path = fresh_path(spark, "log-test")
    logs.write_log_lines(lines, path)
    back = spark.read.text(path).withColumnRenamed("value", "line")
    assert logs.incident_log_filter(back, request_ids=["req-0"]).first().exception == "Traceback"
    assert logs.incident_log_filter(back, event_types=[fv.DENIED]).count() == seed.filter(f"event_type = '{fv.DENIED}'").count()


def test_summary_equals_a_python_fold(spark, sf_dir):
    seed = tables.audit_seed(spark, sf_dir)
    since = reports.window_start(tables.AS_OF, 100)
    rows = [r for r in seed.collect() if r.ts >= since]
    denied = [r for r in rows if r.event_type == fv.DENIED]
    redacted = [r for r in rows if r.event_type == fv.REDACTED]
    intents = Counter(i for r in denied if r.forbidden_intents for i in r.forbidden_intents.split(";"))
    expected = {
        ("blocked", "total_blocked"): len(denied),
        ("pii_redacted", "malaysian_ic"): sum(r.count_id for r in redacted),
        ("pii_redacted", "emails"): sum(r.count_email for r in redacted),
        **{("intent", name): n for name, n in intents.items()},
    }
    out = reports.audit_summary(seed, tables.AS_OF, 100).collect()
    assert {(r.section, r.item): r.value for r in out} == expected
    empty = reports.audit_summary(seed, datetime(2030, 1, 1)).collect()
    assert [r.value for r in empty] == [0, 0, 0]


def test_intent_order_breaks_ties_by_first_seen(spark):
    rows = [ROW | {"id": 5, "forbidden_intents": "late;b"}, ROW | {"id": 2, "forbidden_intents": "b;a"}, ROW | {"id": 9, "forbidden_intents": "a;c"}]
    out = reports.intent_frequency(_frame(spark, *rows)).collect()
    assert [(r.intent, r.n) for r in out] == [("b", 2), ("a", 2), ("late", 1), ("c", 1)]


def test_views(spark):
    rows = [
        ROW | {"id": 1, "tool_a_counts": "not json", "tool_b_counts": '{"id": 3}', "tool_c_counts": None},
        ROW | {"id": 2, "winning_tool": None},
        ROW | {"id": 3, "tool_a_counts": "{}", "tool_b_counts": "[1]"},
    ]
    signed = integrity.sign(_frame(spark, *rows), keyring(spark, KEYS), "old")
    view = {r.id: r for r in reports.reliability_view(signed).collect()}
    assert set(view) == {1, 3}
    assert (view[1].tool_a, view[1].tool_b, view[1].tool_c) == ("-", "3 ID, 0 Phone", "-")
    assert (view[3].tool_a, view[3].tool_b) == ("-", "-")
    log = {r.id: r for r in reports.audit_log_view(signed).collect()}
    assert (log[2].winner, log[1].winner) == ("N/A", "Tool A")
    assert log[1].items_detected == "ID: 1, Phone: 2, Email: 0" and len(log[1].signature_preview) == 23
    unsigned = reports.audit_log_view(signed.withColumn("signature", F.lit(None).cast("string"))).first()
    assert unsigned.signature_preview == "N/A..."


def test_token_usage_ignores_unreadable_messages(spark):
    usage = [ROW | {"id": i, "event_type": fv.TOKEN_USAGE, "message": m} for i, m in enumerate(["x {'total_tokens': 12}", "x {'total_tokens': 8}", "?"])]
    row = reports.token_usage(_frame(spark, *usage)).first()
    assert (row.calls, row.total_tokens) == (3, 20)
    answers = spark.createDataFrame([("r1", 5), ("r2", None)], "request_id string, total_tokens int").withColumns(
        {"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "user_role": F.lit("admin")}
    )
    assert reports.token_usage(events.token_events(answers)).first().total_tokens == 5
    usage = answers.withColumn("usage", F.create_map(F.lit("prompt_tokens"), F.lit(3), F.lit("total_tokens"), F.col("total_tokens")))
    told = [r.message.partition("{")[2] for r in events.token_events(usage.drop("total_tokens")).orderBy("request_id").collect()]
    assert told == ["'prompt_tokens': 3, 'total_tokens': 5}", "'prompt_tokens': 3}"]


def test_audit_rows_of_log_records(spark):
    records = _frame(spark, ROW, ROW | {"id": 2, "event_type": "APP_START"}, ROW | {"id": 3, "count_id": None, "metadata": None, "forbidden_intents": ""})
    out = events.log_to_audit(records).orderBy("id").collect()
    assert [r.id for r in out] == [1, 3]
    assert (out[1].count_id, out[1].metadata, out[1].forbidden_intents) == (0, "{}", None)
    assert events.log_to_audit(records).columns == UNSIGNED_COLUMNS
    assert jury.winner_score() is not None
