"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR   input tables, default /root/testdata/sf0.1
BENCH_CPUS     local threads, default 8
BENCH_REPEATS  runs per job after one warm-up run, default 3; the median counts

A table that is one file with one row group is one split, and one core would read it.  The
tables are therefore written once as ``INPUT_FILES`` files, before anything is timed; the
stream reads the file as it is.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilwork.operators import integrity, jury, policy, reports  # noqa: E402
from veilwork.plans import audit_report, corpus  # noqa: E402
from veilwork.plans import requests as flows  # noqa: E402
from veilwork.session import build_session, fresh_path  # noqa: E402
from veilwork.streaming import jobs  # noqa: E402
from verification import catalogue, seeds, tables  # noqa: E402


INPUT_FILES = 32


def in_many_files(spark, sf_dir):
    """A folder with the tables the jobs read, each as ``INPUT_FILES`` files."""
    folder = fresh_path(spark, "bench-input")
    for name in ("events", "documents", "conversations", "pages"):
        tables.table(spark, sf_dir, name).repartition(INPUT_FILES).write.parquet(f"{folder}/{name}.parquet")
    return folder


def headline(spark, sf_dir, source_dir):
    """name -> job; a job returns the DataFrame to run.  ``source_dir`` has the tables as they are."""

    def scan(name):
        return tables.table(spark, sf_dir, name)

    def prompts():
        return tables.derived(spark, seeds.PROMPTS, events=scan("events"))

    def audit_rows():
        return tables.derived(spark, seeds.AUDIT_SEED, events=scan("events"))

    def signed():
        return tables.sign_rotated(spark, audit_rows())

    def texts():
        return corpus.texts(scan("documents"), scan("conversations"), scan("pages"))

    return {
        "jury_prompts": lambda: jury.redaction_jury(prompts()),
        "sanitize_prompts": lambda: flows.sanitize(prompts()),
        "authorized_prompts": lambda: catalogue.authorized_prompts(spark, sf_dir),
        "corpus_jury": lambda: corpus.corpus_jury(texts()),
        "corpus_findings": lambda: corpus.corpus_findings(texts(), ["collection", "row_key"]),
        "corpus_profile": lambda: reports.tool_by_input_type(jury.scores_only(scan("documents"), "text"), "lang", "source"),
        "sign": signed,
        "sign_and_verify": lambda: integrity.integrity_rollup(integrity.verify(tables.tamper(signed()), tables.keys(spark))),
        "audit_summary_24h": lambda: reports.audit_summary(audit_rows(), tables.AS_OF),
        "audit_report": lambda: audit_report.audit_report(tables.tamper(signed()), tables.keys(spark), tables.AS_OF),
        "audit_dedup": lambda: catalogue.audit_dedup(spark, sf_dir),
        "tool_win_rate": lambda: reports.tool_win_rate(jury.scores_only(prompts())),
        "authorized_compiled": lambda: policy.authorized(prompts()),
        "stream_sanitize": lambda: jobs.run_once(
            spark, flows.sanitize(tables.derived(spark, seeds.PROMPTS, events=tables.event_stream(spark, source_dir))), "bench"
        ),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "256k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables.use_local_folder(spark)
    timings = {}
    for name, job in headline(spark, in_many_files(spark, sf_dir), sf_dir).items():
        runs = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(runs[1:] or runs), 3)
    rows = tables.table(spark, sf_dir, "events").count()
    print(
        json.dumps(
            {
                "metric": "headline_jobs_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "input_files": INPUT_FILES,
                "prompts_per_second": round(rows / timings["jury_prompts"]),
                "signed_rows_per_second": round(rows / timings["sign"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
