"""Registered queries against their SQL, and the list of queries itself."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from veilwork.llm import queries, sql
from verification import compare


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.oracle_connection(sf_dir)


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= names
    assert set(sql.oracle_sql()) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near duplicates", "source mix", "tokens",
    ]


@pytest.mark.parametrize("name", list(sql.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    assert compare.difference(queries.queries()[name](spark, sf_dir), connection.sql(sql.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", ["op4_secrets", "op5_pseudonyms", "op8_quality_rules"])
def test_native_operators_have_no_python_nodes(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "Exchange"))
