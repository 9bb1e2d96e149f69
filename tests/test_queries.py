"""Registered queries against their expected results, and the shape of plans.

A few queries run by default; ``TEST_ALL_QUERIES=1`` runs them all.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from semcat.operators import search
from tests.conftest import SF_DIR
from workloads import corpus as C
from workloads.oracles import ORACLES as EXPECTED
from workloads.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()
SOME = (
    "route_files", "number_columns", "attach_preceding_comment_compat", "extract_tenant_values",
    "decode_escapes", "latest_key", "catalog_values", "rank_bm25", "rank_bm25_any", "search_like",
    "decode_codes", "audit_log", "drift_check",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(EXPECTED)
    assert set(QUERIES) <= set(entry.queries()) and set(EXPECTED) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TEST_ALL_QUERIES") else SOME)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    result = duck.execute(EXPECTED[name])
    described = [c[0] for c in result.description]
    assert sorted(described) == names
    expected = sorted(
        tuple(str(row[described.index(n)]) for n in names) for row in result.fetchall()
    )
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == expected


@pytest.mark.parametrize("name", [
    "drift_check_whole", "drift_trend", "repo_diff_whole", "audit_checks", "table_detail_whole", "search_like_whole", "rank_bm25_column_text", "rank_bm25_column_lang",
])
def test_whole_inputs(spark, duck, name):
    test_query(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize(
    "name",
    ["catalog_columns", "catalog_values", "infer_relations", "bind_enums", "search_like",
     "enum_candidates", "decode_codes", "audit_log", "drift_check", "repo_diff"],
)
def test_plans_stay_in_the_jvm_and_join_by_equality(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert unwanted not in plan


def test_ranking_joins_by_equality(spark):
    # several repos: with one constant repo the planner drops the join condition itself
    docs = C.search_docs(C.load(spark, SF_DIR, "documents"), by_source=True)
    asked = C.load(spark, SF_DIR, "benchmark").selectExpr(
        "concat('src', item_id % 20) as repo_id", "item_id as query_id", "text"
    )
    ranked = search.rank_bm25(search.build_index(docs, ["text"]), asked)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan
