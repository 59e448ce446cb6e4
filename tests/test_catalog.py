"""Registered queries: names, SQL checks, and a side-by-side run at the smallest scale.

``PANELWRIGHT_ALL=1`` compares every query; the default run takes one per area.
"""

import importlib.util
import os

import duckdb
import pytest

from panelwright.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
WITHOUT_SQL = {
    "rolling_eval", "model_choice", "rate_effect", "final_test", "test_predictions", "auc_by_product",
    "result_summary", "production_scores", "permutation_importance", "coefficients",
}
SAMPLE = [
    "version_changeset", "resume_missing", "bronze_audit", "check_masks", "silver_build", "month_end_series",
    "gold_panel", "bh_adjust", "ml_features", "auc_weighted", "closing_numbers", "list_by_product",
]

spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
spark_entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(spark_entry)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_query_has_a_check():
    queries, oracle = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(catalog.QUERIES) - set(oracle) == WITHOUT_SQL


@needs_data
def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["month", "entity", "product"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def chosen():
    if os.environ.get("PANELWRIGHT_ALL"):
        return sorted(catalog.ORACLE)
    return SAMPLE


@needs_data
@pytest.mark.parametrize("name", chosen())
def test_query_equals_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF)
    result = duck.execute(spark_entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(str(dict(zip(columns, r))[c]) for c in order) for r in result.fetchall())
    assert got == want
