"""Every SQL-checkable registered query against its DuckDB oracle.

Runs at sf0.001 by default (fast); set RECOFLOW_TEST_SF=/root/testdata/sf0.01
for the driver's scale.
"""

import os

import pytest

import __spark_entry__ as entry
from recoflow.plans.catalog import QUERIES
from recoflow.plans.oracle import ORACLE_SQL
from oracle_compare import compare, duck

SF = os.environ.get("RECOFLOW_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(entry.oracle_sql())
    assert rows_only == {
        "als_recommend_subset",
        "als_recommend_all",
        "als_pruned_lists",
        "als_rmse",
        "als_grid_search",
        "kmeans_assign",
        "kmeans_silhouette_sweep",
        "kmeans_profile_sweep",
        "cluster_recommendations",
        "hybrid_recommend",
        "hybrid_comparison",
    }


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    ok, msg = compare(df, entry.oracle_sql()[name], con)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["user_id", "recommended_items"]
    assert len(rows) > 0
    assert all(len(r.recommended_items.split(",")) == 72 for r in rows)
