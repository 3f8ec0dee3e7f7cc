"""Every registered query: same rows as its SQL, or stated invariants."""

import pytest

from __spark_entry__ import entry
from check import duckdb_tables, kind, normalised
from registry.jobs import QUERIES
from registry.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"cluster_fit", "cluster_profile", "cluster_share", "cluster_snake", "rfm_score_saved_model"}


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(FOLDER)


def test_only_fitted_clusters_go_without_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("CartesianProduct", "NestedLoopJoin", "EvalPython") if bad in plan]
    want = con.execute(ORACLE[name]).df()
    types = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert {c: kind(t) for c, t in result.dtypes} == types
    assert normalised(result.toPandas()) == normalised(want)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_fitted_clusters(spark, name):
    result = QUERIES[name](spark, FOLDER).toPandas()
    segments = result["Cluster Segment"].unique()
    assert len(segments) == 4
    if "Count" in result:
        assert result["Count"].sum() == QUERIES["client_features"](spark, FOLDER).count()


def test_entry(spark):
    assert entry(spark).count() > 0
