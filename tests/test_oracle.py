"""Every registered query vs its DuckDB oracle (the driver's correctness gate)."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from paylake.plans import catalog  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


FORBIDDEN_PLAN_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                        "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in FORBIDDEN_PLAN_NODES if n in plan], plan
    srecs = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert srecs
        return
    cur = duck.execute(sql)
    ocols = [d[0] for d in cur.description]
    sc, sr = rows_of(df.columns, srecs)
    oc, orows = rows_of(ocols, cur.fetchall())
    assert sc == oc
    assert len(sr) == len(orows)
    assert sr == orows


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_revenue" in df.columns
