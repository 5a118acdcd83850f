"""Every registered query with a SQL oracle matches DuckDB at sf0.01
(row count, columns and exact values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from hearth.plans.tables import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else repr(x)
        return x
    return sorted(repr(tuple(v(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, capsys, name):
    """Same rows as the SQL, by a plan without cartesian or nested-loop joins."""
    df = E.queries()[name](spark, SF)
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _norm(srows, df.columns) == _norm(drows, dcols)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
