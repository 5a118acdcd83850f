"""Plan guard: the flagship's dimension filter reaches the parquet scan (joins
are guarded with the queries' results)."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_flagship_pushdown(spark, capsys):
    plan = _plan(E.queries()["extract_star"](spark, SF), capsys)
    assert "PushedFilters: [In(r_name, [AFRICA,ASIA,EUROPE])" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double," \
           "l_extendedprice:double,l_discount:double>" in plan
