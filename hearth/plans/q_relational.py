"""Relational queries on the driver's tables.

Stand-ins: customer = case, nation/region = partner/platform, lineitem =
credits (credit type = l_linenumber), orders = dated budgets, events =
actions. Reductions run over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import relational as R
from hearth.plans.registry import query
from hearth.plans.tables import day, dbl, lng, money, table

TYPES = list(range(6))
MEASURES = ["sum_price", "avg_qty", "sum_net"]
PLATFORM_REGIONS = ["EUROPE", "ASIA", "AFRICA"]


# --- shared building blocks ----------------------------------------------------

def lineitem_by_type(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return R.credits_by_type(
        li, key="l_orderkey", type_col="l_linenumber",
        measures={
            "sum_price": F.sum(money("l_extendedprice")),
            "avg_qty": F.avg("l_quantity"),
            "sum_net": F.sum(money("l_extendedprice") * (F.lit(1) - money("l_discount"))),
        })


def lineitem_pivot(spark: SparkSession, d: str) -> DataFrame:
    return R.pivot_measures(lineitem_by_type(spark, d), key="l_orderkey",
                            type_col="l_linenumber", measures=MEASURES, types=TYPES,
                            count_col="n_types")


def latest_open_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                         "o_totalprice", "o_orderdate")
    o = R.exclude_like(o, "o_orderstatus", "P")
    return R.latest_per_key(o, key="o_custkey", date_col="o_orderdate", id_col="o_orderkey")


def first_event(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return R.first_per_key(ev, key="user_id", order_col="event_id")


def platform_customers(spark: SparkSession, d: str) -> DataFrame:
    region = R.keep_values(table(spark, d, "region"), "r_name", PLATFORM_REGIONS)
    nation = table(spark, d, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "inner")
    cust = table(spark, d, "customer")
    return R.inner_dimension(cust, nation, left_key="c_nationkey", right_key="n_nationkey",
                             dim_cols=[F.col("r_name").alias("platform")])


def _pivot_cols():
    return [f"{m}_{t}" for m in MEASURES for t in TYPES]


def _pivot_out(prefix: str = ""):
    out = [lng(f"{prefix}n_types").alias("n_types")]
    for c in _pivot_cols():
        out.append(dbl(c, 6).alias(c))
    return out


# --- SQL fragments for the oracle ------------------------------------------------

SQL_BYTYPE = """
  SELECT l_orderkey, l_linenumber,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_price,
         AVG(l_quantity) AS avg_qty,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS sum_net
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""

SQL_PIVOT = ("SELECT l_orderkey, COUNT(l_orderkey) AS n_types, "
             + ", ".join(f"SUM(CASE WHEN l_linenumber = {t} THEN {m} END) AS {m}_{t}"
                         for m in MEASURES for t in TYPES)
             + " FROM bt GROUP BY l_orderkey")

SQL_PIVOT_OUT = ", ".join(
    ["CAST(n_types AS BIGINT) AS n_types"]
    + [f"ROUND(CAST({c} AS DOUBLE), 6) AS {c}" for c in _pivot_cols()])

SQL_LATEST = """
  b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate
        FROM orders WHERE o_orderstatus NOT LIKE 'P'),
  bdm AS (SELECT * FROM b WHERE o_orderdate =
            (SELECT MAX(o_orderdate) FROM b b2 WHERE b2.o_custkey = b.o_custkey)),
  bu AS (SELECT * FROM bdm WHERE o_orderkey IN
            (SELECT MAX(b3.o_orderkey) FROM bdm b3 GROUP BY b3.o_custkey))"""

SQL_FIRST_EVENT = """
  fe AS (SELECT event_id, user_id, event_type, value FROM events
         WHERE event_id IN (SELECT MIN(e2.event_id) FROM events e2 GROUP BY e2.user_id))"""


# --- queries ---------------------------------------------------------------------

@query("extract_star", sql=f"""
WITH bt AS ({SQL_BYTYPE}),
  pv AS ({SQL_PIVOT}),
  {SQL_LATEST},
  {SQL_FIRST_EVENT},
  p AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA'))
SELECT CAST(c.c_custkey AS BIGINT) AS c_custkey, c.c_name, CAST(c.c_acctbal AS DOUBLE) AS c_acctbal,
       c.c_mktsegment, p.r_name AS platform,
       CAST(bu.o_orderkey AS BIGINT) AS o_orderkey, strftime(bu.o_orderdate, '%Y-%m-%d') AS o_orderdate,
       CAST(bu.o_totalprice AS DOUBLE) AS o_totalprice, bu.o_orderstatus,
       {SQL_PIVOT_OUT},
       CAST(fe.event_id AS BIGINT) AS event_id, fe.event_type
FROM customer c
JOIN p ON c.c_nationkey = p.n_nationkey
LEFT JOIN bu ON c.c_custkey = bu.o_custkey
LEFT JOIN pv ON bu.o_orderkey = pv.l_orderkey
LEFT JOIN fe ON c.c_custkey = fe.user_id
""")
def extract_star(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: one wide row per case of the kept platforms, with its latest
    budget, that budget's credit pivot and its first action."""
    cases = platform_customers(spark, d).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "platform")
    latest = latest_open_order(spark, d)
    pivot = lineitem_pivot(spark, d)
    first = first_event(spark, d).select("user_id", "event_id", "event_type")
    x = R.left_attach(cases, "c_custkey", latest, "o_custkey")
    x = R.left_attach(x, "o_orderkey", pivot, "l_orderkey")
    x = R.left_attach(x, "c_custkey", first, "user_id")
    return x.select(
        lng("c_custkey").alias("c_custkey"), "c_name", dbl("c_acctbal").alias("c_acctbal"),
        "c_mktsegment", "platform", lng("o_orderkey").alias("o_orderkey"),
        day("o_orderdate").alias("o_orderdate"), dbl("o_totalprice").alias("o_totalprice"),
        "o_orderstatus", *_pivot_out(), lng("event_id").alias("event_id"), "event_type")


@query("age_join", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
       CAST(annee_naissance AS BIGINT) AS annee_naissance,
       CAST(year(o_orderdate) - annee_naissance AS BIGINT) AS age
FROM orders, (SELECT c_custkey, 1950 + c_nationkey AS annee_naissance FROM customer) n
WHERE orders.o_custkey = n.c_custkey
""")
def age_join(spark: SparkSession, d: str) -> DataFrame:
    births = table(spark, d, "customer").select(
        "c_custkey", (F.lit(1950) + F.col("c_nationkey")).alias("annee_naissance"))
    x = R.attach_age(table(spark, d, "orders"), births, case_id="o_custkey",
                     birth_id="c_custkey", open_date="o_orderdate")
    return x.select(lng("o_orderkey").alias("o_orderkey"), lng("o_custkey").alias("o_custkey"),
                    "o_orderstatus", dbl("o_totalprice").alias("o_totalprice"),
                    day("o_orderdate").alias("o_orderdate"), "o_orderpriority",
                    lng("annee_naissance").alias("annee_naissance"), lng("age").alias("age"))


@query("credits_bytype", sql=f"""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(sum_price AS DOUBLE) AS sum_price, ROUND(avg_qty, 6) AS avg_qty,
       CAST(sum_net AS DOUBLE) AS sum_net
FROM ({SQL_BYTYPE}) t
""")
def credits_bytype(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_by_type(spark, d).select(
        lng("l_orderkey").alias("l_orderkey"), lng("l_linenumber").alias("l_linenumber"),
        dbl("sum_price").alias("sum_price"), dbl("avg_qty", 6).alias("avg_qty"),
        dbl("sum_net").alias("sum_net"))


@query("credits_pivot", sql=f"""
WITH bt AS ({SQL_BYTYPE}), pv AS ({SQL_PIVOT})
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, {SQL_PIVOT_OUT} FROM pv
""")
def credits_pivot(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_pivot(spark, d).select(lng("l_orderkey").alias("l_orderkey"), *_pivot_out())


@query("action_first", sql=f"""
WITH {SQL_FIRST_EVENT}
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, event_type,
       CAST(value AS DOUBLE) AS value FROM fe
""")
def action_first(spark: SparkSession, d: str) -> DataFrame:
    return first_event(spark, d).select(lng("user_id").alias("user_id"),
                                        lng("event_id").alias("event_id"), "event_type",
                                        dbl("value").alias("value"))


@query("action_first_literal", sql=f"""
WITH {SQL_FIRST_EVENT}
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, event_type FROM fe
""")
def action_first_literal(spark: SparkSession, d: str) -> DataFrame:
    """The source's uncorrelated IN-subquery form (a left-semi join)."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type")
    x = R.min_ids_in(ev, key="user_id", id_col="event_id")
    return x.select(lng("user_id").alias("user_id"), lng("event_id").alias("event_id"),
                    "event_type")


@query("budget_latest", sql=f"""
WITH {SQL_LATEST}
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey,
       o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM bu
""")
def budget_latest(spark: SparkSession, d: str) -> DataFrame:
    x = latest_open_order(spark, d)
    return x.select(lng("o_custkey").alias("o_custkey"), lng("o_orderkey").alias("o_orderkey"),
                    "o_orderstatus", dbl("o_totalprice").alias("o_totalprice"),
                    day("o_orderdate").alias("o_orderdate"))


@query("budget_latest_literal", sql=f"""
WITH {SQL_LATEST}
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM bu
""")
def budget_latest_literal(spark: SparkSession, d: str) -> DataFrame:
    """Two-step form: latest-date rows with ties, then max id IN-subquery."""
    o = R.exclude_like(table(spark, d, "orders"), "o_orderstatus", "P")
    x = R.latest_per_key_literal(o, key="o_custkey", date_col="o_orderdate", id_col="o_orderkey")
    return x.select(lng("o_custkey").alias("o_custkey"), lng("o_orderkey").alias("o_orderkey"))


@query("budget_latest_ties", sql="""
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderkey AS BIGINT) AS o_orderkey,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
FROM orders b WHERE o_orderdate = (SELECT MAX(o_orderdate) FROM orders b2 WHERE b2.o_custkey = b.o_custkey)
""")
def budget_latest_ties(spark: SparkSession, d: str) -> DataFrame:
    x = R.latest_rows(table(spark, d, "orders"), key="o_custkey", date_col="o_orderdate")
    return x.select(lng("o_custkey").alias("o_custkey"), lng("o_orderkey").alias("o_orderkey"),
                    day("o_orderdate").alias("o_orderdate"))


@query("row_audit", sql=f"""
WITH bt AS ({SQL_BYTYPE})
SELECT 'orders' AS stage, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS n_keys FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), COUNT(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'credits_bytype', COUNT(*), COUNT(DISTINCT l_orderkey) FROM bt
UNION ALL SELECT 'events', COUNT(*), COUNT(DISTINCT user_id) FROM events
UNION ALL SELECT 'customer', COUNT(*), COUNT(DISTINCT c_custkey) FROM customer
""")
def row_audit(spark: SparkSession, d: str) -> DataFrame:
    return R.row_audit({
        "orders": (table(spark, d, "orders"), "o_custkey"),
        "lineitem": (table(spark, d, "lineitem"), "l_orderkey"),
        "credits_bytype": (lineitem_by_type(spark, d), "l_orderkey"),
        "events": (table(spark, d, "events"), "user_id"),
        "customer": (table(spark, d, "customer"), "c_custkey"),
    })


@query("platform_counts", sql="""
SELECT r_name AS platform, CAST(COUNT(*) AS BIGINT) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA') GROUP BY r_name
""")
def platform_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.value_counts(platform_customers(spark, d), "platform")


@query("distinct_keys", sql="""
SELECT o_orderstatus, o_orderpriority, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS n_customers
FROM orders GROUP BY o_orderstatus, o_orderpriority
""")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.countDistinct("o_custkey").cast("long").alias("n_customers"))


@query("distinct_values", sql="""
SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem
""")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_values(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("consistency_check", sql="""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) d FROM events),
     u AS (SELECT *, CASE WHEN d = 1 THEN row_number() OVER (PARTITION BY user_id, d ORDER BY event_id) END r FROM f)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, event_type,
       CAST(value AS DOUBLE) AS value, props
FROM u WHERE NOT coalesce(d = 1 AND r > 1, false)
""")
def consistency_check(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    x = R.consistency_check(ev, id_col="user_id", invariant_cols=["event_type"],
                            order_col="event_id")
    return x.select(lng("event_id").alias("event_id"), lng("user_id").alias("user_id"),
                    "event_type", dbl("value").alias("value"), "props")


@query("consistency_check_strict", sql="""
WITH firsts AS (SELECT user_id, event_type, MIN(event_id) f FROM events GROUP BY 1, 2),
     f0 AS (SELECT user_id, MIN(f) f0 FROM firsts GROUP BY 1),
     bad AS (SELECT firsts.user_id, event_type FROM firsts JOIN f0 USING (user_id) WHERE f > f0)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(e.user_id AS BIGINT) AS user_id, e.event_type
FROM events e ANTI JOIN bad ON e.user_id = bad.user_id AND e.event_type = bad.event_type
""")
def consistency_check_strict(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type")
    x = R.consistency_check(ev, id_col="user_id", invariant_cols=["event_type"],
                            order_col="event_id", strict=True)
    return x.select(lng("event_id").alias("event_id"), lng("user_id").alias("user_id"),
                    "event_type")


@query("merge_rare", sql="""
WITH c AS (SELECT user_id, COUNT(*) n FROM events GROUP BY user_id)
SELECT CAST(event_id AS BIGINT) AS event_id,
       CAST(CASE WHEN c.n < 60 THEN -1 ELSE e.user_id END AS BIGINT) AS user_id
FROM events e LEFT JOIN c ON e.user_id = c.user_id
""")
def merge_rare(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id")
    x = R.merge_rare(ev, "user_id", floor=60, merged_value=-1)
    return x.select(lng("event_id").alias("event_id"), lng("user_id").alias("user_id"))


@query("exclude_collated", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus FROM orders
WHERE NOT lower(strip_accents(o_orderstatus)) = 'p' AND NOT lower(strip_accents(o_orderpriority)) LIKE '1-urg%'
""")
def exclude_collated(spark: SparkSession, d: str) -> DataFrame:
    """NOT LIKE under a collation in which neither case nor accents count."""
    o = R.exclude_like(table(spark, d, "orders"), "o_orderstatus", "\u1e57", collation="UNICODE_CI_AI")
    o = R.exclude_like(o, "o_orderpriority", "1-\u00dcrg%", collation="UNICODE_CI_AI")
    return o.select(lng("o_orderkey").alias("o_orderkey"), "o_orderstatus")
