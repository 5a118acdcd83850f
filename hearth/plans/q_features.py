"""Feature queries. Stand-in case view (orders joined to their customer):
id = o_orderkey, new orientation code from o_orderstatus, old orientation
label = o_orderpriority, situation = c_mktsegment, dependants =
c_nationkey - 8, age from the birth-year join, income = c_acctbal,
charges = o_totalprice / 100, instalments = o_totalprice / 5,
balance = c_acctbal - 1000."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions import features as X
from hearth.operators import features as FE
from hearth.plans.q_relational import SQL_BYTYPE, SQL_PIVOT, TYPES, lineitem_pivot
from hearth.plans.registry import query
from hearth.plans.tables import dbl, lng, table

STATUS_CODES = {"F": 1, "O": 2, "P": 4}
PRIORITY_CODES = {"1-URGENT": 4, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
COUPLES = ["HOUSEHOLD", "FURNITURE"]
NAMES = {2: "Accompagnement", 3: "Mediation", 4: "Surendettement"}


def cases(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "inner")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("orientation_old"),
        X.map_values("o_orderstatus", STATUS_CODES, 0).alias("orientation"),
        F.col("c_mktsegment").alias("situation"),
        (F.col("c_nationkey") - 8).alias("personne_charges"),
        (F.year("o_orderdate") - 1950 - F.col("c_nationkey")).alias("age"),
        F.col("c_acctbal").alias("revenus_tot"),
        (F.col("o_totalprice") / 100).alias("charges"),
        (F.col("o_totalprice") / 5).alias("sum_mensualite"),
        (F.col("c_acctbal") - 1000).alias("sum_solde"),
    )


SQL_CASES = """
cases AS (
  SELECT o_orderkey AS id, o_orderpriority AS orientation_old,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 4 ELSE 0 END AS orientation,
         c_mktsegment AS situation, c_nationkey - 8 AS personne_charges,
         year(o_orderdate) - 1950 - c_nationkey AS age,
         c_acctbal AS revenus_tot, o_totalprice / 100 AS charges, o_totalprice / 5 AS sum_mensualite,
         c_acctbal - 1000 AS sum_solde
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SQL_OLD_CODE = ("CASE orientation_old WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 2 "
                "WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 ELSE 0 END")
SQL_BACKFILL = (f"CASE WHEN ({SQL_OLD_CODE}) > 1 AND orientation <= 1 THEN ({SQL_OLD_CODE}) "
                "ELSE orientation END")


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d)
    old = X.map_values("orientation_old", PRIORITY_CODES, 0)
    return x.withColumns({"orientation_old": old,
                          "orientation": X.backfill_label("orientation", old)})


@query("clean_projection", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id, CAST(age AS BIGINT) AS age, situation,
       CAST(orientation AS BIGINT) AS orientation,
       CAST(personne_charges AS BIGINT) AS personne_charges,
       CAST(sum_mensualite AS DOUBLE) AS sum_mensualite, CAST(sum_solde AS DOUBLE) AS sum_solde,
       CAST(revenus_tot AS DOUBLE) AS revenus_tot, CAST(charges AS DOUBLE) AS charges
FROM cases
""")
def clean_projection(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d)
    g = FE.column_groups(x, {"other": ["id", "age", "situation", "orientation",
                                       "personne_charges"],
                             "credit_totals": ["sum_mensualite", "sum_solde"],
                             "budget": ["revenus_tot", "charges"]})
    x = FE.exclude_columns(x, ["orientation_old"])
    x = FE.project(x, g["other"] + g["credit_totals"] + g["budget"])
    return x.select(*[lng(c).alias(c) if c in ("id", "age", "orientation", "personne_charges")
                      else (F.col(c) if c == "situation" else dbl(c).alias(c))
                      for c in x.columns])


_DETAIL = [f"{m}_{t}" for m in ("sum_price", "sum_net") for t in TYPES]


@query("fill_zero", sql="""
WITH bt AS ({bt}), pv AS ({pv}),
 z AS (SELECT l_orderkey, {fills} FROM pv)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, {outs},
       ROUND(CAST({tot_p} AS DOUBLE), 6) AS sum_price_tot,
       ROUND(CAST({tot_n} AS DOUBLE), 6) AS sum_net_tot
FROM z
""".format(
    bt=SQL_BYTYPE, pv=SQL_PIVOT,
    fills=", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _DETAIL),
    outs=", ".join(f"ROUND({c}, 6) AS {c}" for c in _DETAIL),
    tot_p=" + ".join(f"{c}" for c in _DETAIL if c.startswith("sum_price")),
    tot_n=" + ".join(f"{c}" for c in _DETAIL if c.startswith("sum_net"))))
def fill_zero(spark: SparkSession, d: str) -> DataFrame:
    pv = lineitem_pivot(spark, d).select(
        "l_orderkey", *[F.col(c).cast("double").alias(c) for c in _DETAIL])
    z = FE.fill_zero(pv, _DETAIL)
    z = FE.add_row_sum(z, "sum_price_tot", [c for c in _DETAIL if c.startswith("sum_price")])
    z = FE.add_row_sum(z, "sum_net_tot", [c for c in _DETAIL if c.startswith("sum_net")])
    return z.select(lng("l_orderkey").alias("l_orderkey"),
                    *[dbl(c, 6).alias(c) for c in _DETAIL + ["sum_price_tot", "sum_net_tot"]])


@query("row_sums", sql="""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       ROUND(CASE WHEN nullif(l_discount, 0) IS NULL AND nullif(l_tax, 0) IS NULL THEN NULL
             ELSE coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0) END, 6) AS total
FROM lineitem
""")
def row_sums(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    tot = X.row_sum([F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))])
    return li.select(lng("l_orderkey").alias("l_orderkey"),
                     lng("l_linenumber").alias("l_linenumber"), dbl(tot, 6).alias("total"))


@query("recode", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id, CAST({SQL_OLD_CODE} AS BIGINT) AS orientation_old FROM cases
""")
def recode(spark: SparkSession, d: str) -> DataFrame:
    x = backfilled(spark, d)
    return x.select(lng("id").alias("id"), lng("orientation_old").alias("orientation_old"))


@query("backfill", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id, CAST({SQL_BACKFILL} AS BIGINT) AS orientation FROM cases
""")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    x = backfilled(spark, d)
    return x.select(lng("id").alias("id"), lng("orientation").alias("orientation"))


@query("collapse", sql=f"""
WITH {SQL_CASES}, b AS (SELECT id, {SQL_BACKFILL} AS o FROM cases),
 c AS (SELECT id, o, CASE WHEN o = 3 THEN 2 ELSE o END AS oc FROM b)
SELECT CAST(id AS BIGINT) AS id, CAST(oc AS BIGINT) AS orientation,
       CAST(trunc((oc - 2) / 2.0) AS BIGINT) AS y,
       CASE o WHEN 2 THEN 'Accompagnement' WHEN 3 THEN 'Mediation' WHEN 4 THEN 'Surendettement' END AS name
FROM c
""")
def collapse(spark: SparkSession, d: str) -> DataFrame:
    x = backfilled(spark, d)
    return x.select(lng("id").alias("id"),
                    lng(X.collapse_label("orientation")).alias("orientation"),
                    lng(X.binary_label(X.collapse_label("orientation"))).alias("y"),
                    X.label_name("orientation", NAMES).alias("name"))


@query("range_filter", sql=f"""
WITH {SQL_CASES}, b AS (SELECT *, {SQL_BACKFILL} AS o FROM cases)
SELECT CAST(id AS BIGINT) AS id FROM b
WHERE o > 1 AND o < 5 AND charges > 0 AND revenus_tot IS NOT NULL
  AND sum_mensualite > 0 AND sum_mensualite <= 80000
""")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    x = FE.filter_cases(backfilled(spark, d))
    return x.select(lng("id").alias("id"))


@query("floor_filter", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id FROM cases WHERE charges > 400 AND revenus_tot > 400
""")
def floor_filter(spark: SparkSession, d: str) -> DataFrame:
    return FE.floor_filter(cases(spark, d)).select(lng("id").alias("id"))


@query("null_outliers", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id,
       CAST(CASE WHEN sum_mensualite > 0 AND sum_mensualite <= 80000 THEN sum_mensualite END AS DOUBLE) AS sum_mensualite,
       CAST(CASE WHEN age >= 18 AND age <= 90 THEN age END AS BIGINT) AS age,
       CAST(CASE WHEN personne_charges >= 0 AND personne_charges <= 10 THEN personne_charges END AS BIGINT) AS personne_charges
FROM cases
""")
def null_outliers(spark: SparkSession, d: str) -> DataFrame:
    x = FE.null_outliers(cases(spark, d))
    return x.select(lng("id").alias("id"), dbl("sum_mensualite").alias("sum_mensualite"),
                    lng("age").alias("age"), lng("personne_charges").alias("personne_charges"))


@query("null_implausible", sql="""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       l_returnflag,
       CAST(CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN NULL ELSE l_discount END AS DOUBLE) AS l_discount,
       CAST(CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN NULL ELSE l_tax END AS DOUBLE) AS l_tax
FROM lineitem
""")
def null_implausible(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x = FE.null_implausible(li, housing="l_returnflag", tenant="R", cols=["l_discount", "l_tax"])
    return x.select(lng("l_orderkey").alias("l_orderkey"),
                    lng("l_linenumber").alias("l_linenumber"), "l_returnflag",
                    dbl("l_discount").alias("l_discount"), dbl("l_tax").alias("l_tax"))


SQL_UNITS = ("(CASE WHEN situation IN ('HOUSEHOLD', 'FURNITURE') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"
             " + 0.3::DOUBLE * (CASE WHEN personne_charges >= 0 AND personne_charges <= 10"
             " THEN personne_charges END))")


@query("units", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id, CAST({SQL_UNITS} AS DOUBLE) AS u_c FROM cases
""")
def units(spark: SparkSession, d: str) -> DataFrame:
    x = FE.null_outliers(cases(spark, d))
    return x.select(lng("id").alias("id"),
                    dbl(X.consumption_units("situation", "personne_charges", couples=COUPLES)
                        ).alias("u_c"))


@query("disposable", sql=f"""
WITH {SQL_CASES}
SELECT CAST(id AS BIGINT) AS id,
       (revenus_tot - charges - sum_mensualite) / {SQL_UNITS} AS rav
FROM cases
""")
def disposable(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d).withColumn("personne_charges",
                                   X.null_outside("personne_charges", 0, 10))
    x = FE.add_indicators(x, couples=COUPLES)
    return x.select(lng("id").alias("id"), dbl("rav").alias("rav"))


@query("income_ratio", sql="""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       ROUND(CASE WHEN l_discount = 0 AND l_tax - 0.04 > 0 THEN 0.0
                  WHEN l_discount = 0 THEN NULL
                  ELSE (l_tax - 0.04) / l_discount END, 6) AS imc
FROM lineitem
""")
def income_ratio(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    imc = X.income_ratio(F.col("l_tax") - 0.04, "l_discount")
    return li.select(lng("l_orderkey").alias("l_orderkey"),
                     lng("l_linenumber").alias("l_linenumber"), dbl(imc, 6).alias("imc"))


@query("quality_report", sql=f"""
WITH {SQL_CASES}, b AS (SELECT *, {SQL_BACKFILL} AS o FROM cases),
 a AS (SELECT COUNT(*) n,
   count_if(o < 2 OR o > 4) r0, count_if(charges <= 0) r1, count_if(revenus_tot <= 0) r2,
   count_if(sum_mensualite <= 0 OR sum_mensualite > 80000) r3, count_if(age < 18 OR age > 90) r4,
   count_if(personne_charges < 0 OR personne_charges > 10) r5,
   count_if(charges < 400) r6, count_if(revenus_tot < 400) r7 FROM b)
SELECT rule, CAST(n_rows AS BIGINT) AS n_rows, ROUND(n_rows * 100.0 / n, 6) AS pct FROM (
  SELECT 'orientation' AS rule, r0 AS n_rows, n FROM a UNION ALL SELECT 'charges', r1, n FROM a
  UNION ALL SELECT 'income', r2, n FROM a UNION ALL SELECT 'instalments', r3, n FROM a
  UNION ALL SELECT 'age', r4, n FROM a UNION ALL SELECT 'dependants', r5, n FROM a
  UNION ALL SELECT 'charges_floor', r6, n FROM a UNION ALL SELECT 'income_floor', r7, n FROM a)
""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    x = backfilled(spark, d)
    o, m = F.col("orientation"), F.col("sum_mensualite")
    rules = {
        "orientation": (o < 2) | (o > 4),
        "charges": F.col("charges") <= 0,
        "income": F.col("revenus_tot") <= 0,
        "instalments": (m <= 0) | (m > 80000),
        "age": (F.col("age") < 18) | (F.col("age") > 90),
        "dependants": (F.col("personne_charges") < 0) | (F.col("personne_charges") > 10),
        "charges_floor": F.col("charges") < 400,
        "income_floor": F.col("revenus_tot") < 400,
    }
    return FE.quality_report(x, rules)


@query("encode_categories", sql="""
WITH b AS (SELECT p_brand AS lab, dense_rank() OVER (ORDER BY p_brand) - 1 AS code
           FROM (SELECT DISTINCT p_brand FROM part)),
     t AS (SELECT p_type AS lab, dense_rank() OVER (ORDER BY p_type) - 1 AS code
           FROM (SELECT DISTINCT p_type FROM part))
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(b.code AS BIGINT) AS p_brand,
       CAST(t.code AS BIGINT) AS p_type
FROM part JOIN b ON p_brand = b.lab JOIN t ON p_type = t.lab
""")
def encode_categories(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    enc, _ = FE.encode_categories(p, ["p_brand", "p_type"])
    return enc.select(lng("p_partkey").alias("p_partkey"), lng("p_brand").alias("p_brand"),
                      lng("p_type").alias("p_type"))


@query("category_codes", sql="""
SELECT 'c_mktsegment' AS "column", c_mktsegment AS label,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT c_mktsegment FROM customer)
""")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment")
    _, mapping = FE.encode_categories(c, ["c_mktsegment"])
    return mapping.select("column", "label", lng("code").alias("code"))

