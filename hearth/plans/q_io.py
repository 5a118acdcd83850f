"""Source/sink round trips: each query writes whole driver tables to a fresh
folder under the shared checkpoint directory in one of the pinned formats
and reads them back with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import features as FE
from hearth.plans.registry import query
from hearth.plans.tables import dbl, lng, table
from hearth.session import shared_path
from hearth.sources import io as IO


@query("keyed_tsv_round_trip", sql="""
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(1950 + c_nationkey AS INTEGER) AS annee_naissance FROM customer
""")
def keyed_tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.lit(1950) + F.col("c_nationkey")).alias("y"))
    path = shared_path(spark, "keyed-tsv")
    IO.write_keyed_tsv(c, path)
    return IO.read_keyed_tsv(spark, path, "id long, annee_naissance int")


@query("tsv_round_trip", sql="""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey,
       CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer
""")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    path = shared_path(spark, "dump-tsv")
    IO.write_dump_tsv(c, path)
    return IO.read_dump_tsv(spark, path, "c_custkey long, c_name string, c_nationkey int, "
                                         "c_acctbal double, c_mktsegment string")


@query("tsv_text_round_trip", sql="""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
""")
def tsv_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Free text with tabs, newlines, backslashes and quotes survives the dump."""
    c = table(spark, d, "conversations")
    path = shared_path(spark, "dump-text")
    IO.write_dump_tsv(c, path)
    return IO.read_dump_tsv(spark, path, "conv_id long, turn long, role string, text string")


@query("csv_round_trip", sql="""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Free text with line ends and accents survives the flat CSV."""
    c = table(spark, d, "conversations")
    path = shared_path(spark, "flat-csv")
    IO.write_flat_csv(c, path)
    return IO.read_flat_csv(spark, path, "conv_id long, turn long, role string, text string")


@query("documents_round_trip", sql="""
SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents
""")
def documents_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents survive the dump."""
    path = shared_path(spark, "dump-documents")
    IO.write_dump_tsv(table(spark, d, "documents"), path)
    return IO.read_dump_tsv(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("extract_report", sql="""
SELECT c_mktsegment AS platform, COUNT(*) AS n_rows, 5 AS n_columns FROM customer GROUP BY ROLLUP (c_mktsegment)
""")
def extract_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and rows per platform of an extract read from its dump."""
    path = shared_path(spark, "extract")
    IO.write_dump_tsv(table(spark, d, "customer"), path)
    _, report = IO.read_extract(spark, path, "c_custkey long, c_name string, c_nationkey int, "
                                "c_acctbal double, c_mktsegment string", platform_col="c_mktsegment")
    return report


@query("clean_round_trip", sql="""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_type, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part
""")
def clean_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The clean sink, read back."""
    p = table(spark, d, "part").select(lng("p_partkey").alias("p_partkey"), "p_type",
                                       dbl("p_retailprice").alias("p_retailprice"))
    path = shared_path(spark, "clean")
    IO.write_clean(p, path)
    return IO.read_table(spark, path)


@query("cluster_export_round_trip", sql="""
SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount,
       CAST(l_linenumber AS BIGINT) AS cluster FROM lineitem
""")
def cluster_export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points with their cluster through the export file and back."""
    li = table(spark, d, "lineitem").select(
        F.array(dbl("l_quantity"), dbl("l_discount")).alias("v"), lng("l_linenumber").alias("cluster"))
    path, names = shared_path(spark, "cluster-export"), ["quantity", "discount"]
    IO.write_cluster_export(li, path, vec="v", names=names)
    return IO.read_cluster_export(spark, path, names=names)


@query("table_round_trip", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders
""")
def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                         "o_totalprice", "o_orderpriority")
    path = shared_path(spark, "table")
    IO.replace_table(o, path, partition_by=["o_orderstatus"])
    r = IO.read_table(spark, path)
    return r.select(lng("o_orderkey").alias("o_orderkey"), lng("o_custkey").alias("o_custkey"),
                    "o_orderstatus", dbl("o_totalprice").alias("o_totalprice"),
                    "o_orderpriority")


@query("mapping_round_trip", sql="""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type
FROM part
""")
def mapping_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Encode, store the mapping table, reload it and re-encode from it."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    _, mapping = FE.encode_categories(p, ["p_type"])
    path = shared_path(spark, "mapping")
    IO.write_mapping(mapping, path)
    again = FE.apply_mapping(p, IO.read_mapping(spark, path), ["p_type"])
    return again.select(lng("p_partkey").alias("p_partkey"), lng("p_type").alias("p_type"))
