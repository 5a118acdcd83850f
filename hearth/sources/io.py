"""Readers and writers with pinned options.

* headerless keyed TSV (``LOAD DATA`` style: tab, ``\\N`` for NULL);
* client dump TSV (header, ``NULL`` word, no quoting, backslash escapes
  inside text);
* flat windows-1252 CSV with backslash escapes;
* parquet for the clean dataset, the category mapping, replaced tables and
  the cluster export (CSV optional).
Paths are caller-given (a shared filesystem on a cluster).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# --- S1 ------------------------------------------------------------------------------------------

def read_keyed_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headerless tab-separated file into a typed table (``\\N`` = NULL)."""
    return spark.read.schema(schema).csv(path, sep="\t", header=False, nullValue="\\N",
                                         quote="", mode="FAILFAST")


def write_keyed_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False, nullValue="\\N",
                                   quote="", escapeQuotes=False)


# --- S3 (client dump) ---------------------------------------------------------------------------

# Characters that would break a line or a field, and their escapes.
_ESCAPES = {"\t": "t", "\n": "n", "\r": "r", "\0": "0"}


def _escape_text(c):
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, letter in _ESCAPES.items():
        c = F.replace(c, F.lit(char), F.lit(f"\\{letter}"))
    # the word itself is not the missing value
    return F.when(c == "NULL", F.lit("\\NULL")).otherwise(c)


def _unescape_text(c):
    # pairs of backslashes first, from the left; what is between them holds single ones only
    def between(part):
        for char, letter in _ESCAPES.items():
            part = F.replace(part, F.lit(f"\\{letter}"), F.lit(char))
        return F.replace(part, F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(c, r"\\\\"), between), "\\")


def write_dump_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header, NULL as the word ``NULL``, no quoting,
    tab, line ends, NUL and backslash escaped inside text (the client's batch
    format). Empty strings, padding and control characters stay as they are."""
    out = df.withColumns({f.name: _escape_text(F.col(f.name)) for f in df.schema.fields
                          if isinstance(f.dataType, StringType)})
    if len(out.columns) == 1:
        # the writer leaves out empty lines; an escape of nothing is the empty string
        name = out.columns[0]
        out = out.withColumn(name, F.when(F.col(name) == "", F.lit("\\")).otherwise(F.col(name)))
    out.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NULL", emptyValue="",
                                    quote="", escapeQuotes=False, lineSep="\n",
                                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_dump_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read the client dump: header, ``NULL`` word, no quote character (a
    stray ``"`` must not swallow the rest of the line), escapes undone in one
    pass. The format has no quoting, so a line is split at its tabs: an empty
    field is an empty string. A line with another number of fields, or a
    number that does not parse, raises. Of the lines of a file that equal the
    header one is its header; others are rows."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    names, fields = [f.name for f in schema.fields], F.split("value", "\t", -1)
    header, lines = F.lit("\t".join(names)), spark.read.text(path, lineSep="\n")
    again = (lines.where(F.col("value") == header).groupBy(F.col("_metadata.file_path").alias("file"))
             .agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
             .select("value", F.explode(F.sequence(F.lit(2), "n"))).select("value"))
    lines = lines.where(F.col("value") != header).select("value").unionByName(again)
    checked = F.when(F.size(fields) == len(names), fields).otherwise(
        F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), F.col("value"))))

    def typed(i, f):
        raw = F.when(F.col("__f")[i] != "NULL", F.col("__f")[i])
        return (_unescape_text(raw) if isinstance(f.dataType, StringType)
                else raw.cast(f.dataType)).alias(f.name)
    return lines.select(checked.alias("__f")).select(*[typed(i, f) for i, f in enumerate(schema.fields)])


def read_extract(spark: SparkSession, path: str, schema: StructType | str,
                 platform_col: str = "plateforme") -> tuple[DataFrame, DataFrame]:
    """The wide extract and its report: (rows, ``platform, n_rows, n_columns``
    with the whole extract under a NULL platform)."""
    df = read_dump_tsv(spark, path, schema)
    width = F.lit(len(df.columns)).alias("n_columns")
    by = df.groupBy(F.col(platform_col).cast("string").alias("platform")).agg(F.count(F.lit(1)).alias("n_rows"))
    whole = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(None).cast("string").alias("platform"), "n_rows")
    return df, by.where(F.col("platform").isNotNull()).unionByName(whole).select("platform", "n_rows", width)


# --- S4 ------------------------------------------------------------------------------------------

def _java_charsets(spark: SparkSession) -> None:
    """Single-byte code pages need this setting of the session, when the file
    is read as well as when the plan is made; it stays on."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_flat_csv(spark: SparkSession, path: str, schema: StructType | str,
                  encoding: str = "windows-1252") -> DataFrame:
    """Comma-separated, header, quoted texts that may hold line ends,
    backslash escapes, single-byte encoding. A quoted empty field is an empty
    string, an unquoted one is NULL."""
    _java_charsets(spark)
    df = spark.read.schema(schema).csv(path, sep=",", header=True, escape="\\", multiLine=True, emptyValue="\0",
                                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                       encoding=encoding, mode="FAILFAST")
    return df.withColumns({f.name: F.when(F.col(f.name) == "\0", "").otherwise(F.col(f.name))
                           for f in df.schema.fields if isinstance(f.dataType, StringType)})


def write_flat_csv(df: DataFrame, path: str, encoding: str = "windows-1252") -> None:
    """Raises on characters that the encoding lacks (the writer alone would
    put question marks)."""
    _java_charsets(df.sparkSession)
    whole = df.withColumns({f.name: F.decode(F.encode(F.col(f.name), encoding), encoding) for f in df.schema.fields
                            if isinstance(f.dataType, StringType)})
    whole.write.mode("overwrite").csv(path, sep=",", header=True, escape="\\", encoding=encoding,
                                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# --- S5 S6 S7 S8 S9 --------------------------------------------------------------------------------

def replace_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """``DROP TABLE IF EXISTS; CREATE TABLE AS``: overwrite a parquet table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Category mapping (column, label, code) as a table."""
    mapping.write.mode("overwrite").parquet(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_cluster_export(df: DataFrame, path: str, *, vec: str, names: Sequence[str],
                         cluster: str = "cluster") -> None:
    """Centres in original units, one column per variable, plus the cluster,
    as CSV with a header (no index column)."""
    out = df.select(*[F.col(vec)[i].alias(n) for i, n in enumerate(names)], cluster)
    out.write.mode("overwrite").csv(path, header=True)


def read_cluster_export(spark: SparkSession, path: str, *, names: Sequence[str],
                        cluster: str = "cluster") -> DataFrame:
    """The cluster export: one double per variable and the cluster id."""
    schema = ", ".join([*(f"`{n}` double" for n in names), f"`{cluster}` long"])
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
