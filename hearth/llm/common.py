"""Shared steps: row identity, ranks over huge groups, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.session import delete_path, shared_path

#: What separates words everywhere: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[ \t-\r]+"


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not use, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame) -> Column:
    """A 64-bit identity made from the content of all columns: the same on
    every retry and in every job, unlike a generated id. Fully repeated rows
    share it and count as one row wherever rows are told apart by it."""
    def plain(t: T.DataType) -> bool:
        if isinstance(t, (T.MapType, T.VariantType)):
            return False
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        return not isinstance(t, T.StructType) or all(plain(f.dataType) for f in t.fields)
    def content(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        # maps and variants have no hash of their own; their JSON has
        return c if plain(f.dataType) else F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    # a null leaves xxhash64 as it is, so its place is hashed as well
    cols = [c for f in df.schema.fields for c in (content(f), F.col(f"`{f.name}`").isNull())]
    return F.xxhash64(*cols)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path. What
    the write shuffled is of no use after it, and its files go at once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def global_rank(df: DataFrame, group: list[str], order: list[Column], rank: str,
                rows_per_part: int = 250_000) -> DataFrame:
    """Rank from 0 within each group, however large the group is.

    ``order[0]`` must be a uniform 64-bit hash: its range is cut into equal
    parts, each (group, part) is ranked alone, and the sizes of the parts
    before it are added. Order within a group is by ``order``; rows equal in
    all of it are interchangeable. The number of parts follows the row count,
    so that a part holds about ``rows_per_part`` rows of the largest group.
    """
    part, size, before, h = fresh(df, "__part", "__size", "__before", "__h")
    keyed = df.withColumn(h, order[0])
    largest = (keyed.groupBy(*group).count().agg(F.max("count")).first()[0]) or 0
    parts = max(1, -(-largest // rows_per_part))
    # the top 31 bits of the hash, unsigned
    top = F.shiftrightunsigned(F.col(h), 33)
    keyed = keyed.withColumn(part, F.floor(top * F.lit(parts) / F.lit(1 << 31)).cast("int"))
    local = Window.partitionBy(*group, part).orderBy(h, *order[1:])
    ranked = keyed.withColumn(rank, F.row_number().over(local).cast("long") - 1)
    if parts > 1:
        sizes = keyed.groupBy(*group, part).agg(F.count(F.lit(1)).alias(size))
        w = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn(before, F.coalesce(F.sum(size).over(w), F.lit(0))).drop(size)
        on = sizes.select(*[F.col(g).alias(f"{g}__r") for g in group],
                          F.col(part).alias(f"{part}__r"), before)
        cond = F.col(part) == F.col(f"{part}__r")
        for g in group:
            cond = cond & F.col(g).eqNullSafe(F.col(f"{g}__r"))
        ranked = ranked.join(on, cond).drop(f"{part}__r", *[f"{g}__r" for g in group])
        ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).drop(before)
    return ranked.drop(part, h)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Distributed union-find: ``edges(a, b)`` of longs to ``(node, root)``,
    root the smallest node of the component; nodes without edges are absent.

    Large-star and small-star rounds: every node's neighbours are hooked onto
    the smallest one until every edge points at its root. Each round is a few
    joins and aggregates on the edges (a hub's minimum is combined before the
    shuffle, and its join can be split), written to the shared folder; the
    rounds grow with the logarithm of the component size. Raises when
    ``max_rounds`` do not settle it."""
    spark = edges.sparkSession
    now = (edges.where(F.col("a") != F.col("b"))
           .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now, path = stored(now, "edges")
    paths, last = [path], None
    for _ in range(max_rounds):
        # large star: u with all its neighbours; the larger ones move to the minimum
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        # small star: u with its smaller neighbours; they and u move to the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .where(F.col("u") != F.col("v")).distinct())
        now, path = stored(small, "edges")
        paths.append(path)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(seen) == last:
            break
        last = tuple(seen)
        if len(paths) > 2:
            delete_path(spark, paths.pop(0))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    for p in paths[:-1]:
        delete_path(spark, p)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
