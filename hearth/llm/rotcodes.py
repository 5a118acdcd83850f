"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated at random; its code is the signs of the rotated
components, and its stored factor is <code, o>. For another rotated vector q,
<code, q> / factor is an unbiased estimate of <o, q>, off by at most
sqrt(1 - factor^2) / factor times the part of q across o; a pair whose estimate
lies farther below the threshold than that bound allows is no link, all others
are computed exactly. Pairs meet in buckets: segments of the codes of enough
rotations that a link is missed in all of them with chance ``MISS`` at most.

Copies count as one. Where many vectors lie within half the link angle of one
of them they form a ball whose members are all linked, so a large group of near
copies costs its size and not its square.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.ann import usable
from hearth.llm.common import connected_components, global_rank, stored
from hearth.plans.tables import table

COSINE, MISS, EPSILON = 0.93, 1e-4, 8.0
BUCKET, PIECE, BLOCK, STRIPE = 256, 4096, 2048, 256  # rows wanted in a bucket; at most for finding leaders, for comparing, at once
HEAVY = 16  # members that a leader has in the piece where it is found


def width_of(d: int) -> int:
    """The length of the codes of vectors of length ``d``."""
    return max(64, 1 << (d - 1).bit_length())


@lru_cache(maxsize=64)
def _signs(width: int, rotation: int) -> np.ndarray:
    return np.random.default_rng([width, rotation]).choice([-1.0, 1.0], (3, width))


def rotate(x: np.ndarray, rotation: int) -> np.ndarray:
    """The rows of ``x``, lengthened by zeros, under one random rotation: three
    rounds of sign flips and a Hadamard transform."""
    n, width = len(x), width_of(x.shape[1])
    y = np.zeros((n, width))
    y[:, :x.shape[1]] = x
    for flips in _signs(width, rotation):
        y *= flips
        step = 1
        while step < width:
            pair = y.reshape(n, width // (2 * step), 2, step)
            y = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, width)
            step *= 2
        y /= math.sqrt(width)
    return y


def units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed codes of unit vectors and their factors."""
    y = rotate(x, 0)
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(axis=1) / math.sqrt(y.shape[1])


def segments(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row in each table: ``bits`` signs, of as many
    rotations as that takes."""
    if not bits:
        return np.zeros((len(x), tables), np.int64)
    need = -(-bits * tables // width_of(x.shape[1]))
    signs = np.concatenate([rotate(x, r) >= 0 for r in range(need)], axis=1)[:, :bits * tables]
    return signs.reshape(len(x), tables, bits) @ (np.int64(1) << np.arange(bits))


def plan_tables(largest: int, cosine: float, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """``(bits, tables)`` for a label of ``largest`` vectors: buckets of about
    ``bucket`` unlike vectors, and so many tables that a pair at the threshold
    shares none of them with chance ``miss`` at most."""
    bits = max(0, math.ceil(math.log2(max(largest, 1) / bucket)))
    if not bits:
        return 0, 1
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def close_pairs(x, codes, factors, radii, left, right, cosine: float, epsilon: float = EPSILON):
    """``(row, column, cosine, computed)`` of the pairs of ``left`` x ``right``
    (each once where they are the same rows) whose angle is at most the link
    angle plus both radii, and the number of pairs computed exactly."""
    width = width_of(x.shape[1])
    y = rotate(x[right], 0).astype(np.float32)
    across = np.sqrt(np.maximum(1 - factors ** 2, 0)) / factors * min(1.0, epsilon / math.sqrt(width - 1))
    angle, out, computed = math.acos(cosine), [], 0
    for a in range(0, len(left), STRIPE):
        rows = left[a:a + STRIPE]
        signs = np.unpackbits(codes[rows], axis=1, count=width).astype(np.float32) * 2 - 1
        estimate = (signs @ y.T) / (math.sqrt(width) * factors[rows][:, None])
        need = np.cos(np.minimum(angle + radii[rows][:, None] + radii[right], math.pi))
        # a pair of at least this cosine has at most this part across
        part = np.where(need > 0, np.sqrt(np.maximum(1 - need ** 2, 0)), 1.0)
        maybe = estimate >= need - across[rows][:, None] * part - 1e-4
        if left is right:
            maybe &= np.arange(len(right)) > np.arange(a, a + len(rows))[:, None]
        r, c = np.nonzero(maybe)
        computed += len(r)
        for b in range(0, len(r), 1 << 16):
            i, j = rows[r[b:b + (1 << 16)]], right[c[b:b + (1 << 16)]]
            exact = np.einsum("ij,ij->i", x[i], x[j])
            wide = radii[i] + radii[j]
            keep = exact >= np.where(wide > 0, np.cos(np.minimum(angle + wide, math.pi)) - 1e-9, cosine)
            out.append((i[keep], j[keep], exact[keep]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), computed
    return *(np.concatenate(z) for z in zip(*out)), computed


def _codes(bits: int, tables: int):
    def run(frames):
        for frame in frames:
            code, factor, keys = [None] * len(frame), np.zeros(len(frame)), [None] * len(frame)
            for _, at in frame.groupby(frame["vector"].map(len)).indices.items():
                x = units(frame["vector"].iloc[at])
                packed, factor[at] = encode(x)
                for i, p, k in zip(at, packed, segments(x, bits, tables)):
                    code[i], keys[i] = p.tobytes(), k
            yield frame.assign(code=code, factor=factor, keys=keys)
    return run


def _leaders(ball: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x, left, found = units(frame["vector"]), np.arange(len(frame)), []
        while len(left) >= HEAVY:
            near = x[left] @ x[left[0]] >= math.cos(ball)
            if near.sum() >= HEAVY:
                found.append(left[0])
            near[0] = True  # near itself, whatever rounding says
            left = left[~near]
        return frame.iloc[found][["label", "dim", "key", "node", "vector"]]
    return run


def _join_ball(ball: float):
    def run(rows: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(leaders):
            return pd.DataFrame({"node": [], "ball": [], "angle": []}).astype({"node": "int64", "ball": "int64"})
        leaders = leaders.sort_values("node")
        x, y = units(rows["vector"]), units(leaders["vector"])
        near = x @ y.T
        # a leader is its own ball, whatever other leader is near
        names = leaders["node"].to_numpy()
        place = np.minimum(np.searchsorted(names, rows["node"].to_numpy()), len(names) - 1)
        leads = names[place] == rows["node"].to_numpy()
        best = np.where(leads, place, near.argmax(axis=1))
        angle = np.where(leads, 0.0, np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1)))
        inside = angle <= ball
        return pd.DataFrame({"node": rows["node"].to_numpy()[inside], "ball": names[best][inside], "angle": angle[inside]})
    return run


def _bucket(cosine: float):
    def run(key, frame):
        i, j = key[-2:]
        x = units(frame["vector"])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in frame["code"]])
        sub, node = frame["sub"].to_numpy(), frame["node"].to_numpy()
        left = np.flatnonzero(sub == i)
        right = left if i == j else np.flatnonzero(sub == j)
        a, b, _, _ = close_pairs(x, codes, frame["factor"].to_numpy(), frame["radius"].to_numpy(), left, right, cosine)
        a, b = node[a], node[b]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


@F.pandas_udf(T.DoubleType())
def cosine_of(u: pd.Series, v: pd.Series) -> pd.Series:
    if not len(u):
        return pd.Series([], dtype="float64")
    out, widths = np.zeros(len(u)), u.map(len)
    for _, at in widths.groupby(widths).indices.items():
        out[at] = np.einsum("ij,ij->i", units(u.iloc[at]), units(v.iloc[at]))
    return pd.Series(out)


def _balls(classes: DataFrame, cosine: float) -> DataFrame:
    """``node, ball, angle`` of the classes within half the link angle of a
    leader. Leaders are sought in a bounded piece of each bucket of the first
    table, and every row of the bucket may join them."""
    ball = math.acos(cosine) / 2 - 1e-6
    own = classes.select("label", "dim", F.col("keys")[0].alias("key"), "node", "vector")
    most = own.groupBy("label", "dim", "key").count().agg(F.max("count")).first()[0] or 0
    pieces = max(1, -(-most // PIECE))
    own = own.withColumn("piece", F.pmod(F.xxhash64("node"), F.lit(pieces)).cast("int"))
    leaders, _ = stored(own.where(F.col("piece") == 0).drop("piece").groupBy("label", "dim", "key").applyInPandas(
        _leaders(ball), own.drop("piece").schema), "vectors-leaders")
    meets = [F.col("label").eqNullSafe(F.col("l_label")), F.col("dim") == F.col("l_dim"), F.col("key") == F.col("l_key")]
    near = own.join(leaders.select(*[F.col(c).alias(f"l_{c}") for c in ("label", "dim", "key")]).distinct(), meets, "left_semi")
    every = leaders.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    by = ("label", "dim", "key", "piece")
    return near.groupBy(*by).cogroup(every.groupBy(*by)).applyInPandas(_join_ball(ball), "node long, ball long, angle double")


def _candidates(classes: DataFrame, members: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """Distinct pairs ``a < b`` of balls (or single classes) whose members may
    be linked."""
    payload = ("vector", "code", "factor")
    t = F.posexplode("keys").alias("t", "key")
    single = (classes.join(members, "node", "left_anti").withColumn("radius", F.lit(0.0))
              .select("label", "dim", "node", "radius", *payload, t))
    # of a ball, one row for each bucket that any member falls in
    keys = classes.join(members, "node").select("ball", t).distinct()
    many = (keys.join(balls.select("ball", "radius"), "ball")
            .join(classes.select("label", "dim", F.col("node").alias("ball"), *payload), "ball")
            .select("label", "dim", F.col("ball").alias("node"), "radius", *payload, "t", "key"))
    rows = single.unionByName(many)
    by = ["label", "dim", "t", "key"]
    # a bucket beyond BLOCK rows is compared block by block
    large = rows.groupBy(*by).count().where(F.col("count") > BLOCK).select(
        *by, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    rows = (rows.join(large, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("sub", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("sub", "other")).withColumn("j", F.greatest("sub", "other")))
    return (rows.select(*by, "i", "j", "node", "sub", "radius", *payload).groupBy(*by, "i", "j")
            .applyInPandas(_bucket(cosine), "a long, b long").dropDuplicates())


def _links(classes: DataFrame, members: DataFrame, balls: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """``node, ball, other, links``: links of a class to the members of another
    ball. Against a ball that lies wholly inside or outside the link angle one
    cosine decides, members are compared one by one only in between."""
    angle = math.acos(cosine)
    size = classes.select("node", "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = balls.select("ball")
    is_ball = lambda c, flag: names.select(F.col("ball").alias(c), F.lit(True).alias(flag))
    both = both.join(is_ball("a", "am"), "a", "left").join(is_ball("b", "bm"), "b", "left")
    plain = both.where(F.col("am").isNull() & F.col("bm").isNull()).join(size.withColumnRenamed("node", "b"), "b").select(
        F.col("a").alias("node"), F.col("a").alias("ball"), F.col("b").alias("other"), F.col("n").alias("links"))
    mixed = both.where(F.col("am").isNotNull() | F.col("bm").isNotNull()).select(
        F.col("a").alias("ball"), F.col("b").alias("other"))
    who = (classes.join(members, "node", "left")
           .select("node", F.coalesce("ball", "node").alias("ball"), "n", "vector"))
    of = mixed.join(who.select("node", "ball", "vector"), "ball")
    heads = (classes.select(F.col("node").alias("other"), "n", F.col("vector").alias("head"))
             .join(balls.select(F.col("ball").alias("other"), "radius", "weight"), "other", "left")
             .select("other", "head", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("weight", "n").alias("weight")))
    near = of.join(heads, "other").withColumn("cosine", cosine_of("vector", "head")).withColumn(
        "angle", F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))))
    wide = F.col("radius") > 0
    near = near.withColumn("verdict", F.when(~wide, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
                           .when(F.col("angle") + F.col("radius") <= angle - 1e-7, "all")
                           .when(F.col("angle") - F.col("radius") > angle + 1e-7, "none").otherwise("some"))
    sure = near.where(F.col("verdict") == "all").select("node", "ball", "other", F.col("weight").alias("links"))
    one = who.select(F.col("ball").alias("other"), F.col("vector").alias("own"), "n")
    some = (near.where(F.col("verdict") == "some").select("node", "ball", "other", "vector").join(one, "other")
            .where(cosine_of("vector", "own") >= cosine)
            .groupBy("node", "ball", "other").agg(F.sum("n").alias("links")))
    return plain.unionByName(sure).unionByName(some)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of
    ``vectors(vec_id, embedding, label)``: how many other vectors of its label
    have at least this cosine, the smallest id that links reach, and whether
    that is its own.

    Rows with a null id or label, or a vector that is null, zero or holds null
    or non-finite components, are returned without links as their own
    component (kept). Vectors meet those of their own length. Fully repeated
    rows count once; unlike rows of one id are vectors of their own; copies
    under other ids are linked. Other columns are not read; an empty table
    gives none. No pair below ``cosine`` is linked; one at or above it is missed with chance
    ``miss`` at most (exactly at the threshold, less above), and never where no
    label has more than ``bucket`` unlike vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"),
                          F.col("label").cast("long").alias("label")).dropDuplicates()
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    rows, _ = stored(rows.withColumn("dim", F.size("vector")).withColumn("part", takes_part), "vectors-rows")
    alone = rows.where(~F.col("part")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("part").select("vec_id", "vector", "label", "dim")
    unlike = rows.groupBy("label", "dim", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    ranked = global_rank(unlike, [], [F.xxhash64("label", "vector"), F.col("label"), F.col("vector")], "node")
    most = unlike.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, cosine, miss, bucket)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", code binary, factor double, keys array<long>"
    classes, _ = stored(ranked.mapInPandas(_codes(bits, tables), schema), "vectors-classes")
    members, _ = stored(_balls(classes, cosine), "vectors-members")
    balls, _ = stored(members.join(classes.select("node", "n", "least"), "node").groupBy("ball").agg(
        F.max("angle").alias("radius"), F.sum("n").alias("weight"), F.min("least").alias("least")), "vectors-balls")
    pairs, _ = stored(_candidates(classes, members, balls, cosine), "vectors-pairs")
    links, _ = stored(_links(classes, members, balls, pairs, cosine), "vectors-links")
    root = connected_components(links.select(F.col("ball").alias("a"), F.col("other").alias("b")).distinct())
    of_ball = (classes.join(members.select("node", "ball"), "node", "left")
               .join(balls.select("ball", "weight"), "ball", "left")
               .select("node", "label", "dim", "vector", "n", "least", F.coalesce("ball", "node").alias("ball"),
                       F.coalesce("weight", "n").alias("weight")))
    of_ball = of_ball.join(root.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    first = of_ball.groupBy("root").agg(F.min("least").alias("component_id"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    result = (of_ball.join(first, "root").join(counted, "node", "left")
              .select("label", "dim", "vector", "component_id",
                      (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    own: list[Column] = [F.col("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id",
                         (F.col("vec_id") == F.col("component_id")).alias("kept")]
    return rows.join(result, ["label", "dim", "vector"]).select(*own).unionByName(alone)


def op12_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, label, embedding,
         coalesce(label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS part
  FROM embeddings),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM r WHERE part),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
   AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  WITH RECURSIVE w(a, b) AS (
    SELECT a, b FROM link UNION SELECT w.a, link.b FROM w JOIN link ON w.b = link.a)
  SELECT a, min(b) AS least FROM w GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT r.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       least(r.vec_id, coalesce(reach.least, r.vec_id)) AS component_id,
       r.vec_id = least(r.vec_id, coalesce(reach.least, r.vec_id)) AS kept
FROM r LEFT JOIN counted ON counted.a = r.vec_id LEFT JOIN reach ON reach.a = r.vec_id
"""

QUERIES = {"op12_vector_near_dedup": op12_vector_near_dedup}
ORACLE_SQL = {"op12_vector_near_dedup": _SQL}
