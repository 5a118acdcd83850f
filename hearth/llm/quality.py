"""Quality rules with adaptive thresholds.

Each text is measured once in a task; the rates of all documents go into
mergeable quantile sketches per language and source; thresholds read from
the sketches replace fixed cutoffs and are joined back to filter.

The sketch is a histogram over geometric bins (relative error
``RELATIVE_ERROR``): merging is adding counts, so it combines before the
shuffle, and its quantiles do not depend on partitions, order or retries.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import fresh, stored
from hearth.plans.tables import table

#: Base rule, fixed by contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
RELATIVE_ERROR = 0.01
#: Rate -> (least distance of the upper fence from the median, of the lower fence or None).
RATES = {
    "word_length": (2.0, 2.0),
    "symbol_rate": (0.25, None),
    "dup_line_rate": (0.4, None),
    "repeat_rate": (0.4, None),
    "upper_rate": (0.3, None),
}
#: A fence lies this many times the distance from median to quartile beyond the median.
SPREAD = 5.0
#: Groups of fewer documents use the sketch of their language, then that of the corpus.
MIN_GROUP = 200

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "n_lines", "n_upper", "n_lower")
_SCHEMA = T.StructType([T.StructField(m, T.LongType()) for m in _MEASURES])


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    twice = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(windows)] |= twice
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text; a null text has no words."""
    if not text:
        return (0,) * len(_MEASURES)
    raw = text.encode()
    words = raw.split()  # bytes split at space and \t to \r only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    a = np.frombuffer(raw, np.uint8)
    return (len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")),
            sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), int(((a >= 65) & (a <= 90)).sum()), int(((a >= 97) & (a <= 122)).sum()))


@F.pandas_udf(_SCHEMA)
def measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(_MEASURES), dtype="int64")


def _rates(m: str):
    c = lambda f: F.col(f"{m}.{f}").cast("double")
    some = lambda x: F.greatest(x, F.lit(1.0))
    words = some(c("n_words"))
    return {"word_length": c("word_chars") / words, "symbol_rate": c("n_symbols") / words,
            "dup_line_rate": c("n_dup_lines") / some(c("n_lines")),
            "repeat_rate": c("n_repeat_words") / words,
            "upper_rate": c("n_upper") / some(c("n_upper") + c("n_lower"))}


def _base_failed(m: str):
    words = F.col(f"{m}.n_words")
    return (words < MIN_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT)


def thresholds(docs: DataFrame, text: str = "text", lang: str = "lang",
               source: str = "source") -> DataFrame:
    """``(lang, source, <rate>_low, <rate>_high ...)``, a row for each pair
    that occurs. Only documents that pass the base rule are sketched; a pair
    none of whose documents do has no row and rejects nothing further."""
    gamma = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
    m = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"),
                    measure(F.col(text)).alias("m")).where(~_base_failed("m"))
    rates = _rates("m")
    bins = {r: F.when(x > 0, F.ceil(F.log(x) / math.log(gamma)).cast("int")) for r, x in rates.items()}
    # counts of the joint bins, combined before the shuffle
    sketch = (m.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), b.alias("bin")) for r, b in bins.items()])).alias("s"))
        .groupBy("lang", "source", "s.rate", "s.bin").agg(F.count(F.lit(1)).alias("n")))
    # the three levels are merged from the stored sketches: the texts are measured once for them
    sketch, _ = stored(sketch, "quality-sketch")
    null = F.lit(None).cast("string")
    levels = (sketch.withColumn("level", F.lit(0))
              .unionByName(sketch.withColumn("source", null).withColumn("level", F.lit(1)))
              .unionByName(sketch.withColumn("source", null).withColumn("lang", null)
                           .withColumn("level", F.lit(2)))
              .groupBy("level", "lang", "source", "rate", "bin").agg(F.sum("n").alias("n")))
    # quantiles: a group's bins are bounded by the sketch, not by its documents
    w = Window.partitionBy("level", "lang", "source", "rate")
    upto = levels.withColumns({
        "total": F.sum("n").over(w),
        "upto": F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first())
                                .rowsBetween(Window.unboundedPreceding, 0)),
        "value": F.when(F.col("bin").isNull(), F.lit(0.0))
        .otherwise(F.pow(F.lit(gamma), F.col("bin")) * 2 / (gamma + 1))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value")))
    q = upto.groupBy("level", "lang", "source", "rate").agg(
        F.max("total").alias("total"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    far = lambda which: F.element_at(F.create_map(*[
        F.lit(x) for r, v in RATES.items() for x in (r, v[which] if v[which] is not None else math.inf)]),
        F.col("rate"))
    q = q.select(
        "level", "lang", "source", "rate", "total",
        (F.col("q2") + F.greatest(SPREAD * (F.col("q3") - F.col("q2")), far(0))).alias("high"),
        (F.col("q2") - F.greatest(SPREAD * (F.col("q2") - F.col("q1")), far(1))).alias("low"))
    fences = q.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{r}_{side}")
          for r in RATES for side in ("low", "high")])
    names = [f"{r}_{side}" for r in RATES for side in ("low", "high")]
    packed = fences.select("level", "lang", "source", "total", F.struct(*names).alias("f"))
    own = packed.where("level = 0").drop("level")
    by_lang = packed.where("level = 1").select(F.col("lang").alias("l1"), F.col("total").alias("t1"), F.col("f").alias("f1"))
    whole = packed.where("level = 2").select("f").first()
    out = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l1")), "left")
    corpus = F.struct(*[F.lit(whole.f[n] if whole else None).cast("double").alias(n) for n in names])
    picked = F.when(F.col("total") >= MIN_GROUP, F.col("f")).when(
        F.col("t1") >= MIN_GROUP, F.col("f1")).otherwise(corpus)
    return out.select("lang", "source", picked.alias("f")).select("lang", "source", "f.*")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """``docs`` with two structs: ``measures`` (with ``base_failed``) and
    ``verdict`` (``kept`` and a flag for each rate), under names that no
    column of ``docs`` has.

    A null or empty text has no words and fails the base rule. Null languages
    and sources form groups of their own. Repeated rows are judged alike. An
    empty table gives an empty result. Texts of any length are read whole."""
    m, tl, ts, verdict = fresh(docs, "measures", "__tl", "__ts", "verdict")
    # stored, so that its size is known when the join is planned: a small table is broadcast and no
    # text moves, a large one is joined and AQE splits a hot source
    fences, _ = stored(thresholds(docs, text, lang, source), "quality-fences")
    names = [c for c in fences.columns if c not in ("lang", "source")]
    fences = fences.select(F.col("lang").alias(tl), F.col("source").alias(ts),
                           F.struct(*names).alias(verdict))
    joined = docs.withColumn(m, measure(F.col(text))).join(
        fences, F.col(lang).eqNullSafe(F.col(tl)) & F.col(source).eqNullSafe(F.col(ts)), "left")
    flags = {}
    for r, x in _rates(m).items():
        outside = (x > F.col(f"{verdict}.{r}_high")) | (x < F.col(f"{verdict}.{r}_low"))
        flags[r] = F.coalesce(outside, F.lit(False))
    failed = _base_failed(m)
    any_out = failed
    for f in flags.values():
        any_out = any_out | f
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.col(f"{m}.*"), failed.alias("base_failed")).alias(m),
        F.struct((~any_out).alias("kept"), *[f.alias(f"{r}_out") for r, f in flags.items()]).alias(verdict))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    _, verdict = fresh(docs, "measures", "verdict")
    return judge(docs, text, lang, source).where(F.col(f"{verdict}.kept")).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select(
        "doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "base_failed")],
        "verdict.kept", *[f"verdict.{r}_out" for r in RATES])


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}
