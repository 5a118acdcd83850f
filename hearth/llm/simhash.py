"""Near-duplicate documents by SimHash and a segment-popcount grid.

A fingerprint's 64 bits are cut into segments; the bit counts of the segments
embed it in a small integer grid, where Manhattan distance is a lower bound
of Hamming distance. Two fingerprints within ``r`` bits agree within
``r // bands`` on the counts of at least one band of segments, so each is put
into the grid cells around its own within half that radius, cells are the
join key, and members of a cell are verified by exact Hamming distance.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import connected_components, fresh, row_key, stored
from hearth.plans.tables import table

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Bits of a segment, and bands of segments. Two bands leave a radius of 2 in one band, 1 on either side.
SEGMENT_BITS, BANDS = 2, 2
#: Runs up to this many fingerprints in a cell are compared by shifting; longer ones are searched.
SHORT_RUN = 16
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text; 0 where it has no word (or is null)."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle_words])).tolist()
        pieces = map(joined.__getitem__, map(slice, starts, (ends[shingle_words - 1:] - 1).tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(h), _HASHES_AT_ONCE):
        part = h[k:k + _HASHES_AT_ONCE]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h)).view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, each in its segment's own two bits."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def grid_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, cell)``: for every fingerprint and band its own cell of segment
    counts and the cells one step away inside the grid (counts 0 to 2).
    Points at Manhattan distance 2 or less share at least one such cell."""
    counts = segment_counts(fp)
    rows, cells, index = [], [], np.arange(len(fp))
    half = np.uint64(32)
    for band in range(BANDS):
        own = (counts >> (half * np.uint64(band))) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(band) << np.uint64(32)
        rows.append(index)
        cells.append(own | tag)
        for s in range(0, 32, SEGMENT_BITS):
            unit = np.uint64(1) << np.uint64(s)
            c = (own >> np.uint64(s)) & np.uint64(3)
            up, down = np.flatnonzero(c < 2), np.flatnonzero(c > 0)
            rows += [up, down]
            cells += [(own[up] + unit) | tag, (own[down] - unit) | tag]
    return np.concatenate(rows), np.concatenate(cells)


def _emit_cells(batches):
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fp), 8192):
            rows, cells = grid_cells(fp[k:k + 8192])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.view(np.int64)), pa.array(fp[k:k + 8192][rows].view(np.int64))], ["cell", "fp"])


def spanning_edges(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints that lie within ``max_bits`` of
    one another: each found one leaves the unvisited, so a dense group costs
    about its size and gives one edge less than members, never all pairs."""
    a, b, rest = [], [], fp
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            p = front.pop()
            near = np.bitwise_count(rest ^ p) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), p, np.uint64))
                b.append(found)
                front.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def link_sorted(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by cell."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    a, b = [], []
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for d in range(1, min(SHORT_RUN, len(cell))):
        same = (cell[d:] == cell[:-d]) & short[d:]
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
        a.append(fp[i])
        b.append(fp[i + d])
    for s, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        x, y = spanning_edges(fp[s:s + n], max_bits)
        a.append(x)
        b.append(y)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _link_cells(max_bits: int):
    def run(batches):
        cells, fps = [], []

        def flush(last: bool):
            if not cells:
                return None
            cell, fp = np.concatenate(cells), np.concatenate(fps)
            cut = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            cells[:], fps[:] = [cell[cut:]], [fp[cut:]]
            x, y = link_sorted(cell[:cut], fp[:cut], max_bits)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])

        held = 0
        for batch in batches:
            cells.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held >= 1 << 18 and cells[-1][-1] != cells[0][0]:
                yield flush(False)
                held = len(cells[0])
        out = flush(True)
        if out is not None:
            yield out
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints ``fps(fp)``, enough to
    connect all that chains of links within ``max_bits`` connect.

    Equal fingerprints must have been merged before, so a group of copies is
    one row here. A cell holds distinct fingerprints (8 bytes each while it is
    searched); a group of near copies inside a cell gives a forest."""
    radius = max_bits // BANDS
    if radius > 2:
        raise ValueError("the grid is built for up to 5 differing bits")
    cells = fps.select("fp").mapInArrow(_emit_cells, "cell long, fp long")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(_link_cells(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: ``row_key, doc_id, fp`` and
    ``component_id``, the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, with ``first_key`` the row key of the row that
    has it.

    Null and empty texts have fingerprint zero and link like any other. A null
    doc_id is reachable but never the smallest unless a component has no other
    (then ``component_id`` is null). Repeated rows appear as often as they
    occur. An empty table gives an empty result."""
    if shingle_words != SHINGLE_WORDS:
        fp = F.pandas_udf(lambda s: pd.Series(
            np.array([fingerprint(t, shingle_words) for t in s], np.uint64).view(np.int64)), T.LongType())
    else:
        fp = fingerprints
    marked, _ = stored(docs.select(row_key(docs).alias("row_key"), F.col(doc_id).alias("doc_id"),
                                   fp(F.col(text)).alias("fp")), "simhash")
    # nulls last: (is null, id, key)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    fps, _ = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "simhash-fps")
    roots = connected_components(fingerprint_links(fps, max_bits))
    member = fps.join(roots, fps.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    member, _ = stored(member, "simhash-member")
    top = member.groupBy("root").agg(F.min("first").alias("top"))
    by_fp = member.select("fp", "root").join(top, "root").select(
        "fp", F.col("top.doc_id").alias("component_id"), F.col("top.row_key").alias("first_key"))
    return marked.join(by_fp, "fp").select("row_key", "doc_id", "fp", "component_id", "first_key")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component kept: the one with the smallest
    doc_id. Fully repeated rows count as one."""
    key, = fresh(docs, "__key")
    found = near_duplicates(docs, text, doc_id)
    keep = found.where(F.col("row_key") == F.col("first_key")).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(docs)).join(keep, key, "left_semi").dropDuplicates([key]).drop(key)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
