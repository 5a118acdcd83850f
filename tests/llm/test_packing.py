from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm import packing as P


def cost(lengths, counts, limits):
    return sum(c * min(x for x in limits if x >= n) for n, c in zip(lengths, counts))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=11), st.integers(1, 4))
def test_boundaries_are_optimal(hist, k):
    lengths = sorted(hist)
    counts = [hist[n] for n in lengths]
    got = P.optimal_boundaries(np.array(lengths), np.array(counts), k)
    assert len(got) <= max(k, len(lengths) if len(lengths) <= k else k) and got[-1] == lengths[-1]
    best = min(cost(lengths, counts, [*some, lengths[-1]])
               for some in combinations(lengths[:-1], min(k, len(lengths)) - 1))
    assert cost(lengths, counts, got) == best


def test_batches_keep_the_budget(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = P.pack_documents(df).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in df.select("doc_id").collect())
    lengths, counts = np.unique(out.n_tokens, return_counts=True)
    limits = P.optimal_boundaries(lengths, counts, P.BUCKETS)
    assert sorted(out.padded_length.unique()) == limits
    for (bucket, batch), g in out.groupby(["bucket", "batch"]):
        assert sorted(g.slot) == list(range(len(g)))
        limit = limits[bucket]
        assert (g.n_tokens <= limit).all() and (bucket == 0 or (g.n_tokens > limits[bucket - 1]).all())
        assert len(g) == 1 or len(g) * limit <= P.TOKEN_BUDGET
    # all batches of a bucket but the last are full
    sizes = out.groupby(["bucket", "batch"]).size()
    for bucket, limit in enumerate(limits):
        s = sizes[bucket]
        assert (s.iloc[:-1] == max(1, P.TOKEN_BUDGET // limit)).all() and list(s.index) == list(range(len(s)))


def test_edges(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 5, 0), (2, None, 1), (3, -4, 1), (None, 10**7, 2)],
                               "doc_id int, n int, bucket int")
    out = P.pack(df, "n", buckets=2)
    assert set(df.columns) < set(out.columns) and "bucket_" in out.columns
    got = sorted((r.n or 0, r.bucket_, r.batch) for r in out.collect())
    assert [g[1] for g in got] == [0, 0, 0, 0, 1]
    assert P.pack(df.limit(0), "n").collect() == []
    text = spark.createDataFrame([(None,), ("",), ("a\t b\n",), ("w " * 100_000,)], "t string")
    assert [r[0] for r in text.select(P.n_tokens(text.t)).collect()] == [1, 1, 3, 100_001]
