import numpy as np

from hearth.llm import sharding as H


def test_hypergeometric_follows_its_law():
    rng = np.random.default_rng(0)
    x = np.array([H.hypergeometric(rng, 30, 50, 20) for _ in range(20_000)])
    y = rng.hypergeometric(30, 50, 20, 20_000)
    assert abs(x.mean() - 7.5) < 0.06 and abs(x.var() - y.var()) < 0.15
    assert x.min() >= 0 and x.max() <= 20
    assert H.hypergeometric(rng, 5, 0, 3) == 3 and H.hypergeometric(rng, 0, 5, 3) == 0
    big = [H.hypergeometric(rng, 4 * 10**12, 12 * 10**12, 10**8) for _ in range(50)]
    assert abs(np.mean(big) / 10**8 - 0.25) < 1e-4


def test_matrix_has_exact_margins():
    parts, shards = [100, 0, 37, 63], [50, 50, 51, 49]
    m = H.communication_matrix(parts, shards)
    assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == shards and (m >= 0).all()


def rows(df):
    return sorted((r.shard, r.slot, r.i) for r in df.collect())


def test_deal_is_exact_gapless_and_repeatable(spark):
    df = spark.range(10_003).withColumnRenamed("id", "i")
    out = rows(H.deal(df, 7, rows_per_part=500))
    for s in range(7):
        slots = [slot for shard, slot, _ in out if shard == s]
        assert slots == list(range(len(slots))) and len(slots) in (1429, 1430)
    assert sorted(i for _, _, i in out) == list(range(10_003))
    assert rows(H.deal(df.repartition(13), 7, rows_per_part=500)) == out
    # a uniform shuffle: neighbours in are no neighbours out, shards mix the input evenly
    means = [np.mean([i for shard, _, i in out if shard == s]) for s in range(7)]
    assert max(abs(m - 5001) for m in means) < 400
    order = [i for shard, _, i in out if shard == 0]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 1), (1, "a", 2), (2, "", 3)],
                               "i int, __key string, __part int")
    out = H.deal(df, 16)
    assert out.columns == ["i", "__key", "__part", "shard", "slot"]
    assert sorted(r.shard for r in out.collect()) == [0, 1, 2, 3]
    assert H.deal(df.limit(0), 3).collect() == []
