import re

import numpy as np
import xxhash

from hearth.llm import simhash as S
from tests.llm.helpers import docs_frame, read, union_find


def brute(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, bits=4):
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits]
    return union_find(ids, pairs)


def test_fingerprints():
    for t in (None, "", " \n\t", "One", "a B c", "a b c d", "É É é X\x85y z w v u", "a b c d " * 1000,
              "w " * 70_000, "日本 語 の テキスト です"):
        assert S.fingerprint(t) == brute(t)


def test_matches_brute_force(spark):
    docs = read("sf0.001", "documents")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(df).collect()}
    fps = {d: brute(t) for d, t in zip(docs.doc_id, docs.text)}
    want = components(list(fps), list(fps.values()))
    assert got == {d: (fps[d], want[d]) for d in fps}


def linked(spark, values, bits=4):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.fingerprint_links(df, bits).collect()]
    assert all(bin(a ^ b).count("1") <= bits for a, b in pairs)
    return union_find(values, pairs), len(pairs)


def test_links_connect_all_that_brute_force_connects(spark):
    rng = np.random.default_rng(1)
    values = set(map(int, rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    for base in list(values)[:40]:  # chains and exact borders of 4 and 5 bits
        for n in (1, 2, 3, 4, 5, 5):
            bits = rng.choice(64, n, replace=False)
            values.add(base ^ sum(1 << int(b) for b in bits))
    values = sorted(values)
    got, _ = linked(spark, values)
    assert got == components(values, values)


def test_large_group_of_near_copies_gives_a_forest(spark):
    rng = np.random.default_rng(2)
    values = sorted({sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(3000)})
    got, n = linked(spark, values)
    assert len(set(got.values())) == 1
    assert n < 60 * len(values)


def test_edges(spark):
    df = docs_frame(spark, [None, "", "same text here now", "SAME text here now", "other words in this line"])
    df = df.unionByName(df.where("doc_id = 2")).selectExpr("*", "1 as fp", "2 as row_key", "3 as __key")
    df = df.unionByName(spark.createDataFrame([(None, "same text here now", "en", "s", 1, 1, 2, 3)], df.schema))
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 0), (2, 2), (2, 2), (3, 2), (4, 4), (99, 2)]
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
    assert S.drop_near_duplicates(df.limit(0)).collect() == []
