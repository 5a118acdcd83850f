"""Small reference implementations for the tests."""

import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, schema=DOCS):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def read(sf, name):
    return pd.read_parquet(f"/root/testdata/{sf}/{name}.parquet")
