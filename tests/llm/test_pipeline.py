"""Every stage against a plain version of it, and the pipeline as a whole."""

import re

import numpy as np
import pytest

import corpus_pipeline as C
from hearth.llm import packing as P
from hearth.llm import quality as Q
from tests.llm import test_lines as lines
from tests.llm import test_simhash as simhash
from tests.llm.helpers import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality_stage(spark, docs):
    out = C.quality(spark, docs, SF)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    table = read("sf0.001", "documents")
    measures = {d: Q.measure_text(t) for d, t in zip(table.doc_id, table.text)}
    base = {d for d, m in measures.items() if m[0] < 50 or 100 * m[4] > 50 * m[0]}
    # thresholds by sorting all documents that pass the base rule, instead of sketches (all groups are small here)
    rates = {d: (m[1] / max(1, m[0]), m[2] / max(1, m[0]), m[3] / max(1, m[5]), m[4] / max(1, m[0]), m[6] / max(1, m[6] + m[7]))
             for d, m in measures.items()}
    lang = dict(zip(table.doc_id, table.lang))
    good = [d for d in measures if d not in base]
    wrong = 0
    for d in measures:
        group = [g for g in good if lang[g] == lang[d]]
        group = group if len(group) >= Q.MIN_GROUP else good
        out_of = d in base
        for k, (far_high, far_low) in enumerate(Q.RATES.values()):
            x = np.sort([rates[g][k] for g in group])
            q1, q2, q3 = (x[max(0, int(np.ceil(len(x) * q)) - 1)] for q in (0.25, 0.5, 0.75))
            high, low = q2 + max(Q.SPREAD * (q3 - q2), far_high), q2 - max(Q.SPREAD * (q2 - q1), far_low or np.inf)
            out_of |= rates[d][k] > high or rates[d][k] < low
        wrong += out_of == (d in kept)
    assert wrong == 0


def test_line_stage(spark, docs):
    out = C.line_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    table = read("sf0.001", "documents")
    first, pairs = lines.brute(zip(table.doc_id, table.text))
    want = {}
    for d, t in zip(table.doc_id, table.text):
        parts = t.split("\n")
        keep = [x for i, x in enumerate(parts) if first.get((d, i), (d, i)) == (d, i)]
        if any(lines.normal(x) for x in keep) or not any(map(lines.normal, parts)):
            want[d] = "\n".join(keep)
    got = {r.doc_id: r.text for r in out.collect()}
    assert sum(got.get(d) != want.get(d) for d in set(got) | set(want)) <= 0.01 * max(1, len(pairs))


def test_near_duplicate_stage(spark, docs):
    out = C.near_duplicates(spark, docs, SF)
    table = read("sf0.001", "documents")
    fps = [simhash.brute(t) for t in table.text]
    root = simhash.components(list(table.doc_id), fps)
    assert rows(out) == rows(docs.where(docs.doc_id.isin(sorted(set(map(int, root.values()))))))


def test_packing_stage(spark, docs):
    out = C.packing(spark, docs, SF).toPandas()
    table = read("sf0.001", "documents")
    n = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for d, t in zip(table.doc_id, table.text)}
    assert dict(zip(out.doc_id, out.n_tokens)) == n
    lengths, counts = np.unique(list(n.values()), return_counts=True)
    assert sorted(out.padded_length.unique()) == P.optimal_boundaries(lengths, counts, P.BUCKETS)


def test_stages_run_on_nulls_repeats_and_no_rows(spark, docs):
    odd = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, "a b " * 60, None, None, 3), (10**9, "", "en", None, 0)], docs.schema))
    for _, stage in C.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark, docs):
    out = C.run(spark, SF).toPandas()
    assert 0 < len(out) < docs.count() and out.doc_id.is_unique
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "packing"]
