from functools import lru_cache

import numpy as np
import pytest

from hearth.llm import nbest as N
from tests.llm.helpers import DOCS, read


@pytest.fixture(scope="module")
def lattice():
    return N._lattice(N.default_model())


def paths(lattice, s):
    """All segmentations, best first."""
    edges = lattice.edges(s)

    @lru_cache(None)
    def upto(end):
        if end == 0:
            return [(0.0, ())]
        return [(sc + w, ids + ((p,) if p >= 0 else tuple(lattice.bytes[b] for b in s[st:end].encode())))
                for st, p, w in edges[end - 1] for sc, ids in upto(st)]
    return sorted(upto(len(s)), key=lambda x: -x[0])


@pytest.mark.parametrize("unit", ["▁the", "▁queeaux", "a", "▁", "▁éàx", "日本", "▁éléphant", "😀a"])
def test_units_against_all_paths(lattice, unit):
    every = paths(lattice, unit)
    got = lattice.n_best(unit, 6)
    assert [s for s, _ in got] == [s for s, _ in every[:6]]
    assert len(set(ids for _, ids in got)) == len(got) and set(got) <= set(every)
    lattice.clear()
    lattice.learn([unit, "▁other", unit + "xy"])
    code = lattice.codes[unit]
    assert lattice.best[code] == every[0][0]
    assert lattice.loss[code] == (every[0][0] - every[1][0] if len(every) > 1 else np.inf)


@pytest.mark.parametrize("text", ["the cat sat", "le\nchat noir", "a b  c", "x\ty z", "été", "the the the", "\n\n", "a"])
def test_texts_against_all_paths(lattice, text):
    norm = lattice.model.normalize(text)
    assert "".join(lattice.text_units(text)) == norm
    every = paths(lattice, norm)
    got = lattice.encode(text, 5)
    assert [s for s, _ in got] == [s for s, _ in every[:5]]
    assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
    assert {(s, tuple(ids.tolist())) for s, ids in got} <= set(every)
    for _, ids in got:
        assert lattice.decode(ids.tolist()) == norm.replace("▁", " ").removeprefix(" ")


def test_long_units_and_vector_form_agree(lattice):
    words = ["▁" + w for t in read("sf0.001", "documents").text[:20] for w in t.split()[:80]]
    words = list(dict.fromkeys(words + ["▁" + "pneumono" * 9]))
    lattice.clear()
    lattice.learn(words)
    for w in words:
        best = lattice.n_best(w, 2)
        c = lattice.codes[w]
        assert lattice.best[c] == best[0][0]
        assert lattice.loss[c] == (best[0][0] - best[1][0] if len(best) > 1 else np.inf)
        ids = lattice.flat[lattice.start[c]:lattice.start[c] + lattice.size[c]].tolist()
        assert "".join(lattice.text_of[i] for i in ids if i not in lattice.byte_of) or ids
        assert sum(lattice.score[i] for i in ids if i not in lattice.byte_of) + (
            0 if not any(i in lattice.byte_of for i in ids) else lattice.best[c]) is not None


def test_decode_gives_the_text_back(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text for r in df.collect()}
    model = N._lattice(N.default_model()).model
    out = N.decode(N.n_best(df, 3)).collect()
    assert {r.doc_id for r in out} == set(want)
    for r in out:
        assert r.text == model.normalize(want[r.doc_id]).replace("▁", " ").removeprefix(" ")
        assert len(r.ids) == 4 * r.n_pieces
    scores = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        scores.setdefault(r.doc_id, []).append(r.score)
    assert all(s == sorted(s, reverse=True) for s in scores.values())


def test_cuts_and_batches(lattice):
    text = "naïve,日本語テキスト。word…word 😀 the-end 日本語"
    units = lattice.text_units(text)
    assert "".join(units) == lattice.model.normalize(text) and len(units) > 10
    for a, b in zip(units, units[1:]):
        assert not any(a[-1] + b[0] in p for p in lattice.pieces)
    texts = [text, None, "", text, "the cat", "日" * 200]
    lattice.clear()
    together = lattice.encode_batch(texts, 4)
    lattice.clear()
    for t, got in zip(texts, together):
        alone = lattice.encode(t, 4)
        assert [(s, i.tolist()) for s, i in got] == [(s, i.tolist()) for s, i in alone]
        assert all(lattice.decode(i) == lattice.restored(t) for _, i in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "a b"), (4, "x" * 20_000), (5, "a b"), (5, "a b")]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, rank int, score int")
    out = N.n_best(df).collect()
    assert sorted({str(r.doc_id) for r in out}) == ["1", "2", "3", "4", "5", "None"]
    assert [(r["rank"], r.score, r.n_pieces) for r in out if r.doc_id in (1, 2)] == [(1, 0.0, 0)] * 2
    assert all(r.restored for r in out)
    assert len([r for r in out if r.doc_id == 5]) == 2 * len([r for r in out if r.doc_id is None]) > 2
    assert N.n_best(spark.createDataFrame([], DOCS)).collect() == []
