import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm import quality as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#|<\n\t\x0b\x85\xa0\x1c😀", max_size=60))
def test_measures(text):
    assert Q.measure_text(text)[:5] == brute(text)


def test_measures_of_null_and_long_texts():
    assert Q.measure_text(None) == Q.measure_text("") == (0,) * 8
    assert Q.measure_text("a b c " * 50_000)[:5] == (150_000, 150_000, 0, 0, 150_000)


def clean(i, n=80):
    rng = np.random.default_rng(i)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n))


def test_verdicts_follow_the_group(spark):
    rows = [(i, clean(i), "en", "a") for i in range(300)]
    rows += [(1000, " ".join(w + "###" for w in clean(5000).split()), "en", "a"),  # symbols
             (1001, clean(5001).upper(), "en", "a"),                              # capitals
             (1002, " ".join(w * 6 for w in clean(5002).split()), "en", "a"),     # long words
             (1003, "too short", "en", "a"), (1004, "x y z " * 40, "en", "a"), (1005, None, "en", "a")]
    # a source where symbols are usual keeps them
    rows += [(2000 + i, " ".join(w + "#" for w in clean(9000 + i).split()), "en", "code") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.measures.base_failed, r.verdict.kept) for r in Q.judge(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (False, True) for i in [*range(300), *range(2000, 2300)])
    assert [got[i] for i in range(1000, 1003)] == [(False, False)] * 3
    assert [got[i] for i in range(1003, 1006)] == [(True, False)] * 3
    assert {r.doc_id for r in Q.quality_filter(df).collect()} == {*range(300), *range(2000, 2300)}


def test_thresholds_are_quantiles_of_the_group(spark):
    texts = [clean(i) for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string")
    row = Q.thresholds(df).first()
    x = np.sort([len(t.replace(" ", "")) / len(t.split()) for t in texts])
    q1, q2, q3 = (x[int(np.ceil(len(x) * q)) - 1] for q in (0.25, 0.5, 0.75))
    assert abs(row.word_length_high - (q2 + max(2.0, Q.SPREAD * (q3 - q2)))) < 0.05 * row.word_length_high
    assert abs(row.word_length_low - (q2 - max(2.0, Q.SPREAD * (q2 - q1)))) < 0.05 * row.word_length_high


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, measures int, verdict int, __tl string"
    rows = [(None, clean(1), None, None, 1, 2, "x"), (1, clean(1), "en", None, 1, 2, "x"),
            (1, clean(1), "en", None, 1, 2, "x"), (2, "", "en", "a", None, None, None), (3, None, None, "a", 1, 1, "y")]
    df = spark.createDataFrame(rows, schema)
    out = Q.quality_filter(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([tuple(r) for r in rows[:3]], key=str)
    assert Q.quality_filter(df.limit(0)).collect() == []
