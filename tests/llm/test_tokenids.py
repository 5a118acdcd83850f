import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearth.llm import simple8b as S
from hearth.llm import tokenids as K
from tests.llm.helpers import DOCS, docs_frame, read

value = st.integers(0, 63).flatmap(lambda b: st.integers(0, (1 << b) * 2 - 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(value, max_size=300), st.integers(1, 12))
def test_simple8b_round_trip(values, times):
    x = np.array(values * times, np.uint64)
    words, offsets, escapes = S.encode(x)
    assert (S.decode(words, offsets, escapes, len(x)) == x).all()
    assert len(escapes) == sum(v >= 1 << 60 for v in values) * times


def test_simple8b_packs_tight():
    for bits, per_word in ((0, 120), (1, 60), (7, 8), (12, 5), (15, 4), (16, 3)):
        x = np.full(S.SEGMENT * 4, (1 << bits) - 1, np.uint64)
        words, offsets, _ = S.encode(x)
        assert len(words) == 4 * -(-S.SEGMENT // per_word) and offsets[-1] == len(words)


def test_blocks():
    ids, counts = np.arange(5000) % 49_408, np.array([0, 4999, 0, 1])
    a, b = K.read_block(K.write_block(ids, counts))
    assert (a == ids).all() and (b == counts).all()


ODD = ["", " ", "One, TWO. three!!! it's I'M don't", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>.", "É. ÀÉ! über-Straße; ß, ÿ.",
       "İstanbul ΣΑΣ. ΟΔΟΣ", "é. ȩ́, x́!", "a b\x85c\x1cd e", "日本語、テキスト。 123.45 1,2;3:4",
       "..., ?!) *% $# x% y$z& &&& ** a** b##", "don't. 's 'll'd.", "x" * 3000 + ".", "µ ª º. ªB", "\x00a \x7f.", "😀. 👍🏽!"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzABZ019 \n\t.,'!<|>*é́ßÉΣ _-", max_size=40))
def test_ids_are_the_library_s(text):
    check([text])


def check(texts):
    memo, tok = K._memo(K.default_tokenizer()), Tokenizer.from_file(K.default_tokenizer())
    ids, counts = memo.encode(texts, 2)
    stops = np.cumsum(counts)
    for t, a, b in zip(texts, stops - counts, stops):
        assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids + [2], t


def test_odd_texts():
    check(ODD)
    check([None, "", None])
    check(list(read("sf0.001", "documents").text))


def expected(rows):
    tok, start, out = Tokenizer.from_file(K.default_tokenizer()), 0, []
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_over_the_table(spark):
    docs = read("sf0.001", "documents").sort_values("doc_id")
    got = sorted(map(tuple, K.op10_token_ids(spark, "/root/testdata/sf0.001").collect()))
    assert got == expected(zip(docs.doc_id, docs.text))


def test_edges(spark):
    df = docs_frame(spark, ["b", None, "", "a a", "x " * 30_000]).selectExpr("*", "1 as part", "2 as block")
    df = df.unionByName(df.where("doc_id = 3"))
    df = df.unionByName(spark.createDataFrame([(None, "null id", None, None, None, 1, 2)], df.schema))
    blocks, _ = K.write_token_ids(df)
    got = sorted(map(tuple, K.read_token_ids(blocks).collect()), key=lambda r: r[1])
    assert got == expected([(None, "null id"), (0, "b"), (1, None), (2, ""), (3, "a a"), (3, "a a"), (4, "x " * 30_000)])
    empty, _ = K.write_token_ids(spark.createDataFrame([], DOCS))
    assert K.read_token_ids(empty).collect() == []


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "MEMO_BYTES", 200_000)
    memo, model = K.WordMemo(K.default_tokenizer()), Tokenizer.from_file(K.default_tokenizer())
    texts = read("sf0.001", "documents").text.tolist()
    most = 0
    for t in texts * 2:
        ids, counts = memo.encode([t], 2)
        assert ids.tolist() == model.encode(t, add_special_tokens=False).ids + [2] and counts.tolist() == [len(ids)]
        most = max(most, memo.held)
    new = max(len(t.encode()) for t in texts) * 2 * K.ENTRY_BYTES
    assert most < 200_000 + new and memo.entries
