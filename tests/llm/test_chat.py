import hashlib

from hypothesis import example, given, settings
from hypothesis import strategies as st

from hearth.llm import chat as C

part = st.sampled_from(["<|im_end|>", "<|im_start|>", "<|", "|>", "<", "|", "\\", "\n", "im_end", "user", "a", "é😀", " ", "\r"])
text = st.lists(part, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(text, text), max_size=5))
@example([("user", C.PROBE_TEXT), ("assistant", C.PROBE_TEXT)])
@example([("a\\n\n<|im_end|>", "<\\|im_end|>")])
def test_round_trip(pairs):
    turns = [C.Turn(r, t) for r, t in pairs]
    out, spans, _ = C.format_turns(turns)
    assert [t for t, _, _ in C.parse(out)] == turns
    assert [C.unescape(out[a:b]) for a, b in spans] == [t for _, t in pairs]


def test_only_conflicts_are_escaped():
    out, _, n = C.format_turns([C.Turn("user", "a <| b | <x> <|other|>"), C.Turn("assistant", "<|im_end|>")])
    assert n == 1 and "a <| b | <x> <|other|>" in out and "<\\|im_end|><|im_end|>" in out


def test_grammar_rejects_other_texts():
    good = "<|im_start|>user\nhi<|im_end|>\n"
    assert len(C.parse(good * 2)) == 2 and C.parse("") == []
    for bad in ("hi", good + "x", good[:-1], "<|im_start|>user", "<|im_start|>user\nhi<|im_start|>", good.replace("hi", "<|im_start|>")):
        assert C.parse(bad) is None


def test_edges(spark):
    rows = [(1, 1, "assistant", None, 7), (1, 0, None, "", 7), (1, 0, "assistant", "b", 7), (1, 0, "assistant", "b", 7),
            (None, None, "user", "x" * 200_000, 7), (2, 0, "system", C.PROBE_TEXT, 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert set(out) == {1, 2, None}
    assert [t for t, _, _ in C.parse(out[1].formatted)] == [("", ""), ("assistant", "b"), ("assistant", "b"), ("assistant", "")]
    spans = out[1].loss_spans
    assert [out[1].formatted[s.start:s.end] for s in spans] == ["b", "b", ""]
    assert out[2].escaped_turns == 1 and out[2].loss_spans == [] and out[1].escaped_turns == 0
    assert C.format_conversations(df.limit(0)).collect() == []


def test_probe(spark):
    got = {r.conv_id: r for r in C.op2_chat_format(spark, "/root/testdata/sf0.001").collect()}[-1]
    h = hashlib.sha256(f"user\n{C.PROBE_TEXT}\nassistant\n{C.PROBE_TEXT}\n".encode()).hexdigest()
    assert (got.n_turns, got.turns_sha256, got.loss_chars) == (2, h, len(C.PROBE_TEXT))
    assert got.loss_sha256 == hashlib.sha256(C.PROBE_TEXT.encode()).hexdigest()
