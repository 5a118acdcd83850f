import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from hearth.llm import repair as P
from tests.llm.helpers import read

SCHEMA = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(turn, role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows, kinds):
    """Least (cost, audit) by best-first search over whole audits."""
    n, seen = len(rows), set()
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, initials, final = heapq.heappop(heap)
        if i == n and RIGHT.fullmatch(initials):
            return cost, audit, final
        # what can follow depends on the row and on the last initial only
        state = (i, initials[-1:], not initials)
        if state in seen:
            continue
        seen.add(state)
        steps = [(3, "I", i, r, (r, "")) for r in ("user", "assistant")]
        if i < n:
            (_, role, text), kind = rows[i], kinds[i]
            steps.append((4, "D", i + 1, None, None))
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                steps.append((more, "K", i + 1, role, (role, text)))
                steps += [(3 + more, "R", i + 1, r, (r, text)) for r in ("user", "assistant")]
        for price, letter, j, role, turn in steps:
            now = initials + (role[:1] or "-" if role is not None else "")
            # a beginning of a right conversation
            if role is None or RIGHT.fullmatch(now) or RIGHT.fullmatch(now + "a") or RIGHT.fullmatch(now + "ua"):
                heapq.heappush(heap, (cost + price, audit + letter, j, now, final + ((turn,) if turn else ())))
    raise AssertionError


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        kinds, seen = [], set()
        for _, role, text in mine:
            said = text.rstrip(BLANK)
            kinds.append("blank" if not said else "duplicate" if (role, text) in seen
                         else "truncated" if said[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, final = cheapest(mine, kinds)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost,
                     audit, sha)
    return out


def as_dict(report):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = report.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in cols) for r in rows}


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in read("sf0.01", "conversations")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    assert as_dict(P.op13_conversation_repair(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_random_conversations_with_odd_rows(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "what", "", None, " \t", "end. ", "Yes.", "a" * 5000 + "?", "é。", "x.\x85"]
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rng.randrange(0, 9)):
            turn = None if rng.random() < 0.1 else rng.randrange(0, 12)
            rows.append((conv, turn, rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)))
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", pos long, key string")
    assert as_dict(P.repair(df)[0]) == brute(rows)


def test_turns_come_back_and_are_right(spark):
    df = spark.createDataFrame([(7, t, "assistant", "Hm.") for t in range(6)] + [(8, 0, "system", "Be good.")], SCHEMA)
    report, turns = P.repair(df)
    final = {}
    for r in sorted(turns.collect(), key=lambda r: (r.key, r.seq)):
        final.setdefault(r.key, []).append((r.role, r.text))
    for r in report.collect():
        mine = final.get(str(r.conv_id), [])
        assert RIGHT.fullmatch("".join(a[0] for a, _ in mine))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest()


def test_empty_table_and_conversation_without_rows_left(spark):
    assert P.repair(spark.createDataFrame([], SCHEMA))[0].collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    out = as_dict(P.repair(spark.createDataFrame([(5, gone, "user", "Hi.")], SCHEMA))[0])
    assert out == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_codes_against_search_and_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    kinds = {0: None, 4: "blank", 8: "truncated"}
    lengths = rng.integers(0, 12, 200)
    lengths[:3] = 0
    codes = rng.choice([2, 3], lengths.sum()) + rng.choice([0, 0, 0, 4, 8], lengths.sum())
    other = rng.random(len(codes)) < 0.2
    codes[other] = codes[other] // 4 * 4 + rng.integers(0, 2, other.sum())
    cost, conv, letter, _ = P.cheapest_edits(codes, lengths)
    first = np.cumsum(lengths) - lengths
    for c, (a, n) in enumerate(zip(first, lengths)):
        rows = [(i, names[x & 3], "t.") for i, x in enumerate(codes[a:a + n])]
        want = cheapest(rows, [kinds[x & 12] for x in codes[a:a + n]])
        assert (cost[c], "".join(P.LETTERS[letter[conv == c]])) == want[:2]
    whole = P.cheapest_edits(codes, np.array([len(codes)]))
    monkeypatch.setattr(P, "ROWS_AT_ONCE", 37)
    pieces = P.cheapest_edits(codes, np.array([len(codes)]))
    for a, b in zip(whole, pieces):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("at_once", [3, 50])
def test_streams_do_not_depend_on_batches(monkeypatch, at_once):
    import pandas as pd
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"key": np.repeat([f"{i:03}" for i in range(60)], 5), "code": rng.integers(0, 4, 300)})
    gather = lambda batches: pd.concat(P._plan(iter(batches)))
    one = gather([frame])
    monkeypatch.setattr(P, "ROWS_AT_ONCE", at_once)
    parts = gather([frame.iloc[a:a + 7] for a in range(0, 300, 7)] + [frame.iloc[:0]])
    for out in (one, parts):
        out["audit"] = out["audit"].fillna("-")
    top = lambda df: sorted(df[df.seq < 0][["key", "audit", "cost"]].itertuples(index=False, name=None))
    assert top(one) == top(parts)
    left = lambda df: [tuple(map(str, r)) for r in
                       df[df.seq >= 0].sort_values(["key", "seq"])[["key", "pos", "role"]].itertuples(index=False, name=None)]
    assert left(one) == left(parts)
