"""Repair of damaged conversations by the cheapest edits.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``.
Rows may be kept, given another role or deleted, and empty turns inserted; the
cost dynamic programme runs backwards over (row, state) nodes. Of the cheapest
edit sequences the one whose audit (the initials of its edits) is least in
ASCII order is taken by prefix doubling: nodes are ranked by the first 1, 2, 4,
... letters of the least audit that starts there, pairs of ranks giving the
rank of twice the length, and the doubled pointers give every step of the path.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm.common import stored
from hearth.plans.tables import table

BLANKS = " \t\n\x0b\x0c\r"

#: States: nothing yet, after a system turn, after a user, after an assistant (as the first, a right end).
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of each initial (other, s, u, a); -1: not allowed.
AFTER = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: The only state that a user or assistant turn leads to.
FORCED = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
RIGHT_END = np.array([True, False, False, True])

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = np.array(list("DIKR"))  # in ASCII order
D, I, K, R = range(4)
FAR = np.int64(1) << 40

#: A row's code: its initial (0 other, 1 s, 2 u, 3 a), plus 4 if it must go, plus 8 if truncated.
MUST_GO, IS_TRUNCATED = 4, 8

#: Rows of the conversations that are planned at once, and of a piece of a longer one.
ROWS_AT_ONCE = 65_536


def costs_to_go(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least cost from every node to a right end, for conversations that
    stand one after another in ``codes``; a conversation of n rows has
    4 (n + 1) nodes. All conversations step back together, row by row."""
    first = np.cumsum(lengths) - lengths
    nodes = first + np.arange(len(lengths))  # levels before the conversation
    out = np.empty((len(codes) + len(lengths), 4), np.int64)
    out[nodes + lengths] = [0, INSERT * 2, INSERT, 0]
    order = np.argsort(-lengths, kind="stable")
    many = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    for back, n in enumerate(many, 1):
        own = order[:n]
        level = nodes[own] + lengths[own] - back
        code = codes[first[own] + lengths[own] - back]
        after = out[level + 1]
        best = after + DELETE
        stays = (code & MUST_GO) == 0
        more = np.where(code & IS_TRUNCATED, TRUNCATED, 0)
        to = AFTER[:, code & 3].T
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), FAR) + more[:, None]
        rerole = after[:, FORCED] + (REROLE + more)[:, None]
        best = np.where(stays[:, None], np.minimum(best, np.minimum(kept, rerole)), best)
        u, a = best[:, USER], best[:, ASSISTANT]
        best[:, USER], best[:, ASSISTANT] = np.minimum(u, a + INSERT), np.minimum(a, u + INSERT)
        best[:, :USER] = np.minimum(best[:, :USER], best[:, USER:USER + 1] + INSERT)
        out[level] = best
    return out


def optimal_arcs(codes: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The node that each edit (D, I, K, R) leads to where it lies on a
    cheapest path, else -1: an array of nodes x 4 for consecutive rows, node 4
    i + state standing before row i. The last level has no row after it."""
    n = len(codes)
    arcs = np.full((n + 1, 4, 4), -1, np.int64)
    level = 4 * np.arange(n + 1)[:, None]
    arcs[:, :, I] = np.where(costs == costs[:, FORCED] + INSERT, level + FORCED, -1)
    here, after, level = costs[:-1], costs[1:], level[1:]
    arcs[:-1, :, D] = np.where(here == after + DELETE, level + np.arange(4), -1)
    more = np.where(codes & IS_TRUNCATED, TRUNCATED, 0)[:, None]
    stays = ((codes & MUST_GO) == 0)[:, None]
    to = AFTER[:, codes & 3].T
    kept = np.take_along_axis(after, np.maximum(to, 0), 1) + more
    arcs[:-1, :, K] = np.where(stays & (to >= 0) & (here == kept), level + to, -1)
    arcs[:-1, :, R] = np.where(stays & (here == after[:, FORCED] + REROLE + more), level + FORCED, -1)
    return arcs.reshape(-1, 4)


def least_paths(arcs: np.ndarray, last: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(nodes, letters, steps)``: the paths of least audit from ``starts``
    to nodes that are ``last``, one after another, and the steps of each.

    Edits out of one node have different letters, so the least letter is the
    first pointer; rank 0 is the end, before every letter."""
    here = np.arange(len(arcs))
    has = (arcs >= 0) & ~last[:, None]
    rank = np.where(last, 0, 1 + has.argmax(axis=1))
    hop = np.where(last, here, arcs[here, rank - 1])
    steps, hops, reach = np.where(last, 0, 1), [hop], 1
    while not last[hop[starts]].all():
        # the least audit of twice the length: a rank, then the rank where the pointer ends
        rank = np.unique(rank * (rank.max() + 1) + rank[hop], return_inverse=True)[1]
        steps, hop, reach = steps + steps[hop], hop[hop], 2 * reach
        hops.append(hop)
    # of the edits out of a node, the one of least (letter, rank of the audit that follows)
    follows = np.where(has, np.arange(4) * (rank.max() + 1) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
    choice = follows.argmin(axis=1)
    of = steps[starts]
    step = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
    nodes = np.repeat(starts, of)
    for k, hop in enumerate(hops):
        on = (step >> k) & 1 == 1
        nodes[on] = hop[nodes[on]]
    return nodes, choice[nodes], of


def cheapest_edits(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For conversations one after another in ``codes``: the cost of each, and
    for each edit the conversation, the letter (index into D I K R), and the
    node's row and state as ``4 row + state``. A conversation beyond
    ``ROWS_AT_ONCE`` rows is ranked piece by piece, each piece starting in the
    state in which the one before it ends."""
    costs = costs_to_go(codes, lengths)
    first = np.cumsum(lengths) - lengths
    nodes = first + np.arange(len(lengths))
    cost = costs[nodes, EMPTY]
    if len(lengths) == 1 and lengths[0] > ROWS_AT_ONCE:
        state, found = EMPTY, []
        for a in range(0, lengths[0], ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, lengths[0])
            arcs = optimal_arcs(codes[a:b], costs[a:b + 1])
            last = np.zeros(len(arcs), bool)
            last[-4:] = RIGHT_END & (costs[b] == 0) if b == lengths[0] else True
            at, letter, _ = least_paths(arcs, last, np.array([state]))
            found.append((at + 4 * a, letter))
            end = arcs[at[-1], letter[-1]] if len(at) else state
            state = int(end % 4)
        at, letter = (np.concatenate(x) for x in zip(*found))
        return cost, np.zeros(len(at), np.int64), letter, at
    # a row of its own after each conversation, which leads nowhere
    gap = np.zeros(len(codes) + len(lengths), np.int64)
    gap[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
    arcs = optimal_arcs(gap, np.vstack((costs, np.full((1, 4), FAR)))).reshape(-1, 4, 4)[:-1]
    ends = nodes + lengths
    arcs[ends] = np.where(np.arange(4) == I, arcs[ends], -1)
    last = np.zeros((len(arcs), 4), bool)
    last[ends] = RIGHT_END
    at, letter, steps = least_paths(arcs.reshape(-1, 4), last.ravel(), 4 * nodes)
    conv = np.repeat(np.arange(len(lengths)), steps)
    return cost, conv, letter, at - 4 * nodes[conv]


_PLAN = "key string, seq long, pos long, role string, audit string, cost long"


def _plan(frames):
    """Streams rows sorted by conversation and place; holds one byte a row
    until a conversation ends."""
    key, held, done, size = None, bytearray(), [], 0

    def flush():
        lengths = np.array([len(c) for _, c in done], np.int64)
        codes = np.frombuffer(b"".join(bytes(c) for _, c in done), np.uint8).astype(np.int64)
        cost, conv, letter, at = cheapest_edits(codes, lengths)
        keys = np.array([k for k, _ in done], object)
        text = "".join(LETTERS[letter])
        cut = np.searchsorted(conv, np.arange(len(done) + 1))
        yield pd.DataFrame({"key": keys, "seq": -1, "pos": pd.array([None] * len(done), "Int64"), "role": None,
                            "audit": [text[a:b] for a, b in zip(cut, cut[1:])], "cost": cost})
        stays = letter != D
        conv, letter, at = conv[stays], letter[stays], at[stays]
        pos = pd.array(at // 4, "Int64")
        pos[letter == I] = pd.NA
        role = np.where(letter == K, None, np.array([None, None, "user", "assistant"], object)[FORCED[at % 4]])
        for a in range(0, len(conv), ROWS_AT_ONCE):
            b = a + ROWS_AT_ONCE
            yield pd.DataFrame({"key": keys[conv[a:b]], "seq": np.arange(len(conv))[a:b], "pos": pos[a:b],
                                "role": role[a:b], "audit": None, "cost": pd.array([None] * len(conv[a:b]), "Int64")})

    for frame in frames:
        keys, codes = frame["key"].to_numpy(), frame["code"].to_numpy().astype(np.uint8)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        for a, b in zip(new, [*new[1:], len(keys)]):
            if keys[a] != key:
                if key is not None:
                    # a long conversation is planned alone
                    if done and size + len(held) > ROWS_AT_ONCE:
                        yield from flush()
                        done, size = [], 0
                    done.append((key, held))
                    size += len(held)
                key, held = keys[a], bytearray()
            held += codes[a:b].tobytes()
    if key is not None:
        if done and size + len(held) > ROWS_AT_ONCE:
            yield from flush()
            done = []
        done.append((key, held))
    if done:
        yield from flush()


def _digest(frames):
    """Streams repaired turns sorted by conversation and place into one hash
    a conversation."""
    key, sha = None, None
    for frame in frames:
        out = []
        for k, role, text in zip(frame["key"], frame["role"], frame["text"]):
            if k != key:
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "repaired_sha256"])


def _key(conv: Column) -> Column:
    """A conversation's name; rows with a null conv_id are one conversation."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text, copy``: the rows after damage by the
    checksum of ``conv_id:turn`` (a null in either is a space, as is a null
    role or text)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(_key(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.col("fate")
    return (rows.withColumn("key", _key(F.col("conv_id")))
            .withColumn("fate", F.crc32(F.encode(name, "UTF-8")) % 20).where(fate != 0)
            .withColumn("text", F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(fate == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("key", "conv_id", "turn", "role", "text", "copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows(key, turn, role, text, copy)`` with their place ``pos`` in the
    conversation (by turn, nulls first, then role and text), their first fault
    (blank, duplicate, truncated or null), whether the step from the row before
    is illegal, and whether the turn is new.

    One exchange by conversation; every window sorts inside it."""
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    alike = Window.partitionBy("key", "role", "text").orderBy("pos")
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    step = F.concat(F.substring(F.lag("role").over(order), 1, 1), F.substring("role", 1, 1))
    return (rows.withColumn("pos", F.row_number().over(order).cast("long") - 1)
            .withColumn("illegal", F.coalesce(~step.isin("su", "ua", "au"), F.lit(False)))
            .withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
            .withColumn("seen", F.row_number().over(alike) > 1)
            .withColumn("fault", F.when(said == "", "blank").when(F.col("seen"), "duplicate")
                        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")).drop("seen", "copy"))


def plan_repairs(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``rows(key, pos, role,
    fault)``: one row of ``seq`` -1 with ``audit`` and ``cost``, and the turns
    that remain in order (``pos`` null: inserted; ``role`` null: as it was).

    A conversation passes through one task, sorted, as one byte a row."""
    initial = F.substring("role", 1, 1)
    code = (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
            + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(0)
            + F.when(F.col("fault") == "truncated", IS_TRUNCATED).otherwise(0)).cast("int")
    return (rows.select("key", "pos", code.alias("code")).repartition("key").sortWithinPartitions("key", "pos")
            .select("key", "code").mapInPandas(_plan, _PLAN))


def repaired_turns(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``key, seq, role, text`` of the conversations after their edits."""
    turns = plan.where(F.col("seq") >= 0).select("key", "seq", "pos", F.col("role").alias("given"))
    own = rows.select("key", "pos", "role", "text")
    return turns.join(own, ["key", "pos"], "left").select(
        "key", "seq", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, turns)`` of ``conversations(conv_id, turn, role, text)``:
    what was wrong after damage with each original conv_id and its cheapest
    edits, and the repaired turns themselves.

    Null roles and texts are one space; rows with a null conv_id are one
    conversation; null turns come first. Rows of the same turn follow role and
    text, repeated rows are repeated turns (so all but the first are
    duplicates). A role counts by its first character; one that is not s, u or
    a can only be given another role or deleted. Of the cheapest audits the
    least in ASCII order is taken; it fixes the repaired turns. Texts of any
    length stay in the JVM but for the hash, which reads them in a stream. Other
    columns are not read; an empty table gives empty results."""
    rows, _ = stored(faults(damage(conversations)), "repair-rows")
    plan, _ = stored(plan_repairs(rows), "repair-plan")
    turns = repaired_turns(rows, plan)
    count = lambda c: F.sum(c.cast("long"))
    facts = rows.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn"))).alias("gaps"),
        *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"))
    digest = (turns.repartition("key").sortWithinPartitions("key", "seq").select("key", "role", "text")
              .mapInPandas(_digest, "key string, repaired_sha256 string"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", _key(F.col("conv_id")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    report = (every.join(facts, "key", "left")
              .join(plan.where(F.col("seq") < 0).select("key", "audit", "cost"), "key", "left")
              .join(digest, "key", "left")
              .select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
    return report, turns


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))[0]


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
