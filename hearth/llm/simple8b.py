"""Simple-8b: as many integers as fit into each 64-bit word.

A word's top four bits select how many values of how many bits its other 60
bits hold. Values are coded in segments of ``SEGMENT`` whose word offsets are
kept, so that all segments of a block are coded, and any are decoded, side by
side. Values of more than 60 bits are escaped: their word holds the low 60
bits and a list beside the words holds the high four, in order.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1024
# Fixed values of the coding: selector -> values in a word, bits of each. Selector 0 escapes.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_PAYLOAD = np.uint64((1 << 60) - 1)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, as uint8."""
    w = np.zeros(len(values), np.uint8)
    top = int(values.max()).bit_length() if len(values) else 0
    for b in range(top):
        w += values >= np.uint64(1 << b)
    return w


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, segment_offsets, escapes)`` of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    segments = -(-n // SEGMENT)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint8)
    reach = int(COUNTS.max())
    flat = np.zeros(segments * SEGMENT, np.uint64)
    flat[:n] = values
    # beyond a segment's end nothing needs a bit, so its last word may have room to spare
    wide = np.zeros((segments, SEGMENT + reach), np.uint8)
    wide[:, :SEGMENT] = _widths(flat).reshape(segments, SEGMENT)
    most = {1: wide}
    for c in sorted(set(COUNTS.tolist()) - {1}):
        a = max(x for x in most if x < c)
        while a * 2 < c:  # overlapping windows cover c when a is half of it at least
            m = most[a].copy()
            m[:, :-a] = np.maximum(m[:, :-a], most[a][:, a:])
            a *= 2
            most[a] = m
        m = most[a].copy()
        m[:, :a - c] = np.maximum(m[:, :a - c], most[a][:, c - a:])
        most[c] = m
    pick = np.where(wide > 60, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        pick[most[int(COUNTS[s])] <= BITS[s]] = s
    pick = pick[:, :SEGMENT].ravel()
    # follow the chain of words in all segments at once
    at = np.arange(segments, dtype=np.int64) * SEGMENT
    ends = np.minimum(at + SEGMENT, n)
    starts = []
    while len(at):
        starts.append(at)
        at = at + COUNTS[pick[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    starts = np.sort(np.concatenate(starts))
    chosen = pick[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((flat, np.zeros(reach, np.uint64)))
    last = (starts // SEGMENT + 1) * SEGMENT
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        if BITS[s] == 0:
            continue
        for k in range(int(COUNTS[s])):
            i = starts[rows] + k
            v = np.where(i < last[rows], padded[i], np.uint64(0)) & _PAYLOAD
            words[rows] |= v << np.uint64(k * int(BITS[s]))
    escapes = (flat[starts[chosen == 0]] >> np.uint64(60)).astype(np.uint8)
    offsets = np.searchsorted(starts, np.arange(segments + 1) * SEGMENT).astype(np.uint32)
    return words, offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values behind ``encode``'s result, all segments at once."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    segment = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    first = before[offsets[:-1].astype(np.int64)]
    starts = segment * SEGMENT + before - first[segment]
    out = np.zeros((len(offsets) - 1) * SEGMENT + int(COUNTS.max()), np.uint64)
    last = (segment + 1) * SEGMENT
    for s in np.unique(chosen).tolist():
        if BITS[s] == 0:
            continue
        rows = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            i = starts[rows] + k
            v = (words[rows] >> np.uint64(k * int(BITS[s]))) & mask
            if k:
                inside = i < last[rows]
                i, v = i[inside], v[inside]
            out[i] = v
    if len(escapes):
        out[starts[chosen == 0]] |= escapes.astype(np.uint64) << np.uint64(60)
    return out[:n]
