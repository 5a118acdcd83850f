"""N-best SentencePiece segmentation.

The pieces of the model form a lattice over the normalised text. Forward
Viterbi scores are the exact cost to go for an A* search that runs backward
from the end, so complete paths leave its queue best first. Between two
characters that no piece has side by side no edge crosses, so a text's lattice
is a chain of unit lattices: units are solved once, many at a time, and a
text's N best paths are merged from the alternatives of its units with the
smallest losses.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.plans.tables import table

N_BEST = 4
#: Entries, and characters in them, after which a worker's memory of units starts anew.
MEMO_UNITS, MEMO_CHARS = 1 << 19, 1 << 23
#: Units whose alternatives are remembered as well, before it starts anew.
MEMO_WAYS = 1 << 16
#: Characters of texts whose units are learnt together (one text at least).
BATCH_CHARS = 1 << 18
#: Units up to this long are solved side by side, longer ones one by one.
SIDE_BY_SIDE = 48
UNKNOWN_PENALTY = 10.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceLattice:
    """Lattices over a SentencePiece model's pieces, whose own scores add up
    along a path. A character that no piece covers is one edge, written as its
    UTF-8 byte pieces, at the least piece score less ``UNKNOWN_PENALTY``."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text_of = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [i for i in range(len(self.text_of))
                 if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        self.score = np.array([m.get_score(i) for i in range(len(self.text_of))])
        self.pieces = {self.text_of[i]: i for i in plain}
        self.longest = max(map(len, self.pieces))
        usual = self.score[plain][self.score[plain] > -1e8]
        self.unknown = float(usual.min()) - UNKNOWN_PENALTY
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        # two characters that no piece has side by side are a place that no edge crosses
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.pieces:
            at = self.letter[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        # beginnings of pieces by length: sorted hashes, and the piece that ends there or -1
        self.tables = []
        for n in range(1, self.longest + 1):
            some = sorted({p[:n] for p in self.pieces if len(p) >= n})
            h = self._hash(np.array([list(map(ord, p)) for p in some], np.uint64).reshape(len(some), n))
            order = np.argsort(h)
            ids = np.array([self.pieces.get(p, -1) for p in some], np.int64)
            self.tables.append((h[order], ids[order]))
        text = [bytes((self.byte_of[i],)) if i in self.byte_of else p.replace("▁", " ").encode()
                for i, p in enumerate(self.text_of)]
        self.text_size = np.fromiter(map(len, text), np.int64, len(text))
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer(b"".join(text), np.uint8)
        self.clear()

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            h = PieceLattice._step(h, chars[:, k])
        return h

    @staticmethod
    def _step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        h = (h ^ char) * _MIX
        return h ^ (h >> np.uint64(29))

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ways: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.chars = 0
        self.best, self.loss = np.zeros(1 << 12), np.zeros(1 << 12)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end in a unit the edges ``(start, piece or -1, score)``."""
        out = []
        for end in range(1, len(unit) + 1):
            here = [(s, self.pieces[unit[s:end]], float(self.score[self.pieces[unit[s:end]]]))
                    for s in range(max(0, end - self.longest), end) if unit[s:end] in self.pieces]
            if not any(s == end - 1 for s, _, _ in here):
                here.append((end - 1, -1, self.unknown))
            out.append(here)
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths (fewer if there are no more), best first.
        Among equal scores the search follows the path it is on, so a long run
        of one character, whose paths tie without number, costs its length."""
        edges = self.edges(unit)
        forward = [0.0]
        for here in edges:
            forward.append(max(forward[s] + w for s, _, w in here))
        order, done = count(0, -1), []
        queue = [(-forward[-1], next(order), len(unit), 0.0, None)]
        while queue and len(done) < n:
            _, _, at, behind, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend([path[0]] if path[0] >= 0 else [self.bytes[b] for b in unit[path[1]].encode()])
                    path = path[2]
                done.append((behind, tuple(ids)))
                continue
            for s, piece, w in edges[at - 1]:
                heapq.heappush(queue, (-(forward[s] + w + behind), next(order), s, w + behind, (piece, s, path)))
        return done

    def _side_by_side(self, units: list[str]) -> None:
        """Best path and loss of the second best of units of like length, by
        forward Viterbi over all of them at once that keeps the two best
        scores of each place: the second best path to a place takes another
        last edge than the best, or the same one after the second best."""
        m, size = len(units), max(map(len, units))
        chars = np.zeros((size, m), np.uint64)
        lens = np.fromiter(map(len, units), np.int64, m)
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(m), lens)
        start = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        chars[start, row] = flat
        # pieces by their length, from the starts whose characters so far begin a piece
        left, h, found = lens[row] - start, np.zeros(len(flat), np.uint64), []
        for n in range(1, min(self.longest, size) + 1):
            some = np.flatnonzero(left >= n)
            row, start, left = row[some], start[some], left[some]
            h = self._step(h[some], chars[start + n - 1, row])
            known, of = self.tables[n - 1]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            some = np.flatnonzero(known[at] == h)
            row, start, left, h, piece = row[some], start[some], left[some], h[some], of[at[some]]
            if not len(row):
                break
            real = np.flatnonzero(piece >= 0)
            found.append((start[real] + n, row[real], piece[real]))
        most = max(1, len(found))
        w = np.full((size + 1, most, m), -np.inf)  # by end and piece length - 1
        ids = np.full((size + 1, most, m), -1, np.int32)
        for n, (end, r, piece) in enumerate(found):
            w[end, n, r], ids[end, n, r] = self.score[piece], piece
        alone = w[1:, 0]
        alone[np.isneginf(alone)] = self.unknown
        first, second = np.full((size + 1, m), -np.inf), np.full((size + 1, m), -np.inf)
        came, rows = np.zeros((size + 1, m), np.int64), np.arange(m)
        first[0] = 0
        for e in range(1, size + 1):
            k = min(most, e)
            via = first[e - k:e][::-1] + w[e, :k]
            last = via.argmax(axis=0)
            first[e], came[e] = via[last, rows], last
            via[last, rows] = second[e - 1 - last, rows] + w[e, last, rows]
            second[e] = via.max(axis=0)
        total = first[lens, rows]
        loss = total - second[lens, rows]
        at, live, steps = lens.copy(), rows, []
        sizes = np.zeros(m, np.int64)
        odd = np.zeros(m, bool)
        while len(live):
            n = came[at[live], live]
            piece = ids[at[live], n, live]
            steps.append((live, sizes[live], piece))
            odd[live[piece < 0]] = True
            sizes[live] += 1
            at[live] -= n + 1
            live = live[at[live] > 0]
        plain = np.flatnonzero(~odd)
        base = np.cumsum(np.where(odd, 0, sizes)) - 1  # where a unit's last id goes
        out = np.zeros(int(base[-1]) + 1, np.int32)
        for r, step, piece in steps:
            some = ~odd[r]
            out[base[r[some]] - step[some]] = piece[some]
        self._keep([units[r] for r in plain.tolist()], total[plain], loss[plain], sizes[plain], out)
        for r in np.flatnonzero(odd).tolist():  # characters without a piece are written as bytes
            path, e = [], int(lens[r])
            while e:
                n = int(came[e, r])
                p = int(ids[e, n, r])
                path.extend([p] if p >= 0 else [self.bytes[b] for b in units[r][e - 1].encode()][::-1])
                e -= n + 1
            self._keep([units[r]], total[r:r + 1], loss[r:r + 1], [len(path)], path[::-1])

    def _keep(self, units: list[str], best, loss, sizes, ids) -> None:
        code, to = len(self.codes), len(self.codes) + len(units)
        while to > len(self.start):
            self.best, self.loss, self.start, self.size = (
                np.concatenate((x, np.zeros_like(x))) for x in (self.best, self.loss, self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.codes.update(zip(units, range(code, to)))
        self.chars += sum(map(len, units))
        self.best[code:to], self.loss[code:to], self.size[code:to] = best, loss, sizes
        self.start[code:to] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self, units: list[str]) -> None:
        units = sorted(units, key=len)
        short = units[:bisect_right(units, SIDE_BY_SIDE, key=len)]
        k = 0
        while k < len(short):
            step = max(64, 20_000 // len(short[k]))
            self._side_by_side(short[k:k + step])
            k += step
        for unit in units[len(short):]:
            found = self.n_best(unit, 2)
            loss = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            self._keep([unit], found[0][0], loss, [len(found[0][1])], found[0][1])

    def text_units(self, text: str | None) -> list[str]:
        """The normalised text cut at the places that no piece crosses."""
        text = self.model.normalize(text) if text else ""
        if not text:
            return []
        at = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = (np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encode_batch(self, texts: list[str | None], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """``encode`` of each text, with the new units of all of them learnt together."""
        if len(self.codes) > MEMO_UNITS or self.chars > MEMO_CHARS or len(self.ways) > MEMO_WAYS:
            self.clear()
        cut = [self.text_units(t) for t in texts]
        self.learn([u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.codes])
        return [self._encode_units(units, n) for units in cut]

    def encode(self, text: str | None, n: int) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best ``(score, ids)`` of a whole text."""
        return self.encode_batch([text], n)[0]

    def _encode_units(self, units: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        if not units:
            return [(0.0, np.zeros(0, np.int32))]
        codes = np.fromiter(map(self.codes.__getitem__, units), np.int64, len(units))
        sizes = self.size[codes]
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[codes] - (upto - sizes), sizes) + np.arange(upto[-1])]
        best = float(self.best[codes].sum())
        # a path among the n best changes only units whose loss is among the n - 1 smallest
        loss = self.loss[codes]
        some = np.zeros(0, np.int64)
        if n > 1:  # of equal losses the first in the text
            some = np.flatnonzero(loss <= np.partition(loss, min(n - 1, len(loss)) - 1)[min(n - 1, len(loss)) - 1])
            some = some[np.argsort(loss[some], kind="stable")[:n - 1]]
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for u in sorted(some.tolist()):
            if not np.isfinite(loss[u]):
                continue
            options = self.ways.get((units[u], n))
            if options is None:
                options = self.ways[units[u], n] = self.n_best(units[u], n)
            ways = sorted(((lost + (options[0][0] - s), change + (((u, path),) if r else ()))
                           for lost, change in ways for r, (s, path) in enumerate(options)),
                          key=lambda x: x[0])[:n]
        out = []
        for lost, change in ways:
            parts, at = [], 0
            for u, path in change:
                parts += [ids[at:upto[u] - sizes[u]], np.array(path, np.int32)]
                at = upto[u]
            out.append((best - lost, np.concatenate([*parts, ids[at:]])))
        return out

    def decode(self, ids) -> str:
        """The normalised text behind ids, without the space before it."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        sizes = self.text_size[ids]
        upto = np.cumsum(sizes)
        flat = self.text_flat[np.repeat(self.text_start[ids] - (upto - sizes), sizes) + np.arange(upto[-1])]
        return flat.tobytes().decode().removeprefix(" ")

    def restored(self, text: str | None) -> str:
        """What ``decode`` has to give for every segmentation of a text."""
        return self.model.normalize(text).replace("▁", " ").removeprefix(" ") if text else ""


@lru_cache(maxsize=2)
def _lattice(path: str) -> PieceLattice:
    return PieceLattice(path)


def _runs(texts: list[str | None]):
    """Slices of about ``BATCH_CHARS`` characters."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH_CHARS or k + 1 == len(texts):
            yield slice(start, k + 1)
            start, held = k + 1, 0


def _segment(path: str, n: int):
    def run(batches):
        lattice = _lattice(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in _runs(texts):
                rows = []
                for d, t, found in zip(doc_ids[some], texts[some], lattice.encode_batch(texts[some], n)):
                    whole = lattice.restored(t)
                    rows += [(d, r + 1, s, len(ids), ids.astype("<u4").tobytes(), lattice.decode(ids) == whole)
                             for r, (s, ids) in enumerate(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float64(), pa.int64(),
                                                                 pa.binary(), pa.bool_()))],
                    ["doc_id", "rank", "score", "n_pieces", "ids", "restored"])
    return run


def n_best(docs: DataFrame, n: int = N_BEST, model: str | None = None, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, rank, score, n_pieces, ids, restored`` of the ``n`` best
    segmentations of each whole text (fewer if it has fewer), ``ids`` as
    little-endian unsigned 32-bit integers; ``restored`` says whether they
    decode to the normalised text.

    A null, empty or blank text has one segmentation without pieces, of score
    0. Equal scores come in the order in which the search finds them, the
    same for equal texts. Null ids and repeated rows come through as they are;
    other columns are not read; an empty table gives an empty result."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _segment(model or default_model(), n), "doc_id long, rank int, score double, n_pieces long, ids binary, restored boolean")


def decode(segmented: DataFrame, model: str | None = None) -> DataFrame:
    """``segmented`` with the ``text`` that its ids stand for."""
    path = model or default_model()

    def run(batches):
        lattice = _lattice(path)
        for batch in batches:
            texts = [lattice.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, "text"])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segmented.schema.fields)
    return segmented.mapInArrow(run, f"{ddl}, text string")


def op6_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = n_best(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), "restored")


QUERIES = {"op6_nbest_pieces": op6_nbest_pieces}
ORACLE_SQL: dict[str, str] = {}
