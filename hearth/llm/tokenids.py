"""Token ids of documents in a word-aligned binary format.

Documents are put in ascending doc_id order by a range exchange, encoded and
written as blocks: a header, the id count of each document, the word offset
of each segment, Simple-8b words, escapes. Spark's own writer commits the
blocks (one binary value each, with the doc_ids beside it) into a table, so a
lost executor or a repeated task leaves no half-written file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm import simple8b
from hearth.llm.common import stored
from hearth.plans.tables import table

END_ID = 2
#: A block is closed at the first document end beyond this many ids.
BLOCK_IDS = 1 << 18
#: Bytes after which a worker forgets words that it met once, and what an entry takes beside its word and ids.
MEMO_BYTES, ENTRY_BYTES = 128 << 20, 150
#: Characters of texts that are encoded together (one text at least).
BATCH_CHARS = 1 << 18
#: Words that stay whole: characters beyond Latin-1, or what may be a special token.
_ODD = re.compile(r"[^\x00-\xff]|<\||\|>")
#: A lower-case line cut between a letter and closing punctuation, or whole.
_PARTS = re.compile(r"^(?:([^'\n]*[a-zªµºà-öø-ÿß])([.,;:!?)*%$#&]+)|(.+))$", re.M)
_HEADER = struct.Struct("<4sIQQII")
_MAGIC = b"S8B1"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordMemo:
    """Ids of words, each encoded once by the tokenizers library.

    For a vocabulary that drops white space and never joins what it
    separates, the ids of a text are those of its blank-separated words in
    turn. Plain Latin words that differ in case or closing punctuation share
    the work as well, as the normaliser lowers them and the pre-tokenizer
    cuts between a letter and a punctuation mark."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(1)  # a word reaches the library once
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(self.suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.parts: dict[str, int] = {}
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int64)
        self.flat, self.used, self.entries, self.held = np.zeros(1 << 14, np.uint32), 0, 0, 0

    def forget(self) -> None:
        """Drop words met once since the last time; all, if that frees less than half."""
        often = self.uses[:self.entries] > 1
        words = [(w, c) for w, c in self.codes.items() if often[c] and w]
        parts = [(p, c) for p, c in self.parts.items() if often[c]]
        kept = np.flatnonzero(often)
        sizes, ids = self.size[kept], self._gather(kept)[0]
        self.clear()
        if ENTRY_BYTES * (len(words) + len(kept)) + 4 * len(ids) > MEMO_BYTES // 2:
            return
        moved = np.cumsum(often) - 1
        self._keep(sizes, ids)
        self.uses[:self.entries] = 1
        self.codes = {w: int(moved[c]) for w, c in words}
        self.parts = {p: int(moved[c]) for p, c in parts}
        self.held += sum(map(len, self.codes)) + sum(map(len, self.parts)) + ENTRY_BYTES * len(words)

    def _keep(self, sizes: np.ndarray, ids: np.ndarray) -> range:
        """New entries of so many ids each; their codes."""
        code, to = self.entries, self.entries + len(sizes)
        while to > len(self.start):
            self.start, self.size, self.uses = (
                np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.uses))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.size[code:to] = sizes
        self.start[code:to] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.entries = to
        self.held += ENTRY_BYTES * len(sizes) + 4 * len(ids)
        return range(code, to)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in turn, and how many each has.

        Where pieces at the end of a word have a sign of their own, words of
        letters are encoded as one text, which saves most of the library's
        work for each call, and are told apart by that sign. Should the signs
        not be as many as the words, they are encoded one by one."""
        if self.suffix and all(p.isalpha() for p in parts):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids,
                           np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(parts) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are not remembered: as two parts, where one of
        plain Latin letters closes with punctuation, as one otherwise."""
        text = b"\n".join(words).decode()
        plain = text.split("\n")
        odd: list[str] = []
        if _ODD.search(text):
            unlike = [(not w.isascii() or "|" in w) and bool(_ODD.search(w)) for w in plain]
            odd = list(compress(plain, unlike))
            like = [not x for x in unlike]
            words = [*compress(words, like), *compress(words, unlike)]
            plain = list(compress(plain, like))
        cut = _PARTS.findall("\n".join(plain).lower()) if plain else []
        firsts = [core or whole for core, _, whole in cut] + odd
        tails = [tail for _, tail, _ in cut] + [""] * len(odd)
        new = [p for p in dict.fromkeys(chain(firsts, filter(None, tails))) if p not in self.parts]
        letters = [p.isalpha() and (p.isascii() or not _ODD.search(p)) for p in new]
        for some in (list(compress(new, letters)), [p for p, x in zip(new, letters) if not x]):
            for k in range(0, len(some), 4096):
                ids, sizes = self._ids(some[k:k + 4096])
                self.parts.update(zip(some[k:k + 4096], self._keep(sizes, ids)))
                self.held += sum(map(len, some[k:k + 4096]))
        codes = np.fromiter(map(self.parts.__getitem__, firsts), np.int64, len(firsts))
        second = np.fromiter(map(self.parts.get, tails, repeat(-1)), np.int64, len(tails))
        two = np.flatnonzero(second >= 0)
        if len(two):
            both = np.stack((codes[two], second[two]), axis=1)
            self.uses[:self.entries] += np.bincount(both.ravel(), minlength=self.entries)
            codes[two] = self._keep(self.size[both].sum(axis=1), self._gather(both.ravel())[0])
        self.codes.update(zip(words, codes.tolist()))
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries in turn, and where each entry's end."""
        sizes = self.size[codes]
        upto = np.cumsum(sizes)
        shift = self.start[codes] - (upto - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(upto[-1] if len(upto) else 0)], upto

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by ``end``, and their counts."""
        if self.held > MEMO_BYTES:
            self.forget()
        if b"" not in self.codes:  # stands for the end of a text
            self.codes[b""] = self._keep(np.array([1]), np.array([end]))[0]
        words, ends = [], []
        for t in texts:
            if t:
                words += t.encode().split()
            words.append(b"")
            ends.append(len(words))
        codes = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            self.learn(list(dict.fromkeys(words[i] for i in missing.tolist())))
            codes[missing] = [self.codes[words[i]] for i in missing.tolist()]
        self.uses[:self.entries] += np.bincount(codes, minlength=self.entries)
        ids, upto = self._gather(codes)
        stops = upto[np.array(ends, np.int64) - 1] if ends else np.zeros(0, np.int64)
        return ids, np.diff(stops, prepend=0)


@lru_cache(maxsize=2)
def _memo(path: str) -> WordMemo:
    return WordMemo(path)


def write_block(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One block: the ids of whole documents and how many each has."""
    words, offsets, escapes = simple8b.encode(ids)
    head = _HEADER.pack(_MAGIC, len(counts), len(ids), len(words), len(offsets), len(escapes))
    return b"".join((head, np.asarray(counts, "<u8").tobytes(), offsets.astype("<u4").tobytes(),
                     words.astype("<u8").tobytes(), escapes.tobytes()))


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, counts)`` of a block."""
    magic, n_docs, n_ids, n_words, n_offsets, n_escapes = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEADER.size
    counts = np.frombuffer(data, "<u8", n_docs, at)
    at += counts.nbytes
    offsets = np.frombuffer(data, "<u4", n_offsets, at)
    at += offsets.nbytes
    words = np.frombuffer(data, "<u8", n_words, at)
    escapes = np.frombuffer(data, np.uint8, n_escapes, at + words.nbytes)
    return simple8b.decode(words, offsets, escapes, n_ids), counts.astype(np.int64)


def _runs(batch: pa.RecordBatch):
    """Slices of about ``BATCH_CHARS`` characters."""
    upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        stop = int(np.searchsorted(upto, before + BATCH_CHARS)) + 1
        yield batch.slice(start, stop - start)
        start = stop


def _encode_partition(path: str, end: int):
    def run(batches):
        memo, part = _memo(path), TaskContext.get().partitionId()
        doc_ids, ids, counts, held, block = [], [], [], 0, 0

        def out():
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([write_block(np.concatenate(ids), np.concatenate(counts))], pa.binary())],
                ["part", "block", "doc_ids", "payload"])

        for batch in batches:
            for some in _runs(batch):
                i, c = memo.encode(some.column(1).to_pylist(), end)
                doc_ids += some.column(0).to_pylist()
                ids.append(i)
                counts.append(c)
                held += len(i)
                if held >= BLOCK_IDS:
                    yield out()
                    doc_ids, ids, counts, held = [], [], [], 0
                    block += 1
        if doc_ids:
            yield out()
    return run


def write_token_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, text: str = "text",
                    doc_id: str = "doc_id", end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Write the ids of every whole text, in ascending doc_id order, and
    return the table of blocks and its path (a new one in the shared folder
    where ``path`` is None).

    A null or empty text has the end id only. Null doc_ids come first; rows of
    one doc_id are ordered by text. Repeated rows are written as often as they
    occur; an empty table gives an empty one. Other columns are not read. A
    text of any length lies in one block."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))
    blocks = ordered.mapInArrow(_encode_partition(tokenizer or default_tokenizer(), end_id),
                                "part int, block long, doc_ids array<long>, payload binary")
    if path is None:
        return stored(blocks, "token-ids")
    blocks.write.parquet(path)
    return spark.read.parquet(path), path


def _decode_blocks(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            some = batch.slice(row, 1)
            ids, counts = read_block(some.column(3)[0].as_py())
            raw, stops = ids.astype("<u4"), np.cumsum(counts)
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * (b - n):4 * b]) for b, n in zip(stops.tolist(), counts.tolist())]
            n = len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(some.column(2)[0].as_py(), pa.int64()),
                pa.array(np.full(n, some.column(0)[0].as_py(), np.int32)),
                pa.array(np.full(n, some.column(1)[0].as_py(), np.int64)),
                pa.array(stops - counts), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"])


def read_token_ids(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from
    the blocks. ``start`` adds up block totals: inside a part by a window over
    its blocks, across parts on the driver, one number for each part."""
    docs = blocks.select("part", "block", "doc_ids", "payload").mapInArrow(
        _decode_blocks, "doc_id long, part int, block long, inside long, n_tokens long, ids_crc32 long")
    docs, _ = stored(docs, "token-index")
    sizes = docs.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    totals = sorted(sizes.groupBy("part").agg(F.sum("n")).collect())
    before = np.cumsum([0] + [r[1] for r in totals]).tolist()
    offsets = blocks.sparkSession.createDataFrame(
        [(r[0], b) for r, b in zip(totals, before)], "part int, before long")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = (sizes.withColumn("upto", F.coalesce(F.sum("n").over(w), F.lit(0)))
            .join(offsets, "part").select("part", "block", (F.col("upto") + F.col("before")).alias("base")))
    return docs.join(base, ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _ = write_token_ids(table(spark, sf_dir, "documents"))
    return read_token_ids(blocks)


QUERIES = {"op10_token_ids": op10_token_ids}
ORACLE_SQL: dict[str, str] = {}
