"""Main text of web pages by repeated runs of a host and page markup.

Pages are gathered by host. The token streams of a host's pages are joined
into one sequence, whose suffix array (prefix doubling up to the run length)
shows the long substrings that distinct pages share. Tokens covered by such
runs are boilerplate; unique runs decide which container of a page is its
article, and outside of a container they are what stays. Markup that is never
article text (menus, forms, adverts, comments ...) goes by its own signs,
whether it repeats or not; an article's own text stays whole, also where
another page quotes or copies it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import stored
from hearth.plans.tables import table
from hearth.session import delete_path

#: Tokens of a repeated run; a power of two, as the suffix array doubles up to it.
RUN_TOKENS = 16
#: Distinct page contents that share a run before it counts as boilerplate.
RUN_PAGES = 3
#: Html of one host that is searched in one task; a larger host is dealt into shards that exchange the hashes of their runs.
SHARD_BYTES = 8 << 20
#: Up to so many hosts larger than that are broadcast with their shard counts (some MB); more are joined.
BROADCAST_HOSTS = 100_000

_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|title|select|xmp|noembed|noframes"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z0-9]+")

# Element names of the HTML standard by what they mean here.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr img label".split())
_JUNK = set("nav footer aside form button menu dialog head fieldset datalist optgroup audio video".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role attributes that mark what is not the article.
_JUNK_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside complementary ad ads "
    "advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations teaser comment comments commentlist disqus reply replies "
    "respond discussion toolbar pagination pager widget widgets search contentinfo dialog copyright".split())
_HEADER_WORDS = {"header", "topbar"}
_MAIN_WORDS = set("article content main post entry story articlebody maincontent postbody".split())
_KEEP = {"html", "body", "main"}


class Block(NamedTuple):
    """Text of one block: words joined by a space, the share of them inside
    links, whether markup rules it out, and the containers around it."""
    words: tuple[str, ...]
    linked: int
    junk: bool
    inside: tuple[int, ...]


def _signs(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes mark junk, a header, a main container."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, False, False
    names, hidden = set(), False
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id", "role"):
            names.update(_NAME.findall(v))
        elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
            hidden = True
    return hidden or bool(names & _JUNK_WORDS), bool(names & _HEADER_WORDS), bool(names & _MAIN_WORDS)


def blocks_of(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in order, and the kind of each container (2: an
    article, 1: a main element, 0: named like one)."""
    blocks: list[Block] = []
    kinds: list[int] = []
    # open elements that matter: (tag, junk, header, container)
    stack: list[tuple[str, bool, bool, int | None]] = []
    text: list[str] = []
    links, linked, at, heading = 0, 0, 0, 0

    def close():
        nonlocal linked
        words = tuple("".join(text).split()) if text else ()
        if words:
            junk = any(j for _, j, _, _ in stack)
            inside = tuple(c for _, _, _, c in stack if c is not None)
            if not junk and any(h for _, _, h, _ in stack) and not (inside and heading):
                junk = True  # a header keeps only the headings of its article
            blocks.append(Block(words, min(linked, len(words)), junk, inside))
        text.clear()
        linked = 0

    def add(part: str):
        nonlocal linked
        if part:
            part = unescape(part) if "&" in part else part
            text.append(part)
            if links:
                linked += len(part.split())

    for m in _TOKEN.finditer(html):
        add(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("select", "textarea"):
                close()
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            if not m["end"] and attrs and tag not in _VOID:
                junk, _, _ = _signs(tag, attrs)
                if junk:
                    close()
                    stack.append((tag, True, False, None))
            elif m["end"] and any(t == tag for t, _, _, _ in stack):
                close()
                while stack.pop()[0] != tag:
                    pass
            continue
        close()
        if tag in _HEADINGS:
            heading = 0 if m["end"] else 1
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and not (attrs and not m["end"]):
            # left open at will; one that was marked ends where the next begins
            while stack and stack[-1][0] == tag:
                stack.pop()
            continue
        if tag in _VOID:
            continue
        if m["end"]:
            if any(t == tag for t, _, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        junk, header, main = _signs(tag, attrs)
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th"):
            while stack and stack[-1][0] == tag:
                stack.pop()
            if not junk:
                continue
        container = None
        if tag in ("article", "main") or main and tag in ("div", "section", "td"):
            container = len(kinds)
            kinds.append(2 if tag == "article" else 1 if tag == "main" else 0)
        stack.append((tag, tag in _JUNK or junk and tag not in _KEEP,
                      tag == "header" or header and tag not in _KEEP, container))
    add(html[at:])
    close()
    return blocks, kinds


def suffix_ranks(tokens: np.ndarray, run: int) -> np.ndarray:
    """For each position the rank of its first ``run`` tokens among all, by
    prefix doubling: equal ranks are equal substrings."""
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while width < run:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        width *= 2
    return rank


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """For each position a 64-bit hash of the first ``run`` word hashes from
    there, by the doubling of :func:`suffix_ranks`: the same in every shard."""
    found, width = words, 1
    while width < run:
        after = np.zeros_like(found)
        after[:-width] = found[width:]
        found = (found ^ found >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + after
        found = (found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        width *= 2
    return found ^ found >> np.uint64(32)


def _n_owners(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct owners of each value below ``n``."""
    owners = int(owner.max()) + 1 if len(owner) else 1
    return np.bincount(np.unique(value * owners + owner) // owners, minlength=n)


class _Streams:
    """Distinct token streams one after the other, a token of its own behind
    each, so that no run crosses them."""

    def __init__(self, streams: list[tuple[str, ...]], run: int):
        sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        words = np.empty(int(sizes.sum()), object)
        words[:] = [w for words in streams for w in words]
        ids, self.vocab = pd.factorize(words)
        ends = np.cumsum(sizes + 1) - 1
        self.owner = np.repeat(np.arange(len(streams)), sizes + 1)
        self.tokens = -1 - self.owner
        inside = np.ones(len(self.tokens), bool)
        inside[ends] = False
        self.tokens[inside] = ids
        self.streams, self.run, self.starts = streams, run, ends - sizes

    def shared(self, least: int) -> np.ndarray:
        """Whether ``least`` streams hold the run at each position."""
        rank = suffix_ranks(self.tokens, self.run)
        return _n_owners(rank, self.owner, int(rank.max()) + 1)[rank] >= least

    def whole(self) -> np.ndarray:
        """The positions of runs that end inside their stream."""
        ends = np.zeros(len(self.tokens) + 1, np.int64)
        np.cumsum(self.tokens < 0, out=ends[1:])
        at = np.arange(max(len(self.tokens) - self.run + 1, 0))
        return at[ends[at + self.run] == ends[at]]

    def hashes(self, run: int) -> np.ndarray:
        of_word = pd.util.hash_array(np.array([*self.vocab, ""], object), categorize=False)
        return run_hashes(of_word[np.maximum(self.tokens, -1)], run)

    def marks(self, at: np.ndarray) -> np.ndarray:
        """For the run at each position the least hash of its half runs: equal
        runs have equal marks, and runs side by side mostly share theirs."""
        half = self.hashes(self.run // 2)
        least = half[at]
        for i in range(1, self.run - self.run // 2 + 1):
            np.minimum(least, half[at + i], out=least)
        return least

    def covered(self, shared: np.ndarray) -> list[np.ndarray]:
        """For each stream which tokens lie in a run that ``shared`` marks at its start."""
        edge = np.zeros(len(self.tokens) + self.run + 1, np.int64)
        hits = np.flatnonzero(shared)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + self.run, -1)
        covered = np.cumsum(edge)[:len(self.tokens)] > 0
        return [covered[a:a + len(words)] for a, words in zip(self.starts, self.streams)]


def covered_tokens(pages: list[list[str]], run: int = RUN_TOKENS, least: int = RUN_PAGES) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run of ``run``
    tokens or more that ``least`` distinct streams share. Equal streams are
    one: a copied page alone makes nothing boilerplate."""
    same: dict[tuple[str, ...], int] = {}
    content = [same.setdefault(tuple(p), len(same)) for p in pages]
    if len(same) < least or sum(map(len, same)) + len(same) < run:
        return [np.zeros(len(p), bool) for p in pages]
    streams = _Streams(list(same), run)
    covered = streams.covered(streams.shared(least))
    return [covered[c] for c in content]


def main_text(blocks: list[Block], kinds: list[int], covered: np.ndarray) -> str:
    """The article. The container with the most unique tokens holds it (with
    the most tokens, where nothing is unique); articles come before main
    elements and those before containers named like one. Without a container,
    blocks that are neither mostly links nor mostly covered stay."""
    ends = np.cumsum([len(b.words) for b in blocks], dtype=np.int64)
    unique = [len(b.words) - int(covered[e - len(b.words):e].sum()) for b, e in zip(blocks, ends)]
    for kind in (2, 1, 0):
        best = None
        for c in (c for c, k in enumerate(kinds) if k == kind):
            mine = [i for i, b in enumerate(blocks) if c in b.inside and not b.junk]
            mass = (sum(unique[i] for i in mine), sum(len(blocks[i].words) for i in mine))
            if mass[1] and (best is None or mass > best[0]):
                best = (mass, mine)
        if best:
            return " ".join(" ".join(blocks[i].words) for i in best[1])
    out = []
    for i, (b, e) in enumerate(zip(blocks, ends)):
        if b.junk or b.linked * 2 > len(b.words):
            continue
        if unique[i] == len(b.words):
            out.append(" ".join(b.words))
        elif unique[i]:  # the unique runs of a block that is covered in part
            own = ~covered[e - len(b.words):e]
            out.append(" ".join(w for w, keep in zip(b.words, own) if keep))
    return " ".join(out)


_ROW = "page_id long, url string, text string, n_chars long, n_tokens long, n_covered long"


def _rows(frame: pd.DataFrame, parsed: list[tuple[list[Block], list[int]]], covered: list[np.ndarray]) -> pd.DataFrame:
    texts = [main_text(blocks, kinds, c) for (blocks, kinds), c in zip(parsed, covered)]
    return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts,
                         "n_chars": [len(t) for t in texts], "n_tokens": [len(c) for c in covered],
                         "n_covered": [int(c.sum()) for c in covered]})


def _extract_host(frame: pd.DataFrame) -> pd.DataFrame:
    parsed = [blocks_of(h) if h else ([], []) for h in frame["html"]]
    return _rows(frame, parsed, covered_tokens([[w for b in blocks for w in b.words] for blocks, _ in parsed]))


# --- hosts of many tasks --------------------------------------------------------------------------

_MARKS = "host string, shards int, shard int, stream binary, marks binary"
_TOLD = "host string, shard int, place long, hashes binary, n binary"
_HEARD = "host string, shard int, hashes binary"


def _words(blocks: list[Block]) -> tuple[str, ...]:
    return tuple(w for b in blocks for w in b.words)


def _stream(words: tuple[str, ...]) -> bytes:
    """The hash of a token stream."""
    return blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _page_marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The marks of each page, without repeats side by side; some MB of html at a time."""
    for frame in frames:
        size = np.cumsum([len(h) if h else 0 for h in frame["html"]], dtype=np.int64)
        for _, some in frame.groupby(size // SHARD_BYTES, sort=False):
            words = [_words(blocks_of(h)[0]) if h else () for h in some["html"]]
            streams = _Streams(words, RUN_TOKENS)
            at = streams.whole()
            marks, owner = streams.marks(at), streams.owner[at]
            new = np.ones(len(at), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1])
            cuts = np.searchsorted(owner[new], np.arange(1, len(words)))
            yield some[["host", "shards", "shard"]].assign(
                stream=[_stream(w) for w in words],
                marks=[m.tobytes() for m in np.split(marks[new], cuts)]).drop_duplicates(["host", "shard", "stream"])


def _told(key: tuple, shards: int, hashes: np.ndarray, owner: np.ndarray, counted: np.ndarray) -> pd.DataFrame:
    """Every hash of a shard once with the number of its streams that count
    there, dealt to as many places as the host has shards."""
    values, code = np.unique(hashes, return_inverse=True)
    once = np.unique(code * max(1, len(counted)) + owner)
    found = np.bincount(once // max(1, len(counted)), counted[once % max(1, len(counted))], len(values))
    n = np.minimum(found, RUN_PAGES).astype(np.uint8)
    place = (values % np.uint64(shards)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    places, cuts = np.unique(place[order], return_index=True)
    cuts = cuts[1:]
    return pd.DataFrame({"host": key[0], "shard": key[1], "place": places,
                         "hashes": [x.tobytes() for x in np.split(values[order], cuts)][:len(places)],
                         "n": [x.tobytes() for x in np.split(n[order], cuts)][:len(places)]})


def _numbers(found: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in found]])


def _shard_marks(key: tuple, frame: pd.DataFrame, away: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates("stream")
    if not len(frame):
        return pd.DataFrame({c: [] for c in ("host", "shard", "place", "hashes", "n")})
    sizes = frame["marks"].map(len).to_numpy(np.int64) // 8
    return _told(key, int(frame["shards"].iloc[0]), _numbers(frame["marks"]), np.repeat(np.arange(len(frame)), sizes),
                 ~frame["stream"].isin(away["hashes"]).to_numpy(bool))


def _shard_runs(key: tuple, frame: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
    """The runs whose mark ``RUN_PAGES`` streams of the host have: no others can be shared by so many."""
    words = list(dict.fromkeys(_words(blocks_of(h)[0]) if h else () for h in frame["html"]))
    if not words:
        return pd.DataFrame({c: [] for c in ("host", "shard", "place", "hashes", "n")})
    streams, away = _Streams(words, RUN_TOKENS), set(heard["hashes"][heard["away"]])
    at = streams.whole()
    at = at[np.isin(streams.marks(at), _numbers(heard["hashes"][~heard["away"]]))]
    return _told(key, int(frame["shards"].iloc[0]), streams.hashes(streams.run)[at], streams.owner[at],
                 np.array([_stream(w) not in away for w in words]))


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """What ``RUN_PAGES`` streams of a host have, for each shard that has it."""
    hashes = [np.frombuffer(h, np.uint64) for h in frame["hashes"]]
    values, code = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["n"]])
    common = values[np.bincount(code, n, len(values)) >= RUN_PAGES]
    return frame[["host", "shard"]].assign(hashes=[h[np.isin(h, common)].tobytes() for h in hashes])


def _extract_shard(frame: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    parsed = [blocks_of(h) if h else ([], []) for h in frame["html"]]
    same: dict[tuple[str, ...], int] = {}
    content = [same.setdefault(_words(blocks), len(same)) for blocks, _ in parsed]
    if not same:
        return _rows(frame, [], [])
    streams = _Streams(list(same), RUN_TOKENS)
    shared, at = np.zeros(len(streams.tokens), bool), streams.whole()
    shared[at[np.isin(streams.hashes(streams.run)[at], _numbers(runs["hashes"]))]] = True
    covered = streams.covered(shared)
    return _rows(frame, parsed, [covered[c] for c in content])


def _extract_shards(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt(host, shards, shard, page_id, url, html)`` as one task
    would find them that held a whole host. Shards tell each other the hashes of
    their marks, then those of the runs with a common mark. Of equal streams the
    one in the first shard counts, the others are away from home.

    Pages are parsed in each of three passes and not kept in between: the text
    of a page is nearly as large as its html, so one exchange of the html is
    what there is on disk at a time, and beside it the hashes."""
    spark = dealt.sparkSession
    marked, marked_path = stored(dealt.select("host", "shards", "shard", "html").mapInPandas(_page_marks, _MARKS), "host-marked")
    places = marked.groupBy("host", "stream").agg(F.collect_set("shard").alias("shards")).where(F.size("shards") > 1)
    away, away_path = stored(places.select("host", F.explode(F.filter("shards", lambda s: s != F.array_min("shards"))).alias("shard"),
                                           F.col("stream").alias("hashes")), "host-away")
    by_shard = dealt.groupBy("host", "shard")

    def common(found: DataFrame, name: str) -> tuple[DataFrame, str]:
        return stored(found.groupBy("host", "place").applyInPandas(_meet, _HEARD), name)
    marks, marks_path = common(marked.groupBy("host", "shard").cogroup(away.groupBy("host", "shard")).applyInPandas(
        _shard_marks, _TOLD), "host-marks")
    delete_path(spark, marked_path)
    heard = marks.withColumn("away", F.lit(False)).unionByName(away.withColumn("away", F.lit(True)))
    runs, _ = common(by_shard.cogroup(heard.groupBy("host", "shard")).applyInPandas(_shard_runs, _TOLD), "host-runs")
    delete_path(spark, marks_path)
    delete_path(spark, away_path)
    return by_shard.cogroup(runs.groupBy("host", "shard")).applyInPandas(_extract_shard, _ROW)


def host(url: Column) -> Column:
    """The host of a url, without port, user and leading www; empty if none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(found, r"^www\.", "")


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars, n_tokens, n_covered`` of each row of
    ``pages(page_id, url, html)``; ``n_covered`` counts the page's tokens in
    runs that repeat on its host.

    A null or empty html has an empty text. Pages without a host are one host.
    Repeated rows appear as often as they occur. Other columns are not read;
    an empty table gives an empty result; html of any length is read whole.

    A host of more than ``shard_bytes`` is dealt into shards, which count the
    runs of the whole host together by 64-bit hashes made by the same doubling,
    so the rows are the same whatever the size of a shard."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    large = (keyed.groupBy(F.col("host").alias("large")).agg(F.sum(F.octet_length("html")).alias("bytes"))
             .where(F.col("bytes") > shard_bytes)
             .select("large", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("shards")))
    large, _ = stored(large, "large-hosts")
    n = large.count()
    if not n:
        return keyed.groupBy("host").applyInPandas(_extract_host, _ROW)
    large = F.broadcast(large) if n <= BROADCAST_HOSTS else large
    dealt = keyed.join(large, keyed.host == large.large).select(
        "host", "shards", F.pmod(F.xxhash64("page_id", "url"), "shards").cast("int").alias("shard"), "page_id", "url", "html")
    rest = keyed.join(large, keyed.host == large.large, "left_anti")
    return rest.groupBy("host").applyInPandas(_extract_host, _ROW).unionByName(_extract_shards(dealt))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extract": op1_html_extract}
ORACLE_SQL: dict[str, str] = {}
