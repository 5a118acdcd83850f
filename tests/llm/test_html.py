from pathlib import Path

import numpy as np
import pytest

from hearth.llm import html as H


def one(page, covered=None):
    blocks, kinds = H.blocks_of(page)
    n = sum(len(b.words) for b in blocks)
    return H.main_text(blocks, kinds, np.zeros(n, bool) if covered is None else covered)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">menu</a></ul></nav><!-- ad <article> --><div class="ad">buy</div>
%s<aside>side</aside><div id="cookie-notice">cookies</div><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Head &amp; more</h1><p>one<br>two <b>th</b>ree<p>four\n\t five</article>", "Head & more one two three four five"),
    ("<article><header><h1>Head</h1><span>by me</span></header><p>text</p><footer>tags</footer></article>", "Head text"),
    ("<main><p>text &lt;b&gt; &#233;&eacute;&nbsp;x</p><form><input><p>mail</p><button>go</button></form></main>", "text <b> éé x"),
    ("<article><p>text</p><section class='comments'><article><p>first!</p></article></section></article>", "text"),
    ("<article><p>text</p></article><div id=\"comments\"><p>a reader</p></div>", "text"),
    ("<div class='post-content'><p>text</p><div class=\"share-buttons\">tweet</div><p>more</p></div><div>other</div>", "text more"),
    ("<p>plain text</p><p><a href=x>only a link</a></p>", "plain text"),
    ("<article><p class=lead>a</p><p class='ad'>b</p><p>c</p><ul><li class=promo>d<li>e</ul></article>", "a c e"),
    ("<article><p>text</p><div hidden>no</div><div style='display: none'>no</div><p title='a > b'>end", "text end"),
    ("<article><h2>a<i>b</i>c</h2><table><tr><td>1<td>2</table><pre>x\n y</pre><noscript>js</noscript></article>", "abc 1 2 x y"),
    ("<article><p>5 < 6 and a<b></article>", "5 < 6 and a"),
    ("<ARTICLE><P>Upper</P><SCRIPT>no</SCRIPT></ARTICLE>", "Upper"),
    ("<article></article>", ""),
])
def test_article(body, text):
    assert one(PAGE % body) == text


def test_odd_pages():
    assert H.blocks_of("") == ([], [])
    for page in ("<", "<p", "</p>", "<!--", "<script>", "&", "&#x;", "</article>" * 50, "<div>" * 3000 + "x"):
        one(page)
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert one(long) == " ".join(["word & word"] * 50_000)


def brute(pages, run, least):
    streams = set(map(tuple, pages))
    seen = {}
    for s in streams:
        for i in range(len(s) - run + 1):
            seen.setdefault(s[i:i + run], set()).add(s)
    out = []
    for p in pages:
        c = np.zeros(len(p), bool)
        for i in range(len(p) - run + 1):
            if len(seen[tuple(p[i:i + run])]) >= least:
                c[i:i + run] = True
        out.append(c.tolist())
    return out


def test_suffix_array_finds_shared_runs():
    rng = np.random.default_rng(0)
    shared = [f"s{i}" for i in range(30)]
    pages = []
    for k in range(12):
        own = [str(x) for x in rng.integers(0, 40, rng.integers(0, 60))]
        cut = int(rng.integers(0, 20))
        pages.append(own + shared[cut:cut + int(rng.integers(0, 30))] + own[::-1])
    pages += [pages[0], [], ["x"]]
    for run in (2, 4, 8):
        assert [c.tolist() for c in H.covered_tokens(pages, run, 3)] == brute(pages, run, 3)


def test_boilerplate_without_markup_goes_and_unique_runs_stay(spark):
    note = " ".join(f"note{i}" for i in range(20))
    rows = [(k, f"http://www.a.org/{k}", f"<body><p>{note}</p><p>p{k} own text of the page {k}</p><p>x{k} {note}</p></body>")
            for k in range(5)]
    rows += [(9, "http://b.org/", f"<body><p>{note}</p></body>"), (10, None, None), (11, "", ""), (None, "odd", "<p>t</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as shard", "3 as text")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert [got[k].text for k in range(5)] == [f"p{k} own text of the page {k} x{k}" for k in range(5)]
    assert got[9].text == note and got[10].text == got[11].text == "" and got[None].text == "t"
    assert got[0].n_covered == 40 and got[0].n_chars == len(got[0].text)
    assert H.extract(df.limit(0)).collect() == []
    assert H.extract(df.union(df)).count() == 2 * len(rows)


def test_an_article_stays_whole_where_others_quote_it(spark):
    quote = " ".join(f"q{i}" for i in range(40))
    rows = [(k, "http://a.org/", f"<article><p>{quote}</p><p>own {k}</p></article>") for k in range(4)]
    rows += [(7, "http://a.org/", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df, shard_bytes=600).collect()}
    assert got == {k: f"{quote} own {k % 7}" for k in (0, 1, 2, 3, 7)}


def test_host(spark):
    urls = ["https://www.A.org:80/x?y", "http://u:p@b.org/#c", "ftp://c.org", None, "", "no url", "http://d.org?x@y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(H.host(df.url)).collect()] == ["a.org", "b.org", "c.org", "", "", "", "d.org"]


def test_shards_find_what_a_whole_host_finds(spark):
    rng = np.random.default_rng(3)
    note = [" ".join(f"n{j}_{i}" for i in range(20)) for j in range(12)]
    rows = []
    for k in range(60):
        # notes of two to five pages each, far fewer than shards, and pages copied with another markup
        body = "".join(f"<p>own{k} {note[j]} x{k}</p>" for j in rng.choice(12, int(rng.integers(0, 4)), replace=False))
        rows.append((k, "http://a.org/", f"<body>{body}<p>text {k}</p></body>"))
        if k % 7 == 0:
            rows += [(100 + k, "http://a.org/", f"<div>{body}<p>text {k}</p></div>"), rows[-1]]
    rows += [(300, "http://a.org/", None), (None, "http://a.org/x", "<p>t</p>"), (301, "http://b.org/", f"<p>{note[0]}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, H.extract(df).collect()))
    assert sum(r.n_covered > 0 for r in H.extract(df).collect()) > 20
    for size in (20_000, 500):
        assert sorted(map(str, H.extract(df, shard_bytes=size).collect())) == want


def test_shards_keep_hashes_and_no_texts(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    note = " ".join(f"note{i}" for i in range(20))
    rows = [(k, "http://a.org/", f"<body><p>{note}</p><p>{' '.join(rng.bytes(4).hex() for _ in range(300))}</p></body>")
            for k in range(200)]
    rows += [(k, "http://a.org/", None) for k in (300, 301)] + [(400 + k, f"http://a.org/{k}", rows[0][2]) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want, written, whole = sorted(map(str, H.extract(df).collect())), [], H.stored

    def stored(table, name):
        out, path = whole(table, name)
        written.append(sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet")))
        return out, path
    monkeypatch.setattr(H, "stored", stored)
    assert sorted(map(str, H.extract(df, shard_bytes=20_000).collect())) == want
    df.write.parquet(str(tmp_path / "pages"))
    # texts would be as large as the pages
    assert len(written) > 1 and sum(written) < 0.6 * sum(f.stat().st_size for f in (tmp_path / "pages").rglob("*.parquet"))
