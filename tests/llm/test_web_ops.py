"""URL reputation, nearest neighbours, HTML text and WARC against brute force."""

import hashlib
import html as entities
import os
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, archive, html, queries, urls, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{SF}/pages.parquet")


def key(rows):
    return sorted(str([None if x is None or x != x else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "documents", "embeddings", "benchmark", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLES[name]).to_arrow_table()
    assert sorted(want.schema.names) == columns
    rows = lambda t: key(zip(*(t[c].to_pylist() for c in columns), strict=True))
    assert rows(got.toArrow()) == rows(want)


# URLs


def test_hosts_paths_and_rules(spark):
    given = {
        None: ("", "", None), "no-scheme.com/en/": ("", "", None), "http://": ("", "", None),
        "HTTP://Sub.Example.COM/en/7x?q#f": ("sub.example.com", "/en/7x", "example.com/en/7"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/"), "x://a.net#/de/": ("a.net", "", None),
        "x://a.net/de/8": ("a.net", "/de/8", "net/de/"), "x://m.example.net/de/8?": ("m.example.net", "/de/8", "example.net/de/8"),
        "x://org/es/": ("org", "/es/", "org/es/"), "x://borg/es/": ("borg", "/es/", None), "x://a://b/c": ("a:", "//b/c", None), "x://É.Org?x/y": ("É.org", "", None),
    }
    rows = [(i, u, "old") for i, u in enumerate(given)] + [(0, None, "old")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame([(1, 1), (None, 1), (2, None)], "id long, good int"), queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule) == given[r.url]
        assert r.verdict == ("block" if r.rule in ("com/en/", "example.net/de/8", "org/es/") else "allow")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, spark.createDataFrame([], "id long, good int")).count() == 0


def test_reputation_blocks_only_on_evidence(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.example.com/{i}") for i in range(600)] + [(i, f"http://new{i}.example.com/") for i in range(600, 620)] + [(700, "http://once.example.org/")]
    outcomes = [(i, int(i % 3 != 0 or i % 30 == 0)) for i in range(600)] + [(700, 0)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "id long, good int")).toPandas()
    verdict = dict(zip(got.host, got.verdict))
    assert verdict["bad.example.com"] == "block"
    assert {v for h, v in verdict.items() if h != "bad.example.com"} == {"allow"}


def test_levels_of_hosts(spark):
    given = {"a.b.example.com": ("example.com", "com"), "u:p@x.example.co.uk:8080": ("example.co.uk", "co.uk"), "a.com:8080": ("a.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "com": ("com", "com"), "": ("", ""), "x.y.kawasaki.jp": ("kawasaki.jp", "jp")}
    domain, suffix = urls.levels_of(urls.named_host(F.col("h")))
    got = spark.createDataFrame([(h,) for h in given], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in got} == given
    domain, suffix = urls.levels_of(F.col("h"), ["y.kawasaki.jp", "kawasaki.jp", "co.uk"])
    got = spark.createDataFrame([("w.x.y.kawasaki.jp",), ("w.z.kawasaki.jp",)], "h string").select(domain.alias("d"), suffix.alias("s")).collect()
    assert [tuple(r) for r in got] == [("x.y.kawasaki.jp", "y.kawasaki.jp"), ("z.kawasaki.jp", "kawasaki.jp")]


def test_the_bound_decides_verdicts_of_the_query(spark, tmp_path):
    """Labelled tables on which hosts are blocked, through the query and its SQL."""
    rng = np.random.default_rng(11)
    hosts = [f"{'bad' if i % 3 == 0 else 'fine'}{i}.site{i % 5}.{('com', 'net', 'co.uk')[i % 3]}" for i in range(30)] + ["u@10.0.0.1:80", "10.0.0.1:81", "x.com:8080"]
    pages = [(i, f"http://{hosts[i % 33]}/fr/{i}", "") for i in range(2000)]
    labels = [(i, int(rng.random() > (0.9 if i % 33 % 3 == 0 else 0.05)), int(rng.random() < 0.02)) for i in range(0, 2000, 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op1_url_reputation(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op1_url_reputation"]).to_arrow_table()
    columns = sorted(got.columns)
    rows = lambda t: key(zip(*(t[c].to_pylist() for c in columns), strict=True))
    assert rows(got.toArrow()) == rows(want)
    blocked = {r.host for r in got.where("rule is null and verdict = 'block'").select("host").collect()}
    assert len(blocked) >= 10 and all(hosts.index(h) % 3 == 0 for h in blocked)


# Nearest neighbours


def brute_nearest(ids, vectors, asked, k=5):
    out = []
    v = np.array(vectors, np.float64)
    for i in asked:
        score = (v * v[i]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[i] * v[i]).sum()))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out += [(ids[i], r + 1, ids[j], score[j]) for r, j in enumerate(order)]
    return out


def test_recall_of_the_query(spark):
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids = table.vec_id.to_numpy()
    want = brute_nearest(ids, np.stack(table.embedding), np.flatnonzero(ids % 50 == 0))
    got = queries.op2_nearest(spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == len(want)
    found = {(r.query_id, r.vec_id): r.score for r in got.itertuples()}
    recall = np.mean([(q, v) in found for q, _, v, _ in want])
    assert recall >= 0.97, recall
    assert all(abs(found[q, v] - s) < 1e-12 for q, _, v, s in want if (q, v) in found)


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(2)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same) for i in range(0, 300, 2)] + [(i, rng.standard_normal(8).tolist()) for i in range(1, 300, 2)]
    bad = [(400, None), (450, [0.0] * 8), (500, [1.0] * 7 + [None]), (550, [float("nan")] * 8), (600, [float("inf")] + [1.0] * 7), (None, same), (650, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.nearest(df, "id % 50 = 0").toPandas().sort_values(["query_id", "rank"])
    ids = np.array([r[0] for r in rows])
    want = sorted(brute_nearest(ids, [r[1] for r in rows], np.flatnonzero(ids % 50 == 0)))
    assert [tuple(map(int, r)) for r in got[["query_id", "rank", "id"]].to_numpy()] == [tuple(map(int, r[:3])) for r in want]
    assert ann.nearest(df.where("vec_id in (0, 1, 2)"), "id % 50 = 0").count() == 2
    assert ann.nearest(df.where("vec_id = 0"), "id % 50 = 0").count() == 0
    assert ann.nearest(df.where("false"), "id % 50 = 0").count() == 0


def test_vectors_of_extreme_length_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BASE_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((200, 8))
    rows = [(i, (plain[i] * (1e200, 1.0, 1e-200)[i % 3]).tolist()) for i in range(200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0").toPandas().sort_values(["query_id", "rank"])
    want = sorted(brute_nearest(np.arange(200), plain.tolist(), np.arange(0, 200, 20)))
    assert [tuple(map(int, r)) for r in got[["query_id", "rank", "id"]].to_numpy()] == [tuple(map(int, r[:3])) for r in want]
    assert np.allclose(got.score, [r[3] for r in want], rtol=1e-12)


# HTML


def test_the_article_of_each_page(spark, pages):
    got = queries.op6_html_text(spark, SF).toPandas().set_index("page_id")
    for p in pages.itertuples():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got.text[p.page_id] == "\n".join(b for b in blocks if b)
        assert got.n_chars[p.page_id] == len(got.text[p.page_id]) and got.url[p.page_id] == p.url


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><div class="nav-bar nav"><ul><li><a href=/>Home<li><a href=/b>More</ul></div>
<div class=cookie-notice>We use cookies</div><div id=x><div id=y><h1>Title {n} &amp; more</h1><p>First   <b>bold {n}</b> and<br>line &lt;{n}&gt;<p>Second {n}<ul><li>one {n}<li>two</ul>
<p>Read more at our site</p></div><div class="comments"><p>Nice {n}</p></div></div><form><input><p>Search {n}</p></form><div>Copyright owner, all rights reserved</div><script>if (a<b) x("</p>{n}")</script></body></html>"""


def test_templates_of_a_host_are_found(spark):
    rows = [(n, f"http://h.example.com/{n}", PAGE.format(n=n * 7)) for n in range(12)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(12):
        assert got[n] == f"Title {n * 7} & more\nFirst bold {n * 7} and line <{n * 7}>\nSecond {n * 7}\none {n * 7}"
    copies = [(n, "http://h.example.com/", "<article><p>all the same</p></article>") for n in range(9)]
    assert {r.text for r in html.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"all the same"}


def text_of(page):
    """A page's text where nothing is known of its host."""
    found = html.leaves(page, None)
    best = max((x.main for x in found), default=0)
    return "\n".join(x.text for x in found if x.main == best and (best or not x.menu))


def test_misleading_names_stay_and_named_parts_go():
    assert text_of('<article><p>One</p><div class="social-science note-legal"><p>two</p></div><div class="share-price promo banner">three</div><section role="note">four</section></article>') == "One\ntwo\nthree\nfour"
    assert text_of('<div class="social-science"><p>One</p></div><div class="copyright-law">two</div><div class="cookie-recipes">three</div><div class="advert-free">four</div>') == "One\ntwo\nthree\nfour"
    assert text_of('<article><p>One</p><div class="ad-box">a</div><div id="comments-2">b</div><ul class="site-nav"><li>c</ul><div class="cookie-notice">d</div></article>') == "One"
    assert text_of('<div class="site-footer">a</div><div class="top-banner">b</div><p class="legal-notice">c</p><p>One') == "One"
    assert text_of("<p><a href=x>a whole paragraph that is a link</a></p><p>and one that is not</p>") == "a whole paragraph that is a link\nand one that is not"
    assert text_of("<div><a href=x>a</a></div><div><ul><li><a href=x>b</a><li><a href=y>c</a></ul></div><p>text</p>") == "a\ntext"


def generated(rng, n, article):
    """A host's pages, and what each should give: parts that vary, without those that don't."""
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], k)) + f" {rng.integers(10**9)}"
    rows, want = [], []
    for _ in range(n):
        parts = [words(6) for _ in range(rng.integers(1, 9))]
        extra = [f"<div class=promo-codes>{p}</div>" if rng.random() < 0.2 else f"<p>{p}" for p in parts]
        body = f"<div class=lead-in>Our daily service to you</div><h1>{parts[0]}</h1>{''.join(extra[1:])}<p>All stories end like this one.</p>"
        body = f"<article>{body}</article>" if article else f"<div class=col-1>{body}</div>"
        rows.append(f"<html><body><ul><li><a href=1>{words(1)}</a><li><a href=2>{words(1)}</a></ul>{body}<div class=bottom>Printed on paper</div></body></html>")
        want.append("\n".join(parts))
    return rows, want


@pytest.mark.parametrize("article", [False, True])
def test_slots_decide_on_pages_of_a_host(spark, article, monkeypatch):
    pages, want = generated(np.random.default_rng(7), 30, article)
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (html.BROADCAST_BYTES, -1):  # references and templates broadcast, or joined
        monkeypatch.setattr(html, "BROADCAST_BYTES", bound)
        got = {r.id: r.text for r in html.extract(df).collect()}
        assert [got[i] for i in range(30)] == want
    monkeypatch.setattr(html, "SHARE", 2.0)  # no template: what all pages share stays
    bare = {r.id: r.text for r in html.extract(df).collect()}
    assert all(bare[i] != want[i] and "All stories end like this one." in bare[i] for i in range(30))


def test_near_copies_on_a_host_keep_their_text(spark):
    """Some near copies of one article on a host of other pages, and a host of copies alone."""
    pages, want = generated(np.random.default_rng(8), 20, True)
    copy = lambda k: f"<article><h1>Same</h1>{''.join(f'<p>part {i}' for i in range(20))}<p>last {k}</article>"
    rows = [(i, "http://h.example/", p) for i, p in enumerate(pages)] + [(100 + k, "http://h.example/", copy(k)) for k in range(8)] + [(200 + k, "http://c.example/", copy(k)) for k in range(8)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == w for i, w in enumerate(want))
    for k in range(8):
        assert got[100 + k] == got[200 + k] == "\n".join(["Same", *(f"part {i}" for i in range(20)), f"last {k}"])


def extracted(spark, pages):
    rows = [(i, "http://h.example/", p) for i, p in enumerate(pages)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(pages))]


def test_main_text_around_articles_stays(spark):
    assert extracted(spark, ["<main><h1>Head</h1><p>Long main text</p><article><p>Card</p></article></main>"]) == ["Head\nLong main text\nCard"]
    assert extracted(spark, ["<main><p>More</p><article><p>A long article text</p></article></main>"]) == ["A long article text"]


def test_headings_that_many_articles_have_stay(spark):
    pages = [f"<article><p>Our service</p><h1>Title {n}</h1><h2>Summary</h2><p>first {n}</p><h2>Conclusion</h2><p>last {n}</p><p>Thank you</p></article>" for n in range(6)]
    assert extracted(spark, pages) == [f"Title {n}\nSummary\nfirst {n}\nConclusion\nlast {n}" for n in range(6)]


def test_a_long_notice_is_template(spark):
    notice = "We tell you about the rules of this place. " * 10
    assert extracted(spark, [f"<div><p>unique paragraph {n}</p></div><div><p>{notice}</p></div>" for n in range(6)]) == [f"unique paragraph {n}" for n in range(6)]


def test_comments_inline_elements_and_named_parts_of_articles():
    assert text_of('<article><p>One</p><div class="user-comments"><p>c</p></div><div class="footer">f</div><div class="login-form">l</div></article>') == "One"
    assert text_of('<article><p>One <span class="advert">Buy <b>this</b> <span>now</span></span>two <b hidden>x</b><i>three</i></p></article>') == "One two three"
    assert text_of('<p>One <span class="advert">Buy<p>two</p><div class="no-comments">three</div><div class="has-sidebar">four</div>') == "One\ntwo\nthree\nfour"
    assert text_of('<p>see <a class="advert" href=x>this</a> there <a href=y>and</a> that</p>') == "see there and that"


def brute_template(pages):
    """Texts that are the same in a slot of most pages: each page is aligned with the reference
    by matching trees in all ways (most nodes, then most equal children)."""
    trees = [html.parse(p) for p in pages]
    for t in trees:
        html._finish(t)

    def best(a, b):
        if a.label != b.label:
            return 0, []
        table = {}

        def of(i, j):
            if i == len(a.kids) or j == len(b.kids):
                return 0, 0, []
            if (i, j) not in table:
                n, pairs = best(a.kids[i], b.kids[j])
                n2, same, rest = of(i + 1, j + 1)
                table[i, j] = max([(n + n2, same + (a.kids[i].full == b.kids[j].full), pairs + rest), of(i + 1, j), of(i, j + 1)], key=lambda x: x[:2])
            return table[i, j]

        n, _, pairs = of(0, 0)
        return n + 1, [(a, b), *pairs]

    reference = min(zip(trees, pages), key=lambda x: xxhash64(x[1]))[0]
    slots, votes = [], Counter()
    for t in trees:
        own = {x: y.number for x, y in best(t, reference)[1]}
        slots.append(own)
        votes.update({(own.get(x), x.text) for x in walk(t) if x.text})
    out = []
    for t, own in zip(trees, slots):
        out.append([(x.text, votes[own.get(x), x.text] >= max(4, 0.6 * len(pages))) for x in walk(t) if x.text and not x.skip])
    return out


def walk(node):
    yield node
    for k in node.kids:
        yield from walk(k)


def xxhash64(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


@pytest.mark.parametrize("article", [False, True])
def test_the_query_against_brute_force_where_templates_decide(spark, tmp_path, article):
    """Whole hosts of pages as the query's table: without templates its result would be wrong."""
    rows, want, bare = [], {}, 0
    for h in range(3):
        pages, _ = generated(np.random.default_rng(40 + h), 12, article)
        for k, (page, nodes) in enumerate(zip(pages, brute_template(pages))):
            nodes = [(t, c) for t, c in nodes if not t.startswith(("alpha", "beta", "gamma", "delta", "eps")) or len(t.split()) > 2]
            varying = [i for i, (_, c) in enumerate(nodes) if not c]
            kept = nodes[varying[0] : varying[-1] + 1] if article else [nodes[i] for i in varying]
            bare += len(kept) < len(nodes)
            want[100 * h + k] = "\n".join(t for t, _ in kept)
            rows.append((100 * h + k, f"http://h{h}.example/{k}", page))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op6_html_text(spark, str(tmp_path)).collect()}
    assert got == want and bare == 36


def test_long_lists_of_children_are_aligned():
    def page(tags):
        return "".join(f"<{t}>x</{t}>" for t in tags)

    rng = np.random.default_rng(1)
    a, b = (list(rng.choice(["div", "section", "h2", "pre"], n)) for n in (2500, 2300))
    x, y = html.parse(page(a)), html.parse(page(b))
    html._finish(x), html._finish(y)
    row = np.zeros(len(b) + 1, int)
    codes = np.array([hash(t) for t in b])
    for t in a:
        new = row.copy()
        new[1:] = np.maximum(new[1:], row[:-1] + (codes == hash(t)))
        row = np.maximum.accumulate(new)
    assert len(html.match(x, y)) == 1 + 2 * row[-1]


def test_what_elements_say_of_themselves():
    text = text_of

    assert text('<div style="overflow:hidden" data-x="hidden nav ad">a</div><div hidden>b</div><div style="display: none">c</div><p aria-hidden=true>d<p aria-hidden="false">e') == "a\ne"
    assert text('<div class="Main-Nav">a</div><div id="ads_top">b</div><div class="shadow navy">c</div><div role="navigation">d</div>') == "c"
    assert text('<header>site</header><main><article><header><h1>T</h1></header><p>x</p><aside>y</aside><footer>z</footer><section class="comments"><article class="comment">r</article></section></article><p>w</p></main>') == "T\nx"
    assert text("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>a<dd>b</dl><pre> k  l\n m</pre>&nbsp;&lt;&#233;&nbsp;") == "1\n2\n3\na\nb\nk l m\n<é"
    assert text("<ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>see <a href=z>this</a> in the text</p>") == "see this in the text"


def test_html_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain  text"), (4, "u", deep), (5, "u", "<p>a" * 4000), (6, "u", "<p>a<script>never closed"), (7, "u", "<<p>x</p></p></div>y<!-- no end"), (8, "u", '<a "' * 3000), (None, "u", "<p>n"), (3, "u", "plain  text")]
    got = sorted((r.id or 0, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert len(got) == len(rows)
    assert got[1:3] == [(1, ""), (2, "")] and (3, "plain text") in got and (4, "deep") in got and (6, "a") in got
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_is_maximal():
    def count(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + count(x, y))
        return 1 + m[-1][-1]

    rng = np.random.default_rng(0)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if depth < 3 else 'x'}</{t}>" for t in rng.choice(["div", "section", "ul"], rng.integers(0, 4)))

    for _ in range(60):
        a, b = html.parse(page()), html.parse(page())
        order_a, order_b = html._finish(a), html._finish(b)
        found = html.match(a, b)
        assert len(found) == count(a, b) and len(set(found.values())) == len(found)
        assert all(order_a[i].label == order_b[j].label for i, j in found.items())


# WARC


def test_round_trip_and_revisits(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(5, "u5", big), (3, "u3", big), (9, "a\r\nb", big), (4, "u4", "small"), (2, "u2", "small"), (7, None, None), (8, "u8", ""), (3, "u3", big), (None, "n", big)]
    path = archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = archive.read(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.payload.decode()
        assert (r.record_type == "revisit") == (r.refers_to is not None)
        if r.record_type == "revisit":
            assert r.refers_to == "urn:page:3" and r.payload == b"" and r.payload_length == len(big.encode())
        else:
            assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest() and len(r.payload) == r.payload_length
            assert text in (big, "small", "")
    assert sum(r.record_type == "response" and r.payload_length > 100 for r in got) == 1
    assert {r.target_uri for r in got} == {r[1] for r in rows}
    empty = archive.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert archive.read(spark, empty).count() == 0


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * 50_000 + str(i // 2)) for i in range(40)]
    path = archive.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    got = archive.read(spark, path, payload=False).where("record_type = 'revisit' and payload_length > 10")
    assert "payload" not in got.columns and got.count() == 20
    reader = warc.WarcReader({"path": path}, True)
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringStartsWith(("target_uri",), "u")]))
    assert len(left) == 1 and len(reader.partitions()) == 1
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 20
    store, root = warc.filesystem(path)
    for name in reader.partitions()[0].files:
        with store.open_input_file(name) as f:
            records = warc.Records(f, True)
            assert sum(1 for _ in records) == 40 and records.decoded < 40 * 2100
    small = warc.WarcReader({"path": path, "partition_bytes": "1"}, True)
    assert len(small.partitions()) == len(reader.partitions()[0].files)


def test_appends_keep_and_overwrites_replace(spark, tmp_path):
    pages = lambda a, b: spark.createDataFrame([(i, f"u{i}", f"text {i}") for i in range(a, b)], "page_id long, url string, html string")
    path = archive.write(pages(0, 30), f"file://{tmp_path}/w")
    archive.write(pages(30, 50), path)
    got = archive.read(spark, path).select(archive.page_of(F.col("record_id")).alias("i")).collect()
    assert sorted(r.i for r in got) == list(range(50))
    archive.write(pages(7, 9), path, mode="overwrite")
    archive.write(pages(9, 10), path)
    got = archive.read(spark, path).select(archive.page_of(F.col("record_id")).alias("i")).collect()
    assert sorted(r.i for r in got) == [7, 8, 9]
    assert sum(f.endswith(".warc.gz") for f in os.listdir(f"{tmp_path}/w")) <= 3 * 4


URLS = ["http://a/?q=%0Ax%25", "http://a/ x", " lead", "trail\t", "a\nb%0A", "%", "", "\r", "é\u2028", "x\u3000", "<http://b>", "http://a/a,b=c"]


def test_urls_and_ids_read_back_as_they_were(spark, tmp_path):
    path = archive.write(spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    rows = archive.read(spark, path, payload=False)
    got = {r.i: r.target_uri for r in rows.select(archive.page_of(F.col("record_id")).alias("i"), "target_uri").collect()}
    assert got == dict(enumerate(URLS))
    for i, u in enumerate(URLS):
        assert [r.i for r in rows.where(F.col("target_uri") == u).select(archive.page_of(F.col("record_id")).alias("i")).collect()] == [i]


def test_records_conform(spark, tmp_path):
    import gzip

    big = "b" * 200
    path = archive.write(spark.createDataFrame([(1, "u", big), (2, "u", big), (None, "v", big), (None, "w", "short")], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    heads = []
    for f in os.listdir(f"{tmp_path}/w"):
        if f.endswith(".gz"):
            heads += [x.split("\r\n\r\n")[0].split("\r\n") for x in ("WARC/1.1" + x for x in gzip.decompress((tmp_path / "w" / f).read_bytes()).decode().split("WARC/1.1")[1:])]
    assert len(heads) == 4
    for h in heads:
        fields = dict(x.split(": ", 1) for x in h[1:])
        assert re.fullmatch(r"<[^<>]+:[^<>]+>", fields["WARC-Record-ID"]) and re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] == "<urn:page:1>" and fields["Content-Length"] == "0"
        else:
            assert fields["Content-Type"].startswith("application/http")
    assert sum(r.refers_to is not None for r in archive.read(spark, path).collect()) == 2


def test_digests_may_be_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "BROADCAST_DIGESTS", 0)
    rows = [(i, "u", "same" * 50 if i % 3 else f"own{i}" * 50) for i in range(60)]
    path = archive.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = archive.read(spark, path).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] == "revisit") == [("revisit", "urn:page:1", 39)]


def test_warc_query_pushes_record_types(spark):
    plan = queries.op10_warc(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and "SortMergeJoin" not in plan
    # pushed predicates are gone from the plan: no filter is left above the scans
    assert "Filter (" not in plan


def test_archives_of_others(spark, tmp_path):
    import gzip

    row = {"record_type": "response", "record_id": "<urn:uuid:1>", "target_uri": "http://a/", "refers_to": None, "payload_digest": None, "payload_length": 3, "payload": b"abc"}
    one = warc.record(row)
    two = warc.record(row | {"record_id": "<urn:uuid:2>", "payload": b"q" * 300_000})
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = archive.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_id, r.payload) for r in got) == sorted([("<urn:uuid:1>", b"abc"), ("<urn:uuid:2>", b"q" * 300_000)] * 2)
    assert archive.read(spark, f"file://{tmp_path}").where("record_id = '<urn:uuid:1>'").count() == 2
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(two)[:-40])
    with pytest.raises(Exception):
        archive.read(spark, f"file://{tmp_path}").collect()


sys.setrecursionlimit(10_000)
