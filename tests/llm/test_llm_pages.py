"""Main text of pages, and embedding near-dedup against brute force."""

import random
import re
import time
import tracemalloc
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from parity import SF_DIR

from convoweave.llm import main_text as mt, rows as rows_module, vector_dedup as vd


def test_parse_and_landmarks():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; more</h1><p>One <b>bold</b><br>line<p>Two&nbsp; words
    <ul><li>a<li>b</ul><aside>Aside</aside><div class="ad-slot ad">Buy</div><form>Name <input></form><script>var t = "</p>";</script></article>
    <section id="comments">Nice!</section></main><footer>&copy; x</footer><!-- gone --></body></html>"""
    assert mt.main_text(html) == "Head & more\n\nOne bold line\n\nTwo words\n\na\n\nb"
    assert mt.main_text(None) == mt.main_text("") == mt.main_text("<nav>x</nav>") == ""
    assert mt.main_text("<p>a<div>b</div>c <span>d</span>") == "a\n\nb\n\nc d"
    assert mt.main_text("plain < text & more") == "plain < text & more"
    assert mt.main_text("<div>" * 5000 + "deep") == "deep"


def test_deep_nests_keep_their_place():
    deep = "<div>" * 200 + "text" + "</div>" * 200
    assert mt.main_text(f"<div id=page><article>{deep}<p>rest</p></article></div>") == "text\n\nrest"
    menu = "<div>" * 200 + "<nav><a>Menu</a></nav><form>Name</form>text" + "</div>" * 200
    assert mt.main_text(f"<article>{menu}</article>") == "text"
    pages = [f"<body>{'<div>' * 3000}<b>Shop</b>{'<span>' * 3000}word {k}{'</div>' * 3000}<p>rest {k}</p></body>" for k in range(4)]
    assert mt.main_text(pages[0], rule_of(pages)) == "word 0\n\nrest 0"


def rule_of(pages):
    """The wrapper that all of `pages` give."""
    reference = mt.packed(min(pages, key=len))
    counts, slots = Counter(), {}
    for digest, *rest in (t for p in pages for t in mt.told(p, reference)[1]):
        counts[digest] += 1
        slots[digest] = rest
    varying = {}
    for digest, (place, plain, link) in slots.items():
        if counts[digest] < 0.8 * len(pages):
            a, b = varying.get(place, (0, 0))
            varying[place] = a + counts[digest] * plain, b + counts[digest] * link
    return mt.wrapper(reference, [d for d, c in counts.items() if c >= 0.8 * len(pages)], varying)


def site(k, words):
    return f"<html><head><title>Title {k}</title></head><body><div>Shop of things</div><div>About | Contact</div><h1>Title {k}</h1><p>{words}</p><div>All rights reserved</div></body></html>"


def test_wrapper_drops_what_is_constant_on_a_host(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(k, f"http://one.example/{k}", site(k, " ".join(word() for _ in range(20)))) for k in range(60)]
    rows += [(100, "http://two.example/", site(0, "alone")), (101, None, site(1, "no url")), (None, "http://one.example/x", site(7, "no id")), (5, "http://one.example/5", rows[5][2]), (102, "http://one.example/e", None)]
    got = mt.main_texts(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for k in range(60):
        assert text[k].split("\n\n")[0] == f"Title {k}"
        assert len(text[k].split("\n\n")) == 2
    assert "Shop of things" in text[100]  # one page tells no template
    assert text[None] == "Title 7\n\nno id"
    assert text[102] == ""
    assert mt.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_of_all_layouts_without_titles(spark):
    rows = [(k, f"http://one.example/{k}", f"<body><div>Shop</div><p>words {k}</p></body>") for k in range(40)]  # no titles
    rows += [(100 + k, f"http://one.example/{k}", f"<body><section><div>Wiki</div><div>Terms</div><p>entry {k}</p></section></body>") for k in range(6)]
    rows += [(200 + k, f"http://one.example/{k}", "<title>Same</title><body><section><section><p>copied</p></section></section></body>") for k in range(9)]  # one page
    rows += [(300, "http://one.example/a", "<body><div>Shop</div><div><div><p>odd</p></div></div></body>")]  # a layout of its own
    rows += [(400 + k, "http://two.example/", f"<title>Same</title><body><div>{'Top' if k else ''}</div><p>text {k}</p></body>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in mt.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(40)] == [f"words {k}" for k in range(40)]
    assert [got[100 + k] for k in range(6)] == [f"entry {k}" for k in range(6)]
    assert [got[200 + k] for k in range(9)] == ["copied"] * 9
    assert got[300] == "odd"
    assert [got[400 + k] for k in range(5)] == [f"text {k}" for k in range(5)]


def plain_matching(a, b):
    """Simple tree matching as in the textbook, over collapsed trees."""
    if a.key != b.key:
        return 0
    m = [[0] * (len(b.runs) + 1) for _ in range(len(a.runs) + 1)]
    for i, x in enumerate(a.runs):
        for j, y in enumerate(b.runs):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_matching(x[0], y[0]))
    return m[-1][-1] + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>x", "</p>", "<b>", "</b>", "<ul><li>y", "</ul>"]), max_size=40), st.lists(st.sampled_from(["<div>", "</div>", "<p>x", "</p>", "<b>", "</b>", "<ul><li>y", "</ul>"]), max_size=40))
def test_simple_tree_matching(one, two):
    a, b = (mt.shaped(mt.parse("".join(x))) for x in (one, two))
    size, pairs = mt.matched(a, b)[a.shape, b.shape]
    assert size == plain_matching(a, b)
    assert pairs == sorted(pairs)
    order = {id(n): k for k, n in enumerate(mt.below(b))}
    found = mt.places(a, b, order)
    assert len({v for v in found.values()}) <= size <= len(found)


def test_long_rows_are_halved(monkeypatch):
    rng = np.random.default_rng(5)
    weights = rng.integers(0, 4, (5, 6))
    a, b = rng.integers(0, 5, 40), rng.integers(0, 6, 50)
    weigh = lambda pairs: sum(weights[a[i], b[j]] for i, j in pairs)
    whole = mt.aligned(weights, a, b)
    monkeypatch.setattr(mt, "CELLS", 30)
    halved = mt.aligned(weights, a, b)
    assert weigh(whole) == weigh(halved) == mt.totals(weights[a], b)[-1]
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(halved, halved[1:], strict=False))


def test_wide_and_broken_pages_take_seconds():
    row = lambda k: "".join(f"<p>w{k}</p><ul><li>{i}</ul>" for i in range(10_000))
    pages = [f"<body><div>Shop</div><div>{row(k)}</div></body>" for k in range(4)]
    began = time.monotonic()
    assert mt.main_text(pages[1], rule_of(pages)).count("w1") == 10_000
    for junk in ("<a ", "<a '", "<script ", "<!x", "<div '\"", "<p class"):
        mt.main_text(junk * (1_000_000 // len(junk)))
    assert time.monotonic() - began < 60


def test_only_marks_of_boxes_go_from_an_article():
    html = """<body><article><h2 class="section-header">Title</h2><div class="section-header"><h3>Part</h3></div><p class="search">How to search</p>E <math><mi>mc</mi></math> z
    <svg><text>drawn</text></svg><p id="related-work">Work</p><table class="menu-card"><tr><td>Soup</table><div class="ad-slot">Buy</div><div class="comment-list">Nice</div>
    <section class="comments">Great</section><ul class="share"><li>Tell</ul><div class="reader-comments">Wow</div><div id="comments-section" role="x">Hm</div>
    <section id="sharing-data-between-threads">Threads</section><div class="all-about-the-ads">Ads</div><form>Name</form><footer>By</footer><header><b>Head</b></header></article></body>"""
    want = ["Title", "Part", "How to search", "E mc z drawn", "Work", "Soup", "Threads", "Ads", "Head"]
    assert mt.main_text(html).split("\n\n") == want
    pages = [html.replace("Work", f"Work {k}").replace("Part", f"Part {k} {'x' * k}") for k in range(5)]
    assert "Title" not in mt.main_text(pages[1], rule_of(pages))  # the same on all pages: template
    assert [x for x in mt.main_text(pages[1], rule_of(pages)).split("\n\n")] == ["Part 1 x", "Work 1"]


def test_wide_pages_of_unlike_siblings_take_seconds_and_little_memory():
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    ids = [name() for _ in range(8000)]
    pages = ["<body><b>Shop</b><div>" + "".join(f'<div id="{i if k else name()}"><i>t</i>word {k} {n}</div>' for n, i in enumerate(ids)) + "</div></body>" for k in range(3)]
    reference = mt.packed(pages[1])
    began = time.monotonic()
    tracemalloc.start()
    assert len(mt.told(pages[2], reference)[1]) > 8000
    assert len(mt.told(pages[0], reference)[1]) > 8000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert time.monotonic() - began < 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5)), max_size=25, unique_by=lambda p: p[:2]))
def test_chains_weigh_most(points):
    points = sorted(points, key=lambda p: (p[0], -p[1]))
    weight = {p[:2]: p[2] for p in points}
    found = mt.chained(iter(points))
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
    best = {}
    for k, (r, c, w) in enumerate(points):
        best[k] = w + max((best[j] for j in range(k) if points[j][0] < r and points[j][1] < c), default=0)
    assert sum(weight[p] for p in found) == max(best.values(), default=0)


def test_hosts_of_few_pages_have_wrappers_of_their_own(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    page = lambda shop, body: f"<body><div>{shop}</div><div><p>{body}</p></div><div>Terms of {shop}</div></body>"
    bodies = [text(30) for _ in range(12)]
    rows = [(k, f"http://shop{k // 2}.example/{k}", page(f"Shop {k // 2}", bodies[k])) for k in range(8)]  # two pages a host
    copied = [(20 + k, f"http://copy.example/{k}", f"<body><section><p>{bodies[8]}</p></section><section>Advert {k}</section></body>") for k in range(2)]
    alone = [(30 + k, f"http://alone{k}.example/", f"<body><main><div>Top</div><div><p>{bodies[9 + k]}</p></div></main></body>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in mt.main_texts(spark.createDataFrame(rows + copied + alone, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(8)] == bodies[:8]
    assert all(bodies[8] in got[20 + k] for k in range(2))  # rather copies than pages of one template
    assert [got[30 + k] for k in range(3)] == bodies[9:]  # hosts of one page, taken together by their layout


def unmarked(html):
    return re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", html).replace(' class="ad"', "")


def test_wrappers_decide_where_nothing_is_marked(spark):
    """Menus, adverts and footers that differ from page to page, in elements that say nothing."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    bare = spark.createDataFrame([(r["page_id"], r["url"], unmarked(r["html"])) for r in rows], pages.select("page_id", "url", "html").schema)
    got = {r["page_id"]: r["text"] for r in mt.main_texts(bare).collect()}
    for r in rows:
        assert got[r["page_id"]] == article_of(r["html"])
        assert mt.main_text(unmarked(r["html"])) != article_of(r["html"])


def article_of(html):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(x for x in blocks if x)


def test_large_wrappers_are_joined_by_salted_keys(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    want = sorted(map(tuple, mt.main_texts(pages).collect()))
    monkeypatch.setattr(rows_module, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mt.main_texts(pages).collect())) == want


def test_articles_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in mt.op4_html_extraction(spark, SF_DIR).collect():
        assert r["text"] == article_of(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def brute(vectors, threshold=0.95):
    ids = [i for i, v in vectors if v is not None]
    x = np.array([v for _, v in vectors if v is not None], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(ids)).min(axis=1))
        if (new == label).all():
            return {i: (int(near[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}, int(near.sum())
        label = new


def test_embeddings_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    want, links = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vd.op6_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    assert got.keys() == want.keys()
    assert sum(n for n, _ in got.values()) >= 0.98 * links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_recall_at_the_threshold_and_split_buckets(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(150):  # pairs right above the threshold
        a = rng.normal(size=48)
        b = rng.normal(size=48)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(k, list(a)), (k + 1, list(0.9505 * a + np.sqrt(1 - 0.9505**2) * b))]
        k += 2
    centre = rng.normal(size=48)
    rows += [(k + j, list(centre + 0.02 * rng.normal(size=48))) for j in range(120)]  # one group of near vectors, over many parts
    data = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want, links = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vd.near_vectors(data, tile=16).collect()}
    assert sum(n for n, _ in got.values()) >= 0.97 * links
    pairs = sum(n for i, (n, _) in got.items() if i < 300)
    assert pairs >= 0.9 * 300
    assert all(got[i] == want[i] for i in range(300, 420))


def planted(pairs, seed, low=0.95, high=0.955):
    """Rows of pairs of vectors with cosines from `low` to `high`."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(pairs):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(low, high)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    return rows


def test_recall_of_pairs_right_above_the_threshold(spark):
    rows = planted(2000, 6)
    want, links = brute(rows)
    assert links >= 3990
    got = {r["vec_id"]: r["n_links"] for r in vd.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= want[i][0] for i in want)
    assert sum(got.values()) >= 0.99 * links


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, nan]), (6, [inf, 0.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e38, 0.0])]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, digest string")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in vd.near_vectors(data).collect())
    assert got == [
        (-1, 0, None, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
        (10, 0, 10, True), (11, 3, 1, False),
    ]
    assert vd.near_vectors(data.limit(0)).count() == 0


def test_lengths_that_collide_are_told_apart():
    """Vectors of two lengths in one bucket: those of one length still meet."""
    rng = np.random.default_rng(1)
    rows = [(1, rng.normal(size=8)), (2, None), (3, rng.normal(size=4)), (4, None)]
    rows = [(1, rows[0][1]), (2, rows[0][1] * 1.001), (3, rows[2][1]), (4, rows[2][1] * 2)]
    batch = pa.RecordBatch.from_pylist(
        [{"bucket": 5, "part": 0, "a": 0, "b": 0, "at": 0, "id": i, "n": 1, "vec": vd.packed(v), "buckets": [5], "tables": [0]} for i, v in rows],
        pa.schema([*((k, pa.int64()) for k in ("bucket", "part", "a", "b", "at", "id", "n")), ("vec", pa.binary()), ("buckets", pa.list_(pa.int64())), ("tables", pa.list_(pa.int32()))]),
    )
    found = [r for b in vd.meet(iter([batch]), 0.95) for r in b.to_pylist()]
    assert {(r["a"], r["links"]) for r in found if r["links"]} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert {(r["a"], r["b"]) for r in found if r["b"]} == {(2, 1), (4, 3)}
