"""Hard negatives, whitening and page extraction against brute force and hand-made pages."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives, markup, page_slots, spectra

VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ("row", "id", "rank", "anchor", "score", "x", "n", "component", "host", "key", "text", "limits")


def clashing(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in df.columns])


def vector_rows(seed, n, dims, labels=3, spread=2.0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.uniform(-spread, spread, dims).round(1).astype(float).tolist(), int(rng.integers(labels)))
            for i in range(n)]
    # Equal vectors under several ids, so that scores tie.
    return [(i, rows[i % 7][1] if i % 5 == 0 else v, label) for i, v, label in rows]


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    kept = [(k, i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(object), label)
            for k, (i, v, label) in enumerate(rows)
            if None not in (i, v, label) and all(c is not None and np.isfinite(c) for c in v)]

    def score(a, b):
        return sum(int(x) * int(y) for x, y in zip(a, b, strict=False))

    out = []
    for k, i, v, label in kept:
        if not is_anchor(i):
            continue
        scored = sorted((-score(v, w), j, m == label) for q, j, w, m in kept if q != k)
        for s, j, _ in [t for t in scored if t[2]][:positives]:
            fits = [(-t[0], t[1]) for t in scored if not t[2] and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(i, j, r, m, -s, t) for r, (t, m) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("dims, spread", [(4, 2.0), (3, 1e6), (2, 3e3), (4, 0.3)])
def test_negatives_of_tied_scores(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    rows = vector_rows(dims, 130, dims, spread=spread)
    df = spark.createDataFrame(rows, VECTORS).repartition(5, F.col("vec_id") % 3)
    found = mined(df)
    assert found == brute_negatives(rows, lambda i: i % 10 == 0) and found


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(9, 40, 3) + [
        (None, [1.0, 1.0, 1.0], 1), (50, None, 1), (60, [1.0, 1.0, 1.0], None), (70, [nan, 1.0, 1.0], 1),
        (80, [inf, 1.0, 1.0], 1), (90, [None, 1.0, 1.0], 1), (100, [], 1), (110, [2.0], 1),
        (20, [1.0, 1.0, 1.0], 2), (20, [1.0, 1.0, 1.0], 2), (41, [1.0, 1.0, 1.0, 9.0], 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS))
    found = mined(df)
    assert found == brute_negatives(rows, lambda i: i % 10 == 0)
    # An empty anchor scores 0 everywhere, so its windows hold the scores of 0.
    assert {r[4:] for r in found if r[0] == 100} == {(0, 0)}
    assert mined(df.where("false")) == []
    assert mined(df.where("label = 1 OR label IS NULL")) == []


def test_one_label_with_most_rows(spark):
    rows = [(i, [1.0 + i % 3, 2.0], 0 if i % 9 else i % 2 + 1) for i in range(300)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows, lambda i: i % 10 == 0)


# Whitening


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.lists(st.integers(0, 2**32), min_size=1, max_size=30), st.integers(1, 3))
def test_rank_one_updates_make_the_scatter(width, seeds, spread):
    rows = np.array([np.random.default_rng(s).integers(-spread, spread + 1, width) for s in seeds])
    one, many = spectra.Spectrum.empty(width), spectra.Spectrum.empty(width)
    for row in rows:
        one.add(row[None])
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        if len(part):
            piece = spectra.Spectrum.empty(width)
            piece.add(part)
            many.combine(piece)
    centred = rows - rows.mean(0)
    for s in (one, many):
        assert s.n == len(rows) and (s.sums == rows.sum(0)).all()
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, centred.T @ centred, atol=1e-9)
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(width), atol=1e-10)


def test_secular_roots_of_close_poles():
    poles = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 5.0])
    weights = np.array([1e-20, 3.0, 1e-8, 2.0, 1e-3])
    nearest, x = spectra.secular_roots(poles, weights)
    roots = poles[nearest] + x
    assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
    exact = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(np.sort(roots), exact, rtol=1e-12, atol=1e-14)


def brute_whitening(rows, most=16):
    kept = [(i, v) for i, v, _ in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    wide = max(len(v) for _, v in kept)
    x = np.array([np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, wide - len(v))))
                  for _, v in kept]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    apart = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-values)
    order = order[values[order] > 1e-9 * values.sum()][:most]
    white = ((n * x - sums) / n) @ vectors[:, order] / np.sqrt(values[order])
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(1), white, values[order] / values.sum()


def check_whitening(df, rows):
    ids, n, deviation, white, explained = brute_whitening(rows)
    found = spectra.whiten(df).collect()
    assert len(found) == white.size and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-10
    sign = {}
    for k, i in enumerate(ids):
        mine = [r for r in found if r.vec_id == i and r.deviation == deviation[k]]
        assert sorted({r.component for r in mine}) == list(range(1, white.shape[1] + 1))
        for r in mine:
            c = r.component - 1
            sign.setdefault(c, 1 if abs(r.whitened) < 1e-9 else np.sign(r.whitened * white[k, c]))
            assert abs(r.explained - explained[c]) < 1e-12
    return found, ids, white, sign


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spectra, "FAN", 3)
    monkeypatch.setattr(spectra, "BATCH", 7)
    nan = float("nan")
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * (4, 3, 2, 1)).tolist(), 0) for i in range(200)]
    rows += [(300, None, 0), (301, [nan, 1.0, 1.0, 1.0], 0), (302, [None, 1.0, 1.0, 1.0], 0),
             (303, [], 0), (304, [5.0], None), (0, rows[0][1], 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(11)
    found, ids, white, sign = check_whitening(df, rows)
    for k, i in enumerate(ids):
        if i in (0, 303, 304, 17):
            for r in found:
                if r.vec_id == i:
                    assert abs(r.whitened * sign[r.component - 1] - white[k, r.component - 1]) < 1e-9
    assert sum(r.vec_id == 0 for r in found) == 8
    same = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)], VECTORS)
    for none in (df.where("false"), same, same.where("vec_id = 3")):
        out = spectra.whiten(none)
        assert out.collect() == [] and out.columns == [
            "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_are_at_most_the_directions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-64, 64, (50, 2)) / 64
    rows = [(i, [float(a), float(b), float(a), 0.5, float(a)], 0) for i, (a, b) in enumerate(base)]
    found, *_ = check_whitening(spark.createDataFrame(rows, VECTORS), rows)
    assert {r.component for r in found} == {1, 2}


# Pages

BOILER = ('<nav class="top"><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav>'
          '<header><a href="/">Site</a><p>Daily letters</p></header>')


def page_of(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{BOILER}{body}" \
           "<footer>&copy; all rights</footer></body></html>"


def texts(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in page_slots.extract(clashing(df)).orderBy("page_id").collect()]


def test_marked_articles(spark):
    cases = [
        ("<article><h1>T  &amp; U</h1><p>One<br>two\n three</p>tail<p><b>Open<p>next</article>",
         "T & U\nOne two three\ntail\nOpen\nnext"),
        ("<aside>side</aside><article><header><h1>T</h1><p>by me</p></header><p>a</p>"
         "<div class='ad'>buy</div><form><p>mail?</p><input></form>"
         "<section id=comments><h2>Comments</h2><p>first!</p></section><footer>tags</footer></article>",
         "T\na"),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><main><p>in main</p></main><div>out</div>",
         "in main"),
        ("<article><p>long enough to be the one</p></article><article class=teaser><p>b</p></article>",
         "long enough to be the one"),
        ("<article><p>main words of it</p><!-- <p>no</p> --><p hidden>no</p>"
         "<p style='display: none'>no</p><span class=ad>no</span> yes</article>", "main words of it\nyes"),
        ("<div itemprop=articleBody><p>body &lt;b&gt; &#8364; &amp</p></div><p>more</p>", "body <b> € &"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table></article>",
         "a\nb\nc\nd\ne\nf"),
        ("<div class='cookie-notice'>ok?</div><article><pre>x\n  y</pre><h2>z", "x y\nz"),
        ("<article></article>", "© all rights"[:0]),
    ]
    found = texts(spark, [(f"http://h{k}.com/a", page_of(body)) for k, (body, _) in enumerate(cases)])
    assert found == [want for _, want in cases]


def test_templates_of_unmarked_pages(spark):
    """Pages without an article element: repeated texts and link lists are the template's."""
    pages, want = [], []
    for i in range(12):
        story = [f"Story {i} begins with number {i * 7} here", f"and goes on to {i * i} at length",
                 "Same closing line"][:2 + i % 2]
        body = "".join(f"<p>{s}</p>" for s in story)
        pages.append((f"https://News.example.com:80/{i}", page_of(
            f"<div class=wrap><div class=c1><h1>Head {i}</h1>{body}</div>"
            f"<div class=c2><p>We wish you a pleasant day and thank you for your visit</p>"
            f"<a href=/1>first of the links {i}</a> <a href=/2>second of the links {i}</a></div></div>")))
        want.append("\n".join([f"Head {i}", *story[:2]]))
    found = texts(spark, pages)
    for i, text in enumerate(found):
        assert text.startswith(want[i])
        assert "pleasant" not in text and "links" not in text and "Home" not in text


def test_odd_pages(spark):
    pages = [("http://a/1", None), (None, ""), ("no address", "plain words"), ("http://a/1", "<p>"),
             ("http://a/2", "<article><p>x</p></article>"), ("http://a/2", "<article><p>x</p></article>"),
             ("http://b/", "a < b and <3 <article>c <p"), ("http://b/2", "<!-- open <article>x")]
    assert texts(spark, pages) == ["", "", "plain words", "", "x", "x", "c", ""]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    out = page_slots.extract(clashing(df))
    assert out.collect() == [] and out.columns == ["page_id", "url", "text", "n_chars"]


def test_many_copies_keep_their_text(spark):
    same = page_of("<article><h1>All alike</h1><p>on every page</p></article>")
    assert set(texts(spark, [("http://h/", same)] * 40)) == {"All alike\non every page"}


def test_templates_of_marked_articles(spark):
    """The template tells what in an article the host has put there on all its pages."""
    pages, want = [], []
    for i in range(12):
        story = [f"Story {i} begins with number {i * 7} here", f"and goes on to {i * i} at length"]
        body = "".join(f"<p>{s}</p>" for s in story)
        pages.append((f"https://news.example.com/{i}", page_of(
            f"<article><h1><a href=/{i}>Head {i}</a></h1>{body}<p>Letters reach us by post</p>"
            f"<div class=more><a href=/1>first of the links {i}</a> <a href=/2>second {i}</a></div>"
            f"</article><p>A pleasant day</p>")))
        want.append("\n".join([f"Head {i}", *story]))
    assert texts(spark, pages) == want
    # Near copies, and text in elements of a page's own below a slot that holds links elsewhere.
    line = "All but the last line of these pages is the same on every one of them"
    near = [(f"http://near/{i}", page_of(f"<article><p>{line}</p><p>Line {i}</p></article>"))
            for i in range(5)]
    own = [(f"http://own/{i}", page_of(
        f"<article><h1>Head {i}</h1><div class=c><div class=k{'abcdefghijklmnop'[i]}>"
        f"<p>{line} but {i}</p></div><a href=/>more {i}</a></div></article>")) for i in range(16)]
    assert texts(spark, near) == [f"{line}\nLine {i}" for i in range(5)]
    assert texts(spark, own) == [f"Head {i}\n{line} but {i}\nmore {i}" for i in range(16)]


def test_equivalence_classes_nest():
    rows = [
        {"token": 0, "parent": -1, "is_text": False, "vector": 1, "pages": 9, "chars": 0, "links": 0},
        {"token": 1, "parent": 0, "is_text": False, "vector": 1, "pages": 9, "chars": 0, "links": 0},
        {"token": 2, "parent": 1, "is_text": False, "vector": 1, "pages": 9, "chars": 30, "links": 0},
        # A class of its own: the same vector, but below an element of another one.
        {"token": 3, "parent": 1, "is_text": False, "vector": 5, "pages": 9, "chars": 10, "links": 10},
        {"token": 4, "parent": 3, "is_text": False, "vector": 1, "pages": 9, "chars": 4, "links": 0},
        {"token": 5, "parent": 2, "is_text": True, "vector": 1, "pages": 9, "chars": 10, "links": 0},
    ]
    good, constant = page_slots.template(rows)
    assert set(good) == {0, 1, 2} and constant == {5}
    assert good[2] == 20 and good[1] == 20 + 0 and good[0] == 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([
    "<p>", "</p>", "<b>", "</b>", "<div class=ad>", "</div>", "<article>", "</article>", "<a href='x\">",
    "<!--", "-->", "<script>", "</script>", "text ", "&amp;", "<", ">", "'", '"', "<li>", "<ul>", "</ul>",
    "<td>", "<table>", "</table>", "<span hidden>", "</span>", "<br/>", "<h1>", "<h2>", "</h1>", "<?x>",
])))
def test_any_markup_is_read(parts):
    page = markup.parse("".join(parts))
    assert all(0 <= e.parent < i for i, e in enumerate(page.elements) if i)
    page_slots.main_text(page, {}, set())
    page_slots.page_tokens(page)


@pytest.mark.parametrize("source", [
    "<div>" * 60_000 + "x", "<" * 300_000, "<a \"" * 60_000, "<p>" * 60_000, "<!--" * 60_000,
    "<p title='" * 60_000, "<li><p>" * 30_000, "<script>" * 60_000, "x" * 3_000_000,
    "<span hidden>" * 60_000, "</div>" * 60_000, "<td><p>" * 30_000,
])
def test_hostile_pages_take_linear_time(source):
    start = time.perf_counter()
    page = markup.parse(source)
    page_slots.main_text(page, {}, set())
    page_slots.page_tokens(page)
    assert time.perf_counter() - start < 20
