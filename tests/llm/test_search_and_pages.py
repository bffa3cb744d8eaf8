import math

import numpy as np
from pyspark.sql import functions as F

from spotweave.llm import html, vafile


def brute(rows, k):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(64 * x) for x in v]
        best[i] = max(best.get(i, ints), ints)
    out = []
    for q, a in best.items():
        if q % 3 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in best.items() if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(130)]
    rows += [(200 + i, [0.25] * 6) for i in range(30)] + [(300, None), (301, []), (302, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (303, [float("nan")] + [0.0] * 5), (306, [float("inf")] + [0.0] * 5),
             (None, [0.1] * 6), (309, [0.5, 0.5]), (310, [0.25, -0.5]), (3, rows[3][1]), (6, [9.0] * 6), (312, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    for block in (8192, 40):
        monkeypatch.setattr(vafile, "ROWS_PER_BLOCK", block)
        monkeypatch.setattr(vafile, "QUERIES_PER_BLOCK", block)
        got = sorted(tuple(r) for r in vafile.top_k(frame, F.col("vec_id") % 3 == 0, k=7).collect())
        assert got == brute(rows, 7)


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(frame, F.col("vec_id") % 20 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t {i}</title><style>p{{x}}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar menu">
<div id="site-header"><a href="/">Site name</a></div><nav><ul><li><a href="/{i}">nav {i}</a></li><li>more</ul></nav><div class="cookie-notice"><p>We use cookies {i} and more text here</p></div>
<div class="wrap"><div class="post"><h1>Title&nbsp;{i} &amp; co</h1><p>First   paragraph {i}<br>goes
on<p><b>Second {i}<p>Third &lt;x&gt; {i}<ul><li>one {i}<li>two</ul><div class="ad-slot">Buy {i}!</div><p class="tagline">Always the same sentence</p></div>
<aside><p>Side text {i} which is rather long and not at all the article of this page</p></aside><form><p>Name {i}</p><input></form>
<section id="comments"><h2>Comments</h2><p>I disagree with number {i}</p></section></div><footer>&copy; {i}</footer><!-- <p>hidden {i}</p> --></body></html>"""


def expected(i, constant):
    return "\n\n".join([f"Title {i} & co", f"First paragraph {i} goes on", f"Second {i}", f"Third <x> {i}", f"one {i}", "two"] + ["Always the same sentence"] * constant)


def test_pages(spark, monkeypatch):
    rows = [(i, f"http://WWW.a.example:80/x/{i}", PAGE.format(i=i), "c") for i in range(12)] + [
        (100, "https://alone.example/q", PAGE.format(i=100), "c"), (101, None, PAGE.format(i=101), "c"), (102, "http://www.a.example/", None, "c"), (103, "http://www.a.example/", "", "c"),
        (104, "http://www.a.example/", "just text <b>here", "c"), (105, "x", "<p>a <p", "c"), (106, "http://www.a.example/z", "<article><header><h1>H</h1></header><p>only", "c"),
        (3, "http://www.a.example/x/3", PAGE.format(i=3), "c"), (107, "y", "<div>" * 300 + "deep", "c"), (108, "http://www.a.example/", PAGE.format(i="word " * 30000), "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for limit in (1 << 20, -1):
        monkeypatch.setattr(html, "BROADCAST_BYTES", limit)
        got = {r["row"]["page_id"]: r["text"] for r in html.main_text(frame).collect()}
        assert all(got[i] == expected(i, 0) for i in range(12))
        assert got[100] == expected(100, 1) and got[101] == expected(101, 1)
        assert (got[102], got[103], got[104], got[106], got[107]) == ("", "", "just text here", "H\n\nonly", "deep")
        assert got[105].startswith("a")
        assert got[108] == expected("word " * 30000, 0).replace("  ", " ").replace(" \n", "\n").replace("word  ", "word ")
    assert html.main_text(frame.limit(0)).count() == 0


def test_tree_matching_counts():
    shape = lambda page: html.collapsed([html.parse(page)], "#root")
    a, b = shape("<div><h1>x</h1><p>y</p></div>"), shape("<div><p>z</p><p>u</p></div><ul><li>1</ul>")
    assert html.match(a, b)[0] == 3 and html.match(a, a)[0] == 4


def test_rare_layout_of_a_large_host(spark):
    first = "<body><div class=post><p>Main {i} says this</p><p class=x>Other {i}</p></div></body>"
    second = "<body><div class=blurb><h2>Head {i}</h2><p>Rare {i} says that</p><p class=z>Always on rare pages</p></div></body>"
    rows = [(i, "http://hot.example/", (second if i % 50 == 7 else first).format(i=i)) for i in range(500)]
    rows += [(1000 + i, "http://copies.example/", first.format(i=0)) for i in range(9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["row"]["page_id"]: r["text"] for r in html.main_text(frame).collect()}
    assert all(got[i] == (f"Head {i}\n\nRare {i} says that" if i % 50 == 7 else f"Main {i} says this\n\nOther {i}") for i in range(500))
    assert {got[1000 + i] for i in range(9)} == {"Main 0 says this\n\nOther 0"}


def test_markup_as_deep_as_it_comes(spark):
    """Nested elements, unclosed and closed, chrome in chrome, and a host of two deep layouts: no depth ends the job."""
    text = html.Extractor(None).text
    for depth in (5_000, 100_000):
        assert text("<div>" * depth + "deep") == "deep"
        assert text("<p>top</p>" + "<section>" * depth + "<p>deep</p>" + "</section>" * depth + "<p>end</p>") == "top\n\ndeep\n\nend"
        assert text("<aside>" * depth + "side" + "</aside>" * depth + "<p>main</p>" + "</nav>" * depth) == "main"
        assert text("<ul><li>" * depth + "item") == "item"
    pages = [(i, "http://deep.example/", ("<div>" * (3000 + 10 * (i % 2)) + "<p>Words of page {i}</p><p class=z>Same on every page</p>").format(i=i)) for i in range(12)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["row"]["page_id"]: r["text"] for r in html.main_text(frame).collect()}
    assert got == {i: f"Words of page {i}" for i in range(12)}


def test_names_count_as_whole_words():
    body = "Words of the article as they are. " * 5
    for name in ("commentary", "format-standard", "barcelona", "metal", "metabolism", "shared-lanes", "advertorial", "navy", "skipper"):
        assert html.Extractor(None).text(f"<body><div class='{name}'><p>{body}</p></div></body>") == body.strip(), name
        assert html.Extractor(None).text(f"<body><article><h1>T</h1><div class='{name}'><p>{body}</p></div></article></body>") == f"T\n\n{body.strip()}", name
    for name in ("comments", "site-nav", "cookie-bar", "related_posts", "share"):
        assert html.Extractor(None).text(f"<body><div class=x><p>{body}</p></div><div class='{name}'><p>Other words</p></div></body>") == body.strip(), name


def test_all_parts_of_the_content_stay():
    body = " ".join(f"word{k}" for k in range(200))
    nav = "<div class=links><ul><li><a href=/>Home</a></li></ul></div>"
    parts = f"<div class=post><h1>Title</h1><p class=lead>Lead text</p><div class=entry-body><p>{body}</p><p>End</p></div></div>"
    text = html.Extractor(None).text
    assert text(f"<body>{nav}<div class=wrap>{parts}<div class=sidebar><p>Side text</p></div></div></body>") == f"Title\n\nLead text\n\n{body}\n\nEnd"
    assert text(f"<body><div class=wrap><section class=intro><p>Intro text</p></section>{parts}</div></body>") == f"Intro text\n\nTitle\n\nLead text\n\n{body}\n\nEnd"
    assert text(f"<body>{nav}<article class=one><p>Small part</p></article><article class=two><p>{body}</p></article></body>") == f"Small part\n\n{body}"
