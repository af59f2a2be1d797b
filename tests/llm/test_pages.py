import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from yearbook.llm import queries as Q
from yearbook.llm import pages
from yearbook.llm.pages import INSIDE, NAMED, common_lines, main_text, place_of


def plain(page):
    """The test tables' pages all mark an article of headings, paragraphs and line breaks."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", article)
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"</?b>", "", b)).split())))


def test_query(spark, sf):
    expected = {r["page_id"]: plain(r["html"]) for r in Q.table(spark, sf, "pages").collect()}
    got = Q.queries()["op8_html_extraction"](spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == expected and len(got) == len(expected)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def lines_of(page):
    """The lines that no element's name rules out, and whether they lie in an article."""
    return [(line, flag == INSIDE) for line, _, flag in pages.lines_of(page) if flag != NAMED]


def test_lines():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="nav"><header>Site</header><div id="side" class="x sidebar">s</div>
    <script>if (a<b) document.write("<p>no</p>")</script><div role=navigation>n</div><form><p>f</form><!-- <p>c</p> --><p hidden>h</p>
    <main><header><h1>Head&amp;line</h1></header><p>one\n  <b>two</b>&nbsp;three<p>four<br>five<div class="comments"><p>c</div><div class="adventure">six</div><footer>g</footer></main>
    <p title="a>b">after</p><footer>x"""
    assert lines_of(page) == [("Head&line", True), ("one two three", True), ("four", True), ("five", True), ("six", True), ("after", False)]
    assert lines_of("plain < text") == [("plain < text", False)] and lines_of("<p>open <b") == [("open <b", False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = [a[i] for i in sorted(common_lines(a, b))]
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(x in rest for x in found)


def test_differencing(spark):
    page = lambda body: f"<body><div>Home</div><div>All rights reserved</div>{body}<div>Imprint</div></body>"
    copy = "".join(f"<p>A long copied paragraph {i}</p>" for i in range(20))
    rows = [(1, "http://a.x/n/1?q", page("<p>first story</p>")), (2, "http://A.x/n/2#t", page("<p>second story</p>")), (3, "http://b.x/", page("<p>alone</p>")), (4, "http://a.x/z", None), (5, None, ""), (None, "http://c.x/c1", page(copy)), (7, "http://c.x/c2", page(copy)), (2, "http://A.x/n/2#t", page("<p>second story</p>"))]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in main_text(df).collect())
    whole = lambda x: f"Home\nAll rights reserved\n{x}\nImprint"
    copied = whole("\n".join(f"A long copied paragraph {i}" for i in range(20)))
    # the second story comes twice: each is the other's nearest page, and they are copies; the first shows their template
    assert got == sorted([(1, "first story"), (2, "second story"), (2, "second story"), (3, whole("alone")), (4, ""), (5, ""), (0, copied), (7, copied)])
    assert main_text(df.limit(0)).collect() == []
    assert place_of("HTTPS://Ex.Org/a/b?c#d") == ("ex.org", "a/b")




def test_names_round_an_article():
    text = lambda page: [line for line, inside in lines_of(page) if inside]
    for names in ("content has-sidebar", "no-sidebar", "with-menu page", "without_ads", "page-with-menu", "widget"):
        assert text(f'<body><div>Home</div><div class="{names}"><article><p>The whole story</p><div class="comments"><article>No</article></div></article></div></body>') == ["The whole story"]
    assert lines_of('<div class="no-sidebar"><p>unmarked</p></div><div class="site-sidebar">s</div><div id="nav_top">n</div><div class="has-x menu">m</div>') == [("unmarked", False)]
    assert text('<div class="widget"><div><div role="main">By its role</div></div></div>') == ["By its role"]
    # what else is an article in a dropped element: teasers beside the article, comments under unmarked text
    assert lines_of('<article>Story</article><div class="related"><article>A longer teaser</article></div>') == [("Story", True)]
    assert lines_of('<p>A long text that nothing marks</p><div class="comments"><article>First!</article></div>') == [("A long text that nothing marks", False)]
    assert lines_of('<aside><article>teaser</article></aside><div class="menu" hidden><main>m</main></div>') == []


def test_short_articles_under_long_menus(spark):
    menu = "".join(f"<div>A long entry of the menu, number {i}</div>" for i in range(30))
    end = "<div>All rights reserved by the owners of this site</div>"
    copy = "".join(f"<p>A copied paragraph, number {i}</p>" for i in range(10))
    bodies = {f"http://a.x/n/{i}": f"<p>Story {i}</p>" for i in range(6)} | {"http://a.x/p/1": f"{copy}<p>Monday</p>", "http://a.x/p/2": f"{copy}<p>Tuesday</p>"}
    df = spark.createDataFrame([(i, u, f"<body>{menu}{b}{end}</body>") for i, (u, b) in enumerate(bodies.items())] + [(99, "http://a.x/z", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert {i: got[i] for i in range(6)} == {i: f"Story {i}" for i in range(6)}
    # copies keep what they share, though half of the host has other articles
    assert all(f"A copied paragraph, number {i}" in got[p] for p in (6, 7) for i in range(10)) and "Monday" in got[6] and "Tuesday" in got[7] and got[99] == ""


def frame(spark, bodies):
    return spark.createDataFrame([(i, f"http://a.x/n/{i}", f"<body>{b}</body>") for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_places_of_a_template_go_whole(spark):
    # a strip that is the same on five pages of seven, and two stories that share a paragraph
    strip = ["Buy now"] * 5 + ["Sold out", "Closed"]
    story = [f"<p>Story {i}</p><p>Its second paragraph, {i // 2}</p><p>Its end, {i}</p>" for i in range(7)]
    got = main_text(frame(spark, [f'<div class="k{i}"><div>Home</div></div>{s}<section>{t}</section>' for i, (s, t) in enumerate(zip(story, strip))])).collect()
    for r in got:
        i = r["page_id"]
        assert r["text"] == f"Story {i}\nIts second paragraph, {i // 2}\nIts end, {i}" and (r["n_shared"], r["n_named"], r["n_outside"]) == (2, 0, 0)


def test_shared_lines_go_where_a_place_holds_more_than_the_template(spark):
    got = main_text(frame(spark, [f"<div>Home</div><div>News</div><div>Story {i}</div><div>Imprint</div>" for i in range(4)])).collect()
    assert {r["text"] for r in got} == {f"Story {i}" for i in range(4)}


def test_marks_and_names_decide_the_rest(spark):
    body = lambda i: f"<nav>Menu {i}</nav><article><p>Shared words</p><p>Story {i}</p></article><p>Teaser {i}</p>"
    got = main_text(frame(spark, map(body, range(4)))).collect()
    assert {(r["text"], r["n_shared"], r["n_named"], r["n_outside"]) for r in got} == {(f"Shared words\nStory {i}", 0, 1, 1) for i in range(4)}


def test_odd_pages_are_read_in_linear_time():
    import time

    n = 1 << 18
    for page in ('<a "' * n, "<a \"" * n + ">", '<a ">" ' * n + '"', "<a '" * n + "x>y", "<div>" * n + "</x>" * n, "<b>" * n + "<p>" * n, "<p>" * n, "<" * 4 * n, "<!-- " * n, "</" * n, "<script>" * n, "<div>x" * n):
        began = time.perf_counter()
        pages.lines_of(page)
        assert time.perf_counter() - began < 10, page[:20]


def test_tags():
    def tags(page):
        reader, at, out = pages.Tags(page), 0, []
        while tag := reader.after(at):
            out.append(tag[2:])
            at = tag[1]
        return out

    assert tags('<A b="1>2" c>x</a ><!-- <i> --><br/>< b><!doctype x></>') == [(False, "a", ' b="1>2" c'), (True, "a", " "), (False, "", ""), (False, "br", "/"), (False, "", ""), (False, "", "")]
    # a quote that is never closed: from there on, the first '>' ends a tag
    assert tags("<a b='x><i>y</i><u c=\"1>") == [(False, "a", " b='x"), (False, "i", ""), (True, "i", ""), (False, "u", ' c="1')]
    assert tags("<a b") == [] and tags('<a "' * 5) == []


@settings(max_examples=200, deadline=None)
@given(st.text("ab/", max_size=9), st.text("ab/", max_size=9))
def test_beginning(a, b):
    import os

    assert pages.beginning(a, b) == len(os.path.commonprefix([a, b]))


def test_nearest_over_many_partitions(spark):
    paths = ["", "a", "a/1", "a/12", "a/2", "b", "b/1", "b/1", "zz"]
    rows = [(h, p, i * 100 + j) for i, h in enumerate(("", "h1", "h2", "one")) for j, p in enumerate(paths if h != "one" else ["x"])]
    got = {r["row"]: r["partner"] for r in pages.nearest(spark.createDataFrame(rows, "host string, path string, row long").repartition(7)).collect()}
    order, expected = sorted(rows), {}
    for i, own in enumerate(order):
        near = [(pages.beginning(own[1], o[1]), -k, o[2]) for k, j in enumerate((i - 1, i + 1)) if 0 <= j < len(order) and (o := order[j])[0] == own[0]]
        if near:
            expected[own[2]] = max(near)[2]
    assert got == expected
