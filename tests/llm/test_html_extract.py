"""Markup, page differencing and edge cases."""

import random
from html.parser import HTMLParser

from crisislens.llm import html_extract

from .conftest import words

ARTICLE = "<article><header><h1>A  title</h1></header><p>One &amp; <b>two</b>\n three<br>four</p><ul><li>x&nbsp;y</li></ul><p>last&#33;"
WRAPPED = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body class=home><nav><a>Menu</a></nav><header>Top</header>"
           "<div class='cookie-notice'>We <div>use</div> cookies</div><div id=sidebar>side</div><aside>aside</aside>BODY<div class=\"comments\"><p>nice post</p></div><form><input name=q>go</form><!-- <p>no</p> --><footer>&copy; f</footer></body></html>")


def test_markup():
    own, _ = html_extract.lines(WRAPPED.replace("BODY", ARTICLE + "</article>"))
    assert own == ["A title", "One & two three four", "x y", "last!"]
    assert html_extract.lines(WRAPPED.replace("BODY", "<p>a</p><div>b <span hidden>c</span></div>"))[1] == ["a", "b"]
    assert html_extract.lines("<article>" + ARTICLE)[0][-1] == "last!"
    assert html_extract.lines("<p>a<nav>b<p>c") == ([], ["a"]) and html_extract.lines("") == ([], []) and html_extract.lines("a < b > c")[1] == ["a < b > c"]
    assert html_extract.lines("<article class='comment'>no</article><main><p class='share-count'>no</p>yes</main>") == (["yes"], [])


def test_shared_lines_is_a_common_subsequence():
    assert html_extract.shared_lines(list("axbycz"), list("abc")) == {0, 2, 4}
    assert html_extract.shared_lines(list("aab"), list("baa")) == {0, 1}
    assert html_extract.shared_lines([], ["a"]) == set()


def template(body):
    return f"<html><body><div>Site name</div><div>Home | News</div>{body}<div>All rights reserved</div></body></html>"


def test_nearest_page_of_the_host_tells_the_template(spark):
    bodies = {i: [words(10 * i + j, 30) for j in range(4)] for i in range(30)}
    rows = [(i, f"http://h.org/a/{i:03d}", template("".join(f"<p>{p}</p>" for p in b))) for i, b in bodies.items()]
    rows += [(100, "http://h.org/z/1", template("<p>twin</p>" * 30)), (101, "http://h.org/z/2", template("<p>twin</p>" * 30))]
    rows += [(200, "http://alone.org/1", template("<p>alone</p>")), (201, None, "<p>no url</p>"), (202, None, None), (203, "http://h.org/a/000", ""), (200, "http://alone.org/1", template("<p>alone</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as _host", "'c' as text", "'c' as _lines").repartition(6)
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    for i, b in bodies.items():
        if i:                                            # page 0 has an empty neighbour with its very url
            assert text[i] == "\n".join(b)
    assert text[100] == text[101] == "\n".join(["Site name", "Home | News", *["twin"] * 30, "All rights reserved"])
    assert text[200] == "Site name\nHome | News\nalone\nAll rights reserved" and text[201] == "no url" and text[202] == "" and text[203] == ""


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_extract.extract(pages).collect()
    assert len(got) == pages.count() and all(r["by_markup"] and r["text"] and "<" not in r["text"] for r in got)
    assert html_extract.extract(pages.limit(0)).collect() == []


def paragraphs(*seeds, n=30):
    return "".join(f"<p>{words(x, n)}</p>" for x in seeds)


def texts(spark, rows):
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in got}


def test_marked_pages_are_differenced(spark):
    rows = [(i, f"http://m.org/a/{i:03d}", template(f"<main><div>Read more</div>{paragraphs(i, 100 + i)}<div>Rate this</div></main><p>{words(200 + i, 9)}</p>")) for i in range(12)]
    rows += [(20 + i, f"http://m.org/b/{i}", f"<article>{paragraphs(50, 51)}</article>") for i in range(3)]     # copies
    got = texts(spark, rows)
    assert all(got[i] == [words(i, 30), words(100 + i, 30)] for i in range(12))
    assert all(got[20 + i] == [words(50, 30), words(51, 30)] for i in range(3))


def test_page_differencing_of_short_articles_mixed_markup_and_empty_neighbours(spark):
    long = lambda body: f"<div>{words(900, 80)}</div>{body}<div>{words(901, 120)}</div>"
    rows = [(i, f"http://s.org/{i:03d}", long(paragraphs(i, n=12))) for i in range(12)]                            # template much longer than the article
    rows += [(100 + i, f"http://x.org/{i:03d}", long(f"<article>{paragraphs(i)}</article>" if i % 2 else paragraphs(i))) for i in range(12)]
    rows += [(200 + i, f"http://e.org/{i:03d}", "" if i % 3 else long(paragraphs(i))) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == [words(i, 12)] and got[100 + i] == [words(i, 30)] for i in range(12))
    assert all(got[200 + i] == ([] if i % 3 else [words(i, 30)]) for i in range(12))


def test_copies_are_told_from_templates(spark):
    body = {0: [1], 1: [2, 3], 2: [2, 3], 3: [4], 4: [], 5: [5], 6: [6, 7], 7: [6, 7], 8: [6, 7]}
    rows = [(i, f"http://c.org/{i}", template(paragraphs(*b))) for i, b in body.items()]
    got = texts(spark, rows)
    whole = {i: ["Site name", "Home | News", *[words(x, 30) for x in b], "All rights reserved"] for i, b in body.items()}
    assert all(got[i] == whole[i] for i in (2, 7, 8))                           # the nearest page is a copy
    assert all(got[i] == whole[i][2:-1] for i in (0, 1, 3, 4, 5, 6))            # it is not; page 4 is all template


def test_names_of_wrappers_hide_no_article():
    own = lambda page: html_extract.lines(f"<html><body><nav>n</nav>{page}<footer>f</footer></body></html>")[0]
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "page-related", "sidebar"):
        for attribute in ("class", "id"):
            assert own(f"<div {attribute}='{name}'><div>x</div><article><p>a</p><div>b</div><div class=share>c</div></article><div>y</div></div>") == ["a", "b"]
    assert own("<main><h1>t</h1><div class='no-sidebar'><script>'<article>'</script><article>a</article><p>b</p><main>c</main></div>d</main>") == ["t", "a", "c", "d"]
    assert own("<div class=with-comments><div class=has-sidebar><article>a<nav>n</nav></article></div><article class=comment>c<article>r</article></article></div>") == ["a"]
    assert own("<form><article>a</article></form>") == ["a"] and own("<header><main>a") == ["a"]
    assert own("<article>a</article><div class=comments><article>c</article></div><aside><article>t</article></aside>") == ["a"]
    assert own("<div class=has-sidebar><div hidden><article>h</article></div><article>a</article></div><div hidden><article>h</article></div>") == ["a"]
    assert html_extract.lines("<div class=has-sidebar><main></main>x</div><p>y</p>") == ([], ["y"])


def test_shared_lines_are_as_many_as_can_be():
    rng = random.Random(6)
    assert html_extract.shared_lines(list("Ax"), list("xAx")) == {0, 1}
    for it in range(1500):
        k = rng.choice([1, 2, 3, 8])
        a, b = ([rng.randint(0, k) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = [a[i] for i in sorted(html_extract.shared_lines(a, b))]
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(x in rest for x in got), it


class OwnText(HTMLParser):
    """The text of a page's article elements, without white space."""

    def __init__(self):
        super().__init__()
        self.depth, self.skipped, self.text = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skipped += tag in ("script", "style", "aside", "nav", "form")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skipped -= tag in ("script", "style", "aside", "nav", "form")

    def handle_data(self, data):
        if self.depth > 0 and not self.skipped:
            self.text.append(data)


def test_no_article_line_is_lost(spark):
    """Every given page keeps the whole text of its article element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        own = OwnText()
        own.feed(html[r["page_id"]])
        assert "".join(r["text"].split()) == "".join("".join(own.text).split()), r["page_id"]


def test_lines_of_an_article_go_only_if_most_pages_of_the_host_have_them(spark):
    body = lambda i, more: f"<article>{more}{paragraphs(i, 100 + i)}</article>"
    rows = [(i, f"http://few.org/{i}", body(i, "<p>Rate</p>")) for i in range(5)]                                          # too few pages to tell
    rows += [(20 + i, f"http://some.org/{i:02d}", body(20 + i, "<p>Licence</p>" if i in (3, 4) else "")) for i in range(12)]  # two pages share a line
    rows += [(40 + i, f"http://most.org/{i:02d}", body(40 + i, "<p>Rate</p>" if i < 8 else "")) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == ["Rate", words(i, 30), words(100 + i, 30)] for i in range(5))
    assert all(got[20 + i] == ["Licence"] * (i in (3, 4)) + [words(20 + i, 30), words(120 + i, 30)] for i in range(12))
    assert all(got[40 + i] == [words(40 + i, 30), words(140 + i, 30)] for i in range(7))


def test_a_very_long_page_and_clashing_columns(spark):
    long = "".join(f"<p>{words(i, 20)}</p>" for i in range(3000))
    df = spark.createDataFrame([(1, "http://l.org/1", f"<article>{long}</article>"), (2, "http://l.org/2", f"<article>{long}</article><nav>x</nav>")], "page_id long, url string, html string")
    for c in ("_own", "_halo", "_kept", "_found", "n_chars", "by_markup", "h"):
        df = df.selectExpr("*", f"'c' as {c}")
    assert {r["n_chars"] for r in html_extract.extract(df).collect()} == {len("\n".join(words(i, 20) for i in range(3000)))}
