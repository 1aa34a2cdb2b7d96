"""Main text of web pages by markup and by nearest-URL page differencing.

A page is cut into lines, one for each block of text outside elements that are
never article text by their markup (navigation, footers, forms, scripts,
comments and the like).  An <article> or <main> with text within such an element
is cut into lines all the same, unless it is hidden; if the element is left out
by its tag, its role or a whole class or id, as <aside> or class="comments", that
holds only for a page without article text elsewhere.  The pages of a host tell template from article: pages
are ordered by host and URL path, each page is paired with its nearest neighbour
by path, all their lines are aligned by longest common subsequence, and the
shared lines are deleted.  The markup is a check after it: of a page that marks
its article, only lines of the article stay, and a deleted line of the article
comes back unless most pages of the host have it (SUPPORT).

Copies lose nothing.  A page is a copy of its nearest page if nearly nothing is
left of it: at most LEFT of what the neighbour on its other side leaves, which
has the same template but not the same article.  If that one leaves nearly
nothing either, or there is none, what is left is held against the whole page
(LEAST).  A page that two neighbours hold whole which are no copies of each other
is all template.  Within a marked article, whose markup has most of the template
outside, two pages are copies if more than half is shared (MARKED).

Cases: a null html counts as empty and has no text; broken markup is read as
far as it goes, an element that is never closed ends with its parent article or
body; a null url or one without host belongs to the host '' and pairs with no
other page; a page without lines is nobody's neighbour, the pages around it are
each other's; equal URLs are neighbours in the order of the page key; repeated
rows give repeated rows, which are copies of each other; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import slices
from .ordering import in_order, number_key
from .url_filter import url_host, url_path

LEFT, LEAST = 0.1, 0.02          # copies: shares of the other neighbour's remainder and of the whole page that are nearly nothing
MARKED = 0.5                     # both of them within a marked article
SUPPORT, LEAST_PAGES = 0.5, 8    # a shared line of an article goes if more than this share of a host's pages have it, and the host has so many pages

# Element and attribute names of HTML.
DROPPED = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "iframe", "svg", "button", "select",
           "textarea", "object", "canvas", "dialog", "menu", "video", "audio", "map"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "caption",
          "blockquote", "pre", "section", "article", "main", "header", "hgroup", "figure", "figcaption", "address", "hr", "body", "html", "details", "summary", "center"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|nav(?:bar|igation)?|menu|bread-?crumbs?|footer|masthead|site-?header|page-?header|"
                     r"comments?|comment-?list|respond|replies|disqus|cookies?|consent|notices?|newsletter|subscribe|share|sharing|social|related|widgets?|popup|modal|skip-?link|pagination|pager)(?:$|[\s_-])")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"hidden|display", re.I)
ARTICLE = {"article", "main"}
LOOSE = {"p", "li", "td", "div", "section", "span", "a", "ul", "table"}      # without an end tag these hide nothing


def values(attributes: str) -> dict[str, str]:
    """The attributes of an element in lower case."""
    return {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attributes)}


def hidden(found: dict[str, str]) -> bool:
    """Whether an element with these attributes is not shown."""
    return "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))


def named_outside(name: str, attributes: str) -> bool:
    """Whether the tag, the role or a whole class or id of an element is one outside articles, not only a part of a class or id."""
    found = values(attributes)
    return name in DROPPED or found.get("role") in ROLES or any(OUTSIDE.fullmatch(x) for x in f"{found.get('class', '')} {found.get('id', '')}".split())


def never_article(name: str, attributes: str) -> bool:
    """Whether the markup of an element says that it is not article text."""
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return name == "article" and bool(re.search(r"comment|reply", attributes or ""))
    found = values(attributes)
    if hidden(found):
        return True
    return found.get("role") in ROLES or bool(OUTSIDE.search(found.get("class", "")) or OUTSIDE.search(found.get("id", "")))


def marked_lines(page: str) -> tuple[list[str], list[bool]]:
    """The lines of a page and whether each is of a marked article; character references decoded, white space as one space."""
    found: list[str] = []
    own: list[int] = []          # 0: of no article, 1: of an article, 2: of one within an element named as outside
    block: list[str] = []
    article = 0                  # open article elements
    dropped, depth = "", 0       # the element that is left out, and how often its name is open within
    kind = 1                     # what article lines within that element are, 0 if they are left out
    outer: list[tuple] = []      # elements that are left out around the open article or hidden element, and the count of open articles to go back at
    at, lower = 0, page.lower()

    def close() -> None:
        text = " ".join(entities.unescape("".join(block)).split())
        block.clear()
        if text:
            found.append(text)
            own.append(max([1, *(x[2] for x in outer)]) if article else 0)

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not dropped:
            block.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = m[1] == "/"
        if dropped and not closing and kind and name in ARTICLE and not never_article(name, m[3]):
            outer.append((dropped, depth, kind, article))
            dropped = ""
        if dropped:
            if not closing and name in RAW:
                end = lower.find(f"</{name}", at)
                at = end if end >= 0 else at
            elif not closing and kind and name not in VOID and not m[3].endswith("/") and (name in ARTICLE or NOT_SHOWN.search(m[3]) and hidden(values(m[3]))) and lower.find(f"</{name}", at) >= 0:
                outer.append((dropped, depth, kind, -1))
                dropped, depth, kind = name, 1, 0
            elif name == dropped:
                depth += -1 if closing else name not in VOID and not m[3].endswith("/")
                if depth == 0:
                    dropped = ""
                    if outer and outer[-1][3] < 0:
                        dropped, depth, kind, _ = outer.pop()
            continue
        header = name == "header" and not article
        if not closing and name not in VOID and (header or never_article(name, m[3])):
            close()
            if m[3].endswith("/") and name not in RAW:
                continue
            end = lower.find(f"</{name}", at)
            if name in RAW and end >= 0:
                at = end
            elif end >= 0:
                dropped, depth = name, 1
                kind = 0 if name in ARTICLE or hidden(values(m[3])) else 1 + named_outside(name, m[3])
            elif name not in LOOSE:
                stops = ("</article", "</main", "</body") if name in RAW else ("<article", "<main", "</article", "</main", "</body")
                at = min((x for x in (lower.find(t, at) for t in stops) if x >= 0), default=len(page))
            continue
        if name in BLOCKS:
            close()
            if name in ARTICLE:
                article = max(0, article + (-1 if closing else 1))
                if outer and closing and article <= outer[-1][3]:
                    dropped, depth, kind, _ = outer.pop()
        elif name == "br":
            block.append(" ")
    if not dropped:
        block.append(page[at:])
    close()
    if 1 in own and 2 in own:
        found, own = [x for x, o in zip(found, own, strict=True) if o < 2], [o for o in own if o < 2]
    return found, [o > 0 for o in own]


def lines(page: str) -> tuple[list[str], list[str]]:
    """(article lines, other lines) of a page in page order."""
    found, own = marked_lines(page)
    return [x for x, o in zip(found, own, strict=True) if o], [x for x, o in zip(found, own, strict=True) if not o]


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` on a longest common subsequence with ``b``."""
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):            # the last place first
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []                       # least end in b of a common subsequence of each length
    last: list[int] = []                        # and its link
    chain: list[tuple[int, int]] = []           # (position in a, link in front)
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            if k == len(tails):
                tails.append(j)
                last.append(len(chain))
            elif tails[k] > j:
                tails[k], last[k] = j, len(chain)
            else:
                continue
            chain.append((i, last[k - 1] if k else -1))
    at = last[-1] if last else -1
    while at >= 0:
        out.add(chain[at][0])
        at = chain[at][1]
    return out


def nearer(path: str, front: str | None, behind: str | None) -> int:
    """-1 or 1: the neighbour that shares the longer beginning of the path, the one in front if equal; 0 without any."""
    if front is None or behind is None:
        return 0 if front is behind else (-1 if behind is None else 1)
    return -1 if len(commonprefix([path, front])) >= len(commonprefix([path, behind])) else 1


def left(page: list[str], among: list[int], other: list[str]) -> tuple[list[int], int]:
    """The positions ``among`` those of a page that it does not share with another page, and their characters."""
    shared = shared_lines(page, other)
    kept = [i for i in among if i not in shared]
    return kept, sum(len(page[i]) for i in kept)


def difference(page: list[str], among: list[int], near: list[str], other: list[str] | None, share: float = LEFT, least: float = LEAST) -> list[int]:
    """The positions ``among`` those of a page that its nearest page lacks; all of them if the two are copies.

    ``other`` is the neighbour on the other side, ``share`` and ``least`` are
    the shares of its remainder and of the page that count as nearly nothing.
    """
    kept, n = left(page, among, near)
    if len(kept) == len(among):
        return among
    nothing = least * sum(len(page[i]) for i in among)
    if other is None:
        return kept if n > nothing else among
    far = left(page, among, other)[1]
    if far > nothing:
        return kept if n > share * far else among
    if n > nothing:                                      # the copy is on the other side
        return kept
    # both hold the page: a template if they are not copies themselves
    for a, b in ((near, other), (other, near)):
        if left(a, list(range(len(a))), b)[1] <= least * sum(map(len, a)):
            return among
    return kept


def recurring(parsed: DataFrame) -> DataFrame:
    """(_host, _found): hashes of the article lines that most pages of a host have, over (_host, _lines, _own).

    Counted before anything is joined, so a host with very many pages is no hot
    key; a host has at most twice as many such lines as a page has on average.
    """
    on_host = parsed.where("_host <> ''")
    hashes = F.transform(F.filter(F.arrays_zip("_lines", "_own"), lambda x: x["_own"]), lambda x: F.xxhash64(x["_lines"]))
    counted = (on_host.select("_host", F.explode(F.array_distinct(hashes)).alias("h")).groupBy("_host", "h").agg(F.count(F.lit(1)).alias("c"))
               .where(F.col("c") > SUPPORT * LEAST_PAGES))
    pages = on_host.groupBy("_host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    return counted.join(pages, "_host").where(F.col("c") > SUPPORT * F.col("n")).groupBy("_host").agg(F.collect_list("h").alias("_found"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, by_markup) of every row; the main text's blocks are joined by one line feed."""
    kind, url_kind = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "_html"):
                found = [marked_lines(x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([a for a, _ in found], pa.list_(pa.string())), pa.array([b for _, b in found], pa.list_(pa.bool_()))], [key, url, "_host", "_path", "_lines", "_own"])

    u = F.col(url)
    parsed = pages.select(key, url, url_host(u).alias("_host"), url_path(u).alias("_path"), F.col(html).alias("_html")).mapInArrow(
        parse, f"`{key}` {kind}, `{url}` {url_kind}, _host string, _path string, _lines array<string>, _own array<boolean>")
    # pages without lines stand apart, so that the pages around them are neighbours
    parsed = parsed.withColumn("_host", F.when(F.size("_lines") > 0, F.col("_host")).otherwise(F.lit("")))
    ordered = in_order(parsed, F.concat_ws("\x01", F.col("_host"), F.col("_path"), number_key(F.xxhash64(F.col(key).cast("string")))), before=True)

    def settle(front, row, behind) -> list:
        k, address, host, path, page, own, _, part = row
        marked = any(own)
        among = [i for i, o in enumerate(own) if o or not marked]
        stay = among
        if host:
            sides = [x if x is not None and x[2] == host and x[7] == part else None for x in (front, behind)]
            side = nearer(path, *[None if x is None else x[3] for x in sides])
            if side:
                near, other = sides[::-side]
                stay = difference(page, among, near[4], other and other[4], *([MARKED] * 2 if marked else []))
        if marked and len(stay) < len(among):            # the host's other pages decide about lines of an article
            kept = set(stay)
            return [k, address, None, None, marked, host, [{"line": page[i], "doubt": i not in kept} for i in among]]
        text = "\n".join(page[i] for i in stay)
        return [k, address, text, len(text), marked, None, None]

    doubtful = pa.list_(pa.struct([("line", pa.string()), ("doubt", pa.bool_())]))

    def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), doubtful]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, url, "text", "n_chars", "by_markup", "_host", "_kept"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front, row = None, None
        schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for a in range(0, batch.num_rows, 500):
                columns = [c.to_pylist() for c in batch.slice(a, 500).columns]
                for new in zip(*columns, strict=True):
                    if row is not None and not row[6]:
                        out.append(settle(front, row, new))
                    front, row = row, new
            if out:
                yield batch_of(out, schema)
        if row is not None and not row[6]:
            yield batch_of([settle(front, row, None)], schema)

    settled = ordered.select(key, url, "_host", "_path", "_lines", "_own", "_halo", "_part").mapInArrow(
        work, f"`{key}` {kind}, `{url}` {url_kind}, text string, n_chars long, by_markup boolean, _host string, _kept array<struct<line string, doubt boolean>>")
    clear = settled.where("_kept is null").select(key, url, "text", "n_chars", "by_markup")
    found = F.coalesce("_found", F.array().cast("array<bigint>"))
    lines_left = F.filter("_kept", lambda x: ~x["doubt"] | ~F.array_contains(found, F.xxhash64(x["line"])))
    text = F.array_join(F.transform(lines_left, lambda x: x["line"]), "\n")
    late = settled.where("_kept is not null").join(recurring(parsed), "_host", "left").withColumn("text", text)
    return clear.unionByName(late.select(key, url, "text", F.length("text").cast("long").alias("n_chars"), "by_markup"))
