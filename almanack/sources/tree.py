"""Pages as trees: every element and every piece of text is a row with the interval of row numbers that it holds, so ancestors, boundaries and contents are joins over numbers.

A page is read once, in Arrow batches: tags by position, attributes with either quote or none, character references resolved, comments, scripts and styles left out, ends that
HTML implies put in. What is inside what is then data: node m lies inside node n of its page where n < m <= last(n).

Cases: a null or empty page has no nodes; text outside any element hangs at the root (parent -1); an end tag without a start is passed over; elements left open end with the one
around them; a tag or comment that is never closed swallows the rest of the page; pages of any length are read in time linear in their length and depth.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is text and not shown, elements whose content is plain text, and those that begin a line.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
HIDDEN = frozenset(["script", "style", "noscript", "template", "svg", "xmp", "iframe", "noembed", "noframes"])
PLAIN = frozenset(["textarea", "title"])
LINES = frozenset(["p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "title", "dl", "dt", "dd", "form", "option"])
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Fixed values of HTML: the open elements that a start tag ends, up to the elements that hold them.
ENDS = {
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "tbody": ["thead", "tbody", "tr", "td", "th"], "a": ["a"],
    **{tag: ["p"] for tag in ("p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote", "aside", "figure")},
}
HOLDERS = frozenset(["ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "nav", "body", "td", "th", "form", "header", "footer"])
#: Elements that are no card: all of a page.
PAGE_LEVEL = ("html", "body", "main")
#: Ancestors that a node knows.
UP = 5

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([\"'])|([^\s>]*)))?")
_GAP = re.compile(r"[\s/]*")
#: Rows, or characters of pages, that a task hands out at once.
TOLD, TOLD_CHARS = 10_000, 1 << 22
NODE = "n int, last int, parent int, tag string, attrs map<string,string>, text string, up array<int>, line int, anchor int, heading int"


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from here on, the first of each name, and the place after the tag; the page's end if it is never closed."""
    out: dict[str, str] = {}
    while True:
        if (m := _ATTRIBUTE.match(page, at)) is None:
            at = _GAP.match(page, at).end()
            if at >= len(page) or page[at] == ">":
                return out, min(at + 1, len(page))
            at += 1  # a stray equals sign
            continue
        if m[4]:  # a quote that nothing closes
            return out, len(page)
        at = m.end()
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[5] or ""))


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(tag, '', attributes) of a start, ('/tag', '', None) of an end, ('', text, None) of text."""
    at = 0
    while at < len(page):
        m = _OPEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and (text := html.unescape(page[at:stop])).strip():
            yield "", text, None
        if not m:
            return
        if m[1]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
        elif not m[3]:
            end = page.find(">", m.end())
            at = end + 1 if end >= 0 else len(page)
        else:
            tag, at = m[3].lower(), m.end()
            attributes, at = ({}, at + 1) if page[at : at + 1] == ">" else _attributes(page, at)
            if m[2]:
                yield f"/{tag}", "", None
                continue
            yield tag, "", attributes
            if tag in HIDDEN or tag in PLAIN:
                close = re.compile(rf"</{tag}\b", re.I).search(page, at)
                end = close.start() if close else len(page)
                if tag in PLAIN and (text := html.unescape(page[at:end])).strip():
                    yield "", text, None
                at = end


def _nodes(page: str) -> list[list]:
    """Rows of NODE. line numbers the visible lines; anchor and heading are the nearest link and heading around a node, -1 if none."""
    rows: list[list] = []
    stack: list[tuple[int, int, int]] = []  # open elements, each with the nearest link and heading
    line = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            rows[stack.pop()[0]][1] = len(rows) - 1

    for tag, text, attributes in _tokens(page):
        name = tag.lstrip("/")
        if name in LINES or name == "a":
            line += 1
        if name != tag:
            depth = len(stack) - 1
            while depth >= 0 and rows[stack[depth][0]][3] != name:
                depth -= 1
            if depth >= 0:
                close(depth)
            continue
        if ended := ENDS.get(tag, ()):
            for depth in range(len(stack) - 1, -1, -1):
                if (there := rows[stack[depth][0]][3]) in ended:
                    close(depth)
                elif there in HOLDERS and tag != "a":
                    break
        parent, anchor, heading = stack[-1] if stack else (-1, -1, -1)
        up = [x[0] for x in stack[: -UP - 1 : -1]]
        n = len(rows)
        if not tag:
            rows.append([n, n, parent, "", None, text, up, line, anchor, heading])
            continue
        rows.append([n, n, parent, tag, [*attributes.items()], None, up, line, anchor, heading])
        if tag not in VOID:
            stack.append((n, n if tag == "a" else anchor, n if tag in HEADINGS else heading))
    close(0)
    return rows


def _told(pages: DataFrame, keep: tuple[str, ...], read: Callable[..., list], names: list[str], kinds: list[pa.DataType], schema: str, given: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns with the rows that `read` makes of each page and its columns `given`, many pages' in one batch."""
    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, more, of, rows, size = batch.column("html"), [batch.column(c) for c in given], [], [], 0
            for i in range(len(batch)):
                page = whole[i].as_py() or ""
                found = read(page, *(c[i].as_py() for c in more))
                rows += found
                of += [i] * len(found)
                size += len(page)
                if rows and (len(rows) >= TOLD or size >= TOLD_CHARS or i == len(batch) - 1):
                    same = [batch.column(c).take(pa.array(of, pa.int64())) for c in keep]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keep, *names])
                    of, rows, size = [], [], 0

    return pages.select(*dict.fromkeys((*keep, "html", *given))).mapInArrow(run, f"{kept}, {schema}")


def nodes(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with the nodes of each page: n and last (the interval), parent, tag ('' for text), attrs, text, up (the nearest ancestors, parent first), line, anchor, heading."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()]
    return _told(pages, keep, _nodes, [x.split(" ")[0] for x in NODE.split(", ")], kinds, f"{NODE}")


def _links(page: str) -> list[tuple[int, str, list[str]]]:
    """(pos, href, texts) of the links of a page in its order, an address being told: texts are those inside the link."""
    rows = _nodes(page)
    inside: dict[int, list[str]] = {}
    for r in rows:
        if not r[3] and r[8] >= 0:
            inside.setdefault(r[8], []).append(r[5])
    found = ((r[0], href) for r in rows if r[3] == "a" and (href := next((v for k, v in r[4] if k == "href"), None)) is not None)
    return [(pos, href, inside.get(n, [])) for pos, (n, href) in enumerate(found)]


def links(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with (pos, href, text) of each page's links, as anchors() tells them of a tree, for readers that ask for nothing else of the page: only the links leave the task."""
    found = _told(pages, keep, _links, ["pos", "href", "texts"], [pa.int32(), pa.string(), pa.list_(pa.string())], "pos int, href string, texts array<string>")
    return found.select(*keep, "pos", F.trim("href").alias("href"), squeezed(F.array_join("texts", " ")).alias("text"))


#: Characters that a text does without, and those that are white space in it.
GONE, SPACE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\u200B-\u200D\uFEFF]", r"[ \t\n\r\u00A0]+"


def squeezed(c: Column) -> Column:
    """Text with its white space as single spaces; control characters go."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, GONE, ""), SPACE, " "))


_GONE, _SPACE = re.compile(GONE), re.compile(SPACE)


def _chars(text: str) -> int:
    """The length of squeezed text."""
    return len(_SPACE.sub(" ", _GONE.sub("", text)).strip(" "))


def _bounded_links(most_lines: int, most_chars: int) -> Callable[[str], list[tuple]]:
    """The reader of bounded_links()."""

    def read(page: str) -> list[tuple]:
        rows = _nodes(page)
        free = [r for r in rows if not r[3] and r[8] < 0]
        at, line, total = [r[0] for r in free], [r[7] for r in free], [0]
        for r in free:
            total.append(total[-1] + _chars(r[5]))
        inside: dict[int, list] = {}
        for r in rows:
            if not r[3] and r[8] >= 0:
                inside.setdefault(r[8], []).append(r)
        top = [r[0] for r in rows if r[3] in ("h1", "h2")]

        def elements(link: list) -> list[tuple[int, int]]:
            own = inside.get(link[0], ())
            size, own_lines = sum(_chars(r[5]) for r in own), {r[7] for r in own}
            own_top, around, out = bisect_right(top, link[1]) - bisect_left(top, link[0]), 0, []
            for n in link[6]:
                end, tag = rows[n][1], rows[n][3]
                around += tag in ("h1", "h2")
                i, j = bisect_left(at, n), bisect_right(at, end)
                if tag in PAGE_LEVEL or size + total[j] - total[i] > most_chars or bisect_right(top, end) - bisect_left(top, n) > own_top + around:
                    break
                lines = {*own_lines}
                while i < j and len(lines) <= most_lines:
                    lines.add(line[i])
                    i = bisect_right(line, line[i], i, j)
                if len(lines) > most_lines:
                    break
                if len(lines) >= 2:
                    out.append((n, end))
                if len(lines) >= 4:
                    break
            return out

        return [(r[0], r[1], href, elements(r)) for r in rows if r[3] == "a" and (href := next((v for k, v in r[4] if k == "href"), None)) is not None]

    return read


def bounded_links(pages: DataFrame, *keep: str, most_lines: int, most_chars: int) -> DataFrame:
    """The kept columns with (link, link_last, href, up) of each page's links: up are the elements (n, end) around a link, the nearest first, that may be its card as far as they alone can tell. Of its
    nearest ancestors they are those of two lines or more, up to the first of four lines, and before the first that is a whole page or holds a page's heading, too many lines or too much text."""
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("n", pa.int32()), ("end", pa.int32())]))]
    found = _told(pages, keep, _bounded_links(most_lines, most_chars), ["link", "link_last", "href", "up"], kinds, "link int, link_last int, href string, up array<struct<n:int,end:int>>")
    return found.withColumn("href", F.trim("href"))


def _held(page: str, link: list[int], url: list[str], card: list[int]) -> list[tuple]:
    """Of each address in each card: its first place, what may be its title, and the texts of each line."""
    rows = _nodes(page)
    free, inside = [r for r in rows if r[8] < 0 and r[3] in ("", "img")], {}
    for r in rows:
        if r[8] >= 0 and r[3] in ("", "img"):
            inside.setdefault(r[8], []).append(r)
    at, of, seen, out = [r[0] for r in free], {}, set(), []
    for n, u in zip(link, url, strict=True):
        of.setdefault(u, []).append(n)
    for pos, (n, u, c) in enumerate(zip(link, url, card, strict=True)):
        if (u, c) in seen:
            continue
        seen.add((u, c))
        end, mine = rows[c][1], of[u]
        held = free[bisect_left(at, c) : bisect_right(at, end)]
        for a in mine[bisect_left(mine, c) : bisect_right(mine, end)]:
            held += inside.get(a, ())
        held.sort(key=lambda r: r[0])
        own = [r for r in held if n <= r[0] <= rows[n][1]]
        named = dict(rows[n][4])

        def heading(among: list) -> str | None:
            first = min((r[9] for r in among if not r[3] and r[9] >= 0), default=None)
            return None if first is None else " ".join(r[5] for r in held if not r[3] and r[9] == first)

        def picture(among: list) -> str | None:
            return next((v for r in among if r[3] for k, v in r[4] if k == "alt" and v), None)

        lines: dict[int, list[str]] = {}
        for r in held:
            if not r[3]:
                lines.setdefault(r[7], []).append(r[5])
        out.append((pos, u, [named.get("title"), named.get("aria-label"), heading(own), picture(own), " ".join(r[5] for r in own if not r[3]), heading(held), picture(held)], [" ".join(x) for x in lines.values()]))
    return out


def held(pages: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with (pos, url, told, lines) of the cards of each page. Its columns link, url and card are lists, in the page's order: links, their addresses and the elements that are their cards. A
    card holds the texts and pictures of no link, or of a link to its own address. told: what the link's title, label, heading, picture and text say, and the card's heading and picture."""
    kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    return _told(pages, keep, _held, ["pos", "url", "told", "lines"], kinds, "pos int, url string, told array<string>, lines array<string>", ("link", "url", "card"))


def joined(order: str, text: Column, when: Column) -> Column:
    """An aggregate: the texts in order, one space between them."""
    parts = F.sort_array(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), text.alias("x")))))
    return squeezed(F.array_join(F.transform(parts, lambda p: p["x"]), " "))


def anchors(tree: DataFrame, *page: str) -> DataFrame:
    """(page, n, last, up, attrs, href, text) of the links of a tree: text is what stands inside."""
    inside = tree.where("tag = '' and anchor >= 0").groupBy(*page, F.col("anchor").alias("n")).agg(joined("n", F.col("text"), F.lit(True)).alias("text"))
    links = tree.where("tag = 'a'").select(*page, "n", "last", "up", "attrs", F.trim(F.col("attrs")["href"]).alias("href")).where("href is not null")
    return links.join(inside, [*page, "n"], "left").withColumn("text", F.coalesce("text", F.lit("")))
