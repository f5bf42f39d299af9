"""The main text of web pages: their lines against those of the page with the nearest URL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodtide.llm.alignment import common_lines
from moodtide.llm.frames import stored, text_key
from moodtide.llm.url_filter import host_of, path_of

# Names of HTML, and words that name a box which is no part of the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; all but the first two may hold text that is not shown as such.
RAW = frozenset("script style iframe noembed noframes noscript template textarea title xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption address".split())
NO_TEXT = frozenset(
    "nav footer aside form head menu dialog search select button datalist object svg math canvas audio video map "
    "fieldset optgroup option label input".split()
)
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus cookie cookies consent gdpr "
    "notice notices banner popup modal overlay share sharing social related recommended newsletter subscribe signup login "
    "pagination pager widget skip hidden".split()
)
#: Words that mark a box only outside an article, where they name the page's own head.
OUTER_MARKS = frozenset("header head top".split())
#: Elements that an opening element of the same kind ends: for these no end tag is needed.
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
LISTS = frozenset("ul ol dl table select menu".split())

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
COMMENT_END = re.compile(r"--!?>|^-?>")
MAIN_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?main\b""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What is known of a line: it stands in a box that is no text, in no declared article, in a box or
#: in the running text of one.
BOXED, OPEN, BOX, TEXT = range(4)
OUTLINE = "array<struct<hash:long,kind:int,size:int>>"
OUTLINE_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("kind", pa.int32()), ("size", pa.int32())]))
#: A neighbour that shares more of the page's characters than this is a copy of it.
COPY_SHARE = 0.7
NEAR = 2


class Element(NamedTuple):
    name: str
    no_text: bool  # it, or one around it, is a box that is no text
    main: bool  # it, or one around it, is declared as the main text
    article: bool  # or as an article: one inside that is a reader's comment


OUTSIDE = Element("", False, False, False)


def is_box(name: str, attributes: str, around: Element) -> bool:
    """Whether an element holds something else than the page's text."""
    if name in NO_TEXT or (name == "header" and not around.main) or (name == "article" and around.article):
        return True
    if name in ("html", "body", "article", "main") or not attributes.strip(" /"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value.lower() in NO_TEXT_ROLES and not (around.main and value.lower() == "banner"):
            return True
        if key == "style" and NOT_SHOWN.search(value):
            return True
        if key in ("class", "id"):
            words = {w.lower() for w in NAME_WORD.findall(value)}
            if words & MARKS or (not around.main and words & OUTER_MARKS):
                return True
    return False


class Reader:
    """Reads one page into its lines: a line is the text of a block, with what is known of it."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int]] = []
        self.open: list[Element] = []
        self.count: dict[str, int] = {}
        self.parts: list[str] = []
        self.has_main = False

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                top = self.open[-1] if self.open else OUTSIDE
                kind = BOXED if top.no_text else OPEN if not top.main else TEXT if top.name in FLOW else BOX
                self.lines.append((text, kind))
            self.parts = []

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.count[self.open.pop().name] -= 1

    def start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self.end_line()
            if self.open and self.open[-1].name == "p":
                self.close(len(self.open) - 1)
            endable = SIBLINGS.get(name)
            if endable:
                depth = len(self.open)
                while depth and self.open[depth - 1].name not in LISTS:
                    depth -= 1
                    if self.open[depth].name in endable:
                        self.end_line()
                        self.close(depth)
                        break
        if name in VOID or attributes.endswith("/") and not block:
            return
        top = self.open[-1] if self.open else OUTSIDE
        box = not top.no_text and is_box(name, attributes, top)
        if block or box:
            if box:
                self.end_line()
            no_text = top.no_text or box
            main = top.main or not no_text and (name in ("article", "main") or bool(MAIN_ROLE.search(attributes)))
            self.has_main = self.has_main or main
            self.open.append(Element(name, no_text, main, top.article or main and name == "article"))
            self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        if self.count.get(name):
            if name not in BLOCKS and self.open[-1].name != name:
                return  # an inline box ends with its own tag or with what is around it
            self.end_line()
            depth = len(self.open) - 1
            while self.open[depth].name != name:
                depth -= 1
            self.close(depth)

    def read(self, html: str) -> list[tuple[str, int]]:
        at, n, quoted = 0, len(html), True
        while at < n:
            tag = TAG.search(html, at)
            if not tag:
                self.parts.append(html[at:])
                break
            if tag.start() > at:
                self.parts.append(html[at : tag.start()])
            at = tag.end()
            if tag[1]:
                end = COMMENT_END.search(html, at)
                at = end.end() if end else n
                continue
            if tag[2]:
                at = html.find(">", at) + 1 or n
                continue
            rest = ATTRIBUTES.match(html, at) if quoted else None
            if not rest:
                quoted = False  # a quote that is never closed: from here on the next > ends a tag
            end = rest.end() if rest else html.find(">", at) + 1 or n
            attributes, at, name = html[at : end - 1], end, tag[4].lower()
            if tag[3]:
                self.end(name)
            elif name in RAW:
                self.parts.append(" ") if name not in BLOCKS else None
                closing = RAW_END[name].search(html, at)
                at = html.find(">", closing.end()) + 1 or n if closing else n
            else:
                if name == "br":
                    self.parts.append(" ")
                self.start(name, attributes)
        self.end_line()
        return self.lines


def lines_of(html: str) -> list[tuple[str, int]]:
    """The lines of a page in their order. Where main text or an article is declared, nothing outside is text."""
    reader = Reader()
    lines = reader.read(html)
    if reader.has_main:
        lines = [(text, BOXED if kind == OPEN else kind) for text, kind in lines]
    return lines


def outlines_of(htmls: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in htmls:
        out = []
        for html in part:
            lines = lines_of(html.as_py() or "")
            out.append(
                [{"hash": xxhash.xxh64_intdigest(t.encode()) - (1 << 63), "kind": k, "size": len(t)} for t, k in lines]
            )
        yield pa.array(out, OUTLINE_TYPE)


def shared_lines(pages: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The lines that go since neighbours have them too; of each its path and lines."""
    for page, *others in pages:
        out = []
        for row, *near in zip(page.to_pylist(), *(o.to_pylist() for o in others)):
            # the nearest first; next in order, where equally near
            near = sorted(filter(None, near), key=lambda n: -len(commonprefix([row["path"], n["path"]])))
            out.append(sorted(lines_to_drop(row["lines"], [n["lines"] for n in near])))
        yield pa.array(out, pa.list_(pa.int32()))


def lines_to_drop(page: list[dict], neighbours: list[list[dict]]) -> set[int]:
    """Positions of lines that the page has in common, in order, with nearest pages that are no copies.

    A line outside any article goes when the nearest such page has it; a box inside an article,
    when the two nearest have it; running text of an article stays.
    """
    own = [line["hash"] for line in page]
    size = sum(line["size"] for line in page if line["kind"] != BOXED)
    shared: list[set[int]] = []
    for other in neighbours:
        common = {i for i, _ in common_lines(own, [line["hash"] for line in other])}
        if sum(page[i]["size"] for i in common if page[i]["kind"] != BOXED) <= COPY_SHARE * size:
            shared.append(common)
    first = shared[0] if shared else set()
    both = first & shared[1] if len(shared) > 1 else set()
    return {i for i, line in enumerate(page) if (line["kind"] == OPEN and i in first) or (line["kind"] == BOX and i in both)}


def kept_texts(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The lines that stay, two line breaks between them."""
    for htmls, drops in pages:
        out = []
        for html, drop in zip(htmls, drops.to_pylist()):
            gone = set(drop or ())
            lines = lines_of(html.as_py() or "")
            out.append("\n\n".join(t for i, (t, kind) in enumerate(lines) if kind != BOXED and i not in gone))
        yield pa.array(out, pa.string())


def numbered_in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their place in the order of ``by``, counted by range partitions, not by one task."""
    parts = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(
        parts.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")), "ordered"
    )
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("begin"))
    # a row per partition, not per page
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("begin")).alias("shift"))
    return placed.join(F.broadcast(begins), "part").withColumn("place", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def deletions(pages: DataFrame) -> DataFrame:
    """k1, k2, dropped: the positions of shared lines of each page that has some; pages: host, path, html, k1, k2."""
    lines = stored(
        pages.select("host", "path", "k1", "k2", F.arrow_udf(outlines_of, OUTLINE)("html").alias("lines")).select(
            "*", *text_key(F.col("lines"), "l1", "l2")
        ),
        "outlines",
    )
    # pages of the same lines are one neighbour, whatever their number
    different = lines.groupBy("host", "l1", "l2").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    placed = stored(numbered_in_order(different, ["host", "path", "l1", "l2"]), "placed")
    near = placed.where(F.exists("lines", lambda x: x["kind"].isin(OPEN, BOX)))
    names = []
    for step in range(1, NEAR + 1):
        for side in (step, -step):
            name = f"near{side}".replace("-", "_")
            other = placed.select(
                (F.col("place") - side).alias("place"), F.col("host").alias("host_there"), F.struct("path", "lines").alias(name)
            )
            near = near.join(other, "place", "left").withColumn(name, F.when(F.col("host") == F.col("host_there"), F.col(name)))
            near = near.drop("host_there")
            names.append(name)
    dropped = F.arrow_udf(shared_lines, "array<int>")(F.struct("path", "lines"), *names).alias("dropped")
    found = near.select("host", "l1", "l2", dropped).where(F.size("dropped") > 0)
    return lines.select("host", "l1", "l2", "k1", "k2").distinct().join(found, ["host", "l1", "l2"]).select("k1", "k2", "dropped")


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars, n_dropped.

    A page is read into lines, the text of one block each: character references decoded, white space
    as one space, trimmed. Lines in elements that HTML or their names declare as something else
    (menus, heads, feet, sidebars, notices, adverts, forms, readers' comments, what is not shown) are
    no text; where an article is declared, neither are lines outside it.

    Pages are paired by URL: within a host, in the order of their paths, with the NEAR before and
    after, the one with the longest path in common first. Lines are aligned by longest common
    subsequence, and shared ones go: lines in no article, if the nearest page that is no copy of the
    page has them, and boxes in an article, if the two nearest have them. Running text of a declared
    article stays, as pages of a host quote the same lines. What is left is joined by two line
    breaks in the order of the page; ``n_dropped`` counts shared lines that went.

    Null and empty pages have an empty text. A url that is null or without ``://`` belongs to the
    host and path of that name. Rows repeated whole, and pages of the same lines, are one neighbour
    and get the same text; a page alone on its host loses no shared lines. Only hashes of lines are
    sorted and joined; pages move once, to meet their deletions, if these are too many to broadcast.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    places = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    keyed = rows.select("*", *text_key(F.concat_ws("\n", F.coalesce(F.col("url"), F.lit("")), F.col("html"))))
    dropped = stored(deletions(keyed.select("html", "k1", "k2", *places)), "deletions")
    found = keyed.join(dropped, ["k1", "k2"], "left").select(
        "page_id", "url", F.arrow_udf(kept_texts, "string")("html", "dropped").alias("text"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped")
    )
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_dropped")
