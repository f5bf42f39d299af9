"""What one HTML page says about its posts.

A small helper for the page job: it walks one page and reports links with what surrounds
them, and the times the page's scripts give. Choosing ids, dropping repeats, checking and
parsing times are left to column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

from moodtide.fixed_values import (
    AUTHOR_CLASSES,
    OLD_LINK_PART,
    OLD_ROW_CLASS,
    POST_ID_ATTRIBUTE,
    ROW_SEARCH_LEVELS,
    SCRIPT_ID_KEY,
    SCRIPT_SOURCE_ID_KEY,
    SCRIPT_TIME_KEY,
    TIME_CLASS_PART,
    TIME_CLASSES,
    VISIBLE_TIME_PATTERN,
)

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN_TEXT_TAGS = frozenset("script style template rt rp".split())

_AUTHORS, _TIMES = frozenset(AUTHOR_CLASSES), frozenset(TIME_CLASSES)
_VISIBLE_TIME = re.compile(VISIBLE_TIME_PATTERN)
_NAMED_ID = re.compile(rf'"({SCRIPT_ID_KEY}|{SCRIPT_SOURCE_ID_KEY})"\s*:\s*(?:"(\d+)"|(\d+))')
_PUBLISH_TIME = re.compile(rf'"{SCRIPT_TIME_KEY}"\s*:\s*"([^"]+)"')
_JSON_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


class Outline(HTMLParser):
    """Elements in document order. Element ``i`` spans elements ``i..last[i]`` and the text
    pieces ``text_from[i]:text_to[i]``."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.text_from: list[int] = []
        self.text_to: list[int] = []
        self.texts: list[str] = []
        self.classed: list[int] = []  # elements with a class
        self.links: list[int] = []  # <a> elements
        self.scripts: list[str] = []
        self._open: list[int] = []
        self._buffer: list[str] = []
        self._hidden = 0
        self._open_tags: Counter[str] = Counter()
        self._enter("[document]", {})
        self.feed(html)
        self.close()
        self._leave(0)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def _flush(self) -> None:
        if not self._buffer:
            return
        text = "".join(self._buffer)
        self._buffer = []
        if self.tags[self._open[-1]] == "script":
            self.scripts.append(text)
        if not self._hidden and text.strip():
            self.texts.append(text.strip())

    def _enter(self, tag: str, attrs: dict[str, str]) -> None:
        element = len(self.tags)
        if "class" in attrs:
            self.classed.append(element)
        if tag == "a":
            self.links.append(element)
        self.parent.append(self._open[-1] if self._open else -1)
        self._open.append(element)
        self._open_tags[tag] += 1
        self._hidden += tag in HIDDEN_TEXT_TAGS
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.last.append(-1)
        self.text_from.append(len(self.texts))
        self.text_to.append(-1)

    def _leave(self, depth: int) -> None:
        if self._buffer:
            self._flush()
        last, text_to = len(self.tags) - 1, len(self.texts)
        while len(self._open) > depth:
            element = self._open.pop()
            tag = self.tags[element]
            self._open_tags[tag] -= 1
            self._hidden -= tag in HIDDEN_TEXT_TAGS
            self.last[element] = last
            self.text_to[element] = text_to

    def handle_starttag(self, tag, attrs):
        if self._buffer:
            self._flush()
        self._enter(tag, {name: value or "" for name, value in attrs})
        if tag in VOID_TAGS:
            self._leave(len(self._open) - 1)

    def handle_endtag(self, tag):
        if self._buffer:
            self._flush()
        if not self._open_tags[tag]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[depth]] == tag:
                self._leave(depth)
                return

    def handle_data(self, data):
        self._buffer.append(data)

    def _other(self, _data):
        self._flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _other

    def classes(self, element: int) -> list[str]:
        return self.attrs[element].get("class", "").split()

    def text(self, element: int, separator: str = "") -> str:
        return separator.join(self.texts[self.text_from[element] : self.text_to[element]])

    def first_inside(self, element: int, sorted_elements: list[int]) -> int | None:
        """The first of ``sorted_elements`` below ``element``."""
        at = bisect_left(sorted_elements, element + 1)
        if at < len(sorted_elements) and sorted_elements[at] <= self.last[element]:
            return sorted_elements[at]
        return None


def _post_anchors(page: Outline) -> list[int]:
    marked = [i for i in page.links if POST_ID_ATTRIBUTE in page.attrs[i]]
    if marked:
        return marked
    news = [i for i in page.links if OLD_LINK_PART in page.attrs[i].get("href", "")]
    rows = [i for i in page.classed if page.tags[i] == "div" and OLD_ROW_CLASS in page.classes(i)]
    firsts = [page.first_inside(row, news) for row in rows]
    return [i for i in firsts if i is not None]


def post_links(html: str) -> list[dict]:
    """Post anchors with author and time taken from the nearest row that shows either."""
    page = Outline(html)
    authors = [i for i in page.classed if not _AUTHORS.isdisjoint(page.classes(i))]
    times = [
        i
        for i in page.classed
        if not _TIMES.isdisjoint(page.classes(i)) or TIME_CLASS_PART in page.attrs[i]["class"]
    ]
    visible: dict[int, str | None] = {}
    found = []
    for pos, anchor in enumerate(_post_anchors(page)):
        row = page.parent[anchor]
        for _ in range(ROW_SEARCH_LEVELS):
            if row < 0 or any(
                page.first_inside(row, marks) is not None for marks in (authors, times)
            ):
                break
            row = page.parent[row]
        author = tag_time = text_time = None
        if row >= 0:
            author_at = page.first_inside(row, authors)
            time_at = page.first_inside(row, times)
            author = None if author_at is None else page.text(author_at)
            tag_time = None if time_at is None else page.text(time_at)
            if not tag_time:
                if row not in visible:
                    match = _VISIBLE_TIME.search(page.text(row, " "))
                    visible[row] = match and match.group(1)
                text_time = visible[row]
        found.append(
            {
                "pos": pos,
                "attr_id": page.attrs[anchor].get(POST_ID_ATTRIBUTE),
                "href": page.attrs[anchor].get("href"),
                "title": page.text(anchor),
                "author": author,
                "tag_time": tag_time,
                "text_time": text_time,
            }
        )
    script_times = _script_times(page.scripts)
    found.extend({"script_id": i, "script_time": t} for i, t in script_times.items())
    return found


def _objects_around(script: str, places: list[int]) -> dict[int, tuple[int, int] | None]:
    """For each place the span of the innermost object that holds it; None where that is never closed.

    One pass over all braces outside of strings: the braces open at a place are a stack, and the
    top of it is the object asked for.
    """
    open_: list[tuple[int, list[int]]] = []  # where it begins, and the places directly inside
    found: dict[int, tuple[int, int] | None] = dict.fromkeys(places)
    waiting = sorted(places, reverse=True)

    def settle(until: int) -> None:
        while waiting and waiting[-1] < until:
            place = waiting.pop()
            if open_:
                open_[-1][1].append(place)

    for mark in _JSON_MARK.finditer(script):
        settle(mark.start())
        if mark.group() == "{":
            open_.append((mark.start(), []))
        elif mark.group() == "}" and open_:
            begin, inside = open_.pop()
            found.update(dict.fromkeys(inside, (begin, mark.end())))
    return found


def _script_times(scripts: list[str]) -> dict[str, str]:
    """Post id to publish time. Plain ids go before quoted ones and those before
    ``source_post_id``; of each kind only the first mention in a script counts."""
    times: dict[str, str] = {}
    for script in scripts:
        if SCRIPT_TIME_KEY not in script:
            continue
        mentions: dict[tuple[int, str], int] = {}
        for match in _NAMED_ID.finditer(script):
            name, quoted, plain = match.groups()
            if name == SCRIPT_ID_KEY:
                mentions.setdefault((1, quoted) if quoted else (0, plain), match.start())
            elif quoted:
                mentions.setdefault((2, quoted), match.start())
        around = _objects_around(script, list(mentions.values()))
        published: dict[tuple[int, int], str | None] = {}  # of each object, looked for once
        for kind, post_id in sorted(mentions):
            span = around[mentions[kind, post_id]]
            if post_id in times or span is None:
                continue
            if span not in published:
                time = _PUBLISH_TIME.search(script, *span)
                published[span] = time and time.group(1).strip()
            if published[span] is not None:
                times[post_id] = published[span]
    return times
