"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

#: Tags that start and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td textarea tfoot th thead tr ul".split())
#: Tags whose text is never shown.
HIDDEN_TAGS = frozenset("head iframe math noscript object script style svg template title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends an open tag of these kinds, unless one of the stoppers lies between.
ENDS = {tag: ("p",) for tag in BLOCK_TAGS - frozenset("body button caption html option optgroup tbody td tfoot th thead tr".split())} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
    "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "tfoot": ("p", "td", "th", "tr", "thead", "tbody")}
#: Tags that may stand in head; any other start tag ends an open head, whose end tag may be left out.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript object script style template title".split())
STOPPERS = frozenset("article aside blockquote body button details div dl fieldset figure footer form header main nav ol section table ul".split())

_NAME = re.compile(r"[a-z]+")
_TITLE = re.compile(r"<(/?)title\b", re.IGNORECASE)


class Block(NamedTuple):
    path: tuple  # of (tag, names in class, id and role), from the root
    text: str
    linked: int  # characters inside links


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.hidden = self.links = self.linked = self.at = 0
        self.parts: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(tuple(x for x in self.stack if x[0] in BLOCK_TAGS or x[1]), text, self.linked))
        self.parts, self.linked = [], 0

    def pop_to(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.hidden -= tag in HIDDEN_TAGS
            self.links -= tag == "a"
        del self.stack[at:]

    def leave_head(self, tag: str) -> None:
        """Closes an open head, and a title without an end tag, before a tag that may not stand in them."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == "title":
                end = _TITLE.search(self.rawdata, self.at + 1)
                if tag not in BLOCK_TAGS or end and end[1]:  # tags are plain text in a title that ends
                    return
                self.pop_to(k)
            elif name in HIDDEN_TAGS:
                if name == "head":
                    self.pop_to(k)
                return

    def parse_starttag(self, i):
        self.at = i
        return super().parse_starttag(i)

    def handle_starttag(self, tag, attrs):
        if self.hidden and tag not in HEAD_TAGS:
            self.leave_head(tag)
        if tag in BLOCK_TAGS:
            self.flush()
            ends = ENDS.get(tag, ())
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ends:
                    self.pop_to(k)
                    break
                if self.stack[k][0] in STOPPERS:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names = [v for k, v in attrs if v and k in ("class", "id", "role")]
        self.stack.append((tag, tuple(dict.fromkeys(_NAME.findall(" ".join(names).lower()))) if names else ()))
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if any(t in BLOCK_TAGS for t, _ in self.stack[k:]):
                    self.flush()
                self.pop_to(k)
                break
            if tag not in STOPPERS and self.stack[k][0] in STOPPERS:
                break

    def handle_data(self, data):
        if self.hidden and self.stack[-1][0] == "head" and data.strip():
            self.pop_to(len(self.stack) - 1)
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """The visible leaf blocks in page order, white space inside each turned into single blanks."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks
