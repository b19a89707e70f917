"""A forgiving reader of HTML that keeps block elements, their text blocks and what describes them."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# HTML's element kinds.
RAW = frozenset("script style textarea title".split())
FOREIGN = frozenset("svg math".split())
DROPPED = FOREIGN | frozenset("noscript template iframe object canvas".split())
#: Elements of svg and math that hold HTML.
HOLDING = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset(
    "html body main article section nav aside header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table thead tbody"
    " tfoot tr td th caption form fieldset legend label button select option address details summary dialog menu hgroup center hr".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
#: Tags that svg and math don't have: one of them ends an open svg or math.
BREAKING = BLOCK | frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())
#: A start of one of these ends an open one of the listed kinds, but not across the listed borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NAMING = ("class", "id", "role", "aria-label", "itemprop", "data-component")


@dataclass
class Page:
    """One entry per element, parents before children; blocks: (element, text) in page order."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    hidden: list[bool] = field(default_factory=lambda: [False])
    mark: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _naming(attributes: str) -> tuple[tuple[str, ...], bool, str]:
    words: list[str] = []
    hidden, mark = False, ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in NAMING:
            words += (w.lower() for w in PIECE.findall(value))
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "hidden":
            hidden = True
        elif name == "data-mark":
            mark = value
    return tuple(words), hidden, mark


class Tags:
    """Tags of a page, one after the other. What a search didn't find ahead isn't searched for again, so time is linear."""

    def __init__(self, source: str):
        self.source = source
        self.missing: set[str] = set()

    def _find(self, what: str, pos: int) -> int:
        found = -1 if what in self.missing else self.source.find(what, pos)
        if found < 0:
            self.missing.add(what)
        return found

    def _end(self, pos: int) -> int:
        """Behind the ">" that ends the tag open at pos; one in quotes doesn't, and a quote that none follows is a plain sign."""
        while ">" not in self.missing:
            m = STOP.search(self.source, pos)
            if m is None:
                self.missing.add(">")
            elif m[0] == ">":
                return m.end()
            else:
                closing = self._find(m[0], m.end())
                pos = m.end() if closing < 0 else closing + 1
        return -1

    def next(self, pos: int) -> tuple[int, int, str, str] | None:
        """(start, end, name, attributes) of the next tag from pos on; comments and declarations have no name."""
        source = self.source
        at = source.find("<", pos)
        while at >= 0:
            if source.startswith("<!--", at):
                end = self._find("-->", at + 4)
                return at, len(source) if end < 0 else end + 3, "", ""
            if source[at + 1 : at + 2] in ("!", "?"):
                end = self._find(">", at)
                if end >= 0:
                    return at, end + 1, "", ""
            elif m := NAME.match(source, at):
                end = self._end(m.end())
                if end >= 0:
                    return at, end, m[1].lower(), source[m.end() : end - 1].removesuffix("/")
            at = source.find("<", at + 1)
        return None


def read(source: str) -> Page:
    page = Page()
    tags = Tags(source)
    places: defaultdict[str, list[int]] = defaultdict(list)  # of a kind's open elements in stack
    stack, texts, in_link = [0], [], False
    dropped: list[tuple[str, bool]] = []  # open elements from a DROPPED one down, and whether svg or math reads what follows each
    held: Counter[str] = Counter()  # kinds of dropped
    pos, n = 0, len(source)

    def flush() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                page.blocks.append((stack[-1], text))
            texts.clear()

    def nearest(kinds) -> int:
        return max((places[k][-1] for k in kinds if places[k]), default=0)

    def close(kinds, borders) -> None:
        """End the innermost open element of these kinds, unless a border is inside it; what is closed is looked at once."""
        at = nearest(kinds)
        if at > nearest(borders):
            for x in stack[at:]:
                places[page.tag[x]].pop()
            del stack[at:]

    def in_foreign() -> bool:
        return bool(dropped) and dropped[-1][1]

    def leave() -> str:
        tag = dropped.pop()[0]
        held[tag] -= 1
        return tag

    def enter(tag: str) -> None:
        dropped.append((tag, tag in FOREIGN if tag in DROPPED or tag in HOLDING else in_foreign()))
        held[tag] += 1

    def goes_on(tag: str, ending: bool, closed: bool) -> bool:
        """Whether a tag belongs to what is dropped; if not, the dropped part ends before it."""
        if ending and held[tag]:
            while leave() != tag:
                pass
            return True
        if in_foreign() and tag in BREAKING:
            while in_foreign():
                leave()
            return bool(dropped) and goes_on(tag, ending, closed)
        if ending:
            return not (tag == "head" or (tag == "a" and in_link) or (tag in BLOCK and places[tag]))
        if tag == "body" and not places[tag]:
            return False
        if tag in ENDS and page.tag[stack[-1]] in ENDS[tag][0] and not any(held[k] for k in ENDS[tag][0] | ENDS[tag][1]):
            return False
        if not closed and tag not in VOID:
            enter(tag)
        return True

    while pos < n:
        found = tags.next(pos)
        if found is None:
            if not dropped:
                texts.append(source[pos:])
            break
        at, end, tag, attributes = found
        if at > pos and not dropped:
            piece = source[pos:at]
            texts.append(piece)
            if in_link:
                page.linked[stack[-1]] += len(piece)
        pos = end
        if not tag:
            continue
        ending = source[at + 1] == "/"
        closed = source[pos - 2] == "/" and not ending
        if tag in RAW and not ending and not (dropped and in_foreign()):
            last = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
            pos = last.end() if last else n
            continue
        if dropped:
            if goes_on(tag, ending, closed):
                continue
            dropped.clear()
            held.clear()
        if tag in DROPPED:
            if not ending and not closed:
                enter(tag)
            continue
        if tag == "br":
            texts.append(" ")
        elif tag == "a":
            in_link = not ending
            if in_link:
                page.links[stack[-1]] += 1
        elif tag == "head":
            flush()
        elif tag in BLOCK:
            flush()
            in_link = False
            if ending:
                close({tag}, ())
                continue
            if page.tag[stack[-1]] == "p":
                close({"p"}, ())
            if tag in ENDS:
                close(*ENDS[tag])
            words, hidden, mark = _naming(attributes) if attributes.strip() else ((), False, "")
            page.tag.append(tag)
            page.parent.append(stack[-1])
            page.depth.append(len(stack))
            page.words.append(words)
            page.hidden.append(hidden)
            page.mark.append(mark)
            page.links.append(0)
            page.linked.append(0)
            if tag not in VOID:
                stack.append(len(page.tag) - 1)
                places[tag].append(len(stack) - 1)
    flush()
    return page
