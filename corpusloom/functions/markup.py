"""Elements of an HTML page and simple selectors over them, for functions that run on batches of pages.

A selector is a list, divided by commas, of steps divided by spaces (each inside the one before); a step is a tag, #id, .class and
[attribute], [attribute='value'], [attribute*='part'] in any number. Trees are those of browsers for closed elements, and for open
li, p, a, option, dd, dt, td, th and tr; misnested formatting is not put right.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html.parser import HTMLParser

#: Elements without content, and which open elements a start tag closes, up to which others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "a": ("a",), "option": ("option",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
WALLS = frozenset("ul ol dl table body html div article section select button".split())


class Page(HTMLParser):
    """Elements in order of their start, each with its parent, the last element inside it, and the texts inside it."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.texts: list[tuple[int, int]] = []
        self.pieces: list[str] = []
        self._open: list[int] = []
        self._found: dict[str, list[int]] = {}
        self.feed(html or "")
        self.close()
        while self._open:
            self._shut()

    def _shut(self) -> None:
        at = self._open.pop()
        self.ends[at], self.texts[at] = len(self.tags), (self.texts[at][0], len(self.pieces))

    def _close_open(self, tags: tuple[str, ...], walls: frozenset[str]) -> None:
        """Shuts the nearest open element of the tags, and what is open in it, if no wall is nearer."""
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.tags[self._open[depth]]
            if tag in tags:
                while len(self._open) > depth:
                    self._shut()
                if "tr" not in tags:  # a row shuts the cell first and then the row before
                    return
            elif tag in walls:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close_open(("p",), WALLS)
        if tag in CLOSES:
            self._close_open(CLOSES[tag], WALLS)
        at = len(self.tags)
        self.tags.append(tag)
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        self.attrs.append(own)
        self.parents.append(self._open[-1] if self._open else -1)
        self.ends.append(at + 1)
        self.texts.append((len(self.pieces), len(self.pieces)))
        if tag not in VOID:
            self._open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag):
        if any(self.tags[i] == tag for i in self._open):
            while self.tags[self._open[-1]] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        self.pieces.append(data)

    def text(self, at: int) -> str:
        first, last = self.texts[at]
        return "".join(self.pieces[first:last])

    def all_text(self) -> str:
        return "".join(self.pieces)

    def find(self, selector: str) -> list[int]:
        """All elements that match, in order; one pass over the page for each step of a selector, once."""
        if selector not in self._found:
            hits: set[int] = set()
            for chain in steps_of(selector):
                inside = None
                for step in chain:
                    own = [matches(step, tag, attrs) and (inside is None or (p >= 0 and inside[p])) for tag, attrs, p in zip(self.tags, self.attrs, self.parents, strict=True)]
                    inside = []
                    for at, p in enumerate(self.parents):
                        inside.append(own[at] or (p >= 0 and inside[p]))
                hits.update(i for i, fits in enumerate(own) if fits)
            self._found[selector] = sorted(hits)
        return self._found[selector]

    def inside(self, at: int, selector: str) -> list[int]:
        """Elements inside the one at `at` that match."""
        found = self.find(selector)
        return found[bisect_right(found, at) : bisect_right(found, self.ends[at] - 1)]

    def first(self, at: int, selector: str) -> int | None:
        found = self.find(selector)
        i = bisect_right(found, at)
        return found[i] if i < len(found) and found[i] < self.ends[at] else None

    def closest(self, at: int, selector: str) -> int | None:
        """The element itself or the nearest around it that matches."""
        fits = set(self.find(selector))
        while at >= 0 and at not in fits:
            at = self.parents[at]
        return at if at >= 0 else None

    def after(self, at: int) -> int | None:
        """The next element with the same parent."""
        follower = self.ends[at]
        return follower if follower < len(self.tags) and self.parents[follower] == self.parents[at] else None


STEP = re.compile(r"(?P<tag>^[a-z][a-z0-9]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>\*?=)'(?P<value>[^']*)')?\]")


@lru_cache(maxsize=1000)
def steps_of(selector: str) -> list[list[list[tuple]]]:
    """Chains of steps; a step is a list of conditions."""
    out = []
    for chain in selector.split(","):
        steps = []
        for step in chain.split():
            found = list(STEP.finditer(step))
            if "".join(m.group() for m in found) != step:
                raise ValueError(f"no selector of the kinds that are known: {selector}")
            steps.append([tuple(m.group("tag", "id", "cls", "name", "op", "value")) for m in found])
        out.append(steps)
    return out


def matches(step: list[tuple], tag: str, attrs: dict[str, str]) -> bool:
    for own_tag, own_id, cls, name, op, value in step:
        if own_tag and tag != own_tag or own_id and attrs.get("id") != own_id or cls and cls not in attrs.get("class", "").split():
            return False
        if name and (name not in attrs or op == "=" and attrs[name] != value or op == "*=" and value not in attrs[name]):
            return False
    return True
