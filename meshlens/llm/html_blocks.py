"""HTML to leaf blocks: the runs of text between block boundaries, each with its ancestors."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape

#: Fixed values from the HTML standard: elements without content, elements whose content isn't markup, inline elements,
#: and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template")
#: Elements of other vocabularies, which stand in a line of text with all that they hold.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head", "title"),
} | {x: ("p",) for x in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Elements that a start tag doesn't reach through when it closes others.
BARRIER = frozenset("body html article section div nav aside header footer main form table ul ol dl td th blockquote details fieldset figure".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_REST = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
_SPECIAL = re.compile("[>\"']")
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*RAW, "title", "textarea")}
#: References whose number html.unescape() wouldn't read, as Python reads no number so long; none is a character.
_HUGE = re.compile(r"&#(?:[0-9]{9,}+|[xX][0-9a-fA-F]{9,}+);?+")
_HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True, eq=False)
class Node:
    """An element that isn't inline, as the ancestor of blocks: ancestors are shared and never copied, however deep they are."""

    up: Node | None
    name: str
    hints: tuple[str, ...]  # ".word" each
    state: object = None  # what a model has worked out for it


@dataclass(slots=True)
class Block:
    place: Node | None  # the innermost ancestor that isn't inline
    text: str
    linked: int  # characters of text inside links


def path(place: Node | None) -> tuple[str, ...]:
    """Ancestors from the outermost in: tag names, each followed by its hints."""
    out: list[tuple[str, ...]] = []
    while place is not None:
        out.append((place.name, *place.hints))
        place = place.up
    return tuple(x for part in reversed(out) for x in part)


class _Tags:
    """Where tags end.  Quotes hide a >, and a tag that never ends is text.

    A search that finds no end would read the rest of the page again for each broken tag; so after
    the first such, ends are looked up in a table that is made once, from the back.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.places: list[int] | None = None

    def end(self, at: int) -> int:
        """The place after the tag whose attributes begin at `at`, or -1."""
        if self.places is None:
            if m := _REST.match(self.html, at):
                return m.end()
            self._make_table()
        return self.ends[bisect_left(self.places, at)]

    def _make_table(self) -> None:
        self.places = [m.start() for m in _SPECIAL.finditer(self.html)]
        n = len(self.places)
        self.ends = [-1] * (n + 2)
        following = {'"': n, "'": n}
        for k in range(n - 1, -1, -1):
            c = self.html[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k] + 1
            else:
                self.ends[k] = self.ends[following[c] + 1]
                following[c] = k


def hints(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and label, in lower case."""
    if "=" not in attributes:
        return ()
    found = " ".join("".join(m) for m in _HINT.findall(attributes)).lower()
    return tuple(f".{w}" for w in _WORD.findall(found)) if found else ()


def characters(text: str) -> str:
    """Text with its character references decoded."""
    if "&" not in text:
        return text
    return unescape(_HUGE.sub("\ufffd", text) if "&#" in text else text)


class _Stack:
    """Open elements.  Every question is answered without walking through them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[Node | None] = []
        self.at: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def open(self, name: str) -> int:
        return len(self.at.get(name, ()))

    def push(self, name: str, attributes: str = "") -> None:
        place = self.place()
        self.at.setdefault(name, []).append(len(self.names))
        if name in BARRIER:
            self.barriers.append(len(self.names))
        self.names.append(name)
        self.nodes.append(place if name in INLINE else Node(place, name, hints(attributes)))

    def place(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def cut(self, size: int) -> None:
        """Closes all but the first `size`."""
        while len(self.names) > size:
            self.nodes.pop()
            name = self.names.pop()
            self.at[name].pop()
            if self.barriers and self.barriers[-1] == len(self.names):
                self.barriers.pop()

    def close(self, name: str) -> None:
        if self.open(name):
            self.cut(self.at[name][-1])

    def closed_by(self, names: tuple[str, ...]) -> None:
        """Closes the innermost of the names, unless a barrier is inside it."""
        top = max((self.at[x][-1] for x in names if self.open(x)), default=-1)
        if top >= 0 and (not self.barriers or top >= self.barriers[-1]):
            self.cut(top)


def blocks(html: str) -> list[Block]:
    """The leaf blocks in page order, with white space collapsed; blocks without text are left out.

    Broken markup never fails: an end tag without a start is skipped, elements left open end with
    their parent, a comment or script left open takes the rest, and a tag left open is text.  The
    contents of scripts, styles and templates are no text; formulas, drawings and fallbacks for what
    isn't shown are.  Time and memory are linear in the page, whatever its markup.
    """
    out: list[Block] = []
    stack, tags = _Stack(), _Tags(html)
    parts: list[str] = []
    linked, drawn = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack.place(), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            text = characters(text)
            parts.append(text)
            if stack.open("a"):
                linked += len(text.strip())

    def next_markup(at: int) -> tuple[int, int, str, bool, str]:
        """(begin, end, name, whether it is an end tag, attributes) of the next markup; no name: a comment or the like."""
        while (begin := html.find("<", at)) >= 0:
            c = html[begin + 1 : begin + 2]
            if c == "!" and html.startswith("--", begin + 2):
                end = html.find("-->", begin + 2)
                return begin, end + 3 if end >= 0 else len(html), "", False, ""
            if c in ("!", "?"):
                end = html.find(">", begin)
                if end >= 0:
                    return begin, end + 1, "", False, ""
                begin = html.find("<!--", begin)  # without another > only a comment left open can follow
                return (begin, len(html), "", False, "") if begin >= 0 else (-1, -1, "", False, "")
            if m := _NAME.match(html, begin + 1 + (c == "/")):
                end = tags.end(m.end())
                if end >= 0:
                    return begin, end, m[0].lower(), c == "/", html[m.end() : end - 1]
            at = begin + 1
        return -1, -1, "", False, ""

    at = 0
    while True:
        begin, end, name, closing, attributes = next_markup(at)
        if begin < 0:
            break
        said(html[at:begin])
        at = end
        if not name:
            continue
        if name in _END and not closing:
            found = _END[name].search(html, end)
            body_end, at = (found.start(), found.end()) if found else (len(html), len(html))
            if name not in RAW:
                flush()
                stack.push(name)
                said(html[end:body_end])
                flush()
                stack.close(name)
            continue
        drawn = drawn or name in FOREIGN
        inline = name in INLINE or drawn and (name in FOREIGN or any(map(stack.open, FOREIGN)))
        if not inline:
            flush()
        if name == "br":
            parts.append(" ")
        if closing:
            stack.close(name)
            continue
        if closes := CLOSES.get(name):
            stack.closed_by(closes)
        if name not in VOID and not attributes.endswith("/"):
            stack.push(name, attributes)
    said(html[at:])
    flush()
    return out
