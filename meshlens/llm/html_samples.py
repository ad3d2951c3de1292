"""Labelled pages to train on: invented pages of many layouts, each block marked as main text or not."""

from __future__ import annotations

import random

#: Class names in common use for the parts of a page.
CONTENT = "content post-content entry-content article-body post story main-text body-text prose text entry".split()
MENU = "menu nav navbar navigation topnav breadcrumbs breadcrumb tabs site-nav pagination toc".split()
ADVERT = "ad ads advert advertisement sponsored promo banner ad-slot sponsor".split()
SIDE = "sidebar side widget related related-posts recommended trending popular more-stories newsletter-box".split()
NOTICE = "cookie cookie-notice consent notice alert gdpr popup modal subscribe-banner".split()
COMMENT = "comments comment comment-list reader-comments discussion responses disqus replies".split()
FOOT = "footer site-footer page-footer copyright bottom legal".split()
HEAD = "header site-header masthead page-header topbar branding".split()
FORM = "login search signup newsletter contact-form subscribe".split()
SHARE = "share social sharing tags byline-links".split()


class Writer:
    """Writes one page; marks holds (text of the block, whether it is main text) in page order."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.out: list[str] = []
        self.marks: list[int] = []
        vowels, consonants = "aeiouéüñ", "bcdfghklmnprstvz"
        self.syllables = ["".join((self.rng.choice(consonants), self.rng.choice(vowels), self.rng.choice(["", "n", "r", "s", "th"]))) for _ in range(60)]

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choices(self.syllables, k=self.rng.choice((1, 1, 2, 2, 3)))) for _ in range(n))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            s = self.words(1, 16).capitalize()
            noise = self.rng.choice(("", "", "", "%%%", "!!", " |", "&amp;"))
            out.append(f"{s.upper() if noise == '!!' else s}{noise}.")
        return " ".join(out)

    def block(self, tag: str, text: str, main: int, attrs: str = "") -> None:
        closed = f"</{tag}>" if tag != "p" or self.rng.random() < 0.85 else ""
        self.out.append(f"<{tag}{attrs}>{text}{closed}")
        self.marks.append(main)

    def attr(self, names: list[str]) -> str:
        return self.rng.choice((f' class="{self.rng.choice(names)}"', f' id="{self.rng.choice(names)}"'))

    def links(self, low: int, high: int) -> None:
        self.out.append("<ul>")
        for _ in range(self.rng.randint(low, high)):
            word = self.words(1, 3)
            self.block("li", f'<a href="/{word.split()[0]}">{word}</a>', 0)
        self.out.append("</ul>")

    def chrome(self, kind: str) -> None:
        """A part of the page that is no main text."""
        rng = self.rng
        names = {"menu": MENU, "ad": ADVERT, "side": SIDE, "notice": NOTICE, "comment": COMMENT, "foot": FOOT, "head": HEAD, "form": FORM, "share": SHARE}[kind]
        tag = {"menu": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form", "comment": "section"}.get(kind, "div")
        plain = rng.random() < 0.35
        tag, attrs = ("div", self.attr(names)) if plain or tag == "div" else (tag, self.attr(names) if rng.random() < 0.4 or kind == "comment" else "")
        self.out.append(f"<{tag}{attrs}>")
        if kind == "menu":
            self.links(2, 9)
        elif kind in ("ad", "notice"):
            if rng.random() < 0.6:
                self.out.append(self.sentences(1, 3))
                self.marks.append(0)
            else:
                for _ in range(rng.randint(1, 2)):
                    self.block("p", self.sentences(1, 3), 0)
        elif kind == "side":
            self.block(rng.choice(("h2", "h3", "h4")), self.words(1, 4), 0)
            self.links(1, 6) if rng.random() < 0.6 else self.block("p", self.sentences(1, 4), 0)
        elif kind == "comment":
            self.block(rng.choice(("h2", "h3")), f"{rng.randint(1, 90)} {self.words(1, 1)}", 0)
            for _ in range(rng.randint(1, 5)):
                inner = rng.choice(("div", "li", "article"))
                self.out.append(f'<{inner} class="{rng.choice(("comment", "comment-body", "reply", "response"))}">')
                self.block("p", self.sentences(1, 5), 0)
                self.out.append(f"</{inner}>")
        elif kind == "foot":
            if rng.random() < 0.7:
                self.out.append(f"&copy; {self.words(1, 2)} &middot; {self.sentences(1, 3)}")
                self.marks.append(0)
            else:
                self.block("p", f"© {rng.randint(1999, 2030)} {self.sentences(1, 2)}", 0)
                self.links(1, 5)
        elif kind == "head":
            if rng.random() < 0.5:
                self.block("h1", self.words(1, 4), 0)
            self.block("p", self.words(2, 8), 0)
        elif kind == "form":
            self.block("label", self.words(1, 3), 0) if rng.random() < 0.0 else self.block("p", self.words(1, 6), 0)
            self.block("button", self.words(1, 2), 0)
        else:
            self.block("p", f'<a href="#">{self.words(1, 2)}</a> <a href="#">{self.words(1, 2)}</a>', 0)
        if kind != "foot" or rng.random() < 0.8:
            self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        opening = rng.choice(("<article>", "<article>", "<main>", "<main><article>", f"<div{self.attr(CONTENT)}>", f"<section{self.attr(CONTENT)}>"))
        self.out.append(opening)
        if rng.random() < 0.85:
            title = self.words(1, 9).capitalize()
            wrap = rng.random() < 0.2
            self.out.append("<header>" * wrap)
            self.block("h1", title, 1)
            self.out.append("</header>" * wrap)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 8, 12))):
            kind = rng.random()
            if kind < 0.08:
                self.out.append("<p><b>" + self.sentences(1, 6) + "<br>")
                self.marks.append(1)
            elif kind < 0.16:  # a line of a list or table in words: within an article it is text, whatever it looks like
                self.block("p", rng.choice((" | ", " | ", " - ", " · ")).join(self.words(1, 2) + rng.choice(("", "", ".", ",")) for _ in range(rng.choice((2, 2, 3, 5, 9, 18, 30)))) + rng.choice((" |", "")), 1)
            elif kind < 0.75:
                text = self.sentences(1, 6)
                self.block("p", f"<b>{text}</b>" if rng.random() < 0.1 else f'{text} <a href="/x">{self.words(1, 2)}</a>.' if rng.random() < 0.15 else text, 1)
            elif kind < 0.83:
                self.block(rng.choice(("h2", "h3")), self.words(1, 6), 1)
            elif kind < 0.89:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    self.block("li", self.words(2, 14), 1)
                self.out.append("</ul>")
            elif kind < 0.93:
                self.block("blockquote", self.sentences(1, 2), 1)
            elif kind < 0.96:
                self.block("pre", self.words(3, 20), 1)
            elif kind < 0.98:
                self.out.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    self.block("td", self.words(1, 4), 1)
                self.out.append("</tr></table>")
            else:
                self.chrome(rng.choice(("ad", "share", "side", "notice")))
        if rng.random() < 0.1:
            self.chrome("comment")
        for tag in ("article", "main", "div", "section"):
            if f"<{tag}" in opening:
                self.out.append(f"</{tag}>")


#: Layouts that pages are written in; of ten pages, so many are of each.
FAMILIES = {"semantic": 5, "columns": 2, "tables": 2, "bare": 1}
#: Class names that say where a part stands and not what it is.
CENTRE = "col-main main-col column center centre middle page wrapper inner container col-md-8 left-col primary box".split()
EDGE = "col-left col-right left right column col-md-4 secondary rail gutter box inner".split()
SEPARATORS = (" | ", " | ", " · ", " / ", " » ", " - ", " ")


def family_of(seed: int) -> str:
    return [name for name, n in FAMILIES.items() for _ in range(n)][seed % 10]


def labelled_page(seed: int, family: str | None = None) -> tuple[str, list[int]]:
    """(html, a mark for each leaf block in page order): 1 for main text.  The family follows from the seed unless it is given."""
    family = family or family_of(seed)
    w = Layouts(seed)
    if family == "semantic":
        return semantic_page(w, seed)
    getattr(w, family)()
    return "".join(w.out), w.marks


class Layouts(Writer):
    """Pages whose markup names no part: columns, layout tables, and text without any container."""

    def said(self, text: str, main: int) -> None:
        self.out.append(text)
        self.marks.append(main)

    def menu(self) -> str:
        """A few links in one line, or their words alone."""
        rng = self.rng
        words = [self.words(1, 2).capitalize() for _ in range(rng.randint(2, 7))]
        linked = rng.random() < 0.75
        return rng.choice(SEPARATORS).join(f'<a href="/{k}">{x}</a>' if linked else x for k, x in enumerate(words))

    def start(self) -> None:
        head = self.rng.random() < 0.8
        self.out.append(f"<html><head><title>{self.words(2, 6)}</title></head><body>" if head else "<body>")
        if head:
            self.marks.append(0)

    def text(self, between: tuple[str, str]) -> None:
        """An article's title and paragraphs; between: what opens and closes a paragraph."""
        rng, (opening, closing) = self.rng, between
        self.block(rng.choice(("h1", "h1", "h2")), self.words(2, 9).capitalize(), 1)
        for _ in range(rng.choice((1, 2, 2, 3, 4, 6, 9))):
            text = self.sentences(2, 6)
            if rng.random() < 0.15:
                text += f' <a href="/y">{self.words(1, 2)}</a>.'
            self.said(f"{opening}{text}{closing}", 1)
            if rng.random() < 0.12:
                self.block(rng.choice(("h2", "h3")), self.words(1, 6), 1)
            if rng.random() < 0.08:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    self.block("li", self.words(3, 12), 1)
                self.out.append("</ul>")

    def edge(self) -> None:
        """What stands beside an article or around it."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.35:
            if rng.random() < 0.5:
                self.block(rng.choice(("h3", "h4", "div", "p")), self.words(1, 3).capitalize(), 0)
            self.links(2, 7)
        elif kind < 0.6:
            self.block(rng.choice(("p", "div")), self.menu(), 0)
        elif kind < 0.8:
            self.block("h4", self.words(1, 3).capitalize(), 0)
            self.block("p", f'<a href="/z">{self.words(2, 6)}</a>', 0)
        else:
            self.block("p", self.words(1, 6), 0)

    def foot(self) -> None:
        self.block(self.rng.choice(("p", "div")), self.rng.choice((f"&copy; {self.rng.randint(1999, 2030)} {self.words(1, 4)}", f"Copyright © {self.words(1, 3)}", f"{self.words(1, 2).capitalize()} {self.rng.randint(1, 28)} {self.words(1, 1)} {self.rng.randint(1995, 2030)}", self.menu())), 0)

    def columns(self) -> None:
        rng = self.rng
        name = lambda names: f' class="{rng.choice(names)}"' if rng.random() < 0.7 else f' id="{rng.choice(names)}"' if rng.random() < 0.4 else ""
        self.start()
        if rng.random() < 0.7:
            self.out.append("<div>")
            self.block(rng.choice(("p", "div", "h2")), self.words(1, 4).capitalize(), 0)
            self.block(rng.choice(("p", "div")), self.menu(), 0)
            self.out.append("</div>")
        self.out.append('<div class="row">' if rng.random() < 0.5 else "<div>")
        parts = ["centre"] + ["edge"] * rng.randint(1, 2)
        rng.shuffle(parts)
        for part in parts:
            self.out.append(f"<div{name(CENTRE if part == 'centre' else EDGE)}>")
            if part == "centre":
                self.text(("<p>", "</p>") if rng.random() < 0.8 else ("<div>", "</div>"))
            else:
                for _ in range(rng.randint(1, 3)):
                    self.edge()
            self.out.append("</div>")
        self.out.append("</div>")
        self.foot()
        self.out.append("</body></html>")

    def tables(self) -> None:
        rng = self.rng
        self.start()
        self.out.append(rng.choice(("<table>", '<table width="100%" border=0>')))
        if rng.random() < 0.7:
            self.out.append("<tr>")
            self.block("td", self.words(1, 4).capitalize(), 0, ' colspan="2"')
            self.out.append("</tr>")
        if rng.random() < 0.8:
            self.out.append("<tr>")
            self.block("td", self.menu(), 0)
            self.out.append("</tr>")
        self.out.append("<tr>")
        cells = ["text", *["edge"] * rng.randint(0, 2)]
        rng.shuffle(cells)
        for cell in cells:
            self.out.append(rng.choice(("<td>", '<td valign="top">')))
            if cell == "text":
                self.text(rng.choice((("<p>", "</p>"), ("<p>", ""), ("<div>", "</div>"))))
            else:
                for _ in range(rng.randint(1, 2)):
                    self.edge()
            self.out.append("</td>")
        self.out.append("</tr><tr>")
        self.block("td", rng.choice((f"&copy; {self.words(1, 3)}", self.menu())), 0)
        self.out.append("</tr></table></body></html>")

    def bare(self) -> None:
        rng = self.rng
        self.start()
        if rng.random() < 0.6:
            self.block("p", self.menu(), 0)
        self.text(("<p>", rng.choice(("</p>", ""))))
        if rng.random() < 0.5:
            self.out.append("<hr>")
            self.foot()
        self.out.append("</body></html>")


def semantic_page(w: Writer, seed: int) -> tuple[str, list[int]]:
    """Pages whose tags or class names say what their parts are."""
    rng = w.rng
    if rng.random() < 0.16:  # an article and nothing else
        if rng.random() < 0.35:  # of a few words
            tag = rng.choice(("article", "article", "main"))
            w.out.append(f"<{tag}>")
            w.block(rng.choice(("p", "p", "p", "h1")), w.words(1, 5).capitalize() + rng.choice(("", ".", ".")), 1)
            w.out.append(f"</{tag}>")
        else:
            w.article()
        return "".join(w.out), w.marks
    w.out.append(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{w.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    w.marks.append(0)
    before = [k for k in ("notice", "head", "menu", "ad", "form", "share", "side") if rng.random() < {"menu": 0.75, "ad": 0.45}.get(k, 0.25)]
    rng.shuffle(before)
    for kind in before:
        w.chrome(kind)
    w.out.append(f"<!-- ad {seed} -->")
    w.article()
    after = [k for k in ("share", "side", "ad", "comment", "form", "menu", "notice") if rng.random() < 0.25]
    for kind in after:
        w.chrome(kind)
    if rng.random() < 0.8:
        w.chrome("foot")
    w.out.append("</body></html>" if rng.random() < 0.7 else "")
    return "".join(w.out), w.marks
