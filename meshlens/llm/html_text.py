"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Blocks are labelled main text or not.  Features are the tags and hint words of a block's ancestors
and what its text looks like; the chain's transitions say how labels follow one another.  Weights
are learned by gradient ascent on the likelihood of labelled pages (forward-backward), and pages are
decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .html_blocks import Block, Node, blocks, path
from .html_samples import labelled_page

#: Pages to learn from, passes over them, learning rate and ridge penalty.
PAGES, EPOCHS, RATE, RIDGE = 1500, 8, 0.3, 1e-4
#: What stands between the words of a menu in one line.
_SEPARATOR = re.compile(r"\s[|·»/•>-]+(?:\s|$)")
#: Places whose scores a model remembers.
STATES = 20_000


def path_features(place: Node | None) -> list[str]:
    """What a block's ancestors say: all their names and hints, the last and the last two names."""
    above = path(place)
    tags = [x for x in above if x[0] != "."]
    out = {f"in {x}" for x in above if x not in ("html", "body")}
    last = tags[-1] if tags else ""
    out.add(f"tag {last}")
    out.add(f"parent {tags[-2] if len(tags) > 1 else ''} {last}")
    return sorted(out)


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    out = [f"long {min(n, 4000).bit_length()}", f"links {4 * block.linked // n}", f"words {min(text.count(' ') + 1, 255).bit_length()}"]
    if text[-1] in ".!?…:;\"'»)":
        out.append("stops")
    if "©" in text:
        out.append("copyright")
    if ", " in text or ". " in text:
        out.append("sentences")
    pieces = _SEPARATOR.split(text)
    if len(pieces) > 1:
        out.append("pieces" if all(p.count(" ") < 3 for p in pieces) else "parted")
    if text == text.lower() or text.count(" ") < 4 and text[-1].isalnum():
        out.append("label")
    return out


class _State:
    """The score of a place in the page: the known features of its ancestors, their weights' sum, its tag and that of its parent."""

    __slots__ = ("weights", "seen", "total", "tag", "score")

    def __init__(self, weights: dict[str, float], seen: frozenset, total: float, tag: str, parent: str) -> None:
        self.weights, self.seen, self.total, self.tag = weights, seen, total, tag
        self.score = total + weights.get(f"tag {tag}", 0.0) + weights.get(f"parent {parent} {tag}", 0.0)


class Crf:
    """Two labels; weights are for label 1 (label 0 has none), transitions for each pair of labels, and for the ends."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.steps = {(a, b): 0.0 for a in (0, 1, 2) for b in (0, 1, 2)}  # 2: before the first and after the last block
        self.states: dict = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "steps": self.steps}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.states = {}

    def state(self, place: Node | None) -> _State:
        """From the parent's state by one step, so that a page costs as many steps as it has elements."""
        top = self.states.get(None) or self.states.setdefault(None, _State(self.weights, frozenset(), 0.0, "", ""))
        below = []
        while place is not None and (place.state is None or place.state.weights is not self.weights):
            below.append(place)
            place = place.up
        here = top if place is None else place.state
        for node in reversed(below):
            key = (here, node.name, node.hints)
            state = self.states.get(key)
            if state is None:
                if len(self.states) > STATES:
                    self.states = {None: top}
                new = {f"in {x}" for x in (node.name, *node.hints) if x not in ("html", "body")}
                new = {f for f in new if f in self.weights} - here.seen
                total = here.total + sum(self.weights[f] for f in sorted(new))
                state = self.states[key] = _State(self.weights, here.seen | new if new else here.seen, total, node.name, here.tag)
            here = node.state = state
        return here

    def scores(self, page: list[Block]) -> list[float]:
        get = self.weights.get
        return [self.state(b.place).score + sum(get(f, 0.0) for f in text_features(b)) for b in page]

    def decode(self, page: list[Block]) -> list[int]:
        """Labels of the likeliest labelling; ties go to label 0."""
        if not page:
            return []
        step = self.steps
        scores = self.scores(page)
        off, on = step[2, 0], step[2, 1] + scores[0]
        back = []
        for s in scores[1:]:
            a, b, c, d = off + step[0, 0], on + step[1, 0], off + step[0, 1], on + step[1, 1]
            back.append((int(b > a), int(d > c)))
            off, on = max(a, b), max(c, d) + s
        label = int(on + step[1, 2] > off + step[0, 2])
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def learn(self, pages: Iterable[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> Crf:
        """Adagrad on the log likelihood, a page at a time."""
        made = [([path_features(b.place) + text_features(b) for b in page], labels) for page, labels in pages if page]
        squares: dict = {}
        weights, steps = self.weights, self.steps

        def move(table: dict, key, gradient: float) -> None:
            if gradient:
                squares[key] = squares.get(key, 1e-6) + gradient * gradient
                table[key] = table.get(key, 0.0) * (1 - ridge) + rate * gradient / math.sqrt(squares[key])

        for _ in range(epochs):
            for features, labels in made:
                scores = [sum(weights.get(f, 0.0) for f in fs) for fs in features]
                ahead = [(steps[2, 0], steps[2, 1] + scores[0])]
                for s in scores[1:]:
                    off, on = ahead[-1]
                    ahead.append((_log_sum(off + steps[0, 0], on + steps[1, 0]), _log_sum(off + steps[0, 1], on + steps[1, 1]) + s))
                behind = [(steps[0, 2], steps[1, 2])]
                for s in reversed(scores[1:]):
                    off, on = behind[-1]
                    behind.append((_log_sum(steps[0, 0] + off, steps[0, 1] + s + on), _log_sum(steps[1, 0] + off, steps[1, 1] + s + on)))
                behind.reverse()
                total = _log_sum(ahead[-1][0] + steps[0, 2], ahead[-1][1] + steps[1, 2])
                chance = [math.exp(min(0.0, a[1] + b[1] - total)) for a, b in zip(ahead, behind, strict=True)]
                gradient = {k: 0.0 for k in steps}
                for k in range(len(labels) - 1):
                    gradient[labels[k], labels[k + 1]] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            gradient[a, b] -= math.exp(min(0.0, ahead[k][a] + steps[a, b] + scores[k + 1] * b + behind[k + 1][b] - total))
                for a in (0, 1):
                    gradient[2, a] += (labels[0] == a) - (chance[0] if a else 1 - chance[0])
                    gradient[a, 2] += (labels[-1] == a) - (chance[-1] if a else 1 - chance[-1])
                for key, g in gradient.items():
                    move(steps, key, g)
                for fs, label, p in zip(features, labels, chance, strict=True):
                    for f in fs:
                        move(weights, f, label - p)
        self.weights, self.states = dict(weights), {}  # what others remember of these weights isn't theirs any more
        return self


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


@lru_cache(1)
def trained(pages: int = PAGES) -> Crf:
    """The model learned from the labelled pages; the same on every call."""
    return Crf().learn((blocks(html), marks) for html, marks in map(labelled_page, range(pages)))


def main_text(html: str, model: Crf) -> str:
    """The main blocks' texts in page order, joined by one space."""
    page = blocks(html)
    return " ".join(b.text for b, label in zip(page, model.decode(page), strict=True) if label)


def extract_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null html is empty html; a page without main text gives an empty text.  Broken markup is read as
    far as it goes.  Equal pages get equal texts (of paths that score alike, Viterbi takes one by a
    fixed rule) and rows that repeat stay; other columns are dropped, an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def make():
        crf = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            texts = [main_text(h or "", crf) for h in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    chosen = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return arrow_map(chosen, make, "page_id bigint, url string, text string, n_chars bigint", text_col=2)
