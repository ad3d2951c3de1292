"""Syntax nodes of Java sources as rows, and declarative tree patterns over them.

A file's nodes are rows with their number in pre-order and in post-order, their parent and their ancestors, so that
what a pattern asks of a tree is a join: a child by its parent's number, a descendant by one of its ancestors.
Only nodes that patterns speak of are rows; a syntax tree is made by a small reader in each task, a file at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import batched, dealt
from .javaparse import MODIFIERS, NO_CALL, NO_TYPE, Source

NODE_DDL = "repo string, file string, pre int, post int, parent int, depth int, ancestors array<int>, kind string, field string, text string, line int"
TYPE_NODES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}


class Tree:
    """Spans of tokens of one file with their kinds, from which nodes are numbered."""

    def __init__(self, text: str) -> None:
        self.s = Source(text)
        self.spans: list[tuple[int, int, str, str, str]] = []
        self.bodies: dict[int, tuple[str, str]] = {}
        self.declared: set[int] = set()
        if self.s.n:
            self.add(0, self.s.n - 1, "program")
            self.read()

    def add(self, start: int, end: int, kind: str, field: str = "", text: str = "") -> None:
        self.spans.append((start, end, kind, field, text))

    def at(self, i: int) -> str:
        return self.s.t[i] if 0 <= i < self.s.n else ""

    def named(self, i: int) -> bool:
        return 0 <= i < self.s.n and self.s.k[i] == "id"

    def closing(self, i: int) -> int:
        """Where the bracket at i closes; the end of the file if it doesn't."""
        return self.s.match.get(i, self.s.n - 1)

    def read(self) -> None:
        around: list[int] = []
        i = 0
        while i < self.s.n:
            t = self.at(i)
            while around and i > self.closing(around[-1]):
                around.pop()
            if self.s.k[i] == "op" and t in "([{":
                around.append(i)
            elif t == "import" and self.named(i) and not around:
                i = self.import_at(i)
            elif t in TYPE_NODES and self.named(i) and self.named(i + 1) and self.at(i - 1) not in (".", "@") and (t != "record" or self.at(i + 2) in ("(", "<")):
                self.type_at(i)
            elif t == "new" and self.named(i):
                self.new_at(i)
            elif self.named(i) and self.at(i + 1) == "(" and i not in self.declared:
                self.called_at(i, self.bodies.get(around[-1]) if around else None)
            i += 1

    def first_of(self, i: int) -> int:
        """The first token of the declaration that holds token i: behind the last statement or block before it."""
        while i > 0 and not (self.s.k[i - 1] == "op" and self.at(i - 1) in ";{}"):
            i = self.s.match.get(i - 1, i - 1) if self.at(i - 1) in ")]" else i - 1
        return i

    def import_at(self, i: int) -> int:
        end = next((j for j in range(i, self.s.n) if self.at(j) == ";"), self.s.n - 1)
        names = [j for j in range(i + 1, end) if self.named(j) and self.at(j) != "static"]
        self.add(i, end, "import_declaration")
        if names:
            self.add(names[0], names[-1], "scoped_identifier" if len(names) > 1 else "identifier", "", ".".join(map(self.at, names)))
        return end

    def type_at(self, i: int) -> None:
        j = i + 2
        while j < self.s.n and self.at(j) not in ("{", ";"):
            j = self.closing(j) + 1 if self.at(j) in ("(", "[") else j + 1
        end = self.closing(j) if self.at(j) == "{" else min(j, self.s.n - 1)
        self.add(self.first_of(i), end, TYPE_NODES[self.at(i)])
        self.add(i + 1, i + 1, "identifier", "name", self.at(i + 1))
        self.declared.add(i + 1)
        self.bodies[j] = (self.at(i), self.at(i + 1))

    def new_at(self, i: int) -> None:
        j = i + 1
        while self.named(j) and self.at(j + 1) == ".":
            j += 2
        first, last = i + 1, j
        kind = "scoped_type_identifier" if last > first else "type_identifier"
        if self.at(j + 1) == "<":
            kind, deep = "generic_type", 0
            for j in range(j + 1, self.s.n):  # noqa: B020
                deep += {"<": 1, ">": -1}.get(self.at(j), 0)
                if not deep:
                    break
        if not self.named(first) or self.at(j + 1) != "(":
            return
        self.declared.add(last)
        close = self.closing(j + 1)
        end = self.closing(close + 1) if self.at(close + 1) == "{" else close
        if end > close:
            self.bodies[close + 1] = ("class", "")
        self.add(i, end, "object_creation_expression", "object" if self.goes_on(end) else "")
        self.add(first, last, kind, "type", "".join(map(self.at, range(first, last + 1))))
        self.add(j + 1, close, "argument_list", "arguments")

    def goes_on(self, end: int) -> bool:
        """Whether what ends at a token is what a method is called on."""
        return self.at(end + 1) == "." and self.named(end + 2) and self.at(end + 3) == "("

    def called_at(self, i: int, body: tuple[str, str] | None) -> None:
        close, before = self.closing(i + 1), self.at(i - 1)
        if body and self.at(close + 1) in ("{", ";", "throws", "default"):
            typed = (self.named(i - 1) and before not in NO_TYPE and before not in MODIFIERS) or before in (">", "]")
            if typed or self.at(i) == body[1]:
                j = close + 1
                while j < self.s.n and self.at(j) not in ("{", ";"):
                    j += 1
                self.add(self.first_of(i), self.closing(j) if self.at(j) == "{" else min(j, self.s.n - 1), "method_declaration" if typed else "constructor_declaration")
                self.add(i, i, "identifier", "name", self.at(i))
                self.add(i + 1, close, "formal_parameters", "parameters")
                return
        if self.at(i) in NO_CALL or before == "@" or body and body[0] == "enum" and before in ("{", ","):
            return
        start = i
        if before == ".":
            start = self.receiver(i - 2)
            if start < 0:  # an annotation's dotted name
                return
            if start == i - 2 and self.named(start):
                self.add(start, start, "identifier" if self.at(start) not in ("this", "super") else self.at(start), "object", self.at(start))
            elif all(self.named(k) or self.at(k) == "." for k in range(start, i - 1)) and self.at(start) != "new":
                self.add(start, i - 2, "field_access", "object", "".join(map(self.at, range(start, i - 1))))
        self.add(start, close, "method_invocation", "object" if self.goes_on(close) else "")
        self.add(i, i, "identifier", "name", self.at(i))
        self.add(i + 1, close, "argument_list", "arguments")

    def receiver(self, p: int) -> int:
        """Where the expression begins that ends at token p; -1 if it is an annotation's name."""
        while True:
            if self.at(p) in (")", "]") and p in self.s.match:
                p = self.s.match[p]
                if self.named(p - 1) and self.at(p - 1) not in NO_CALL:
                    p -= 1
            if self.at(p - 1) in (".", "::") and p >= 2:
                p -= 2
            elif self.at(p - 1) == "@":
                return -1
            else:
                return p - 1 if self.at(p - 1) == "new" else p

    def nodes(self) -> Iterator[dict]:
        """Nodes in pre-order, each with its numbers."""
        order = sorted(range(len(self.spans)), key=lambda k: (self.spans[k][0], -self.spans[k][1], k))
        rows: list[dict] = []
        open_nodes: list[tuple[int, int]] = []
        post = 0
        for pre, k in enumerate(order):
            start, end, kind, field, text = self.spans[k]
            while open_nodes and start > open_nodes[-1][1]:
                rows[open_nodes.pop()[0]]["post"] = post
                post += 1
            up = [p for p, _ in open_nodes]
            rows.append({"pre": pre, "parent": up[-1] if up else None, "depth": len(up), "ancestors": up, "kind": kind, "field": field, "text": text, "line": bisect_right(self.s.lines, self.s.at[start]) + 1})
            open_nodes.append((pre, end))
        while open_nodes:
            rows[open_nodes.pop()[0]]["post"] = post
            post += 1
        yield from rows


def syntax_nodes(files: DataFrame) -> DataFrame:
    """Nodes (NODE_DDL) of files (repo, path, content); a null or empty content has none, broken sources have what can be told."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(NODE_DDL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                for repo, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    yield len(content or ""), [{"repo": repo, "file": path, **n} for n in Tree(content or "").nodes()]

        yield from batched(read(), schema)

    return dealt(files).mapInArrow(run, NODE_DDL)


# ---------------------------------------------------------------- patterns


@dataclass(frozen=True)
class Node:
    """A node of a kind, in a field of its parent if one is named; anywhere below it if `deep`; kept as a column if it has a name."""

    kind: str
    field: str = ""
    keep: str = ""
    deep: bool = False
    below: tuple[Node, ...] = ()


def matches(nodes: DataFrame, pattern: Node) -> DataFrame:
    """(repo, file, a struct (pre, text, line, kind) for each kept node) of all places where a pattern holds.

    Every step is an equi-join of nodes with nodes, on the file and a node's number, so that no file is compared with itself.
    """
    kept = lambda n: [F.struct("pre", "text", "line", "kind").alias(n.keep)] if n.keep else []
    out = nodes.filter(F.col("kind") == pattern.kind).select("repo", "file", F.col("pre").alias("_0"), *kept(pattern))
    todo, n = [(pattern, "_0")], 0
    while todo:
        parent, key = todo.pop()
        for step in parent.below:
            n += 1
            rows = nodes.filter((F.col("kind") == step.kind) & (F.col("field") == step.field if step.field else F.lit(True)))
            up: Column = F.explode("ancestors") if step.deep else F.col("parent")
            rows = rows.select("repo", "file", up.alias(key), F.col("pre").alias(f"_{n}"), *kept(step))
            out = out.join(rows.hint("merge"), ["repo", "file", key])
            todo.append((step, f"_{n}"))
    return out.drop(*[f"_{k}" for k in range(n + 1)])


#: What is taken of Java: the record, and the tree that gives it.  A call without a plain name before it has no receiver.
_NAME = Node("identifier", "name", "name")
_ARGUMENTS = Node("argument_list", "arguments", "arguments")
SYMBOLS = {"class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "record_declaration": "record", "method_declaration": "method", "constructor_declaration": "constructor"}
SYMBOL_PATTERNS = tuple(Node(kind, keep="site", below=(_NAME,)) for kind in SYMBOLS)
IMPORT_PATTERN = Node("import_declaration", keep="site", below=(Node("scoped_identifier", keep="module"),))
CALL_PATTERNS = (
    Node("method_invocation", keep="site", below=(Node("identifier", "name", "target"), _ARGUMENTS)),
    Node("object_creation_expression", keep="site", below=(Node("type_identifier", "type", "target"), _ARGUMENTS)),
)
RECEIVER_PATTERN = Node("method_invocation", keep="site", below=(Node("identifier", "object", "receiver"),))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def symbols(nodes: DataFrame) -> DataFrame:
    """repo, file, pre, kind, name, line of every declared type, method and constructor, once each."""
    kind = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    found = _union([matches(nodes, p) for p in SYMBOL_PATTERNS])
    return found.groupBy("repo", "file", F.col("site.pre").alias("pre")).agg(F.min_by(F.struct("site", "name"), "name.pre").alias("f")).select("repo", "file", "pre", kind[F.col("f.site.kind")].alias("kind"), F.col("f.name.text").alias("name"), F.col("f.site.line").alias("line"))


def imports(nodes: DataFrame) -> DataFrame:
    """repo, file, module, line of every import of a dotted name."""
    return matches(nodes, IMPORT_PATTERN).select("repo", "file", F.col("module.text").alias("module"), F.col("site.line").alias("line"))


def call_sites(nodes: DataFrame) -> DataFrame:
    """repo, file, pre, target, receiver, line, caller of every call and construction; caller is the nearest symbol around it, as name."""
    found = _union([matches(nodes, p) for p in CALL_PATTERNS]).select("repo", "file", F.col("site.pre").alias("pre"), F.col("target.text").alias("target"), F.col("site.line").alias("line"))
    objects = matches(nodes, RECEIVER_PATTERN).select("repo", "file", F.col("site.pre").alias("pre"), F.col("receiver.text").alias("receiver"))
    around = nodes.select("repo", "file", "pre", F.explode("ancestors").alias("_up")).join(symbols(nodes).select("repo", "file", F.col("pre").alias("_up"), "name").hint("merge"), ["repo", "file", "_up"])
    callers = around.groupBy("repo", "file", "pre").agg(F.max_by("name", "_up").alias("caller"))
    keys = ["repo", "file", "pre"]
    return found.join(objects.hint("merge"), keys, "left").join(callers.hint("merge"), keys, "left").select(*keys, "target", F.coalesce("receiver", F.lit("")).alias("receiver"), "line", F.coalesce("caller", F.lit("")).alias("caller"))
