"""A tolerant reader of Java sources: declarations, annotations and calls as plain records.

It reads tokens, not a full grammar: package and imports, types with their members, and inside
bodies local declarations and calls.  What it can't make sense of it skips, so broken sources give
the records that can be had.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r'//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<text>"""(?:\\.|[^\\])*?""")|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<chr>\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<num>0[xX][0-9a-fA-F_]+[lL]?|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?[lLfFdD]?)|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>->|::|\.\.\.|[^\s\w])",
    re.S,
)
#: Fixed values from the language: words that no expression or type begins with.
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
NO_CALL = frozenset("if for while switch catch synchronized return throw new else do try assert super this case yield instanceof".split())
NO_TYPE = frozenset("return throw new else do try assert case yield package import if for while switch break continue goto instanceof".split())
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
PRIMITIVES = frozenset("int long short byte char boolean float double void".split())
VERB_CALLS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "head": "HEAD", "options": "OPTIONS"}
REQUEST_VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD", "HttpOptions": "OPTIONS", "HttpTrace": "TRACE"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def urlish(text: str) -> bool:
    return text.startswith(("/", "http")) or "${" in text or "#{" in text


class Source:
    """Tokens of one file with their kinds, places and matching brackets."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.t: list[str] = []
        self.k: list[str] = []
        self.at: list[int] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup:
                self.t.append(m[0])
                self.k.append("str" if m.lastgroup == "text" else m.lastgroup)
                self.at.append(m.start())
        self.n = len(self.t)
        self.match: dict[int, int] = {}
        open_at: list[int] = []
        for i, t in enumerate(self.t):
            if self.k[i] != "op":
                continue
            if t in _CLOSE:
                open_at.append(i)
            elif t in ")]}":
                while open_at and _CLOSE[self.t[open_at[-1]]] != t:
                    open_at.pop()
                if open_at:
                    j = open_at.pop()
                    self.match[j], self.match[i] = i, j
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, i: int) -> int:
        import bisect

        return bisect.bisect_left(self.lines, self.at[i]) + 1

    def slice(self, a: int, b: int) -> str:
        """Source text of the tokens a to b - 1."""
        return self.text[self.at[a] : self.at[b - 1] + len(self.t[b - 1])] if b > a else ""

    def end(self, i: int) -> int:
        """The token after the bracket that opens at i, or the file's end."""
        return self.match.get(i, self.n - 1) + 1

    def value(self, i: int) -> str:
        """A string literal without its quotes."""
        t = self.t[i]
        return t[3:-3] if t.startswith('"""') else t[1:-1]

    def is_(self, i: int, text: str) -> bool:
        return 0 <= i < self.n and self.t[i] == text

    def kind(self, i: int) -> str:
        return self.k[i] if 0 <= i < self.n else ""

    def generics(self, i: int) -> int:
        """The token after the type arguments that open at i; i itself if they are none."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < self.n:
            t = self.t[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif self.k[j] != "id" and t not in (".", ",", "?", "[", "]", "&", "@"):
                return i
            j += 1
        return i

    def type_at(self, i: int) -> tuple[str, str, int] | None:
        """(text, simple name, next token) of a type that begins at i; arrays and varargs have an empty text."""
        while self.is_(i, "@"):
            i = self.annotation(i)[1]
        if self.kind(i) != "id" or self.t[i] in NO_TYPE:
            return None
        start, simple = i, self.t[i]
        i = self.generics(i + 1)
        while self.is_(i, ".") and self.kind(i + 1) == "id":
            simple = self.t[i + 1]
            i = self.generics(i + 2)
        text = self.slice(start, i)
        while self.is_(i, "[") and self.is_(i + 1, "]"):
            text, i = "", i + 2
        if self.is_(i, "..."):
            text, i = "", i + 1
        return text, simple, i

    # ---------------------------------------------------------------- annotations

    def annotation(self, i: int) -> tuple[dict, int]:
        """({name, args, nested}, next token) of the annotation at i."""
        i += 1
        name = self.t[i] if i < self.n else ""
        i += 1
        while self.is_(i, ".") and self.kind(i + 1) == "id":
            name, i = self.t[i + 1], i + 2
        args: dict[str, list[str]] = {}
        nested: list[dict] = []
        if self.is_(i, "("):
            stop = self.end(i)
            for a, b in self.split(i + 1, stop - 1):
                if self.kind(a) == "id" and self.is_(a + 1, "="):
                    for v in self.constants(a + 2, b, nested, True):
                        args.setdefault(self.t[a], []).append(v)
                        args.setdefault("_raw", []).append(v)
                else:
                    for v in self.constants(a, b, nested, False):
                        args.setdefault("_raw", []).append(v)
            i = stop
        return {"name": name, "args": args, "nested": [{"name": x["name"], "args": x["args"]} for x in nested]}, i

    def constants(self, a: int, b: int, nested: list[dict], named: bool) -> list[str]:
        """Values of an annotation argument: literals, and in named or array arguments bare identifiers."""
        if self.is_(a, "@"):
            nested.append(self.annotation(a)[0])
            return []
        if self.is_(a, "{"):
            out = []
            for x, y in self.split(a + 1, self.end(a) - 1):
                out += self.constants(x, y, nested, True)
            return out
        if b - a != 1:
            return []
        kind = self.k[a]
        if kind == "str":
            return [self.value(a)]
        if named and (kind == "num" or kind == "id"):
            return [self.t[a]] if self.t[a] not in ("true", "false") or named else []
        return []

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges between commas outside brackets and type arguments."""
        out, start, i = [], a, a
        while i < b:
            t = self.t[i]
            if self.k[i] == "op" and t in _CLOSE:
                i = self.end(i)
                continue
            if t == "<":
                i = max(i + 1, self.generics(i))
                continue
            if t == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def modifiers(self, i: int) -> tuple[list[dict], set[str], int]:
        annotations, words = [], set()
        while i < self.n:
            if self.is_(i, "@") and not self.is_(i + 1, "interface"):
                ann, i = self.annotation(i)
                annotations.append(ann)
            elif self.t[i] in MODIFIERS and not (self.t[i] in ("sealed", "non", "default") and self.is_(i + 1, "(")):
                words.add(self.t[i])
                i += 1
                if self.is_(i, "-") and self.is_(i + 1, "sealed"):
                    i += 2
            else:
                break
        return annotations, words, i

    # ---------------------------------------------------------------- expressions

    def chain_start(self, i: int) -> int:
        """Where the expression begins whose last name is token i."""
        while self.is_(i - 1, ".") or (self.is_(i - 1, ">") and self._type_args_before(i) is not None):
            if self.is_(i - 1, ">"):
                i = self._type_args_before(i) + 1
                if not self.is_(i - 1, "."):
                    break
            j = i - 2
            if j < 0:
                break
            while j >= 0 and self.t[j] in (")", "]") and self.k[j] == "op":
                j = self.match.get(j, 0) - 1
                if self.kind(j) != "id" and not self.is_(j, ")") and not self.is_(j, ">"):
                    return j + 1
                if self.is_(j, ">"):
                    k = j
                    while k > 0 and not self.is_(k, "<"):
                        k -= 1
                    j = k - 1
            i = j
            if self.kind(i) not in ("id", "str"):
                return max(i, 0)
        if self.is_(i - 1, "new"):
            return i - 1
        return i

    def _type_args_before(self, i: int) -> int | None:
        """Of a.<T>name the token before <, where name is token i."""
        k = i - 1
        while k > 0 and not self.is_(k, "<"):
            k -= 1
        return k - 1 if self.is_(k - 1, ".") and self.generics(k) == i else None

    def shown(self, a: int, b: int) -> str | None:
        """An argument that counts: a string, a whole number, a name, a field or a call; None for all else."""
        if b - a == 1:
            if self.k[a] == "str":
                return self.value(a)
            if self.k[a] == "id":
                return None if self.t[a] in ("true", "false", "null", "this", "super") else self.t[a]
            return self.t[a] if self.k[a] == "num" and re.fullmatch(r"\d[\d_]*[lL]?", self.t[a]) else None
        return self.slice(a, b) if self.is_call(a, b) or self.is_field(a, b) else None

    def is_field(self, a: int, b: int) -> bool:
        return b - a >= 3 and (b - a) % 2 == 1 and all(self.k[j] == "id" if (j - a) % 2 == 0 else self.t[j] == "." for j in range(a, b)) and self.t[b - 1] != "class" and self.t[a] != "new"

    def is_call(self, a: int, b: int) -> bool:
        """Whether a to b is one call, perhaps at the end of a chain."""
        if not self.is_(b - 1, ")"):
            return False
        name = self.match.get(b - 1, 0) - 1
        return name >= a and self.kind(name) == "id" and self.t[name] not in NO_CALL and not self.created(name) and self.chain_start(name) == a

    def created(self, name: int) -> bool:
        """Whether the call of token `name` is an object creation."""
        j = name
        while self.is_(j - 1, ".") and self.kind(j - 2) == "id":
            j -= 2
        return self.is_(j - 1, "new")

    def new_type(self, a: int, b: int) -> str:
        """The simple name that an argument `new T(...)` creates; '' for other arguments."""
        if not self.is_(a, "new"):
            return ""
        got = self.type_at(a + 1)
        if not got or not self.is_(got[2], "("):
            return ""
        stop = self.end(got[2])
        if self.is_(stop, "{"):
            stop = self.end(stop)
        return got[1] if stop >= b else ""

    def calls_in(self, a: int, b: int) -> list[int]:
        """Name tokens of the calls between a and b, outer before inner and left to right."""
        found = []
        for i in range(a, min(b, self.n) - 1):
            if self.k[i] == "id" and self.t[i + 1] == "(" and self.t[i] not in NO_CALL and not self.created(i) and not self.is_(i - 1, "@"):
                found.append((self.chain_start(i), -self.end(i + 1), i))
        return [i for *_, i in sorted(found)]

    def parts(self, name: int) -> tuple[str, list[tuple[int, int]]]:
        """(receiver, argument ranges) of a call; a receiver is a name or field, never a call."""
        receiver, start = "", self.chain_start(name)
        if start < name and self.is_(name - 1, "."):
            a, b = start, name - 1
            if b - a == 1 and self.k[a] == "id" and self.t[a] not in ("this", "super") or self.is_field(a, b):
                receiver = self.slice(a, b)
        return receiver, self.split(name + 2, self.end(name + 1) - 1)

    def chain_root(self, name: int) -> tuple[str, str, bool]:
        """(root name, HTTP verb called on the way, whether build() is) of a call chain, from its end inward; 25 calls at most."""
        verb, built = "", False
        for _ in range(25):
            m = self.t[name]
            verb, built = VERB_CALLS.get(m, verb), built or m == "build"
            if not self.is_(name - 1, "."):
                return "", verb, built
            j = name - 2
            if self.is_(j, ")"):
                inner = self.match.get(j, 0) - 1
                if self.kind(inner) != "id" or self.created(inner):
                    return "", verb, built
                name = inner
                continue
            return (self.t[j], verb, built) if self.kind(j) == "id" and self.t[j] not in ("this", "super") else ("", verb, built)
        return "", verb, built


# ---------------------------------------------------------------- bodies


def _locals(s: Source, a: int, b: int) -> tuple[dict[str, str], dict[str, tuple[int, int]]]:
    """Local names with their simple types, and the token ranges of their initialisers."""
    types: dict[str, str] = {}
    inits: dict[str, tuple[int, int]] = {}
    i = a
    while i < b:
        if i == a or s.t[i - 1] in (";", "{", "}", "(", ")", "->", "final", ":") or s.is_(i - 1, "final"):
            got = s.type_at(i) if s.kind(i) == "id" and s.t[i] not in MODIFIERS else None
            if got and s.kind(got[2]) == "id" and s.t[got[2]] not in NO_CALL and got[2] + 1 < b and s.t[got[2] + 1] in ("=", ";", ",", "["):
                j = got[2]
                while s.kind(j) == "id":
                    name, stop = s.t[j], j + 1
                    while stop < b and s.t[stop] not in (";", ","):
                        stop = s.end(stop) if s.t[stop] in _CLOSE and s.k[stop] == "op" else max(stop + 1, s.generics(stop))
                    types[name] = got[1]
                    inits[name] = (j + 2, stop) if s.is_(j + 1, "=") else (stop, stop)
                    if not s.is_(stop, ","):
                        break
                    j = stop + 1
        i += 1
    return types, inits


def _request(s: Source, a: int, b: int) -> tuple[str, str]:
    """(url, verb) of `new HttpGet("...")` and its like."""
    kind = s.new_type(a, b)
    if not kind:
        return "", ""
    opened = next((j for j in range(a, b) if s.is_(j, "(")), None)
    for x, y in s.split(opened + 1, s.end(opened) - 1) if opened is not None else []:
        if y - x == 1 and s.k[x] == "str" and urlish(s.value(x)):
            return s.value(x), REQUEST_VERBS.get(kind, "")
    return "", REQUEST_VERBS.get(kind, "")


def _calls(s: Source, a: int, b: int, types: dict[str, str], inits: dict[str, tuple[int, int]]) -> list[dict]:
    requests = {name: r for name, (x, y) in inits.items() if y > x and (r := _request(s, x, y))[0]}
    out = []
    for n, i in enumerate(s.calls_in(a, b)):
        receiver, ranges = s.parts(i)
        args = [v for x, y in ranges if (v := s.shown(x, y)) is not None]
        inner = s.calls_in(i + 2, s.end(i + 1) - 1)
        nested = [j for j in [*s.calls_in(s.chain_start(i), i), *inner]]
        url = next((v for v in args if urlish(v)), "")
        if not url:
            for j in nested:
                if s.t[j] in ("uri", "url", "target", "path"):
                    first = [v for x, y in s.parts(j)[1] if (v := s.shown(x, y)) is not None][:1]
                    if first and urlish(first[0]):
                        url = first[0]
                        break
        request = ("", "")
        for x, y in ranges:
            request = _request(s, x, y) if s.is_(x, "new") else requests.get(s.t[x], ("", "")) if y - x == 1 else ("", "")
            if request[0]:
                break
        factory = ""
        for x, y in ranges:
            if s.is_call(x, y):
                name = s.match[y - 1] - 1
                if s.t[name] in ("createQueue", "createTopic"):
                    factory = next((v for p, q in s.parts(name)[1] if (v := s.shown(p, q)) is not None), "")
                    if factory:
                        break
        topic = ""
        if len(args) == 1 and args[0] in inits:
            for j in s.calls_in(*inits[args[0]]):
                header = [v for x, y in s.parts(j)[1] if (v := s.shown(x, y)) is not None] if s.t[j] == "setHeader" else []
                if len(header) > 1 and header[1]:
                    topic = header[1]
                    break
        first = ranges[0] if ranges else None
        payload_root = ""
        if first and s.is_call(*first):
            root, _, built = s.chain_root(s.match[first[1] - 1] - 1)
            payload_root = root if root and built and root[:1].isupper() else ""
        root, verb, built = s.chain_root(i)
        out.append(
            {
                "ord": n, "line": s.line(s.chain_start(i)), "receiver": receiver, "method": s.t[i], "args": args, "url": url, "request_url": request[0], "request_verb": request[1],
                "factory": factory, "topic": topic, "new_types": [v for x, y in ranges if (v := s.new_type(x, y))], "first_new": s.new_type(*first) if first else "",
                "first_root": payload_root, "first_name": s.t[first[0]] if first and first[1] - first[0] == 1 and s.k[first[0]] == "id" else "", "root": root, "verb": verb, "built": built,
            }
        )
    return out


# ---------------------------------------------------------------- declarations


class Reader:
    def __init__(self, text: str) -> None:
        self.s = Source(text)
        self.types: list[dict] = []
        self.package = ""
        self.explicit: list[str] = []
        self.wildcard: list[str] = []

    def read(self) -> list[dict]:
        s, i = self.s, 0
        while i < s.n:
            t = s.t[i]
            if t in ("package", "import") and s.kind(i) == "id":
                j = i + 1 + (s.is_(i + 1, "static"))
                stop = j
                while stop < s.n and s.t[stop] != ";" and (s.kind(stop) == "id" or s.t[stop] in (".", "*")):
                    stop += 1
                name = "".join(s.t[j:stop])
                if t == "package":
                    self.package = name
                elif name.endswith(".*"):
                    self.wildcard.append(name[:-2])
                elif name:
                    self.explicit.append(name)
                i = stop + 1
                continue
            i = self.declared_type(i) or i + 1
        return self.types

    def declared_type(self, i: int) -> int | None:
        """Reads the type declared at i, if one is; gives the token after it."""
        s, start = self.s, i
        annotations, _, i = s.modifiers(i)
        word = s.t[i] if i < s.n else ""
        if word == "@" and s.is_(i + 1, "interface"):
            j = i
            while j < s.n and not s.is_(j, "{"):
                j += 1
            return s.end(j) if j < s.n else None
        if word not in KINDS or s.kind(i + 1) != "id" or (word == "record" and not (s.is_(i + 2, "(") or s.is_(i + 2, "<"))):
            return None
        name = s.t[i + 1]
        i = s.generics(i + 2)
        if s.is_(i, "("):
            i = s.end(i)
        above: list[str] = []
        while i < s.n and not s.is_(i, "{"):
            if s.t[i] in ("extends", "implements") and not (word == "interface" and s.t[i] == "extends"):
                i += 1
                while got := s.type_at(i):
                    above.append(got[1])
                    i = got[2]
                    if not s.is_(i, ","):
                        break
                    i += 1
            elif s.t[i] == ";":
                break
            else:
                i += 1
        row = {
            "simple_name": name, "kind": KINDS[word], "fqn": f"{self.package}.{name}" if self.package else name, "package": self.package, "line": s.line(start), "explicit": self.explicit,
            "wildcard": self.wildcard, "supertypes": list(dict.fromkeys(above)), "annotations": annotations, "fields": [], "methods": [],
        }
        self.types.append(row)
        stop = s.end(i) if s.is_(i, "{") else i + 1
        if s.is_(i, "{"):
            self.members(row, i + 1, stop - 1, word == "enum")
        return stop

    def members(self, row: dict, i: int, stop: int, is_enum: bool) -> None:
        s = self.s
        if is_enum:
            while i < stop and not s.is_(i, ";"):
                i = s.end(i) if s.k[i] == "op" and s.t[i] in _CLOSE else i + 1
            i += 1
        while i < stop:
            if s.t[i] == ";":
                i += 1
                continue
            before = len(self.types)
            if (after := self.declared_type(i)) is not None:
                for inner in self.types[before : before + 1]:  # an outer type has its nested types' members too
                    row["methods"] += inner["methods"]
                    row["fields"] += inner["fields"]
                i = after
                continue
            i = self.member(row, i, stop)

    def member(self, row: dict, start: int, stop: int) -> int:
        s = self.s
        annotations, words, i = s.modifiers(start)
        if s.is_(i, "{"):
            return s.end(i)
        i = s.generics(i)
        constructor = s.kind(i) == "id" and s.t[i] == row["simple_name"] and (s.is_(i + 1, "(") or row["kind"] == "record" and s.is_(i + 1, "{"))
        if constructor:
            kind, name_at = ("", "", i), i
        else:
            kind = s.type_at(i)
            if not kind or s.kind(kind[2]) != "id":
                return self.skip(i, stop)
            name_at = kind[2]
        if s.is_(name_at + 1, "("):
            return self.method(row, start, annotations, words, kind, name_at, "<init>" if constructor else s.t[name_at])
        if constructor:
            return s.end(name_at + 1)
        i = name_at
        channel = next(((a["args"].get("_raw") or a["args"].get("value") or [""])[0] for a in annotations if a["name"] == "Channel"), "")
        while s.kind(i) == "id":
            name, j = s.t[i], i + 1
            while s.is_(j, "["):
                j = s.end(j)
            literal = s.value(j + 1) if s.is_(j, "=") and s.kind(j + 1) == "str" and (s.is_(j + 2, ";") or s.is_(j + 2, ",")) else None
            while j < stop and s.t[j] not in (";", ","):
                j = s.end(j) if s.k[j] == "op" and s.t[j] in _CLOSE else max(j + 1, s.generics(j))
            row["fields"].append({"name": name, "type": kind[1], "constant": literal if {"static", "final"} <= words else None, "channel": channel})
            if not s.is_(j, ","):
                return j + 1
            i = j + 1
        return self.skip(i, stop)

    def skip(self, i: int, stop: int) -> int:
        s = self.s
        while i < stop:
            if s.is_(i, ";"):
                return i + 1
            if s.k[i] == "op" and s.t[i] in _CLOSE:
                if s.is_(i, "{"):
                    return s.end(i)
                i = s.end(i)
            else:
                i += 1
        return stop

    def method(self, row: dict, start: int, annotations: list, words: set, kind: tuple, name_at: int, name: str) -> int:
        s = self.s
        opened = name_at + 1
        closed = s.end(opened)
        params = []
        for a, b in s.split(opened + 1, closed - 1):
            marks, _, a = s.modifiers(a)
            got = s.type_at(a)
            if got and s.kind(got[2]) == "id" and got[2] < b and not s.is_(got[2] - 1, "..."):
                params.append({"name": s.t[got[2]], "type_text": got[0], "type": got[1] if got[0] else "", "annotations": [m["name"] for m in marks]})
        i = closed
        while i < s.n and s.t[i] not in ("{", ";", "}"):
            i = s.end(i) if s.k[i] == "op" and s.t[i] in ("(", "[") else i + 1
        body = s.is_(i, "{")
        after = s.end(i) if body else i + 1 if s.is_(i, ";") else i
        types, inits = _locals(s, i + 1, after - 1) if body else ({}, {})
        text = s.slice(i, after) if body else ""
        row["methods"].append(
            {
                "name": name, "line": s.line(start), "returns_text": kind[0], "returns": kind[1], "static": "static" in words, "has_body": body, "params": params, "params_text": s.slice(opened, closed),
                "annotations": annotations, "locals": types, "calls": _calls(s, i + 1, after - 1, types, inits) if body else [], "mentions_builder": "SpringApplicationBuilder" in text, "owner": row["simple_name"],
            }
        )
        return after


def parse_java(text: str) -> list[dict]:
    """Types of a source file with their members; an empty list if nothing can be read."""
    return Reader(text).read()
