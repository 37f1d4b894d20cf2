"""TypeScript and JavaScript, from a token stream with a stack of scopes."""

from __future__ import annotations

import re

from gneiss.sources.extract.model import FileFacts, clip_doc, simple_type

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|[{}()\[\];,.:=<>?!&|+\-*/%^~@\#])""",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "constructor", "import", "new", "do", "else", "void", "delete", "in", "of", "case", "throw", "yield", "async"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "abstract", "override", "get", "set", "declare"}


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = None
        if text[at] == "/" and not text.startswith(("//", "/*"), at) and (not out or out[-1][1] in "([{,;:=!&|?+-*%<>~^" or out[-1][1] in ("=>", "return", "typeof", "case")):
            m = _REGEX.match(text, at)
            if m:
                out.append(("string", m[0], line, at))
        if not m:
            m = _TOKEN.match(text, at)
            if m and m.lastgroup != "skip":
                out.append((m.lastgroup, m[0], line, at))
        if not m:
            at += 1
            continue
        line += m[0].count("\n")
        at = m.end()
    return out


class _Walker:
    def __init__(self, path: str, text: str):
        self.text, self.t, self.f = text, _tokens(text), FileFacts(path)
        self.alias: dict[str, str] = {}
        self.refs: list[tuple[str, str]] = []
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, x, _, _) in enumerate(self.t):
            if kind == "op" and x in "([{":
                stack.append(i)
            elif kind == "op" and x in ")]}" and stack:
                self.match[stack.pop()] = i

    def x(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] != "string" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "name"

    def run(self) -> FileFacts:
        head = re.match(r"\s*/\*\*(.*?)\*/", self.text, re.DOTALL)
        if head:
            self.f.doc = clip_doc(re.sub(r"^\s*\*", "", head[1], flags=re.MULTILINE))
        self.block(0, len(self.t), None, None, {})
        known = {n for n, k, _, _ in self.f.defines if k in ("function", "method", "class")} | {n for n, _ in self.f.imports}
        for caller, callee in self.refs:
            if callee in known and caller != callee:
                self.f.call(caller, callee)
        return self.f

    def source(self, i: int, end: int) -> tuple[str | None, int]:
        """The module's name after `from` (or at i), and where its statement goes on."""
        while i < end and self.x(i) != ";" and self.t[i][0] != "string":
            i += 1
        return (self.t[i][1][1:-1], i + 1) if i < end and self.t[i][0] == "string" else (None, i)

    def names(self, i: int, end: int) -> list[tuple[str, str]]:
        """(name, local name) of {a, b as c}."""
        out = []
        while i < end:
            if self.is_name(i) and self.x(i) != "type":
                name = self.x(i)
                if self.x(i + 1) == "as":
                    out.append((name, self.x(i + 2)))
                    i += 2
                else:
                    out.append((name, name))
            i += 1
        return out

    def import_(self, i: int, end: int) -> int:
        found: list[tuple[str, str]] = []
        j = i + 1
        while j < end and self.x(j) not in ("from", ";") and self.t[j][0] != "string":
            if self.x(j) == "{":
                found += self.names(j + 1, self.match.get(j, j))
                j = self.match.get(j, j)
            elif self.x(j) == "*" and self.x(j + 1) == "as":
                found.append((self.x(j + 2), self.x(j + 2)))
                j += 2
            elif self.is_name(j) and self.x(j) != "type":
                found.append((self.x(j), self.x(j)))
            j += 1
        source, j = self.source(j, end)
        if source is None:
            return i + 1
        for name, local in found:
            self.f.imports.append((name, source))
            if name != local:
                self.alias[local] = name
        return j

    def params(self, i: int) -> dict[str, str]:
        """Types of the parameters between the parentheses that open at i."""
        out, end = {}, self.match.get(i, i)
        for j in range(i + 1, end):
            if self.is_name(j) and self.x(j + 1) in (":", "?") and self.x(j - 1) in ("(", ",", *_MODIFIERS):
                k = j + 2 if self.x(j + 1) == ":" else j + 3
                t = simple_type(self.type_text(k, end))
                if t:
                    out[self.x(j)] = t
        return out

    def type_text(self, i: int, end: int) -> str:
        j, depth = i, 0
        while j < end and not (depth == 0 and self.x(j) in (",", ")", "=", ";", "{", "=>")):
            depth += {"<": 1, "[": 1, "(": 1, ">": -1, "]": -1, ")": -1}.get(self.x(j), 0)
            if j > i and self.t[j][2] != self.t[j - 1][2] and depth == 0:
                break
            j += 1
        return "".join((" | " if self.x(k) == "|" else self.t[k][1]) for k in range(i, j))

    def body_of(self, i: int, end: int) -> tuple[int, int, str] | None:
        """From the parameter list at i: begin and end of the body, and the signature's end; None if there is no body."""
        j = self.match.get(i, i) + 1
        if self.x(j) == ":":
            depth = 0
            j += 1
            while j < end and not (depth == 0 and self.x(j) in ("{", "=>", ";")):
                if self.x(j) == "{" or self.x(j) in "([<" and self.x(j):
                    depth += 1
                elif self.x(j) and self.x(j) in ")]>":
                    depth -= 1
                j += 1
        if self.x(j) == "{":
            return j + 1, self.match.get(j, end), ""
        return None

    def signature(self, i: int, j: int) -> str:
        return self.text[self.t[i][3] : self.t[j][3]].strip() if j < len(self.t) else self.text[self.t[i][3] :].strip()

    def arrow(self, i: int, end: int) -> tuple[int, int, dict[str, str]] | None:
        """An arrow function or function expression at i: begin and end of its body, types of its parameters."""
        if self.x(i) == "async":
            i += 1
        if self.x(i) == "function":
            while i < end and self.x(i) != "(":
                i += 1
            body = self.body_of(i, end)
            return (body[0], body[1], self.params(i)) if body else None
        types: dict[str, str] = {}
        if self.x(i) == "<":
            while i < end and self.x(i) != "(":
                i += 1
        if self.x(i) == "(":
            types, j = self.params(i), self.match.get(i, i) + 1
            if self.x(j) == ":":
                while j < end and self.x(j) not in ("=>", ";"):
                    j += 1
        elif self.is_name(i):
            j = i + 1
        else:
            return None
        if self.x(j) != "=>":
            return None
        j += 1
        if self.x(j) == "{":
            return j + 1, self.match.get(j, end), types
        k = j
        while k < end and self.x(k) not in (";", ",", ")", "}") and not (k > j and self.t[k][2] != self.t[k - 1][2] and self.x(k) not in (".", "?.", "(", "+", "&", "|", "?", ":")):
            k = self.match.get(k, k) + 1
        return j, k, types

    def function(self, name: str, kind: str, at: int, params: int, end: int, owner: str | None, types: dict[str, str]) -> int:
        body = self.body_of(params, end)
        stop = body[0] - 1 if body else self.match.get(params, params) + 1
        self.f.define(name, kind, self.t[at][2], self.signature(at, stop))
        if kind == "method" and owner:
            self.f.contains.append((owner, name))
        if not body:
            return stop
        self.block(body[0], body[1], name, owner, {**types, **self.params(params)})
        return body[1] + 1

    def class_(self, i: int, end: int, exported: bool) -> int:
        name = self.x(i + 1)
        self.f.define(name, "class", self.t[i][2])
        if exported:
            self.f.export(name)
        j = i + 2
        while j < end and self.x(j) != "{":
            if self.x(j) == "extends" and self.is_name(j + 1):
                self.f.extends.append((name, self.x(j + 1)))
            j += 1
        stop = self.match.get(j, end)
        j += 1
        while j < stop:
            start = j
            while self.x(j) in _MODIFIERS and self.x(j + 1) not in ("(", "=", ":", ";"):
                j += 1
            if self.x(j) == "#":
                j += 1
            k = j + 1
            if self.is_name(j) and self.x(k) == "<":
                while k < stop and self.x(k) != "(":
                    k += 1
            if self.is_name(j) and self.x(k) == "(":
                if self.x(j) == "constructor":
                    for p in range(k + 1, self.match.get(k, k)):
                        if self.x(p) in ("public", "private", "protected", "readonly") and self.is_name(p + 1) and self.x(p + 2) in (":", "?") and self.x(p + 1) not in _MODIFIERS:
                            t = simple_type(self.type_text(p + (3 if self.x(p + 2) == ":" else 4), self.match[k]))
                            if t:
                                self.f.fields.append((name, self.x(p + 1), t))
                j = self.function(self.x(j), "method", start, k, stop, name, {})
                continue
            if self.is_name(j):
                field, k = self.x(j), j + 1
                if self.x(k) in ("?", "!"):
                    k += 1
                if self.x(k) == ":":
                    t = simple_type(self.type_text(k + 1, stop))
                    if t:
                        self.f.fields.append((name, field, t))
                    while k < stop and self.x(k) not in ("=", ";") and not (self.t[k][2] != self.t[j][2]):
                        k += 1
                if self.x(k) == "=":
                    made = self.arrow(k + 1, stop)
                    if made:
                        self.f.define(field, "method", self.t[start][2], self.signature(start, made[0] - 1))
                        self.f.contains.append((name, field))
                        self.block(made[0], made[1], field, name, made[2])
                        j = made[1] + 1
                        continue
                    if self.x(k + 1) == "new" and self.is_name(k + 2):
                        self.f.fields.append((name, field, self.x(k + 2)))
                j = k
            j = self.match.get(j, j) + 1
        return stop + 1

    def block(self, i: int, end: int, scope: str | None, owner: str | None, types: dict[str, str]) -> None:
        types = dict(types)
        while i < end:
            kind, x, line, _ = self.t[i]
            if kind != "name":
                i += 1
                continue
            member = self.x(i - 1) in (".", "?.")
            exported = self.x(i - 1) in ("export", "default", "async", "abstract") and any(self.x(i - k) == "export" for k in (1, 2, 3))
            if x == "import" and not member and self.x(i + 1) not in ("(", "."):
                i = self.import_(i, end)
                continue
            if x == "export" and self.x(i + 1) == "{":
                close = self.match.get(i + 1, i + 1)
                for name, local in self.names(i + 2, close):
                    self.f.export(local if self.x(close + 1) == "from" else name)
                if self.x(close + 1) == "from":
                    source, j = self.source(close + 1, end)
                    for name, _ in self.names(i + 2, close):
                        self.f.imports.append((name, source))
                    i = j
                    continue
                i = close + 1
                continue
            if x == "function" and not member and self.is_name(i + 1 + (self.x(i + 1) == "*")):
                n = i + 1 + (self.x(i + 1) == "*")
                if exported:
                    self.f.export(self.x(n))
                p = n
                while p < end and self.x(p) != "(":
                    p += 1
                i = self.function(self.x(n), "function", i, p, end, owner, types)
                continue
            if x == "class" and not member and self.is_name(i + 1):
                i = self.class_(i, end, exported)
                continue
            if x == "interface" and self.is_name(i + 1) and not member:
                self.f.define(self.x(i + 1), "interface", line)
                if exported:
                    self.f.export(self.x(i + 1))
                while i < end and self.x(i) != "{":
                    i += 1
                i = self.match.get(i, i) + 1
                continue
            if x in ("const", "let", "var") and self.is_name(i + 1):
                name, k = self.x(i + 1), i + 2
                if self.x(k) == ":":
                    t = simple_type(self.type_text(k + 1, end))
                    if t:
                        types[name] = t
                    depth = 0
                    while k < end and not (depth == 0 and self.x(k) in ("=", ";")):
                        depth += {"<": 1, "(": 1, "{": 1, "[": 1, ">": -1, ")": -1, "}": -1, "]": -1}.get(self.x(k), 0)
                        k += 1
                made = self.arrow(k + 1, end) if self.x(k) == "=" else None
                if self.x(i - 1) == "export":
                    self.f.export(name)
                if made:
                    self.f.define(name, "function", line, self.signature(i + 1, made[0] - 1))
                    self.block(made[0], made[1], name, owner, {**types, **made[2]})
                    i = made[1]
                    continue
                if scope is None and self.x(i - 1) == "export":
                    self.f.define(name, "variable", line)
                if self.x(k) == "=" and self.x(k + 1) == "new" and self.is_name(k + 2):
                    types.setdefault(name, self.x(k + 2))
                elif self.x(k) == "=" and self.is_name(k + 1) and self.x(k + 2) in (";", "") and self.x(k + 1) in types:
                    types.setdefault(name, types[self.x(k + 1)])
                i = k
                continue
            k = i + 1
            if self.x(k) == "<" and self.is_name(k + 1):  # type arguments of a call
                j = k
                while j < end and self.x(j) not in ("(", ";", "{", ")", "&", "|"):
                    j += 1
                if self.x(j) == "(" and self.x(j - 1) == ">":
                    k = j
            if self.x(k) == "(" and self.x(i - 1) != "new" and (member or x not in _NOT_CALLS):
                self.f.call(scope, x if member else self.alias.get(x, x))
                if member and scope:
                    chain, j = [], i - 1
                    while self.x(j) in (".", "?.") and self.is_name(j - 1):
                        chain.insert(0, self.x(j - 1))
                        j -= 2
                    if chain and self.x(j) not in (")", "]"):
                        self.f.pending.append((scope, x, chain, owner, dict(types)))
            elif not member and scope and self.x(i - 1) in ("(", ",") and self.x(i + 1) in (",", ")"):
                self.refs.append((scope, self.alias.get(x, x)))
            i += 1


def extract(path: str, text: str) -> FileFacts:
    return _Walker(path, text).run()
