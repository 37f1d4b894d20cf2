"""Clojure, from its forms: definitions first, then calls, with names qualified by namespace."""

from __future__ import annotations

import re

from gneiss.sources.extract.model import FileFacts, clip_doc

_TOKEN = re.compile(r'(?P<skip>[\s,]+|;[^\n]*|#!.*|\^(?:\{[^}]*\}|:?[\w.]+))|(?P<string>#?"(?:[^"\\]|\\.)*")|(?P<open>#?[(\[{]|#\?@?\()|(?P<close>[)\]}])|(?P<quote>[\'`~@#]+(?=[^\s\w]|\w)|#\')|(?P<char>\\\S+)|(?P<atom>[^\s,()\[\]{}"\';`~@^]+)', re.DOTALL)
_DEFINE = {"defn": True, "defn-": False, "defmacro": True, "defmulti": True}
#: Forms that are no calls.
_SPECIAL = {"def", "defn", "defn-", "defmacro", "defmulti", "defmethod", "defrecord", "deftype", "defprotocol", "ns", "let", "if", "if-let", "if-not", "when", "when-let", "when-not", "do", "fn", "loop", "recur", "cond", "case", "try", "catch", "finally", "throw", "quote", "var", "new", "set!", "for", "doseq", "dotimes", "binding", "->", "->>", "some->", "some->>", "cond->", "as->", "and", "or", "comment", "declare", "letfn", "with-open", "."}
#: Macros that thread a value through steps, with the number of forms before the steps.
_THREADING = {"->": 1, "->>": 1, "some->": 1, "some->>": 1, "cond->": 1, "cond->>": 1, "doto": 1, "as->": 2}
#: Functions that call their first argument.
_CALLS_FIRST = set(
    "map mapv mapcat pmap map-indexed filter filterv remove reduce reduce-kv reductions keep keep-indexed apply partial every? not-every? some not-any?"
    " sort-by group-by partition-by take-while drop-while split-with iterate repeatedly memoize fnil run! trampoline complement".split()
)
#: Functions that call each of their arguments.
_CALLS_ALL = {"comp", "juxt", "use-fixtures"}


class _Form(list):
    line = 0
    open = "("


class _Symbol(str):
    line = 0


def read(text: str) -> list:
    stack, at, line = [_Form()], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup
        if kind == "open":
            form = _Form()
            form.line, form.open = line, m[0]
            stack[-1].append(form)
            stack.append(form)
        elif kind == "close" and len(stack) > 1:
            stack.pop()
        elif kind in ("atom", "string"):
            x = _Symbol(m[0])
            x.line = line
            stack[-1].append(x)
        line += m[0].count("\n")
        at = m.end()
    return stack[0]


def _is_symbol(x) -> bool:
    return isinstance(x, _Symbol) and not x.startswith((":", '"', '#"')) and not re.match(r"[-+]?\d", x) and x not in ("nil", "true", "false", "&")


def extract(path: str, text: str) -> FileFacts:
    f, forms = FileFacts(path), read(text)
    ns, alias = None, {}
    for form in forms:
        if isinstance(form, _Form) and form[:1] == ["ns"] and len(form) > 1:
            ns = str(form[1])
            f.doc = clip_doc(form[2][1:-1]) if len(form) > 2 and isinstance(form[2], _Symbol) and form[2].startswith('"') else None
            for part in form[2:]:
                if isinstance(part, _Form) and part and part[0] in (":require", ":use", ":import"):
                    for spec in part[1:]:
                        name = spec[0] if isinstance(spec, _Form) and spec else spec
                        if isinstance(name, _Symbol):
                            f.imports.append((str(name), str(name)))
                        if isinstance(spec, _Form):
                            for a, b in zip(spec, spec[1:]):
                                if a == ":as":
                                    alias[str(b)] = str(name)
                                if a == ":refer" and isinstance(b, _Form):
                                    for x in b:
                                        alias["\0" + x] = str(name)
    full = lambda name: f"{ns}/{name}" if ns else str(name)
    mine: set[str] = set()
    bodies: list[tuple[str, _Form, list]] = []
    for form in forms:
        if not isinstance(form, _Form) or not form or not _is_symbol(form[0]):
            continue
        head, name = str(form[0]), form[1] if len(form) > 1 else None
        if head in _DEFINE and _is_symbol(name):
            args = next((x for x in form[2:] if isinstance(x, _Form)), None)
            shown = "[" + " ".join(map(str, args)) + "]" if args is not None and args.open == "[" and all(isinstance(x, _Symbol) for x in args) else ""
            f.define(full(name), "function", form.line, f"({head} {name} {shown})")
            if _DEFINE[head]:
                f.export(full(name))
            mine.add(full(name))
            bodies.append((full(name), form, form[2:]))
        elif head == "def" and _is_symbol(name):
            value = form[2] if len(form) > 2 else None
            function = isinstance(value, _Form) and value[:1] == ["fn"]
            f.define(full(name), "function" if function else "variable", form.line)
            f.export(full(name))
            mine.add(full(name))
            bodies.append((full(name), form, form[2:]))
        elif head in ("defrecord", "deftype", "defprotocol") and _is_symbol(name):
            f.define(full(name), "interface" if head == "defprotocol" else "class", form.line)
            f.export(full(name))
            for m in form[2:]:
                if isinstance(m, _Form) and m.open == "(" and m and _is_symbol(m[0]):
                    f.define(full(m[0]), "method", m.line)
                    f.contains.append((full(name), full(m[0])))
                    mine.add(full(m[0]))
                    bodies.append((full(m[0]), m, m[1:]))
        elif head == "defmethod" and _is_symbol(name):
            bodies.append((full(name), form, form[3:]))
        elif head != "ns":
            bodies.append((ns or path, form, [form]))  # a call at the top belongs to the file

    def resolved(name: str) -> str:
        prefix, slash, local = name.partition("/")
        if slash and local:
            return f"{alias[prefix]}/{local}" if prefix in alias else name
        if full(name) in mine:
            return full(name)
        return f"{alias[chr(0) + name]}/{name}" if ns and chr(0) + name in alias else name

    def walk(caller: str, x, bound: frozenset[str]) -> None:
        if not isinstance(x, _Form):
            return
        if x.open.endswith("(") and x and _is_symbol(x[0]):
            head = str(x[0])
            if head not in _SPECIAL and head not in bound and not head.startswith("."):
                f.call(caller, resolved(head.rstrip(".")))
            plain = head.rpartition("/")[2] or head
            called = x[1 + _THREADING[plain] :] if plain in _THREADING else x[1:2] if plain in _CALLS_FIRST else x[1:] if plain in _CALLS_ALL else ()
            for step in called:
                if _is_symbol(step) and step not in bound and resolved(str(step)) != caller and ("/" in step or step not in _SPECIAL):
                    f.call(caller, resolved(str(step)))
            if head in ("let", "loop", "when-let", "if-let", "for", "doseq", "binding") and len(x) > 1 and isinstance(x[1], _Form):
                bound = bound | {str(s) for s in x[1][::2] if _is_symbol(s)}
            for arg in x[1:]:
                if _is_symbol(arg) and arg not in bound and (full(arg) in mine or (("/" in arg) and arg.partition("/")[0] in alias)) and resolved(str(arg)) != caller:
                    f.call(caller, resolved(str(arg)))
        for y in x:
            walk(caller, y, bound)

    for caller, _, body in bodies:
        args = next((x for x in body if isinstance(x, _Form)), None)
        bound = frozenset(str(s) for s in args if _is_symbol(s)) if args is not None and args.open == "[" else frozenset()
        for x in body:
            walk(caller, x, bound)
    return f
