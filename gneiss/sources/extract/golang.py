"""Go, by lines of declarations and tokens of bodies. Capitalised names are exports."""

from __future__ import annotations

import re

from gneiss.sources.extract.model import FileFacts, clip_doc

_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\]|\\.)+\'', re.DOTALL)
_FUNC = re.compile(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", re.MULTILINE)
_TYPE = re.compile(r"^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\b", re.MULTILINE)
_CALL = re.compile(r"(?<![\w.])((?:\w+\.)*)(\w+)\s*\(")
_KEYWORDS = {"func", "if", "for", "switch", "return", "go", "defer", "select", "range", "case", "var", "const", "type", "chan", "map", "struct", "interface"}


def _close(text: str, at: int, pair: str) -> int:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == pair[0]) - (text[k] == pair[1])
        if not depth:
            return k
    return len(text)


def extract(path: str, text: str) -> FileFacts:
    f = FileFacts(path)
    head = re.match(r"((?:\s*//[^\n]*\n)+)\s*package", text)
    if head:
        f.doc = clip_doc(re.sub(r"^\s*//", "", head[1], flags=re.MULTILINE))
    bare = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = lambda at: text.count("\n", 0, at) + 1
    for m in re.finditer(r"^import\s*(?:\(|(?:[\w.]+\s+)?\")", text, re.MULTILINE):
        end = text.find(")", m.end()) if m[0].rstrip().endswith("(") else text.find("\n", m.end())
        for s in re.findall(r'"([^"\n]+)"', text[m.start() : end if end > 0 else len(text)]):
            f.imports.append((s.rpartition("/")[2], s))
    found = [(m.start(), "type", m) for m in _TYPE.finditer(bare)] + [(m.start(), "func", m) for m in _FUNC.finditer(bare)]
    for at, what, m in sorted(found, key=lambda x: x[0]):
        if what == "type":
            f.define(m[1], "class" if m[2] == "struct" else "interface", line(at))
            if m[1][0].isupper():
                f.export(m[1])
            continue
        receiver, name = m[1], m[2]
        params = _close(bare, m.end() - 1, "()")
        body = bare.find("{", params)
        after = bare[params + 1 : body] if body > 0 else ""
        if "interface" in after or "struct" in after:
            body = bare.find("{", _close(bare, body, "{}"))
        f.define(name, "method" if receiver else "function", line(at), text[at : body if body > 0 else params + 1])
        if receiver:
            f.contains.append((receiver, name))
        if name[0].isupper():
            f.export(name)
        if body > 0:
            for c in _CALL.finditer(bare, body, _close(bare, body, "{}")):
                if c[2] not in _KEYWORDS:
                    f.call(name, c[2])
    return f
