"""Python, from its own syntax tree. There are no exports."""

from __future__ import annotations

import ast

from gneiss.sources.extract.model import FileFacts, clip_doc


class _Visitor(ast.NodeVisitor):
    def __init__(self, f: FileFacts):
        self.f, self.scope, self.classes, self.alias = f, None, [], {}
        self.refs: list[tuple[str, str]] = []

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.f.define(node.name, "class", node.lineno)
        for b in node.bases:
            if isinstance(b, ast.Name):
                self.f.extends.append((node.name, b.id))
        self.classes.append(node.name)
        old, self.scope = self.scope, None
        for x in node.body:
            self.visit(x)
        self.scope = old
        self.classes.pop()

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        method = bool(self.classes) and self.scope is None
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        self.f.define(node.name, "method" if method else "function", node.lineno, f"def {node.name}({ast.unparse(node.args)}){returns}")
        if method:
            self.f.contains.append((self.classes[-1], node.name))
        old, self.scope = self.scope, node.name
        for x in node.body:
            self.visit(x)
        self.scope = old

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.f.imports.append((a.name, a.name))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        source = "." * node.level + (node.module or "")
        for a in node.names:
            self.f.imports.append((a.name, source))
            if a.asname:
                self.alias[a.asname] = a.name

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.f.call(self.scope, self.alias.get(node.func.id, node.func.id))
        elif isinstance(node.func, ast.Attribute):
            self.f.call(self.scope, node.func.attr)
            chain, at = [], node.func.value
            while isinstance(at, ast.Attribute):
                chain.insert(0, at.attr)
                at = at.value
            if isinstance(at, ast.Name) and self.scope:
                self.f.pending.append((self.scope, node.func.attr, [at.id, *chain], self.classes[-1] if self.classes else None, {}))
        for a in [*node.args, *(k.value for k in node.keywords)]:
            if isinstance(a, ast.Name) and self.scope:
                self.refs.append((self.scope, self.alias.get(a.id, a.id)))
        self.generic_visit(node)


def extract(path: str, text: str) -> FileFacts:
    f = FileFacts(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return f
    f.doc = clip_doc(ast.get_docstring(tree))
    v = _Visitor(f)
    v.visit(tree)
    known = {n for n, k, _, _ in f.defines if k in ("function", "method", "class")} | {n for n, _ in f.imports}
    for caller, callee in v.refs:
        if callee in known and caller != callee:
            f.call(caller, callee)
    return f
