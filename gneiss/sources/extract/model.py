"""What a parser of one file fills in."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class FileFacts:
    path: str
    defines: list[tuple] = field(default_factory=list)  # name, kind, line, signature
    calls: list[tuple] = field(default_factory=list)  # caller, callee
    imports: list[tuple] = field(default_factory=list)  # name, source
    exports: list[str] = field(default_factory=list)
    contains: list[tuple] = field(default_factory=list)  # parent, child
    fields: list[tuple] = field(default_factory=list)  # class, field, type
    extends: list[tuple] = field(default_factory=list)  # class, parent
    pending: list[tuple] = field(default_factory=list)  # caller, callee, receiver chain, enclosing class, types of variables
    doc: str | None = None
    seen: set = field(default_factory=set)

    def define(self, name: str, kind: str, line: int, signature: str | None = None) -> None:
        self.defines.append((name, kind, line, " ".join(signature.split()) if signature else None))

    def call(self, caller: str | None, callee: str | None) -> None:
        """Calls are distinct within a file."""
        if caller and callee and (caller, callee) not in self.seen:
            self.seen.add((caller, callee))
            self.calls.append((caller, callee))

    def export(self, name: str) -> None:
        self.exports.append(name)


def clip_doc(text: str | None, most: int = 240) -> str | None:
    flat = " ".join((text or "").split())
    return (flat[: most - 1] + "…" if len(flat) > most else flat) or None


def simple_type(text: str | None) -> str | None:
    """The one class that a type annotation names; None for arrays, containers, and unions of several."""
    if not text:
        return None
    parts = [p.strip() for p in text.split("|") if p.strip() not in ("null", "undefined", "void", "")]
    if len(parts) != 1:
        return None
    t = parts[0]
    if t.endswith("]"):
        return None
    head, _, rest = t.partition("<")
    if head in ("Readonly", "Partial", "Required") and rest.endswith(">"):
        return simple_type(rest[:-1])
    if head in ("Array", "Promise", "Map", "Set", "Record", "ReadonlyArray"):
        return None
    head = head.strip()
    return head if head.replace("_", "").replace("$", "").replace(".", "").isalnum() and not head[0].isdigit() else None
