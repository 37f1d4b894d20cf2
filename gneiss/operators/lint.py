"""Checks of specifications before they go to a solver."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SMT_NOISE = re.compile(r'"(?:[^"]|"")*"?|;[^\n]*')
_PROLOG_NOISE = re.compile(r"%[^\n]*|/\*.*?(?:\*/|$)|'(?:[^'\\]|\\.|'')*'?|\"(?:[^\"\\]|\\.|\"\")*\"?", re.DOTALL)
#: A fence: three backticks or more where a line begins, with the word that names a language.
_FENCE = re.compile(r"^`{3,}[\w.+-]*[ \t]*\n?", re.MULTILINE)
_COMMANDS = (("check-sat", r"\(\s*check-sat\s*\)"), ("get-model", r"\(\s*get-model\s*\)"), ("exit", r"\(\s*exit\s*\)"), ("set-logic", r"\(\s*set-logic\s+\w+\s*\)"))


def _balance(bare: str) -> list[str]:
    depth = 0
    for k, c in enumerate(bare):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return [f"a parenthesis closes at {k} that was never opened"]
    return [f"{depth} parentheses are not closed"] if depth else []


def lint_spec(spec: str, solver: str) -> dict:
    """The cleaned text, what was fixed, and what is wrong. solver: z3 or prolog."""
    fixes, errors, text = [], [], spec
    if _FENCE.search(text):
        text = _FENCE.sub("", text)
        fixes.append("removed code fences")
    text = text.strip()
    if not text:
        return {"spec": text, "fixes": fixes, "errors": ["the specification is empty"]}
    if slots := re.findall(r"\{\{SLOT:\w+\}\}", text):
        errors.append("slots are not filled: " + ", ".join(slots))
    if solver == "z3":
        for name, pattern in _COMMANDS:
            new = re.sub(pattern, "", text)
            if new != text:
                text = new
                fixes.append(f"removed ({name})")
        text = text.strip()
        # noise keeps its length, so that places in messages are those of the text
        errors += _balance(_SMT_NOISE.sub(lambda m: " " * len(m[0]), text))
    else:
        bare = _PROLOG_NOISE.sub(lambda m: " " * len(m[0]), text)
        if bare.strip():
            if "." not in bare:
                errors.append("no clause ends with a period")
            errors += _balance(bare)
    return {"spec": text, "fixes": fixes, "errors": errors}


def lint_column(spec: Column, solver: Column) -> Column:
    """struct(spec, fixes, errors), in Arrow batches."""

    @F.pandas_udf("struct<spec string, fixes array<string>, errors array<string>>")
    def run(specs: pd.Series, solvers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lint_spec(a or "", b) for a, b in zip(specs, solvers)])

    return run(spec, solver)
