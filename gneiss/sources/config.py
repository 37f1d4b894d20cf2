"""Configuration, and import aliases from a project's compiler settings."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

#: Where aliases are looked for, in this order.
CANDIDATES = ("tsconfig.json", "tsconfig.base.json", "jsconfig.json", "tsconfig.app.json")


def load_config(home: str) -> dict:
    """config.json of a folder; without one, or with a broken one, nothing is set."""
    try:
        with open(os.path.join(home, "config.json"), encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas as JSON."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def tsconfig_aliases(root: str) -> list[tuple[str, str]]:
    """(prefix, target below root), longest prefix first. A chain of `extends` is followed once around; a path's first target counts."""

    def load(path: str, seen: set[str]) -> tuple[dict, str]:
        real = os.path.realpath(path)
        if real in seen:
            return {}, ""
        seen.add(real)
        try:
            with open(path, encoding="utf-8") as f:
                own = json.loads(strip_jsonc(f.read()))
        except (OSError, ValueError):
            return {}, ""
        options, folder = own.get("compilerOptions") or {}, os.path.dirname(path)
        paths, base = options.get("paths"), options.get("baseUrl")
        at = os.path.join(folder, base) if base else folder
        if paths is None and isinstance(own.get("extends"), str) and own["extends"].startswith("."):
            parent = os.path.join(folder, own["extends"])
            found, above = load(parent if parent.endswith(".json") else parent + ".json", seen)
            return found, (at if base else above)
        return paths or {}, at

    for name in CANDIDATES:
        paths, at = load(os.path.join(root, name), set())
        if paths:
            out = []
            for pattern, targets in paths.items():
                if targets:
                    target = os.path.relpath(os.path.normpath(os.path.join(at, targets[0].removesuffix("*").rstrip("/"))), root)
                    star = pattern.endswith("*")
                    out.append((pattern.removesuffix("*"), ("" if target == "." else target) + ("/" if star and pattern.endswith("/*") and target != "." else "")))
            return sorted(out, key=lambda x: (-len(x[0]), x[0]))
    return []


def alias_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(tsconfig_aliases(root), "prefix string, target string")
