"""Outlines of a code base: overview, one file, one symbol; and their rendering."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import format_tokens, glob_pattern, kind_priority, truncate_doc
from gneiss.sources.facts import CodeGraph


def overview(graph: CodeGraph, include: list[str] | None = None, max_exports: int = 8) -> DataFrame:
    """A row per file: path, language, doc, tokens, lines, export_count, top_exports (the first by kind, line and name)."""
    files = graph.files
    if include:
        files = files.where(F.col("path").rlike("|".join(f"(?:{glob_pattern(p)})" for p in include)))
    exported = graph.exports.select("file", "name").distinct()
    shown = graph.defines.join(exported, ["file", "name"], "left_semi")
    rank = "row_number() over (partition by file order by priority, line, name) as k"
    shown = shown.withColumn("priority", kind_priority(F.col("kind"))).selectExpr("*", rank).where(F.col("k") <= max(0, max_exports))
    top = shown.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "name", "kind", "line", "signature"))).alias("top_exports"))
    counts = exported.groupBy("file").agg(F.count("*").alias("export_count"))
    out = files.join(counts, F.col("path") == counts["file"], "left").drop("file").join(top, F.col("path") == top["file"], "left")
    empty = F.array().cast(top.schema["top_exports"].dataType)
    return out.select("path", "language", truncate_doc(F.col("file_doc")).alias("doc"), "token_estimate", "line_count", F.coalesce("export_count", F.lit(0)).alias("export_count"), F.coalesce("top_exports", empty).alias("top_exports"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("token_estimate").alias("tokens"), F.sum("export_count").alias("exports"))


def directory_tree(rows: DataFrame) -> DataFrame:
    """(folder, files, tokens): every folder above a file with what lies below it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit(".")))
    return rows.select(F.explode(above).alias("folder"), "token_estimate").groupBy("folder").agg(F.count("*").alias("files"), F.sum("token_estimate").alias("tokens"))


def file_symbols(graph: CodeGraph, path: str) -> DataFrame:
    return graph.defines.where(F.col("file") == path).select("name", "kind", "line").orderBy("line", "name")


def file_detail(graph: CodeGraph, path: str) -> dict | None:
    """Exports, imports (distinct by source and name) and symbols by line; None for an unknown file."""
    found = graph.files.where(F.col("path") == path).limit(1).collect()
    if not found:
        return None
    out = found[0].asDict()
    out["exports"] = [x.name for x in graph.exports.where(F.col("file") == path).select("name").distinct().orderBy("name").collect()]
    out["imports"] = [x.asDict() for x in graph.imports.where(F.col("file") == path).groupBy("source", "name").agg(F.min("resolved").alias("resolved")).orderBy("source", "name").collect()]
    out["symbols"] = [x.asDict() for x in graph.defines.where(F.col("file") == path).select("name", "kind", "line", "signature").orderBy("line", "name").collect()]
    return out


def symbol_detail(graph: CodeGraph, name: str) -> DataFrame:
    """(relation: define, caller or callee, name: the file or the other symbol); by the exact name."""
    defines = graph.defines.where(F.col("name") == name).select(F.lit("define").alias("relation"), F.col("file").alias("name"))
    callers = graph.calls.where(F.col("callee") == name).select(F.lit("caller").alias("relation"), F.col("caller").alias("name")).distinct()
    callees = graph.calls.where(F.col("caller") == name).select(F.lit("callee").alias("relation"), F.col("callee").alias("name")).distinct()
    return defines.unionAll(callers).unionAll(callees)


def overview_lines(rows: DataFrame) -> DataFrame:
    """(path, line): a line of Markdown for each file."""
    names = F.array_join(F.transform("top_exports", lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))), ", ")
    doc = F.coalesce(F.concat(F.lit(" — "), F.col("doc")), F.lit(""))
    more = F.when(F.size("top_exports") > 0, F.concat(F.lit(": "), names)).otherwise("")
    tokens = format_tokens(F.coalesce("token_estimate", F.lit(0)))
    return rows.select("path", F.concat(F.lit("- **"), F.col("path"), F.lit("** ("), F.coalesce("language", F.lit("?")), F.lit(", "), tokens, F.lit(" tokens)"), doc, more).alias("line"))


def render(rows: DataFrame, kind: str = "markdown") -> str:
    """An overview as text: Markdown lines, or JSON."""
    if kind == "json":
        return json.dumps([x.asDict(recursive=True) for x in rows.orderBy("path").collect()])
    return "\n".join(x.line for x in overview_lines(rows).orderBy("path").collect())
