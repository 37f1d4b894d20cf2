"""Source files to facts: a parser per language inside mapInPandas, then resolution as joins."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.scalars import EXTENSIONS, line_count, token_estimate
from gneiss.operators import resolve
from gneiss.operators.numbering import numbered
from gneiss.sources.extract import golang, lisp, python, script
from gneiss.sources.extract.model import FileFacts
from gneiss.sources.facts import CodeGraph

MOST_BYTES = 10 << 20
Parser = Callable[[str, str], FileFacts]
_BUILT_IN: dict[str, Parser] = {"typescript": script.extract, "tsx": script.extract, "javascript": script.extract, "python": python.extract, "go": golang.extract, "clojure": lisp.extract}
_adapters: dict[str, tuple[tuple[str, ...], Parser]] = {}


def register_adapter(language: str, extensions: tuple[str, ...], parser: Parser) -> None:
    """A parser for one more language. Built-in extensions keep their parsers."""
    _adapters[language] = (tuple(e.lower() for e in extensions), parser)


def clear_adapters() -> None:
    _adapters.clear()


def discover_adapters(group: str = "gneiss.adapters") -> list[str]:
    """Registers what installed packages offer: entry points whose object is (language, extensions, parser)."""
    found = []
    for e in entry_points(group=group):
        language, extensions, parser = e.load()
        register_adapter(language, extensions, parser)
        found.append(language)
    return found


def extension_languages() -> dict[str, str]:
    return {e: k for k, (ends, _) in _adapters.items() for e in ends} | EXTENSIONS


def supported_extensions() -> list[str]:
    return sorted(extension_languages())


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files with path and content, warnings with path and reason): too large or missing files are left out, with a warning."""
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (q := fs.Path(p)).getFileSystem(conf).exists(q)]
    if not there:
        raise ValueError("no file can be read")
    data = raw.load(there).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")
    small = data.where(F.col("length") <= MOST_BYTES)
    large = data.where(F.col("length") > MOST_BYTES).select("path", F.lit("too large").alias("reason"))
    missing = wanted.join(data.select("path"), "path", "left_anti").select("path", F.lit("can't be read").alias("reason"))
    return small.select("path", F.decode("content", "UTF-8").alias("content")), large.unionAll(missing)


PARSED = "path string, relation string, k int, a string, b string, c string, d string, line int"
_ROWS_AT_ONCE = 50_000


def parse(files: DataFrame) -> DataFrame:
    """The rows (PARSED) that a parser finds in each of files (path, content): relation, place in it, values. Other languages give none."""
    languages, parsers = extension_languages(), _BUILT_IN | {k: p for k, (_, p) in _adapters.items()}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")]).astype({"line": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                language = languages.get("." + path.rpartition("/")[2].rpartition(".")[2].lower())
                if language is None:
                    continue
                f = parsers[language](path, content or "")
                add = lambda relation, k, *x: rows.append((path, relation, k, *x, *[None] * (5 - len(x))))  # noqa: E731, B023
                add("files", 0, language, f.doc)
                for k, (name, kind, line, signature) in enumerate(f.defines):
                    add("defines", k, name, kind, signature, None, line)
                for relation, found in (("calls", f.calls), ("imports", f.imports), ("contains", f.contains), ("fields", f.fields), ("extends", f.extends)):
                    for k, x in enumerate(found):
                        add(relation, k, *x)
                for k, name in enumerate(f.exports):
                    add("exports", k, name)
                for k, (caller, callee, chain, owner, types) in enumerate(f.pending):
                    add("pending", k, caller, callee, owner, json.dumps([chain, types]))
                if len(rows) >= _ROWS_AT_ONCE:  # what is held follows the rows, not the batch of files
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, PARSED)


def relation(rows: DataFrame, name: str, columns: dict[str, str], *order: str) -> DataFrame:
    """One relation of parsed rows, its values (a, b, c, d, line, path) under their names, with the columns that order it."""
    return rows.where(F.col("relation") == name).select(*(F.col(x).alias(c) for c, x in columns.items()), *order)


def pending_calls(rows: DataFrame, *order: str) -> DataFrame:
    """(caller, callee, enclosing_class, receiver_chain, var_types) of the calls whose receiver isn't known yet."""
    of = relation(rows, "pending", {"caller": "a", "callee": "b", "enclosing_class": "c", "d": "d"}, *order)
    chain, types = F.from_json(F.get_json_object("d", "$[0]"), "array<string>"), F.from_json(F.get_json_object("d", "$[1]"), "map<string,string>")
    return of.select("caller", "callee", "enclosing_class", chain.alias("receiver_chain"), types.alias("var_types"), *order)


EXTENDS = {"class_name": "a", "parent": "b"}
FIELDS = {"class_name": "a", "field": "b", "type": "c"}
CONTAINS = {"parent": "a", "child": "b"}
CALLS = {"caller": "a", "callee": "b"}
IMPORTS = {"file": "path", "name": "a", "source": "b"}


def inherited_fields(rows: DataFrame, extends: DataFrame, *order: str) -> DataFrame:
    """(class_name, field, type, owner), inherited ones included. The last of order is what later rows are larger by."""
    fields = relation(rows, "fields", FIELDS, *order)
    return resolve.inherited(fields.withColumn("seq", F.struct(*order)), extends, "field", "type")


def inherited_methods(rows: DataFrame, extends: DataFrame, *order: str) -> DataFrame:
    """(class_name, method, v, owner), inherited ones included."""
    own = relation(rows, "contains", {"class_name": "a", "method": "b"}, *order)
    return resolve.inherited(own.withColumns({"v": F.lit(""), "seq": F.struct(*order)}), extends, "method", "v")


def file_stats(files: DataFrame) -> DataFrame:
    return files.select("path", token_estimate(F.col("content")).alias("token_estimate"), line_count(F.col("content")).alias("line_count"))


def plain_relations(rows: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    """The relations that are what the parser found, from rows with seq: definitions, exports, containment and files."""
    return {
        "defines": relation(rows, "defines", {"file": "path", "name": "a", "kind": "b", "line": "line", "signature": "c"}, "seq"),
        "exports": relation(rows, "exports", {"file": "path", "name": "a"}, "seq"),
        "contains": relation(rows, "contains", CONTAINS, "seq"),
        "files": relation(rows, "files", {"path": "path", "language": "a", "file_doc": "b"}, "seq").join(stats, "path"),
    }


def extract(files: DataFrame, aliases: DataFrame | None = None, resolve_calls: bool = True, parsed: DataFrame | None = None) -> CodeGraph:
    """The facts of files (path, content). Every file is parsed once; the parsed rows are a table of their own.

    aliases: (prefix, target) of import specifiers, see tsconfig_aliases. parsed: the rows of parse(files), where they are known.
    """
    from gneiss.operators.fixpoint import checkpointed

    parsed = parsed if parsed is not None else checkpointed(parse(files))
    # seq follows the order of paths and of rows in a file
    rows = numbered(parsed, ["path", "k", "relation"])
    plain = plain_relations(rows, file_stats(files))
    calls = relation(rows, "calls", CALLS, "seq").withColumn("callee_qn", F.lit(None).cast("string"))
    if resolve_calls:
        extends = relation(rows, "extends", EXTENDS)
        fields, methods = inherited_fields(rows, extends, "seq"), inherited_methods(rows, extends, "seq")
        calls = resolve.qualify_callees(calls, pending_calls(rows, "seq"), fields, methods, plain["contains"])
    imports = resolve.resolve_imports(relation(rows, "imports", IMPORTS, "seq"), plain["files"], aliases)
    return CodeGraph.of(files.sparkSession, calls=calls, imports=imports, **plain)
