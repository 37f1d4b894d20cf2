"""Incremental extraction: files that arrive or change are parsed as they come, and what follows from them is brought up to date.

Resolution looks across files: a call's receiver may have a type whose fields and methods come from classes of other
files. Each batch therefore finds, by joins, what its changed files can change elsewhere, and makes only that anew:

1. classes whose own members or parents differ, and all that inherit from them: their fields and methods;
2. calls of changed files, and calls of a method, or through a field, whose entry has changed for some class;
3. imports of changed files, and those that a new path is a candidate for.

Every table is a log: a batch writes the groups that it made anew (a file, a class, a caller and callee), and the keys
of these groups, also of those that are empty now. A group's rows are those of the last batch that names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.functions.scalars import content_hash
from gneiss.operators import resolve
from gneiss.operators.fixpoint import checkpointed, frontiers, written
from gneiss.operators.numbering import numbered
from gneiss.sources import extract
from gneiss.sources.cache import ExtractionCache
from gneiss.sources.facts import CodeGraph

ORDER = ("path", "k")
#: By table: the columns of a group's key, and all of its columns.
TABLES = {
    "rows": (("path",), extract.PARSED),
    "stats": (("path",), "path string, hash string, token_estimate int, line_count int"),
    "fields": (("class_name",), "class_name string, field string, type string, owner string"),
    "methods": (("class_name",), "class_name string, method string, v string, owner string"),
    "calls": (("caller", "callee"), "caller string, callee string, callee_qn string, path string, k int"),
    "imports": (("file",), "file string, name string, source string, resolved string, path string, k int"),
}


def source(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, content) of the files below a folder."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return raw.schema(schema).load(folder).where(F.col("length") <= extract.MOST_BYTES).select("path", F.decode("content", "UTF-8").alias("content"))


class Facts:
    """Facts that are kept up to date, in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def _columns(self, table: str) -> list[str]:
        return [c.split()[0] for c in TABLES[table][1].split(", ")]

    def _batches(self, before: int | None) -> list[int]:
        """The batches that are complete; one that isn't has no mark, and runs again under its number."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/batch=*/_DONE")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        numbers = sorted(int(x.getPath().getParent().getName().removeprefix("batch=")) for x in found)
        return [b for b in numbers if before is None or b < before]

    def _log(self, table: str, what: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema + ", batch int")
        parts = [f"{self.at}/batch={b}/{table}/{what}" for b in batches]
        return self.spark.read.schema(schema + ", batch int").option("basePath", self.at).parquet(*parts)

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The table as it is after all batches, or those before one."""
        key, schema = TABLES[table]
        batches = self._batches(before)
        last = self._log(table, "keys", ", ".join(f"{k} string" for k in key), batches).groupBy(*key).agg(F.max("batch").alias("batch"))
        return self._log(table, "rows", schema, batches).join(last, [*key, "batch"], "left_semi").select(*self._columns(table))

    def _write(self, table: str, batch: int, keys: DataFrame, rows: DataFrame) -> None:
        key = TABLES[table][0]
        rows.select(*self._columns(table)).write.mode("overwrite").parquet(f"{self.at}/batch={batch}/{table}/rows")
        keys.select(*key).distinct().write.mode("overwrite").parquet(f"{self.at}/batch={batch}/{table}/keys")

    def _merged(self, table: str, batch: int) -> DataFrame:
        """The table after a batch that has written its part, but has no mark yet."""
        key, schema = TABLES[table]
        keys = self._log(table, "keys", ", ".join(f"{k} string" for k in key), [batch]).drop("batch")
        return self.read(table, batch).join(keys, list(key), "left_anti").unionByName(self._log(table, "rows", schema, [batch]).drop("batch"))

    def add(self, files: DataFrame, batch: int, cache: ExtractionCache | None = None) -> None:
        """Takes in (path, content) of files that are new or may have changed; a batch that runs again does the same again.

        Of several contents of one path in a batch the greatest counts, so a source should send one.
        """
        one = files.groupBy("path").agg(F.max("content").alias("content")).withColumn("hash", content_hash(F.col("content"), F.col("path")))
        known = self.read("stats", batch)
        changed = written(one.join(known.select("path", "hash"), ["path", "hash"], "left_anti"))
        if not changed.limit(1).count():
            return
        content = changed.select("path", "content")
        if cache is None:
            parsed = extract.parse(content)
        else:
            stored, misses = cache.rows_of(content)
            stored = checkpointed(stored)  # before an eviction can delete what it is read from
            fresh = checkpointed(extract.parse(misses))
            cache.save(misses, fresh)
            parsed = stored.unionByName(fresh)
        paths = changed.select("path")
        added = paths.join(known, "path", "left_anti")
        old = checkpointed(self.read("rows", batch).join(paths, "path", "left_semi"))
        self._write("rows", batch, paths, parsed)
        self._write("stats", batch, paths, changed.select("path", "hash").join(extract.file_stats(content), "path"))
        new = self._log("rows", "rows", TABLES["rows"][1], [batch]).drop("batch")
        rows = self._merged("rows", batch)
        differ = checkpointed(self._different(old, new))
        self._add_classes(batch, rows, old, differ)
        self._add_calls(batch, rows, old, new, differ)
        self._add_imports(batch, rows, paths, added)
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/batch={batch}/_DONE")
        done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done).close()

    @staticmethod
    def _different(old: DataFrame, new: DataFrame) -> DataFrame:
        """(relation, a, before, after): the members of a class that a file gives, in order, where they differ."""
        members = lambda df, name: (
            df.where(F.col("relation").isin("extends", "fields", "contains"))
            .groupBy("path", "relation", "a")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "b", "c"))), lambda x: F.struct(x["b"], x["c"])).alias(name))
        )
        both = members(old, "before").join(members(new, "after"), ["path", "relation", "a"], "full")
        return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("relation", "a", "before", "after")

    def _add_classes(self, batch: int, rows: DataFrame, old: DataFrame, differ: DataFrame) -> None:
        extends = extract.relation(rows, "extends", extract.EXTENDS)
        gone = extract.relation(old, "extends", extract.EXTENDS)
        seeds = differ.select(F.col("a").alias("node")).distinct()
        below = frontiers(extends.unionAll(gone).select(F.col("parent").alias("src"), F.col("class_name").alias("dst")), seeds).select("node")
        affected = checkpointed(seeds.unionAll(below).distinct())
        # what they inherit from, all the way up
        above = frontiers(extends.select(F.col("class_name").alias("src"), F.col("parent").alias("dst")), affected).select("node")
        whole = checkpointed(affected.unionAll(above).distinct())
        some = checkpointed(rows.where(F.col("relation").isin("extends", "fields", "contains")).join(whole.withColumnRenamed("node", "a"), "a", "left_semi"))
        keys = affected.withColumnRenamed("node", "class_name")
        parents = extract.relation(some, "extends", extract.EXTENDS)
        for table, made in (("fields", extract.inherited_fields), ("methods", extract.inherited_methods)):
            self._write(table, batch, keys, made(some, parents, *ORDER).join(keys, "class_name", "left_semi"))

    def _changed(self, table: str, batch: int, column: str) -> DataFrame:
        """(name): values of a column in rows of a table that this batch takes away or adds."""
        key, schema = TABLES[table]
        now = self._log(table, "rows", schema, [batch]).drop("batch")
        keys = self._log(table, "keys", ", ".join(f"{k} string" for k in key), [batch]).drop("batch")
        before = self.read(table, batch).join(keys, list(key), "left_semi")
        return now.exceptAll(before).unionAll(before.exceptAll(now)).select(F.col(column).alias("name"))

    def _add_calls(self, batch: int, rows: DataFrame, old: DataFrame, new: DataFrame, differ: DataFrame) -> None:
        pending = extract.pending_calls(rows, *ORDER)
        contained = differ.where("relation = 'contains'")
        members = contained.select(F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<struct<b:string,c:string>>")) for c in ("before", "after")))).alias("m")).select(F.col("m.b").alias("name"))
        names = checkpointed(self._changed("methods", batch, "method").unionAll(members).distinct())
        steps = checkpointed(self._changed("fields", batch, "field").distinct())
        pair = ["caller", "callee"]
        of_files = old.unionByName(new).where(F.col("relation").isin("calls", "pending")).select(F.col("a").alias("caller"), F.col("b").alias("callee"))
        by_name = pending.join(names.withColumnRenamed("name", "callee"), "callee", "left_semi").select(*pair)
        by_step = pending.select(*pair, F.explode("receiver_chain").alias("name")).join(steps, "name", "left_semi").select(*pair)
        pairs = checkpointed(of_files.unionAll(by_name).unionAll(by_step).distinct())
        callees = pairs.select("callee").distinct()
        some = checkpointed(pending.join(pairs, pair, "left_semi"))
        calls = extract.relation(rows, "calls", extract.CALLS, *ORDER).join(pairs, pair, "left_semi")
        calls = calls.select(*pair, F.lit(None).cast("string").alias("callee_qn"), F.struct(*ORDER).alias("seq"))
        # only entries that these calls can ask for
        asked = some.select(F.explode("receiver_chain").alias("field")).distinct()
        fields = self._merged("fields", batch).join(asked, "field", "left_semi")
        methods = self._merged("methods", batch).join(callees.withColumnRenamed("callee", "method"), "method", "left_semi")
        contains = extract.relation(rows, "contains", extract.CONTAINS).join(callees.withColumnRenamed("callee", "child"), "child", "left_semi")
        found = resolve.qualify_callees(calls, some.withColumn("seq", F.struct(*ORDER)), fields, methods, contains)
        self._write("calls", batch, pairs, found.select(*pair, "callee_qn", "seq.path", "seq.k"))

    def _add_imports(self, batch: int, rows: DataFrame, paths: DataFrame, added: DataFrame) -> None:
        imports = extract.relation(rows, "imports", extract.IMPORTS, *ORDER)
        tries = resolve.import_candidates(imports).select("folder", "source", F.lower("path").alias("path"))
        hit = tries.join(added.select(F.lower("path").alias("path")), "path", "left_semi").select("folder", "source").distinct()
        others = imports.withColumn("folder", resolve.folder_of("file")).join(hit, ["folder", "source"], "left_semi").select("file")
        keys = checkpointed(paths.select(F.col("path").alias("file")).unionAll(others).distinct())
        files = extract.relation(rows, "files", {"path": "path"})
        some = imports.join(keys, "file", "left_semi")
        self._write("imports", batch, keys, resolve.resolve_imports(some, files))

    def graph(self) -> CodeGraph:
        """The facts of each file's latest content: what one extraction of all files would give."""
        rows = numbered(self.read("rows"), ["path", "k", "relation"])
        seq = lambda name: rows.where(F.col("relation") == name).select(*ORDER, "seq")
        return CodeGraph.of(
            self.spark,
            calls=self.read("calls").join(seq("calls"), list(ORDER)),
            imports=self.read("imports").join(seq("imports"), list(ORDER)),
            **extract.plain_relations(rows, self.read("stats").drop("hash")),
        )


def follow(files: DataFrame, cache: ExtractionCache, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the facts below `out` up to date with a stream of (path, content); known contents come from the cache.

    A batch that runs again writes the same under its number; one that has not finished doesn't count.
    """

    def batch(df: DataFrame, number: int) -> None:
        Facts(df.sparkSession, out).add(df, number, cache)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, out: str, cache: ExtractionCache | None = None) -> CodeGraph:
    """The facts of each file's latest content."""
    return Facts(spark, out).graph()
