"""BM25 over a persisted inverted index: postings in blocks with upper bounds, by bucket of the term.

An index is a folder of segments, one for each addition. A segment holds

- blocks, by bucket of the term: a term's documents of like frequency and length together, at most about BLOCK a
  row, with the largest frequency and the smallest length in it. A block's best score follows from these two;
- terms (term, df) in the same buckets, and documents with their lengths, terms and frequencies, by bucket of the document;
- one row of totals.

A search opens the buckets of its terms. It scores the most promising blocks first, which gives a score that the
last of the best `limit` documents has at least. A block can be left out if even with the best blocks of all other
terms it doesn't reach that score: no document in it can be among the best. The result is exact.

Removed documents are a log of ids with the segment up to which they count; their terms come from the documents'
table, so that statistics stay those of an index built from what is left.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.scalars import STOPWORDS, tokenize
from gneiss.operators.fixpoint import written

#: Buckets of terms and of documents, tasks that write a bucket, and documents of a block.
BUCKETS = 16
PIECES = 8
BLOCK = 512
BLOCKS = "term string, max_tf int, min_length int, n int, docs array<{id}>, tfs array<int>, lengths array<int>, bucket int"
TERMS = "term string, df long, bucket int"


def bucket_of(column: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def piece_of(column: str) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(column), 32), F.lit(PIECES)).cast("int")


def counted(tokens: Column) -> Column:
    """struct(length, terms, tfs) of an array of tokens: its distinct ones in order, and how often each occurs."""
    # the tokens in order, then the places at which another one begins; each is made once a row and bound to a name
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = F.transform(F.array(F.sort_array(tokens)), lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, begins(s)).otherwise(F.array().cast("array<int>")).alias("at")))
    both = lambda r: F.struct(
        F.size(r["s"]).alias("length"),
        F.transform(r["at"], lambda i: F.get(r["s"], i)).alias("terms"),
        F.transform(r["at"], lambda i, k: F.coalesce(F.get(r["at"], k + 1), F.size(r["s"])) - i).alias("tfs"),
    )
    return F.get(F.transform(runs, both), F.lit(0))


class StoredBM25:
    """An index in a folder that the cluster shares. Ids have one type; a document is added once, or again after its removal."""

    def __init__(self, spark: SparkSession, at: str, id_type: str = "long"):
        self.spark, self.at, self.id_type = spark, at, id_type
        self.skipped = 0  # blocks that the last search has left out

    def _numbers(self, what: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{what}/*/_DONE")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(x.getPath().getParent().getName()) for x in found)

    def _done(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_DONE")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path).close()

    def _next(self) -> int:
        return max([0, *self._numbers("segments"), *self._numbers("removed")]) + 1

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of all segments, with the number of the segment; of some buckets, no other folder is read."""
        out = None
        for k in self._numbers("segments"):
            df = self.spark.read.schema(schema).parquet(f"{self.at}/segments/{k}/{table}").withColumn("segment", F.lit(k))
            out = df if out is None else out.unionAll(df)
        if out is None:
            return self.spark.createDataFrame([], schema + ", segment int")
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """One more segment. A text without tokens counts with length 0; null texts are empty."""
        at = f"{self.at}/segments/{self._next()}"
        # texts are dealt by buckets and pieces of them, and read once; a text's terms are counted within its row
        texts = docs.select(F.col(id_col).cast(self.id_type).alias("doc"), F.col(text_col).alias("text"))
        texts = texts.withColumn("bucket", bucket_of("doc")).repartition("bucket", piece_of("doc"))
        each = texts.select("doc", "bucket", counted(tokenize(F.coalesce("text", F.lit("")))).alias("x"))
        each.select("doc", F.col("x.length").alias("length"), F.col("x.terms").alias("terms"), F.col("x.tfs").alias("tfs"), "bucket").write.partitionBy("bucket").parquet(f"{at}/docs")
        stored = self.spark.read.schema(f"doc {self.id_type}, length int, terms array<string>, tfs array<int>").parquet(f"{at}/docs")
        rows = stored.select("doc", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc", "length", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
        # documents of like frequency and length, so that a block's bound is close to the scores in it
        level = [F.floor(F.log2(F.col("tf").cast("double"))).cast("int").alias("a"), F.floor(F.log2(F.col("length").cast("double")) * 2).cast("int").alias("b")]
        levels = written(rows.select("term", *level).groupBy("term", "a", "b").agg(F.count("*").alias("n")))
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        cut = rows.select("*", *level).join(levels.select("term", "a", "b", parts.alias("parts")), ["term", "a", "b"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
        posting = F.collect_list(F.struct("doc", "tf", "length")).alias("x")
        blocks = cut.groupBy("term", "a", "b", "part").agg(F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.count("*").cast("int").alias("n"), posting)
        blocks = blocks.select("term", "max_tf", "min_length", "n", F.col("x.doc").alias("docs"), F.col("x.tf").alias("tfs"), F.col("x.length").alias("lengths"), bucket_of("term").alias("bucket"))
        blocks.repartition("bucket", piece_of("term")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/blocks")
        terms = levels.groupBy("term").agg(F.sum("n").alias("df")).withColumn("bucket", bucket_of("term"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/terms")
        stored.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).write.parquet(f"{at}/totals")
        self._done(at)

    def remove(self, ids: DataFrame) -> None:
        """Takes the documents of ids (a column `doc`) out of the segments before now. Their buckets are read for their terms."""
        number = self._next()
        at = f"{self.at}/removed/{number}"
        gone = ids.select(F.col("doc").cast(self.id_type).alias("doc")).distinct()
        buckets = [x.bucket for x in gone.select(bucket_of("doc").alias("bucket")).distinct().collect()]  # at most BUCKETS
        found = self._read("docs", f"doc {self.id_type}, length int, terms array<string>, bucket int", buckets).join(gone, "doc", "left_semi")
        found = self._standing(found).drop("bucket")
        found.write.parquet(f"{at}/docs")
        found = self.spark.read.schema(f"doc {self.id_type}, length int, terms array<string>, segment int").parquet(f"{at}/docs")
        terms = found.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).withColumn("bucket", bucket_of("term"))
        terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/terms")
        found.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("length"), F.lit(0)).alias("total")).write.parquet(f"{at}/totals")
        self._done(at)

    def _removed(self, table: str, schema: str) -> DataFrame:
        numbers = self._numbers("removed")
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.at).parquet(*(f"{self.at}/removed/{k}/{table}" for k in numbers))

    def _standing(self, rows: DataFrame) -> DataFrame:
        """Rows (doc, segment) but for those of documents that were removed from their segment."""
        if not self._numbers("removed"):
            return rows
        return rows.join(self._removed("docs", f"doc {self.id_type}, segment int"), ["doc", "segment"], "left_anti")

    @property
    def totals(self) -> tuple[int, float]:
        """(documents, average length)."""
        every = None
        for what in ("segments", "removed"):
            for k in self._numbers(what):
                df = self.spark.read.schema("n long, total long").parquet(f"{self.at}/{what}/{k}/totals")
                every = df if every is None else every.unionAll(df)
        n, total = every.agg(F.sum("n"), F.sum("total")).first() if every is not None else (0, 0)
        return n, total / n if n else 0.0

    def idf(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df, idf) of some terms, whose buckets alone are read, or of all."""
        buckets = None if terms is None else self._buckets(terms)
        rows = self._read("terms", TERMS, buckets).drop("segment")
        for k in self._numbers("removed"):
            gone = self.spark.read.schema(TERMS).parquet(f"{self.at}/removed/{k}/terms")
            rows = rows.unionByName(gone if buckets is None else gone.where(F.col("bucket").isin(buckets)))
        if terms is not None:
            rows = rows.where(F.col("term").isin(terms))
        df = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.withColumn("idf", F.ln((self.totals[0] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))

    def _buckets(self, terms: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return sorted({x.bucket for x in rows.select(bucket_of("term").alias("bucket")).collect()})

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms; only their buckets are opened, and in these only the terms' row groups."""
        return self._read("blocks", BLOCKS.format(id=self.id_type), self._buckets(terms)).where(F.col("term").isin(terms))

    def search(self, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75, digits: int | None = None) -> DataFrame:
        """(doc, score), best first; a term counts as often as the query holds it.

        digits: scores are rounded to so many decimals before they are ranked, and equal ones go by the smaller doc.
        """
        self.skipped = 0
        times = Counter(t for t in re.split("[^a-z0-9_]+", query.lower()) if len(t) >= 2 and t not in STOPWORDS)
        none = self.spark.createDataFrame([], f"doc {self.id_type}, score double")
        if not times:
            return none
        idf = {x.term: x.idf for x in self.idf(sorted(times)).collect()}  # a row for each term of the query
        average = self.totals[1]
        if not idf:
            return none
        weights = self.spark.createDataFrame([(t, float(times[t] * w)) for t, w in idf.items()], "term string, weight double")
        part = lambda tf, length: F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
        blocks = self.blocks(sorted(idf)).join(F.broadcast(weights), "term").withColumn("bound", part(F.col("max_tf"), F.col("min_length")))
        best = {x.term: x.bound for x in blocks.groupBy("term").agg(F.max("bound").alias("bound")).collect()}

        def scores(some: DataFrame) -> DataFrame:
            each = some.select("weight", "segment", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("x")).select("weight", "segment", "x.*")
            each = self._standing(each.select(F.col("docs").alias("doc"), "segment", part(F.col("tfs"), F.col("lengths")).alias("part")))
            every = each.groupBy("doc").agg(F.sum("part").alias("score")).where("score > 0")
            return every if digits is None else every.select("doc", F.round("score", digits).alias("score"))

        # of each term the best blocks that hold some times `limit` documents: their sums are a floor for the last of the best
        order = "over (partition by term order by bound desc, n desc rows between unbounded preceding and 1 preceding)"
        bounds = blocks.select("term", "bound", "n").groupBy("term", "bound").agg(F.sum("n").alias("n"))
        first = bounds.selectExpr("term", "bound", f"coalesce(sum(n) {order}, 0) as before").where(F.col("before") < 4 * limit).groupBy("term").agg(F.min("bound").alias("least"))
        some = blocks.join(F.broadcast(first), "term").where("bound >= least")
        floor = [x.score for x in scores(some).orderBy(F.desc("score")).limit(limit).collect()]
        if len(floor) == limit:
            others = sum(best.values())
            rest = F.create_map(*(F.lit(x) for t, v in best.items() for x in (t, others - v)))
            room = 0.0 if digits is None else 0.5 / 10**digits  # what rounding may have added
            can = F.col("bound") + F.element_at(rest, F.col("term")) >= (floor[-1] - room) * (1 - 1e-9)
            self.skipped = blocks.where(~can).count()
            blocks = blocks.where(can)
        return scores(blocks).orderBy(F.desc("score"), "doc").limit(limit)
