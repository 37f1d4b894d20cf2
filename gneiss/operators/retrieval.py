"""Ranking: BM25 over an inverted index, cosine over vectors, and the search built on them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.scalars import STOPWORDS, cosine, mock_embedding, norm, snippet, tokenize, word_jaccard
from gneiss.operators.fixpoint import checkpointed
from gneiss.sources.facts import CodeGraph


@dataclass(frozen=True)
class BM25Index:
    """tokens (doc, tokens) of the texts; the inverted index and its statistics follow from them."""

    tokens: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str) -> BM25Index:
        """A text without tokens counts with length 0. Null texts are empty."""
        return cls(docs.select(F.col(id_col).alias("doc"), tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens")))

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> BM25Index:
        """With more texts; statistics follow from all tokens, so an index that grew equals one built at once."""
        return BM25Index(self.tokens.unionAll(BM25Index.build(docs, id_col, text_col).tokens))

    def remove(self, ids: DataFrame) -> BM25Index:
        """Without the texts of ids (a column `doc`)."""
        return BM25Index(self.tokens.join(ids, "doc", "left_anti"))

    @property
    def postings(self) -> DataFrame:
        """(doc, term, tf)."""
        return self.tokens.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))

    @property
    def average(self) -> DataFrame:
        """One row: n, avg_length."""
        return self.tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_length"))

    @property
    def idf(self) -> DataFrame:
        """(term, df, idf)."""
        df = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return self._weighted(df, self.average).select("term", "df", "idf")

    @staticmethod
    def _weighted(df: DataFrame, average: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(average)).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))  # average is one row

    def search(self, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75, digits: int | None = None) -> DataFrame:
        """(doc, score), best first; a term counts as often as the query holds it. Only the query's terms leave the scan.

        digits: scores are rounded to so many decimals before they are ranked, and equal ones go by the smaller doc.
        """
        spark = self.tokens.sparkSession
        words = [t for t in re.split("[^a-z0-9_]+", query.lower()) if len(t) >= 2 and t not in STOPWORDS]
        terms = spark.createDataFrame(list(Counter(words).items()), "term string, times int")
        wanted = sorted(set(words)) or [""]
        # texts are tokenized once; what is kept of a text is its length and the query's terms in it
        hits = checkpointed(self.tokens.select("doc", F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(*wanted)).alias("hits")))
        average = hits.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
        found = hits.select("doc", "length", F.explode("hits").alias("term")).groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))
        df = self._weighted(found.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term"), average)
        scored = found.join(F.broadcast(df), "term")  # a row for each term of the query at most
        part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
        every = scored.groupBy("doc").agg(F.sum(part).alias("score")).where("score > 0")
        if digits is not None:
            every = every.select("doc", F.round("score", digits).alias("score"))
        return every.orderBy(F.desc("score"), "doc").limit(limit)


def upsert_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """(id, vector, norm): new rows replace those of the same id; of equal ids in new, the largest seq counts."""
    dims = store.select(F.size("vector").alias("d")).unionAll(new.select(F.size("vector").alias("d"))).distinct().limit(2).collect()
    if len(dims) > 1:
        raise ValueError(f"vectors of {sorted(x.d for x in dims)} components can't share a store")
    latest = new.groupBy("id").agg(F.max_by("vector", "seq").alias("vector"))
    kept = store.select("id", "vector").join(latest, "id", "left_anti")
    return kept.unionByName(latest).withColumn("norm", norm(F.col("vector")))


def remove_vectors(store: DataFrame, ids: list[str]) -> DataFrame:
    return store.where(~F.col("id").isin(ids))


def save_vectors(store: DataFrame, path: str) -> None:
    store.select("id", "vector").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """(id, vector, norm); a store with vectors of another length than `dimension`, or of several, is refused."""
    store = spark.read.schema("id string, vector array<double>").parquet(path)
    found = [x[0] for x in store.select(F.size("vector")).distinct().limit(2).collect()]
    if len(found) > 1 or dimension and found and found != [dimension]:
        raise ValueError(f"the store holds vectors of {sorted(found)} components")
    return store.withColumn("norm", norm(F.col("vector")))


def nearest(store: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score) by cosine, best first. Zero vectors never match; a zero query or k below 1 gives nothing."""
    q = F.array(*(F.lit(float(x)) for x in query))
    usable = k > 0 and any(query)
    rows = store.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).where("score is not null" if usable else "false")
    return rows.orderBy(F.desc("score"), "id").limit(max(0, k))


def with_cached(texts: DataFrame, cache: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(hits with vectors, misses) of texts (a column `text`) in a cache (key: SHA-256 of the text, vector)."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    good = cache.where(F.size("vector") == dimension).select("key", "vector")
    return keyed.join(good, "key"), keyed.join(good, "key", "left_anti")


def search_corpus(graph: CodeGraph, contents: DataFrame, most: int = 2000) -> DataFrame:
    """(id, file, name, line, text, seq) of functions and methods in files whose content (path, content) is known."""
    rows = graph.defines.where("kind in ('function', 'method')").join(contents, F.col("file") == F.col("path")).join(graph.files.select(F.col("path").alias("p"), "file_doc"), F.col("file") == F.col("p"), "left")
    text = F.concat_ws("\n", "name", "signature", "file_doc", snippet(F.col("content"), F.col("line")))
    return rows.select(F.concat_ws("#", "file", "name", F.col("line").cast("string")).alias("id"), "file", "name", "line", F.substring(text, 1, most).alias("text"), graph.defines["seq"])


class VectorCache:
    """Vectors of texts by the SHA-256 of the text, in a folder that the cluster shares, by buckets of the key.

    A save adds to the buckets of its keys; a lookup reads those of its texts. Vectors of another length are misses.
    """

    def __init__(self, spark: SparkSession, at: str, dimension: int):
        self.spark, self.at, self.dimension = spark, at, dimension

    def _stored(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        schema = "key string, vector array<double>, bucket string"
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.at)

    def put(self, keyed: DataFrame) -> None:
        """Adds (key, vector)."""
        rows = keyed.select("key", "vector", F.substring("key", 1, 1).alias("bucket")).distinct()
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.at)

    def vectors(self, texts: DataFrame, embed) -> DataFrame:
        """texts (a column `text`, and others) with key and vector: stored ones are read, others embedded once a distinct text and added."""
        buckets = [x.b for x in texts.select(F.substring(F.sha2("text", 256), 1, 1).alias("b")).distinct().collect()]  # at most 16
        known = self._stored().where(F.col("bucket").isin(buckets) & (F.size("vector") == self.dimension)).dropDuplicates(["key"])
        _, misses = with_cached(texts, known, self.dimension)
        fresh = checkpointed(misses.select("key", "text").distinct().select("key", embed(F.col("text")).alias("vector")))
        if fresh.limit(1).count():
            self.put(fresh)
        both = known.select("key", "vector").unionByName(fresh)
        return texts.withColumn("key", F.sha2("text", 256)).join(both, "key")


def semantic_search(spark: SparkSession, corpus: DataFrame, query: str, top_k: int = 10, embed=None, dimension: int = 64, cache: VectorCache | None = None) -> DataFrame:
    """(id, score, file, name, line, text): embed maps a text column to a vector column; the default is the deterministic one. top_k is held to 1 .. 100.

    cache: where vectors of texts are kept; only texts that it doesn't know are embedded.
    """
    embed = embed or (lambda c: mock_embedding(c, dimension))
    vector = spark.createDataFrame([(query,)], "q string").select(embed(F.col("q"))).first()[0]
    # of rows with one id the last counts: by seq where the corpus has it, then by text
    seq = F.col("seq") if "seq" in corpus.columns else F.lit(0)
    row = F.struct("file", "name", "line", "text")
    last = corpus.groupBy("id").agg(F.max_by(row, F.struct(seq, row)).alias("x")).select("id", "x.*")
    if cache is None:
        vectors = last.select("id", embed(F.col("text")).alias("vector"))
    else:
        last = checkpointed(last)
        vectors = cache.vectors(last.select("id", "text"), embed).select("id", "vector")
    hits = nearest(vectors, vector, min(100, max(1, top_k)))
    return hits.join(last, "id").orderBy(F.desc("score"), "id")


def near_duplicate(index: BM25Index, texts: DataFrame, candidate: str, id_col: str, text_col: str, least: float = 0.7, digits: int | None = None) -> DataFrame:
    """(id, similarity): of the three best matches of a text, those whose word sets are alike by more than `least`."""
    best = index.search(candidate, 3, digits=digits)
    rows = best.join(texts.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc")
    return rows.select(F.col("doc").alias("id"), word_jaccard(F.col("text"), F.lit(candidate)).alias("similarity")).where(F.col("similarity") > least)
