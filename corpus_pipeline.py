"""From documents to shards: language ID, near-duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir); run() writes what a stage returns and reads it again as the next one's docs.
Stages keep extra columns, and rows that are repeated, but for the near-duplicate stage. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import language
from gneiss.llm.common import dropped, shared_dir, table
from gneiss.llm.decontam import decontaminate
from gneiss.llm.mixing import mix
from gneiss.llm.sharding import shard_rows
from gneiss.llm.similar import keep_one_similar

#: Share of a text's n-grams that its language must know.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or nulls, and those of which no language knows a fifth of the n-grams."""
    found = language.identify(docs, language.fit(docs), docs.columns)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of texts linked by a Jaccard similarity of at least 0.8 between their sets of five-word shingles."""
    return keep_one_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of which at least a twentieth of the words lie in benchmark windows of 13 words; texts without words stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows by Poisson counts for shares of n ** 0.7; a null source is one of its own; rows come shuffled."""
    return mix(docs).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with shard and slot; copies of a row lie apart. A column with the name of one of the stage's own gives way."""
    return shard_rows(docs, carry=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The filters' hashes and the fingerprints have no SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:  # no later stage reads further back than one
            dropped(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
