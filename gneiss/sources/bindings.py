"""The driver's tables as facts, so that every analysis has a deterministic graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources.facts import CodeGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edge(df: DataFrame, a: str, x: str, b: str, y: str) -> DataFrame:
    return df.select(F.concat(F.lit(a + "/"), F.col(x)).alias("caller"), F.concat(F.lit(b + "/"), F.col(y)).alias("callee"))


def hierarchy_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer -> order -> part -> supplier: a DAG of depth 5; a bag, as lines repeat."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        _edge(t("nation"), "region", "n_regionkey", "nation", "n_nationkey"),
        _edge(t("customer"), "nation", "c_nationkey", "customer", "c_custkey"),
        _edge(t("orders"), "customer", "o_custkey", "order", "o_orderkey"),
        _edge(t("lineitem"), "order", "l_orderkey", "part", "l_partkey"),
        _edge(t("lineitem"), "part", "l_partkey", "supplier", "l_suppkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def hierarchy(spark: SparkSession, sf_dir: str) -> CodeGraph:
    t = lambda n: table(spark, sf_dir, n)
    define = lambda df, file, name, key, kind: df.select(F.lit(file).alias("file") if isinstance(file, str) else file.alias("file"), F.concat(F.lit(name + "/"), F.col(key)).alias("name"), F.lit(kind).alias("kind"), F.col(key).cast("int").alias("line"))
    segment = F.concat(F.lit("src/services/"), F.lower("c_mktsegment"), F.lit(".ts"))
    defines = (
        define(t("region"), "src/routes/region.ts", "region", "r_regionkey", "class")
        .unionAll(define(t("nation"), "src/handlers/nation.ts", "nation", "n_nationkey", "class"))
        .unionAll(define(t("customer"), segment, "customer", "c_custkey", "function"))
        .unionAll(define(t("orders"), F.concat(F.lit("src/repositories/"), F.col("o_orderstatus"), F.lit(".ts")), "order", "o_orderkey", "function"))
        .unionAll(define(t("part"), "src/db/part.ts", "part", "p_partkey", "function"))
        .unionAll(define(t("supplier"), "src/db/supplier.ts", "supplier", "s_suppkey", "method"))
    )
    rich = t("customer").where("c_acctbal > 0")
    exports = rich.select(segment.alias("file"), F.concat(F.lit("customer/"), F.col("c_custkey")).alias("name"))
    imports = t("customer").select(segment.alias("file"), F.lit("nation").alias("name"), F.lit("../handlers/nation").alias("source")).distinct()
    contains = t("supplier").select(F.concat(F.lit("nation/"), F.col("s_nationkey")).alias("parent"), F.concat(F.lit("supplier/"), F.col("s_suppkey")).alias("child"))
    files = defines.select(F.col("file").alias("path")).distinct().withColumn("language", F.lit("typescript"))
    return CodeGraph.of(spark, defines=defines, calls=hierarchy_calls(spark, sf_dir), exports=exports, imports=imports, contains=contains, files=files)


def trade(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Customers' nation -> each of the three nations whose suppliers deliver most to it: a small graph with cycles, over all lines."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.groupBy("c_nationkey", "s_nationkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))  # at most one row a pair of nations
    best = pairs.selectExpr("*", "row_number() over (partition by c_nationkey order by n desc, s_nationkey) as k").where("k <= 3")
    calls = best.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("caller"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("callee"))
    defines = t("nation").select(F.lit("src/nation.ts").alias("file"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "method").otherwise("function").alias("kind"), F.col("n_nationkey").alias("line"))
    return CodeGraph.of(spark, defines=defines, calls=calls)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive event types of each user: (source, target), a bag."""
    return table(spark, sf_dir, "events").selectExpr("event_type as source", "lead(event_type) over (partition by user_id order by ts, event_id) as target").where("target is not null")
