"""Mixing sources to target weights by Poisson replication.

A source with share w of the mix and n of the N rows has the mean repetition rate w * N * epochs / n. Each row's
count is a Poisson number with that mean, inverted from a uniform number hashed from its id: the count of values of
the distribution function that are not above it. So a row's copies depend on nothing but its id, the seed and the
rate, also when a task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut

#: Means above this are drawn as sums of equal parts, where exp(-mean) and the table of the distribution stay in range.
PART = 32.0
#: Sources that are broadcast at most; beyond, the rates are joined by a shuffle that splits skewed keys.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n, rate, cdf, parts). weights: target weights by source (others: none); without, n ** temperature."""
    counts = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")))  # the table is read once for this
    if weights is None:
        weight = F.pow("n", F.lit(temperature))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source").cast("string")) if pairs else F.lit(None).cast("double"), F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rates = counts.crossJoin(F.broadcast(total)).withColumn("rate", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_n") * epochs / F.col("n")).otherwise(0.0))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("mean", F.col("rate") / F.col("parts"))
    cdf = F.expr(
        "aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean) + 20) as int)), named_struct('p', exp(-mean), 'c', array(exp(-mean))),"
        " (a, k) -> named_struct('p', a.p * mean / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * mean / k))), a -> a.c)"
    )
    return rates.select("source", "n", "rate", "parts", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(row: a struct of all columns of docs, copy: 1 .. count, shuffle_key), dealt and sorted by shuffle_key.

    A row with count 0 gives no row. A null source is a source of its own; null ids share one draw; repeated ids of a
    source draw alike. An empty table gives no rows. Extra columns are carried inside the struct.
    """
    rates = source_rates(docs, weights, temperature, epochs, source_col)
    small = rates.select("source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.select("source", "parts", "cdf")
    key = F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit(""))
    draw = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), j.cast("string"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(F.broadcast(rates) if small else rates, F.col(f"row.{source_col}").eqNullSafe(rates["source"]))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= draw(j))))
    copies = rows.withColumn("count", count).where("count > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    mixed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed} shuffle"), key, F.col("copy").cast("string"))))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
