"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.fixpoint import checkpointed as cut
from gneiss.operators.fixpoint import components, shared_dir

__all__ = ["by_bytes", "components", "cut", "dropped", "dropped_table", "freed", "once", "running_totals", "shared_dir", "stored", "stored_by", "table"]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it; also inside the functions of arrays."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_totals(values: Column, chunk: int = 512) -> Column:
    """The sums of an array's first 1, 2, 3 ... ints. An array is copied for each of its elements, so it goes in chunks."""

    def within(x: Column) -> Column:
        begun = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
        add = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + v)).alias("sums"))
        return F.aggregate(x, begun, add, lambda a: a["sums"])

    def joined(chunks: Column) -> Column:
        before = within(F.concat(F.array(F.lit(0)), F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), lambda c: F.element_at(c, -1))))
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(c, lambda x: x + b)))

    def chunked(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda c: within(F.slice(x, c * chunk + 1, F.lit(chunk))))
        return F.when(F.size(x) > 0, once(parts, joined)).otherwise(F.array().cast("array<int>"))

    return once(values, chunked)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as compressed columns: for tables of many rows of which each reader needs some columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gneiss-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """Like stored, in buckets by key: joins by key read the table as it lies, without a shuffle of its rows."""
    spark = df.sparkSession
    name = f"gneiss_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = df.repartition(n, key).write.format("parquet").options(compression="zstd", path=f"{shared_dir(spark)}/{name}")
    to.bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only, its files stay
    return out


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that this session wrote and no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped_table(df: DataFrame) -> None:
    """Deletes the files of a table made by stored, which no plan reads any more."""
    files = df.inputFiles()
    if files:
        dropped(df.sparkSession, files[0].rsplit("/", 1)[0])


def freed(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs deleted now: Spark does so once the driver collects their plans, which may be much later."""
    spark._jvm.System.gc()


def by_bytes(texts: list, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `most` bytes, so that a worker's memory doesn't follow the batch's rows."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
