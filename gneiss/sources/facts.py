"""The fact bundle: seven relations about a code base, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "defines": "file string, name string, kind string, line int, signature string, seq long",
    "calls": "caller string, callee string, callee_qn string, seq long",
    "imports": "file string, name string, source string, resolved string, seq long",
    "exports": "file string, name string, seq long",
    "contains": "parent string, child string, seq long",
    "files": "path string, language string, file_doc string, token_estimate int, line_count int, seq long",
    "hyperedges": "id string, label string, nodes array<string>, relation string, source_file string, seq long",
}
KINDS = ("function", "method", "class", "interface", "variable")


@dataclass(frozen=True)
class CodeGraph:
    """Immutable. calls is a bag; every relation has seq, the order of its rows, where an operator's choice depends on it."""

    defines: DataFrame
    calls: DataFrame
    imports: DataFrame
    exports: DataFrame
    contains: DataFrame
    files: DataFrame
    hyperedges: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **relations: DataFrame | list) -> CodeGraph:
        """From DataFrames or lists of tuples; columns that are missing are null, seq is the order of a list."""
        out = {}
        for name, schema in SCHEMAS.items():
            given = relations.get(name, [])
            fields = [f.split() for f in schema.split(", ")]
            if isinstance(given, list):
                width = len(fields) - 1
                rows = [(*x, *[None] * (width - len(x)), k) for k, x in enumerate(given)]
                out[name] = spark.createDataFrame(rows, schema)
            else:
                have = set(given.columns)
                out[name] = given.select(*(F.col(c).cast(t) if c in have else F.lit(None if c != "seq" else 0).cast(t).alias(c) for c, t in fields))
        return cls(**out)

    def with_(self, **relations: DataFrame) -> CodeGraph:
        return replace(self, **relations)

    def edges(self) -> DataFrame:
        """Distinct (caller, callee)."""
        return self.calls.select("caller", "callee").distinct()

    def nodes(self) -> DataFrame:
        """Distinct names: defined, calling or called."""
        return self.defines.select("name").union(self.calls.select("caller")).union(self.calls.select("callee")).distinct()

    def save(self, path: str) -> None:
        for name in SCHEMAS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeGraph:
        return cls.of(spark, **{name: spark.read.parquet(f"{path}/{name}") for name in SCHEMAS})
