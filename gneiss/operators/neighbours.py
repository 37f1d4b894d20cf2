"""The nearest vectors of every vector of a table, exactly, without comparing all pairs.

Vectors are dealt to the nearest of some pivots, and each pivot's cell is cut into rings of at most BLOCK members by
distance from the pivot. A vector first meets its own block, which gives a radius within which its k nearest lie. By
the triangle inequality all members of a ring have at least the distance by which the ring lies off the vector's own
distance from the pivot, so only rings within the radius are visited. Visits to a block are worked off some thousand
at a time, as one product of two matrices; what a task holds doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.fixpoint import written
from gneiss.operators.numbering import numbered

#: Members of a block, and visits to it that are worked off at once.
BLOCK = 1024
VISITS = 2048
#: Distances of unit vectors are compared with this much room for rounding.
ROOM = 1e-7


def _best(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """(id, other, score): of each row of scores the k largest, the smaller other first where they are equal."""
    order = np.argsort(others, kind="stable")
    scores, others = scores[:, order], others[order]
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(ids)), top.shape[1])
    out = pd.DataFrame({"id": ids[rows], "other": others[top.ravel()], "score": scores[rows, top.ravel()]})
    return out[np.isfinite(out.score)]


def nearest_to_each(store: DataFrame, k: int, pivots: int = 64, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, rank, other, score): the k nearest others of every vector by cosine, rank 1 the nearest, ties by the smaller id.

    Ids are distinct longs. Vectors that are null, zero, or hold null or non-finite components neither have neighbours
    nor are any; all others have the same length. pivots: vectors that are sampled by a hash of the id, a bound that
    only speed depends on.
    """
    spark = store.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = store.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    if not sample or k < 1:
        return spark.createDataFrame([], "id long, rank int, other long, score double")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    centres = unit(np.array([x.v for x in sample]))
    away = lambda m: np.sqrt(np.maximum(0, 2 - 2 * m @ centres.T))

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                u = unit(np.stack(f.v.to_numpy()))
                d = away(u)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"id": f.id, "u": list(u), "cell": cell.astype(np.int32), "d": d[np.arange(len(f)), cell]})

    members = numbered(rows.mapInPandas(dealt, "id long, u array<double>, cell int, d double"), ["cell", "d", "id"])
    members = written(members.withColumn("block", F.expr(f"(seq div {BLOCK}) * {len(centres)} + cell")))
    blocks = written(members.groupBy("cell", "block").agg(F.min("d").alias("low"), F.max("d").alias("high")))
    reach = np.full(len(centres), -1.0)
    for x in blocks.groupBy("cell").agg(F.max("high").alias("high")).collect():  # a row a pivot at most
        reach[x.cell] = x.high

    def at_home(f: pd.DataFrame) -> pd.DataFrame:
        u, ids = np.stack(f.u.to_numpy()), f.id.to_numpy()
        scores = u @ u.T
        np.fill_diagonal(scores, -np.inf)
        return _best(ids, ids, scores, k)

    near = written(members.groupBy("cell", "block").applyInPandas(at_home, "id long, other long, score double"))
    # the radius is that of the k-th found; with fewer, everything is within it
    radius = near.groupBy("id").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))) + ROOM).alias("radius"))
    asking = members.join(radius.hint("merge"), "id", "left").select("id", "u", "block", F.coalesce("radius", F.lit(3.0)).alias("radius"))

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 4096):
                g = f.iloc[a : a + 4096]
                d, r = away(np.stack(g.u.to_numpy())), g.radius.to_numpy()
                own = d.min(axis=1)
                # off the cell's outermost ring, or further on the other side of the plane between two pivots
                row, cell = np.nonzero((d - reach[None, :] <= r[:, None]) & (d - own[:, None] <= 2 * r[:, None]) & (reach >= 0)[None, :])
                yield pd.DataFrame({"id": g.id.to_numpy()[row], "cell": cell.astype(np.int32), "d": d[row, cell], "radius": r[row], "own": g.block.to_numpy()[row]})

    visits = asking.mapInPandas(sent, "id long, cell int, d double, radius double, own long")
    visits = visits.join(blocks, "cell").where("d - radius <= high and d + radius >= low and block <> own").select("id", "cell", "block")
    visits = written(visits)
    # a row a block, as a table whose size Spark knows; vectors are never broadcast, however small their files are
    parts = written(visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts")))
    here = members.join(parts, ["cell", "block"]).select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "u")
    there = visits.join(parts, ["cell", "block"]).join(members.select("id", "u").hint("merge"), "id").select("cell", "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "u")

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _best(b.id.to_numpy(), a.id.to_numpy(), np.stack(b.v.to_numpy()) @ np.stack(a.u.to_numpy()).T, k)

    key = ["cell", "block", "part"]
    there = there.toDF("cell", "block", "part", "id", "v")  # other columns than those of `here`
    far = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(met, "id long, other long, score double")
    ranked = near.unionAll(far).selectExpr("id", "cast(row_number() over (partition by id order by score desc, other) as int) as rank", "other", "score")
    return ranked.where(F.col("rank") <= k)
