"""Embedding near-duplicates by an inverted multi-index.

A codebook for each half of the normalised vectors makes a product grid; a vector lies in the cell of its nearest
centroids. A vector within distance d of x can lie in another cell only if x is within d of the planes that part
the centroids: per half, (|x - c|^2 - |x - own|^2) / (2 |c - own|) bounds the way to c's side. Multi-sequence
traversal visits cells from nearest to farthest by the sum of the squared bounds of both halves, until that sum
passes the reach. A reach of d^2 can't miss a neighbour. The reach for a target recall is measured: a sample of the
vectors is compared with all vectors, and the reach that finds that share of their links is taken.
Every pair met in a visited cell is verified in double precision.

Exact copies are one class before the search. Cells are worked in blocks, pairs of blocks in tasks of their own, so
a cell may hold any share of the rows; a task gives back counts and the spanning tree of what it linked, not pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import components, cut


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


@dataclass
class Grid:
    """The codebooks of the two halves, and how far cells are visited (squared)."""

    halves: tuple[np.ndarray, np.ndarray]
    reach: float

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, reach: float) -> Grid:
        cut_at = sample.shape[1] // 2
        return cls((_kmeans(sample[:, :cut_at], k), _kmeans(sample[:, cut_at:], k)), reach)

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both halves: own centroid, and squared lower bounds (rows, centroids) of the way to each centroid's side."""
        own, bound, cut_at = [], [], self.halves[0].shape[1]
        for part, centres in zip((x[:, :cut_at], x[:, cut_at:]), self.halves):
            d = (part**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * part @ centres.T
            mine = d.argmin(1)
            apart = np.sqrt(np.maximum((centres[mine] ** 2).sum(1)[:, None] + (centres**2).sum(1) - 2 * centres[mine] @ centres.T, 0))
            way = (d - d[np.arange(len(x)), mine][:, None]) / np.maximum(2 * apart, 1e-12)
            way[np.arange(len(x)), mine] = 0
            own.append(mine)
            bound.append(way**2)
        return own, bound

    def traverse(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells of one vector, nearest first, as far as the reach goes (first, second: its bounds).

        Multi-sequence: both halves are sorted; a cell is queued once its neighbours before it, in both, are out.
        """
        a, b = (x[np.argsort(v[x], kind="stable")] for v, x in ((first, np.flatnonzero(first <= self.reach)), (second, np.flatnonzero(second <= self.reach))))
        u, v = first[a].tolist(), second[b].tolist()
        a, b = a.tolist(), b.tolist()
        queue, taken = [(u[0] + v[0], 0, 0)], [0] * len(a)  # taken: cells out so far, by place in the first half
        while queue:
            total, i, j = heapq.heappop(queue)
            if total > self.reach:
                return
            yield a[i], b[j]
            taken[i] = j + 1
            if i + 1 < len(a) and taken[i + 1] == j:
                heapq.heappush(queue, (u[i + 1] + v[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(queue, (u[i] + v[j + 1], i, j + 1))


def _normal(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x**2).sum(1))[:, None]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == old).all():
            return label


def _needed_reach(classes: DataFrame, grids: dict[int, Grid], probes: int, least: float, target: float) -> dict[int, float]:
    """By dimension: the reach at which a sample of about `probes` vectors finds the share `target` of its links in all of classes."""
    spark = classes.sparkSession
    whole = 2 * (1 - least)
    share = F.shiftrightunsigned(F.xxhash64(F.lit("probe"), "v"), 11) / F.lit(float(1 << 53))
    sizes = {x.dim: x.n for x in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    limit = reduce(lambda e, d: F.when(F.col("dim") == d, min(1.0, probes / sizes[d])).otherwise(e), sizes, F.lit(0.0))
    drawn: dict[int, list] = {}
    for x in classes.where(share < limit).select("dim", "label", "cid", "v").limit(4 * probes * max(1, len(sizes))).collect():
        drawn.setdefault(x.dim, []).append(x)
    sent = spark.sparkContext.broadcast((grids, {d: ([x.label for x in xs], np.array([x.cid for x in xs]), _normal([x.v for x in xs])) for d, xs in drawn.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grids, asked = sent.value
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim not in asked:
                    continue
                labels, ids, q = asked[dim]
                grid, step = grids[dim], 2048
                q_own, q_bound = grid.bounds(q)
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    y = _normal(some.v)
                    i, j = np.nonzero((y @ q.T >= least) & (some.label.to_numpy()[:, None] == np.array(labels, dtype=object)) & (some.cid.to_numpy()[:, None] != ids))
                    own, bound = grid.bounds(y)
                    there = q_bound[0][j, own[0][i]] + q_bound[1][j, own[1][i]]
                    back = bound[0][i, q_own[0][j]] + bound[1][i, q_own[1][j]]
                    bins = np.clip(np.ceil(np.minimum(there, back) / whole * 1000), 0, 1000).astype(np.int64)
                    found, n = np.unique(bins, return_counts=True)
                    yield pd.DataFrame({"dim": np.full(len(found), dim, np.int32), "bin": found, "n": n})

    counts = classes.select("dim", "label", "cid", "v").mapInPandas(run, "dim int, bin long, n long").groupBy("dim", "bin").agg(F.sum("n").alias("n")).collect()
    out = {}
    for d in grids:
        bins = sorted((x.bin, x.n) for x in counts if x.dim == d)
        total, seen, out[d] = sum(n for _, n in bins), 0, 0.0
        for b, n in bins:
            if seen < target * total:
                out[d] = b / 1000 * whole
            seen += n
    return out


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    target_recall: float = 0.999,
    sample: int = 20_000,
    probes: int = 256,
    block: int = 1024,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component_id, kept (id = component_id).

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    `least`. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different length. Repeated rows are rows like others and link with each other. component_id is the
    smallest id reachable by links; a row without links has its own id, a null id is never the smallest, and kept is
    false for it. Extra columns are not read. An empty table gives no rows.
    The codebooks are fitted on about `sample` vectors a dimension; every vector is indexed and searched. The reach
    that finds the share `target_recall` of the links of about `probes` vectors in all rows holds for all, and is never
    less than a quarter of the way within which no link can be missed; a target of 1 takes that whole way.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    good = F.coalesce(F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.col("v"))).withColumn("label", F.when(good, F.col("label")))
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    shapes = classes.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).collect()
    whole = 2 * (1 - least)
    grids = {}
    for s in shapes:
        some = classes.where(F.col("dim") == s.dim).where(F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(1 << 53)) < min(1.0, sample / s.n)).select("v").limit(2 * sample)
        k = int(np.clip(np.sqrt(s.n / max(1, s.labels) / 64), 1, sample // 5)) if s.dim > 1 else 1
        grids[s.dim] = Grid.fit(_normal([x.v for x in some.collect()]), k, whole)
    if target_recall < 1 and any(len(g.halves[0]) > 1 for g in grids.values()):
        for d, reach in _needed_reach(classes, grids, probes, least, target_recall).items():
            grids[d].reach = max(reach, whole / 4)
    sent = spark.sparkContext.broadcast(grids)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in ((d, p.iloc[k : k + 1024]) for d, p in batch.groupby("dim") for k in range(0, len(p), 1024)):
                grid = sent.value[dim]
                own, bound = grid.bounds(_normal(part.v))
                at, cells, probe = [], [], []
                wide = len(grid.halves[1])
                for r in range(len(part)):
                    mine = own[0][r] * wide + own[1][r]
                    for a, b in grid.traverse(bound[0][r], bound[1][r]):
                        at.append(r)
                        cells.append(a * wide + b)
                        probe.append(cells[-1] != mine)
                out = part.iloc[at].copy()
                out["cell"], out["probe"] = cells, probe
                yield out[["label", "dim", "cell", "probe", "cid", "copies", "v"]]

    kind = classes.schema["label"].dataType.simpleString()
    vector = classes.schema["v"].dataType.simpleString()
    visits = cut(classes.select("label", "dim", "cid", "copies", "v").mapInPandas(visit, f"label {kind}, dim int, cell long, probe boolean, cid long, copies long, v {vector}"))
    sizes = visits.groupBy("label", "dim", "cell").agg(F.count_if(~F.col("probe")).alias("stored"), F.count_if("probe").alias("probes"))
    sizes = sizes.where("stored > 0 and stored + probes > 1")
    # a block's rows are sent once for each other block of its cell: blocks grow with the cell, up to eight times
    sizes = sizes.withColumn("of", F.greatest(F.lit(block), F.least(F.lit(8 * block), F.ceil(F.col("stored") / 64)))).selectExpr("*", "ceil(stored / of) as s", "ceil(probes / of) as p").drop("stored", "probes", "of")
    placed = visits.join(sizes, ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("cid"), F.when(F.col("probe"), F.col("p")).otherwise(F.col("s"))))
    # units of work: (i, j), i <= j: two stored blocks; (-1 - p, j): probe block p against stored block j
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    against = F.when(F.col("p") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda p: F.struct((-1 - p).alias("i"), F.col("mine").alias("j"))))
    asked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda j: F.struct((-1 - F.col("mine")).alias("i"), j.alias("j")))
    units = placed.withColumn("unit", F.explode(F.when(F.col("probe"), asked).otherwise(F.concat(pairs, F.coalesce(against, F.array().cast("array<struct<i:bigint,j:bigint>>"))))))
    units = units.select("label", "dim", "cell", "probe", "cid", "copies", "v", "mine", "unit.i", "unit.j")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        grid: Grid = sent.value[group.dim.iloc[0]]
        i, j, cell = group.i.iloc[0], group.j.iloc[0], group.cell.iloc[0]
        asking = group.probe if i < 0 else group.mine == i
        left, right = group[asking], group[~asking if i < 0 or i != j else asking]
        empty = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        if left.empty or right.empty:
            return empty
        x, y = _normal(left.v), _normal(right.v)
        at, of = [], []
        for k in range(0, len(x), 1024):
            cos = x[k : k + 1024] @ y.T
            for a, b in np.argwhere(np.abs(cos - least) < 1e-9):
                u, v = np.asarray(left.v.iloc[k + a], np.float64), np.asarray(right.v.iloc[b], np.float64)
                cos[a, b] = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v))
            a, b = np.nonzero(cos >= least)
            if i == j:
                a, b = a[a + k != b], b[a + k != b]
            at.append(a + k)
            of.append(b)
        a, b = np.concatenate(at), np.concatenate(of)
        if i < 0 and len(a):
            own = [np.concatenate(o) for o in zip(*(grid.bounds(x[k : k + 1024])[0] for k in range(0, len(x), 1024)))]
            met = np.zeros(len(a), bool)  # the other side visits too
            for k in range(0, len(y), 1024):
                here = np.flatnonzero((b >= k) & (b < k + 1024))
                _, back = grid.bounds(y[k : k + 1024])
                met[here] = back[0][b[here] - k, own[0][a[here]]] + back[1][b[here] - k, own[1][a[here]]] <= grid.reach
            once = (own[0][a] * len(grid.halves[1]) + own[1][a] < cell) | ~met
            a, b = a[once], b[once]
        if not len(a):
            return empty
        lc, rc = left.cid.to_numpy(), right.cid.to_numpy()
        links = [np.bincount(a, right.copies.to_numpy()[b], len(left))]
        ids = [lc]
        if i != j:
            links.append(np.bincount(b, left.copies.to_numpy()[a], len(right)))
            ids.append(rc)
        nodes = np.concatenate(ids)
        root = _roots(len(nodes), a, b + (len(left) if i != j else 0))
        return pd.DataFrame({"cid": nodes, "links": np.concatenate(links).astype("int64"), "root": nodes[root]}).query("links > 0")

    linked = cut(units.groupBy("label", "dim", "cell", "i", "j").applyInPandas(link, "cid long, links long, root long"))
    counts = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    named = cut(named.select("label", "v", "copies", "first", F.coalesce("component", "cid").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "component").select("label", "v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where("v is not null").join(of, ["label", "v"]).select("id", "n_links", "component_id")
    out = out.unionAll(rows.where("v is null").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
