"""Near-duplicates by the Jaccard similarity of word shingles: SimHash, then MinHash bands propose, the sets themselves decide.

First, SimHash fingerprints of the sets are linked within RADIUS bits by covering masks (simhash.py), which miss no such
pair; links whose sets are similar join groups. A pair whose similarity is 0.8 differs in about ten bits, though, and
covering masks for that radius are thousands of tables. So what SimHash hasn't joined is proposed by bands: a pair whose similarity is s shares a band of ROWS minima with probability s ** ROWS, and at least one of BANDS bands
but for (1 - s ** ROWS) ** BANDS: 3 in a million at 0.8, less above. What is proposed is compared exactly.

In a large bucket all first compare with a hub, which settles groups of near copies. Of what is left, those
outside the bucket's main group are compared with all members, in blocks: a task multiplies two blocks' incidence
matrices, so that no pair is ever a row, and gives back the links that join groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import components, cut
from gneiss.llm.simhash import fingerprint_hashes, fingerprint_links, first_rows

#: Bits in which SimHash fingerprints differ at most where they propose.
RADIUS = 3
BANDS, ROWS = 32, 5
_RANDOM = np.random.default_rng(42)
_FACTORS, _TERMS = (_RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)
_WEIGHTS = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
#: Buckets of more than SMALL sets first compare with HUBS members only; an often compared set is dealt over SALTS keys.
SMALL, HUBS, SALTS = 8, 1, 64
#: A block's members and bytes at most (a larger set is a block of its own), and columns of a matrix at once.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 4096


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted XXH64 of the different shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, hashes.size, 2048):
        least = np.minimum(least, (hashes[i : i + 2048] * _FACTORS + _TERMS).min(axis=1))
    return (least.reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(a.size + b.size - both, 1)


def _classes(rows: DataFrame, width: int) -> DataFrame:
    """(id, tid, node, fp, keys) of rows (id, tid, text): the set's hash, its SimHash fingerprint, and its band keys; null for a set without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), []
            for k, t in enumerate(batch.column(2).cast(pa.binary())):
                s = shingle_set(t.as_py() or b"", width)
                nodes[k] = xxhash.xxh64_intdigest(s.tobytes())
                prints[k] = fingerprint_hashes(s)
                keys.append(band_keys(s) if s.size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "tid", "node", "fp", "keys"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, tid long, node long, fp long, keys array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column(1).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b, hot) that are similar enough. A hot b is dealt over SALTS keys."""
    salt = F.when(F.col("hot"), F.pmod("a", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ends = pairs.groupBy("b").agg(F.max("hot").alias("hot"))
    ends = ends.join(sets.withColumnRenamed("node", "b"), "b")
    ends = ends.select("b", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.col("hashes").alias("y"))
    both = pairs.withColumn("salt", salt).join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(ends, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k)] for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([jaccard(s, t) >= least for s, t in zip(x, y)], pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)): how many elements each two sets share."""
    ids, of = np.concatenate(x + y), np.repeat(np.arange(len(x) + len(y)), [v.size for v in x + y])
    _, column, count = np.unique(ids, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]  # elements of one set only are in no common part
    keep = column >= 0
    column, of = column[keep], of[keep]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, int(column[-1]) + 1 if column.size else 0, COLUMNS):
        mine = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        part = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        part[of[mine], column[mine] - at] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out


def _joining(least: float):
    """From a unit's rows (asks, i, j, block, node, comp, hashes): links (a, b) of similar sets, one of which asks, that join all groups that such links join."""

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        left, right = unit[unit.block == unit.i], unit[unit.block == unit.j]
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        asking = left.asks.to_numpy()[:, None] | right.asks.to_numpy()
        if not asking.any():
            return none
        x, y = ([np.frombuffer(h, np.uint64) for h in side.hashes] for side in (left, right))
        both = common(x, y)
        sizes = np.array([v.size for v in x])[:, None] + np.array([v.size for v in y])
        similar = asking & (both >= least * np.maximum(sizes - both, 1) - 1e-3)
        similar &= left.comp.to_numpy()[:, None] != right.comp.to_numpy()
        group: dict[int, int] = {}

        def root(c: int) -> int:
            while group.get(c, c) != c:
                c = group[c]
            return c

        out = []
        for i, j in np.argwhere(similar):
            p, q = root(left.comp.iloc[i]), root(right.comp.iloc[j])
            if p != q and jaccard(x[i], y[j]) >= least:
                group[max(p, q)] = min(p, q)
                out.append((left.node.iloc[i], right.node.iloc[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none

    return run


def _block_links(live: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links within buckets of any size, from rows (key, node, comp, main): members outside of main against all. Each pair of blocks is a unit."""
    sized = sets.select("node", F.octet_length("hashes").alias("bytes"))
    rows = cut(live.select("key", "node", "comp", (F.col("comp") != F.col("main")).alias("asks")).join(sized, "node"))
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("s"), F.bool_or("asks").alias("any")).where("any").drop("any")
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.greatest(F.lit(1), "s")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), "s") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    units = rows.select("key", F.explode(pair).alias("u"), "asks", "block", "node", "comp").select("key", "u.i", "u.j", "asks", "block", "node", "comp").join(sets, "node")
    return units.groupBy("key", "i", "j").applyInPandas(_joining(least), "a long, b long")


def simhash_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, hot): pairs of nodes, of rows (node, fp), that connect what all pairs of at most `radius` different bits connect. A hot b is in many."""
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head")))
    near = fingerprint_links(heads.select("fp"), radius).distinct()
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("b_node")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("a_node")), "b")
    same = prints.join(heads, "fp").where("node <> head")
    pairs = cut(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).unionAll(same.select(F.col("node").alias("a"), F.col("head").alias("b"))))
    return pairs.join(pairs.groupBy("b").agg((F.count("*") > SALTS).alias("hot")), "b").select("a", "b", "hot")


def similar_links(buckets: DataFrame, sets: DataFrame, least: float, known: DataFrame | None = None) -> DataFrame | None:
    """Links (a, b) with the same connected components as known links and all similar pairs within a bucket (rows of key, node).

    What known links connect isn't compared. In HUBS rounds (one), buckets of over SMALL nodes compare only a hub with the others; a hub leaves the bucket after that.
    The last round compares, in blocks, what is not connected yet.
    """
    rows, links = buckets.withColumn("comp", F.col("node")), known
    if known is not None:
        rows = buckets.join(components(known), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    for k in range(HUBS + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.min_by("comp", "node").alias("hub_comp"), F.mode("comp").alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        live = cut(rows.join(sizes.where("c0 <> c1").drop("c0", "c1"), "key"))
        if not live.limit(1).count():
            break
        small, large = live.where(F.col("n") <= SMALL), live.where(F.col("n") > SMALL)
        y = small.select("key", F.col("node").alias("a"), F.col("comp").alias("a_comp"))
        x = small.where("comp <> main").select("key", "main", F.col("node").alias("b"), F.col("comp").alias("b_comp"), F.lit(False).alias("hot"))
        pairs = x.join(y, "key").where("a_comp <> b_comp and (a_comp = main or a > b)").select("a", "b", "hot")
        if k < HUBS:
            pairs = pairs.unionAll(large.where("comp <> hub_comp").select(F.col("node").alias("a"), F.col("hub").alias("b"), F.lit(True).alias("hot")))
        good = _verified(cut(pairs.groupBy("a", "b").agg(F.max("hot").alias("hot"))), sets, least)
        if k == HUBS:
            good = good.unionAll(_block_links(large, sets, least))
        good = cut(good)
        links = good if links is None else links.unionAll(good)
        if k == HUBS or not large.limit(1).count():
            break
        joined = components(links).select("node", F.col("component").alias("comp"))
        rows = large.where("node <> hub").select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    return links


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """docs with one row of each group of texts linked by a similarity of at least `least`: the one with the smallest id, all columns.

    Lower-cases A-Z; words are what ASCII white space separates. Texts with the same shingles are one class before any
    search, so copies make no pairs; null texts and those without words are one class. Null ids come last; of equal ids
    the smallest text hash stays. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    prints = cut(_classes(rows, width))
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tid")
    classes = cut(prints.groupBy("node").agg(F.min(row).alias("first"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    proposed = cut(simhash_pairs(classes.where("keys is not null").select("node", "fp")))
    spread = classes.select("node", F.explode("keys").alias("key"))
    # bands that hold the same nodes are one bucket: its nodes' number and two sums of their hashes tell
    of_key = spread.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    kept = of_key.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    buckets = cut(spread.join(kept, "key"))
    wanted = buckets.select("node").unionAll(proposed.select("a")).unionAll(proposed.select("b")).distinct().join(classes, "node").select("node", F.col("first.id").alias("of"), F.col("first.tid").alias("of_tid"))
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("tid") == F.col("of_tid"))).select("node", "text")
    sets = cut(_sets(texts, width).dropDuplicates(["node"]))
    links = similar_links(buckets, sets, least, cut(_verified(proposed, sets, least)))
    named = cut(classes.join(components(links), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    of = named.select("node", "component").join(smallest, "component").select("node", "first")
    found = prints.join(of, "node").select("id", "tid", F.col("first.id").alias("first_id"), F.col("first.tid").alias("first_tid"))
    return first_rows(docs, found, id_col, text_col)
