"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Each bit position i of a fingerprint gets a non-zero vector m(i) of r + 1 bits. For each non-zero v of r + 1 bits,
a table keeps the positions with <m(i), v> odd and drops the others. Two fingerprints that differ in at most r
positions set at most r linear conditions <m(i), v> = 0 on v, which some non-zero v meets: in that table they are
equal. So no pair within the radius is lost, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_bytes, components, cut

BITS = 64


def covering_masks(radius: int, positions: list[int] | None = None) -> list[tuple[int, list[int]]]:
    """(mask, positions that it drops) for each of the 2 ** (radius + 1) - 1 tables."""
    positions = list(range(BITS)) if positions is None else positions
    n = (1 << (radius + 1)) - 1
    vector = {p: i % n + 1 for i, p in enumerate(positions)}
    out = []
    for v in range(1, n + 1):
        held = [p for p in positions if (vector[p] & v).bit_count() % 2]
        out.append((sum(1 << p for p in held), [p for p in positions if p not in set(held)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_words(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """The majority of the bits of the shingles' XXH64; no words: 0."""
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 200_000):
        part = words[i : i + 200_000 + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_hashes(hashes: np.ndarray) -> int:
    """The majority of the bits of a set's hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, hashes.size, 200_000):
        ones += np.unpackbits(hashes[i : i + 200_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, tid, fp): the text's XXH64, and the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            out = np.zeros(len(texts), np.uint64)
            for k, t in enumerate(texts):
                t = t.as_py()
                if t:
                    out[k] = fingerprint_words(t.lower().split(), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["id", "tid", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(run, f"id {kind}, tid long, fp long")


def spanning_links(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links connect. Each fingerprint is compared once with those not yet reached."""
    links, left = [], found
    while left.size > 1:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            x = stack.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            hit = left[near]
            if hit.size:
                links += [(int(x), int(y)) for y in hit]
                stack += list(hit)
                left = left[~near]
    return links


def fingerprint_links(distinct: DataFrame, radius: int = 2, hot: int = 2048) -> DataFrame:
    """(a, b): links between different fingerprints (a column `fp`) with the same connected components as all links.

    Buckets of over `hot` fingerprints are dealt again by a second set of covering masks over the positions that
    the first mask dropped. A second bucket leaves only a few free positions (12 at radius 2), and its members are
    different, so its size is bounded by the masks alone and no link is given up.
    """
    tables = covering_masks(radius)
    inner = [covering_masks(radius, dropped) for _, dropped in tables]
    spread = distinct.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, (m, _) in enumerate(tables)))).alias("x"),
    ).select("fp", "x.t", "x.key")
    sizes = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = spread.join(sizes, ["t", "key"])
    masks = F.array(*(F.array(*(F.lit(_signed(m)) for m, _ in each)) for each in inner))
    within = F.when(
        F.col("n") > hot,
        F.transform(F.element_at(masks, F.col("t") + 1), lambda m, i: F.struct(i.alias("t2"), F.col("fp").bitwiseAND(m).alias("key2"))),
    ).otherwise(F.array(F.struct(F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2"))))
    buckets = (
        rows.select("t", "key", "fp", F.explode(within).alias("y"))
        .groupBy("t", "key", "y.t2", "y.key2")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for x in batch.column(0):
                links += spanning_links(x.values.to_numpy(zero_copy_only=False), radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(id, tid, fp, component_id) of each row; of a component, first_id and first_tid are those of the row that stays."""
    prints = cut(fingerprints(docs, id_col, text_col))
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tid")
    classes = prints.groupBy("fp").agg(F.min(row).alias("first"))
    joined = components(fingerprint_links(prints.select("fp").distinct(), radius))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = cut(named)
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    of = named.select("fp", "component").join(smallest, "component").select("fp", "first")
    return prints.join(of, "fp").select("id", "tid", "fp", F.col("first.id").alias("first_id"), F.col("first.tid").alias("first_tid"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links of at most `radius` bits).

    Lower-cases A-Z; words are what ASCII white space separates; shingles are three words.
    Null and empty texts have fingerprint zero and link like others. Repeated rows and ids stay, each with its
    component. A null id is never the smallest; a component of null ids only has a null component_id. Other
    columns are not read. An empty table gives no rows. Equal fingerprints are one class before any search, so
    copies make no pairs.
    """
    found = _grouped(docs, id_col, text_col, radius)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """docs with one row of each group: the one with the smallest id (null ids last; of equal ids, the smallest text hash), all columns."""
    return first_rows(docs, _grouped(docs, id_col, text_col, radius), id_col, text_col)


def first_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that `found` (id, tid, first_id, first_tid) names as the first of their group, all columns."""
    stays = cut(found.where(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tid") == F.col("first_tid"))).groupBy("id", "tid").agg(F.count("*").alias("n")))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(held.alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"))
    if stays.where("n > 1").limit(1).count():  # the same row more than once
        rows = rows.dropDuplicates(["id", "tid"])
    on = rows["id"].eqNullSafe(stays["id"]) & (rows["tid"] == stays["tid"])
    return rows.join(stays, on, "left_semi").select("row.*")
