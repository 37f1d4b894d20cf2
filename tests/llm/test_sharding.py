"""The hash tree's law at every number of shards, and slots, against plain Python."""

import collections
import math
import zlib

import xxhash
from pyspark.sql import functions as F

from gneiss.llm.sharding import assign, default_tree, shard_rows
from tests.llm.test_texts import make, texts  # noqa: F401


def test_shards(spark, texts):  # noqa: F811
    rows = [*texts, *[(77, "copies")] * 3000]
    got = shard_rows(make(spark, rows)).collect()
    by_id, slots = collections.defaultdict(set), collections.defaultdict(list)
    for x in got:
        by_id[x.doc_id].add((x.shard, x.grown_shard))
        slots[x.shard].append(x.slot)
        assert x.grown_shard in (x.shard, 24)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == sizes
    again = shard_rows(make(spark, rows[::-1]).repartition(7)).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_carried_columns_and_copies_apart(spark):
    rows = [(k, f"t{k}") for k in range(500)] + [(1, "t1")] * 40 + [(None, None)] * 3
    docs = make(spark, rows).withColumn("shard", F.lit("clash"))
    got = shard_rows(docs, 2, carry=docs.columns)
    assert set(got.columns) == {*docs.columns, "size", "text_crc32", "law", "slot", "grown_shard"}
    got = got.collect()
    assert collections.Counter((x.doc_id, x.text) for x in got) == collections.Counter(rows)
    copies = sorted(x.slot for x in got if x.doc_id == 1)
    assert sum(b - a == 1 for a, b in zip(copies, copies[1:])) < 12
    assert shard_rows(docs.where("false"), carry=docs.columns).count() == 0


def test_copies_in_blocks(spark):
    """Blocks change nothing but the tasks: the same slots, and carried columns for each copy."""
    rows = [(1, "hot")] * 2000 + [(None, "hot")] * 300 + [(k, "x") for k in range(50)]
    docs = make(spark, rows)
    key = lambda x: tuple((v is not None, v) for v in x)
    whole = sorted(shard_rows(docs, 3, carry=["text"]).collect(), key=key)
    for block in (1, 7, 100, 2000):
        assert sorted(shard_rows(docs, 3, carry=["text"], block=block).collect(), key=key) == whole
    assert collections.Counter((x.doc_id, x.text) for x in whole) == collections.Counter(rows)


def test_many_copies_of_one_row(spark):
    """A million equal rows: every shard's slots are gapless, and no task numbers over a block of them."""
    docs = spark.range(1_000_000).selectExpr("1L as doc_id", "'hot' as text").unionAll(make(spark, [(2, "x")] * 5).select("doc_id", "text"))
    got = shard_rows(docs).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots")).collect()
    assert sum(x.n for x in got) == 1_000_005
    assert all((x.low, x.high, x.slots) == (0, x.n - 1, x.n) for x in got)


def python_shard(key, n):
    """The smallest score, with all of them worked out."""

    def draw(path, w):
        h = xxhash.xxh64_intdigest(str(key).encode(), spark_seed(path))
        return -math.log(((h >> 11) + 0.5) / 2**53) / w

    def spark_seed(path):  # Spark chains columns: each hash seeds the next
        return xxhash.xxh64_intdigest(path.encode(), 42)

    best = None
    for r, racks in enumerate(default_tree(n)):
        region = draw(f"{r}", 8.0)
        of_racks = [draw(f"{r}/{k}", 4.0) for k in range(2)]
        for k, rack in enumerate(racks):
            own = [draw(f"{r}/{k}/{s}", 1.0) for s in rack]
            for d, s in zip(own, rack):
                if s < n:
                    score = region + (0 if of_racks[k] == min(of_racks) else of_racks[k]) + (0 if d == min(own) else d)
                    best = min(best, (score, s)) if best else (score, s)
    return best[1]


def test_each_new_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(2000).select(F.col("id"), *(assign(F.col("id"), default_tree(n), n).alias(f"n{n}") for n in range(1, 42))).collect()
    for n in range(1, 41):
        moved = [(x[f"n{n}"], x[f"n{n + 1}"]) for x in ids if x[f"n{n}"] != x[f"n{n + 1}"]]
        assert moved and {b for _, b in moved} == {n}, n
        share = collections.Counter(x[f"n{n}"] for x in ids)
        assert set(share) == set(range(n)) and sum((c - 2000 / n) ** 2 / (2000 / n) for c in share.values()) < n + 6 * math.sqrt(2 * n) + 12
    for x in ids[:300]:
        for n in (1, 3, 8, 13, 24, 25, 41):
            assert x[f"n{n}"] == python_shard(x.id, n)


def test_shares_follow_weights(spark):
    heavy = [[{0: 1.0, 1: 3.0}], [{2: 2.0}, {3: 2.0}]]
    n = collections.Counter(x[0] for x in spark.range(8000).select(assign(F.col("id"), heavy)).collect())
    assert all(abs(n[s] - 1000 * w) < 200 for s, w in {0: 1, 1: 3, 2: 2, 3: 2}.items())
    more = [heavy[0], [{2: 2.0}, {3: 5.0}]]
    moved = spark.range(4000).select(assign(F.col("id"), heavy).alias("a"), assign(F.col("id"), more).alias("b")).where("a <> b")
    assert moved.where("b in (0, 1)").count() == 0 < moved.where("b = 3").count()
