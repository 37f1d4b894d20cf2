"""Shards by a hierarchical weighted hash tree (law: key).

A row descends from the root through regions and racks to a shard. At each node every child draws -ln(u) / weight
with u hashed from the row's key and the child's path; the smallest draw wins, so a child gets rows in proportion to
its weight, and a changed weight moves rows only into or out of the subtree that it belongs to. A node's weight is
the sum of those below.

Growth. The draws give each shard a score: the draw of its region, plus that of its rack unless the rack won among its
siblings, plus that of the shard unless it won among its own. As exponential draws have no memory, the scores of
all shards are independent exponential draws by weight, and the descent finds the smallest one. A region that isn't
full yet keeps the weights of its full form; the row takes the smallest score of the shards that exist. One more
shard so adds one score and changes none: it takes rows only into itself, whatever the number of shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut, once

#: region -> rack -> {shard: weight}
Tree = list[list[dict[int, float]]]


def default_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Equal weights; full regions of racks * per_rack shards, as many as `shards` need."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    tree: Tree = []
    for first in range(0, shards, racks * per_rack):
        tree.append([{s: 1.0 for s in range(k, k + per_rack)} for k in range(first, first + racks * per_rack, per_rack)])
    return tree


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.ln(u) / weight


def _weight(x) -> float:
    return float(sum(_weight(y) for y in x) if isinstance(x, list) else sum(x.values()))


def _draws(key: Column, path: str, children: dict[int, float]) -> Column:
    return F.array(*(_draw(key, f"{path}/{k}", w) for k, w in children.items()))


def _least(draws: Column) -> Column:
    """The place, from 1, of the smallest draw; of equal ones the first."""
    return F.array_position(draws, F.array_min(draws)).cast("int")


def assign(key: Column, tree: Tree, shards: int | None = None) -> Column:
    """The shard of a key, among those below `shards` (all by default). A null key is a key like others."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    exists = lambda s: shards is None or s < shards

    def won(r: int) -> Column:
        """The winner of a full region."""
        racks = tree[r]
        shard = lambda k: F.element_at(F.array(*(F.lit(s) for s in racks[k])), _least(_draws(key, f"{r}/{k}", racks[k])))
        if len(racks) == 1:
            return shard(0)
        best = _least(_draws(key, f"{r}", {k: _weight(x) for k, x in enumerate(racks)}))
        return once(best, lambda b: reduce(lambda e, k: F.when(b == k + 1, shard(k)).otherwise(e), reversed(range(len(racks) - 1)), shard(len(racks) - 1)))

    def scores(r: int, region: Column) -> Column:
        """(score, shard) of the best shard that exists of a region with others that don't."""
        racks = tree[r]
        of_racks = _draws(key, f"{r}", {k: _weight(x) for k, x in enumerate(racks)})

        def of_rack(k: int, draws: Column) -> Column:
            own = _draws(key, f"{r}/{k}", racks[k])
            lost = lambda d, i: F.when(F.element_at(d, i) == F.array_min(d), 0.0).otherwise(F.element_at(d, i))
            return once(own, lambda d: F.array(*(F.struct(region + lost(draws, k + 1) + lost(d, i + 1), F.lit(s)).cast("struct<score:double,shard:int>") for i, s in enumerate(racks[k]) if exists(s))))

        return once(of_racks, lambda draws: F.array_min(F.concat(*(of_rack(k, draws) for k, x in enumerate(racks) if any(map(exists, x))))))

    full = [r for r, x in enumerate(tree) if all(exists(s) for rack in x for s in rack)]
    part = [r for r, x in enumerate(tree) if r not in full and any(exists(s) for rack in x for s in rack)]
    region = lambda r: _draw(key, f"{r}", _weight(tree[r]))
    kind = "struct<score:double,shard:int,region:int>"
    of_part = lambda r: once(scores(r, region(r)), lambda x: F.struct(x["score"], x["shard"], F.lit(r)).cast(kind))
    best = F.array(*(F.struct(region(r), F.lit(-1), F.lit(r)).cast(kind) for r in full), *map(of_part, part))
    return once(F.array_min(best), lambda b: reduce(lambda e, r: F.when((b["region"] == r) & (b["shard"] < 0), won(r)).otherwise(e), full, b["shard"]))


def _blocks(block: int) -> Column:
    """Numbers of blocks of n copies, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}")))


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", parts: int = 1024, carry: list[str] = (), block: int = 1 << 14) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard, and the columns of `carry`.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is that of an empty one. shard and
    grown_shard (with one more shard) depend on the id and the number of shards only. slot numbers a shard's rows
    from 0 without gaps, in an order by hashes that keeps copies of a row apart: copies are counted, and each copy
    falls into one of `parts` parts of its shard by a hash of the row and its number; parts are numbered on their own,
    and each part begins after the rows of those before it. Copies are numbered, and carried columns come back, in
    blocks of `block` copies, each in a task of its own: no task ever holds a shard, or all copies of a row.
    Null ids share one key; repeated ids share a shard. Columns that aren't carried are not read; carried ones of the
    names of the result's own give way to these. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    held = [c for c in carry if c not in own]
    row = F.struct(F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(held)])
    rows = docs.select(
        row.alias("row"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit("row"), F.col(id_col), F.octet_length(F.col(text_col)), F.col(text_col), *[F.col(f"`{c}`") for c in held]).alias("mark"),
    )
    # light rows: all copies of a row in one
    light = rows.select("row.id", "size", "text_crc32", "mark").groupBy("id", "size", "text_crc32", "mark").agg(F.count("*").alias("n"))
    light = light.select(
        "id", "size", "text_crc32", "mark", "n", assign(F.col("id"), default_tree(shards), shards).alias("shard"), assign(F.col("id"), default_tree(shards + 1), shards + 1).alias("grown_shard"),
        _blocks(block).alias("block"),
    ).repartition("mark", "block")
    copies = F.sequence(F.col("block") * block + 1, F.least("n", (F.col("block") + 1) * block))
    each = light.withColumn("copy", F.explode(copies)).drop("n")
    each = cut(each.withColumn("place", F.xxhash64(F.lit("place"), "mark", "copy")).withColumn("part", F.pmod("place", F.lit(parts)).cast("int")))
    # at most shards * parts rows, whatever the input
    counts = each.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "part", "sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding) as base")
    numbered = each.selectExpr("*", "row_number() over (partition by shard, part order by place, mark, copy) - 1 as at")
    out = numbered.join(F.broadcast(before), ["shard", "part"])
    out = out.select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.coalesce("base", F.lit(0))).cast("long").alias("slot"), "grown_shard", "mark", "block")
    named = [F.col("id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if not held:
        return out.select(*named)
    # the carried columns come back by row, once for each block of its copies
    whole = rows.groupBy(F.col("row.id").alias("of"), F.col("mark").alias("of_mark")).agg(F.first("row").alias("row"), F.count("*").alias("n"))
    whole = whole.select("of", "of_mark", "row", _blocks(block).alias("of_block"))
    back = out.join(whole, (F.col("mark") == F.col("of_mark")) & (F.col("block") == F.col("of_block")) & F.col("id").eqNullSafe(F.col("of")))
    return back.select(*named, *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(held)])
