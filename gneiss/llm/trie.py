"""The trie of all conversations' prefixes, by prefix doubling.

Equal turns get equal dense names. Blocks of 2, 4, 8 ... turns, those that begin at a multiple of their length, are
named in turn by the names of their halves. A prefix of d turns is put together from the blocks of d's binary
digits, the largest first: in the round of 2 ** j each prefix whose length is a multiple of 2 ** (j + 1) is made
longer by the next block of 2 ** j. So both ways take a logarithm of the longest conversation in rounds of joins
over numbers, and texts are met once, when turns are named.

A node is a prefix name. What a subtree adds up needs no walk through the tree: a node's subtree is all that its
members' own paths visit from its depth on. So each conversation sums up its path from the end, counting a node
where the conversation is the node's smallest member, and nodes then add up their members' sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.audit import SPACE
from gneiss.llm.common import stored
from gneiss.llm.ranks import named, sorted_groups

#: Turns of a conversation that are summed up together, and bytes of ids that are hashed together.
STRETCH = 1024
PIECE = 1 << 18


def words_of(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, turn_name, words): turns numbered from 1 by turn (null first), then role and text; names are dense.

    Null roles and texts are empty. Rows with a null conv_id are of no conversation and left out. Repeated rows are
    turns of their own. Columns other than conv_id, turn, role and text are not read.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = sorted_groups(rows, ["conv"], ["turn", "role", "text"]).select("conv", (F.col("number") - F.col("start") + 1).alias("at"), "role", "text")
    return named(placed, ["role", "text"], "turn_name").select("conv", "at", "turn_name", words_of(F.col("text")).alias("words"))


def blocks(turns: DataFrame) -> list[DataFrame]:
    """(conv, q, block) for lengths 1, 2, 4 ...: the name of turns q * length + 1 to (q + 1) * length."""
    out = [stored(turns.select("conv", (F.col("at") - 1).alias("q"), F.col("turn_name").alias("block")))]
    while True:
        left = out[-1].where("q % 2 = 0").select("conv", F.col("q"), F.col("block").alias("x"))
        right = out[-1].where("q % 2 = 1").select("conv", (F.col("q") - 1).alias("q"), F.col("block").alias("y"))
        pairs = stored(left.join(right, ["conv", "q"]).select("conv", F.expr("q div 2").alias("q"), "x", "y"))
        if not pairs.limit(1).count():
            return out
        out.append(stored(named(pairs, ["x", "y"], "block").select("conv", "q", "block")))


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv, d, name): a row for each prefix of each conversation, the empty one included. Names are dense by d and round."""
    levels = blocks(turns)
    whole = ids.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))
    for j in reversed(range(len(levels))):
        step = levels[j].select("conv", (F.col("q") * (1 << j)).alias("d"), "block")
        longer = stored(whole.join(step, ["conv", "d"]).select("conv", (F.col("d") + (1 << j)).alias("d"), F.col("name").alias("x"), F.col("block").alias("y")))
        whole = whole.unionAll(stored(named(longer, ["d", "x", "y"]).select("conv", "d", "name")))
    return stored(whole)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (d, name, conv): (d, name, first, ids) with joined ids, some thousands a row."""
    node, first, ids, size = None, 0, [], 0
    for batch in batches:
        out = []
        for d, name, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, name) != node or size > PIECE:
                if ids:
                    out.append((*node, first, ",".join(ids)))
                node, first, ids, size = (d, name), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield _batch(out, ["d", "name", "first", "ids"])
    if ids:
        yield _batch([(*node, first, ",".join(ids))], ["d", "name", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by (d, name, first): (d, name, ends_sha256)."""
    node, sha = None, None
    for batch in batches:
        out = []
        for d, name, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, name) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (d, name), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield _batch(out, ["d", "name", "ends_sha256"])
    if node:
        yield _batch([(*node, sha.hexdigest())], ["d", "name", "ends_sha256"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) from (d, name, conv): the hash of a node's ids in order, joined by commas.

    The ids of a node of any size are sorted and joined in many tasks; a hash is sequential, so one task then reads
    the joined pieces of a node one by one.
    """
    pieces = ends.select("d", "name", "conv").repartitionByRange("d", "name", "conv").sortWithinPartitions("d", "name", "conv")
    pieces = pieces.mapInArrow(_pieces, "d long, name long, first long, ids string")
    return pieces.repartition("d", "name").sortWithinPartitions("d", "name", "first").mapInArrow(_digests, "d long, name long, ends_sha256 string")


def sums_to_the_end(rows: DataFrame, of: list[str]) -> DataFrame:
    """rows of (conv, d) with of's columns summed over the same conversation's rows with at least that d.

    In stretches: no conversation has to be one task's work.
    """
    rows = rows.withColumn("stretch", F.expr(f"d div {STRETCH}"))
    after = rows.groupBy("conv", "stretch").agg(*(F.sum(c).alias(c) for c in of))
    later = "over (partition by conv order by stretch desc rows between unbounded preceding and 1 preceding)"
    after = after.selectExpr("conv", "stretch", *(f"coalesce(sum({c}) {later}, 0) as {c}_after" for c in of))
    here = "over (partition by conv, stretch order by d desc rows between unbounded preceding and current row)"
    rest = [c for c in rows.columns if c not in of]
    within = rows.selectExpr(*rest, *(f"sum({c}) {here} as {c}" for c in of))
    return within.join(after, ["conv", "stretch"]).select(*[c for c in rest if c != "stretch"], *((F.col(c) + F.col(f"{c}_after")).alias(c) for c in of))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv, at, turn_name, words), where at counts a conversation's turns from 1.

    ids: (conv) of all conversations, those without turns included. conv_id (smallest member), depth, parent_conv_id
    (of the root: null), n_convs, n_children, n_leaves, saved_tokens (words that members don't have to be read again,
    in the node's subtree), ends_sha256, and turn_name of the node's last turn (of the root: null). An empty table of
    ids gives no nodes.
    """
    ids = stored(ids.select("conv").distinct())
    paths = prefixes(turns, ids)
    last = turns.select("conv", F.col("at").alias("d"), "turn_name", "words")
    nodes = stored(paths.groupBy("d", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")))
    # a node's parent and last turn are looked up on its smallest member's path
    above = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("above"))
    nodes = stored(nodes.join(above, ["conv", "d"], "left").join(last, ["conv", "d"], "left"))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["d", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = nodes.select("conv", "d", F.lit(True).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    steps = paths.join(last.drop("turn_name"), ["conv", "d"], "left").join(own, ["conv", "d"], "left")
    again = F.when(F.col("own"), 0).otherwise(F.coalesce("words", F.lit(0))).cast("long")
    sums = sums_to_the_end(steps.select("conv", "d", "name", again.alias("saved_tokens"), F.coalesce("leaf", F.lit(0)).alias("n_leaves")), ["saved_tokens", "n_leaves"])
    sums = sums.groupBy("d", "name").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = paths.groupBy("conv").agg(F.max(F.struct("d", "name")).alias("end")).select("end.d", "end.name", "conv")
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("name").alias("above"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, ["d", "name"]).join(end_digests(ends), ["d", "name"], "left").join(parents, ["d", "above"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "turn_name",
    )


def rebuilt(turns: DataFrame, period: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations that begin with the first turns of another: h of conversation c - c % period.

    h is the CRC-32 of c's decimal digits modulo `most`. A conversation's own first h turns give way; fewer than h
    are taken from one that is shorter, none from one that isn't there.
    """
    turns = stored(turns)
    h = F.crc32(F.col("conv").cast("string")) % most
    ids = stored(turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % period).alias("base"), h.alias("h")))
    taken = ids.join(ids.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = taken.select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    first = turns.where(F.col("at") < most).withColumnRenamed("conv", "base")
    first = taken.join(first, "base").where("at <= taken").select("conv", "at", "turn_name", "words")
    rest = turns.where(F.col("at") > h).join(taken.drop("base"), "conv").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "turn_name", "words")
    return stored(first.unionAll(rest)), ids.select("conv")
