"""Driver loops over small jobs: frontiers and closures of edge relations.

Each round joins the frontier with the edges and removes what was seen. Neither side is broadcast by hand: edges
and frontier are of any size, and adaptive execution picks the join. A round's result is cut from its lineage by a
checkpoint or a table in the folder that the session names, so a lost executor costs one round at most.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own, in local mode only, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
    own = os.path.join(tempfile.gettempdir(), "gneiss-checkpoints")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like checkpointed, as a table of files, whose size Spark knows.

    A checkpoint keeps the estimated size of its plan, and a join's is the product of its sides': in loops that join
    their own last result these numbers soon have millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gneiss-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frontiers(edges: DataFrame, seeds: DataFrame, most: int | None = None, stop_at: DataFrame | None = None) -> DataFrame:
    """(node, depth, parent) of all that seeds (a column `node`) reach by at least one edge (src, dst).

    depth: edges of a shortest way; parent: the smallest node before it on one. A seed is in the result only if an
    edge leads back to it. stop_at (a column `node`): the search ends after the round that meets one of its nodes.
    """
    # read once, and dealt by the key of every round's join; a lost part is computed again from its source
    edges = edges.select("src", "dst").repartition("src").persist()
    seen, parts = None, 0
    frontier = checkpointed(seeds.select("node").distinct())
    depth = 0
    while most is None or depth < most:
        depth += 1
        found = frontier.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        found = found.select("node", F.lit(depth).alias("depth"), "parent")
        if seen is not None:
            found = found.join(seen.select("node"), "node", "left_anti")
        found = checkpointed(found)
        if not found.limit(1).count():
            break
        seen, parts = (found, 1) if seen is None else (seen.unionAll(found), parts + 1)
        if parts == 16:  # one table again, so that plans don't grow with the depth
            seen, parts = checkpointed(seen.coalesce(max(1, edges.rdd.getNumPartitions()))), 1
        if stop_at is not None and found.join(stop_at, "node", "left_semi").limit(1).count():
            break
        frontier = found
    edges.unpersist()
    return seen if seen is not None else frontier.select("node", F.lit(0).alias("depth"), F.col("node").alias("parent")).limit(0)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for each dst reached from src by at least one edge: semi-naive, for relations whose closure is wanted whole."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    whole, delta = edges, edges
    while True:
        step = delta.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        delta = checkpointed(step.join(whole, ["src", "dst"], "left_anti"))
        if not delta.limit(1).count():
            return whole
        whole = whole.unionAll(delta)


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left once nodes that nothing leads to, or that lead nowhere, are taken away again and again."""
    core = checkpointed(edges)
    n = core.count()
    while n:
        both = core.select(F.col("src").alias("node")).intersect(core.select(F.col("dst").alias("node")))
        core = checkpointed(core.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        left = core.count()
        if left == n:
            break
        n = left
    return core


def colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that leads to it by any number of edges, itself included."""
    colour = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct().withColumn("colour", F.col("node"))
    colour = written(colour.withColumn("new", F.lit(True)))
    while True:
        sent = colour.where("new").select(F.col("node").alias("src"), "colour").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
        colour = written(colour.join(sent, "node", "left").select("node", F.least("colour", "got").alias("colour"), (F.coalesce("got", "colour") < F.col("colour")).alias("new")))
        if not colour.where("new").limit(1).count():
            return colour.select("node", "colour")


def on_cycles(edges: DataFrame, small: int = 2000) -> DataFrame:
    """(node) of all nodes on a cycle: members of strongly connected components of two and more, and self-loops.

    Only what trimming leaves, the cycles and what lies between them, is looked at. A core of at most `small` nodes
    has a closure of at most small * small rows, which takes the fewest rounds. A larger one is coloured: a colour
    names the smallest node before it, and what leads back to that node within its colour is its strong component;
    found ones are taken out, the rest is trimmed and coloured again. That keeps a row a node. Both give the same.
    """
    core = trimmed(edges.select("src", "dst").distinct())
    nodes = core.select("src").distinct().count()  # after trimming each node leads somewhere
    if nodes <= small:
        return closure(core).where("src = dst").select(F.col("src").alias("node"))
    found = core.select(F.col("src").alias("node")).limit(0)
    while core.limit(1).count():
        colour = colours(core)
        side = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"colour_{c}"))  # noqa: B023, E731
        within = core.join(side("src"), "src").join(side("dst"), "dst").where("colour_src = colour_dst")
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select("node")
        members = written(frontiers(back, roots).select("node"))
        found = found.unionAll(members)
        gone = members.unionAll(roots).distinct()
        core = trimmed(core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of an undirected edge list, named by their smallest node.

    Alternates two star operations until nothing changes: grouped minima, which combine before the shuffle, and
    joins, which Spark can split where a node has very many neighbours. Nodes without another node are absent.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
