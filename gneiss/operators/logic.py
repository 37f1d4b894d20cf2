"""Rules that come up again and again, as joins and fixpoints over relations of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.fixpoint import checkpointed, closure, frontiers, written


def reaches(edges: DataFrame, start: str) -> DataFrame:
    """(node) reached from start (src, dst edges), start itself if it is on a cycle."""
    spark = edges.sparkSession
    return frontiers(edges, spark.createDataFrame([(start,)], "node string")).select("node")


def simple_paths(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """(path) of all ways without a repeated node; with `most`, of those with so many edges at most."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").distinct()
    live = spark.createDataFrame([(start, [start])], "at string, path array<string>")
    out = None
    while most is None or most > 0:
        most = most - 1 if most is not None else None
        step = live.join(edges, F.col("at") == F.col("src"))
        hit = step.where(F.col("dst") == end).select(F.array_append("path", F.col("dst")).alias("path"))
        out = hit if out is None else out.unionAll(hit)
        live = checkpointed(step.where(~F.array_contains("path", F.col("dst")) & (F.col("dst") != end)).select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path")))
        if not live.limit(1).count():
            break
    return out if out is not None else live.select("path").limit(0)


def permissions(roles: DataFrame, inherits: DataFrame, granted: DataFrame) -> DataFrame:
    """(user, action, resource): roles (user, role), inherits (role, inherited), granted (role, action, resource)."""
    granted = granted.select("role", "action", "resource").distinct()
    above = closure(inherits.select(F.col("role").alias("src"), F.col("inherited").alias("dst")))
    # what a role has itself or by inheritance, once for all of its users
    inherited = above.select(F.col("src").alias("to"), F.col("dst").alias("role")).join(granted, "role").select(F.col("to").alias("role"), "action", "resource")
    whole = written(granted.unionAll(inherited).distinct())
    # a user of one role has nothing twice
    users = roles.groupBy("user").agg(F.min("role").alias("role"), F.max("role").alias("other"))
    one = users.where("role = other").join(whole, "role").select("user", "action", "resource")
    several = users.where("role < other").select(F.col("user").alias("u"))
    more = roles.join(several, F.col("user").eqNullSafe(F.col("u")), "left_semi").join(whole, "role").select("user", "action", "resource").distinct()
    return one.unionAll(more)


def missing_pairs(calls: DataFrame, required: DataFrame) -> DataFrame:
    """(func, expected): functions that call `first` of a required pair but not its `second`."""
    uses = calls.select(F.col("caller").alias("func"), "callee").distinct()
    due = uses.join(required, F.col("callee") == F.col("first")).select("func", F.col("second").alias("expected")).distinct()
    have = uses.select("func", F.col("callee").alias("expected"))
    return due.join(have, ["func", "expected"], "left_anti")


def propagate_label(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) labelled: the seeds, and all that call a labelled node, directly or not."""
    back = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    return seeds.select("node").unionAll(frontiers(back, seeds).select("node")).distinct()


def taint(flows: DataFrame, sources: DataFrame, sanitizers: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tainted nodes, tainted sinks). A sanitizer gets tainted, but passes nothing on."""
    open_ = flows.join(sanitizers.select(F.col("node").alias("src")), "src", "left_anti")
    tainted = sources.select("node").unionAll(frontiers(open_, sources).select("node")).distinct()
    return tainted, tainted.join(sinks, "node", "left_semi")
