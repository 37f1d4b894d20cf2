"""Structure of the undirected call graph: hubs, bridges, communities, surprising edges."""

from __future__ import annotations

import random
from collections import defaultdict, deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import cohesion
from gneiss.operators.fixpoint import checkpointed, components, written
from gneiss.operators.graph import degrees, undirected
from gneiss.sources.facts import CodeGraph


def hubs(graph: CodeGraph, top: int = 10) -> DataFrame:
    """(name, degree) of the nodes with most neighbours."""
    return degrees(graph).orderBy(F.desc("degree"), "name").limit(top)


def betweenness_from(neighbours: dict[str, list[str]], sources: list[str]) -> dict[str, float]:
    """For each node, the share of shortest ways from the sources that pass through it, summed over their ends."""
    total: dict[str, float] = defaultdict(float)
    for s in sources:
        order, ways, depth, before = [], {s: 1.0}, {s: 0}, defaultdict(list)
        todo = deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for y in neighbours[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    ways[y] = 0.0
                    todo.append(y)
                if depth[y] == depth[x] + 1:
                    ways[y] += ways[x]
                    before[y].append(x)
        part: dict[str, float] = defaultdict(float)
        for y in reversed(order):
            for x in before[y]:
                part[x] += ways[x] / ways[y] * (1 + part[y])
            if y != s:
                total[y] += part[y]
    return total


def _by_rounds(edges: DataFrame, most_rows: int) -> DataFrame:
    """(name, sum): like betweenness_from, from all nodes of the edges (a, b), as rounds over rows (source, node).

    Outward a level a round, with the number of shortest ways; then the shares back. A level's neighbours lie in it,
    in the one before or in the next, so nothing older is looked at. Sources go in blocks of about most_rows rows.
    """
    near = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select("b", "a")))
    nodes = near.select(F.col("x").alias("s")).distinct()
    n = nodes.count()
    blocks = max(1, -(-n * n // most_rows))
    sums = []
    for block in range(blocks):
        mine = nodes.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == block)
        levels = [written(mine.select("s", F.col("s").alias("x"), F.lit(1.0).alias("ways")))]
        while True:
            ahead = levels[-1].join(near, "x").groupBy("s", F.col("y").alias("x")).agg(F.sum("ways").alias("ways"))
            for known in levels[-2:]:
                ahead = ahead.join(known.select("s", "x"), ["s", "x"], "left_anti")
            ahead = written(ahead)
            if not ahead.limit(1).count():
                break
            levels.append(ahead)
        shares = levels[-1].withColumn("share", F.lit(0.0))
        for before in reversed(levels[:-1]):
            sums.append(shares.groupBy(F.col("x").alias("name")).agg(F.sum("share").alias("sum")))
            sent = shares.select("s", "x", ((1 + F.col("share")) / F.col("ways")).alias("c")).join(near, "x").groupBy("s", F.col("y").alias("x")).agg(F.sum("c").alias("c"))
            shares = written(before.join(sent, ["s", "x"], "left").select("s", "x", "ways", (F.col("ways") * F.coalesce("c", F.lit(0.0))).alias("share")))
        sums = [written(reduce(DataFrame.unionAll, sums).groupBy("name").agg(F.sum("sum").alias("sum")))]
    return sums[0]


def betweenness(graph: CodeGraph, buckets: int = 32, most_edges: int = 1_000_000, most_rows: int = 1_000_000_000) -> DataFrame:
    """(name, score): normalised betweenness of all nodes with neighbours, exactly.

    The edges of a component with at most `most_edges` go to `buckets` tasks, each of which searches from its share of
    the sources. Larger components don't have to fit a task: they go by rounds over all pairs of source and node.
    """
    edges = undirected(graph)
    named = checkpointed(edges.join(components(edges), F.col("a") == F.col("node")).select("a", "b", "component"))
    large = checkpointed(named.groupBy("component").agg(F.count("*").alias("edges")).where(F.col("edges") > most_edges).select("component"))
    some = large.limit(1).count() > 0
    small = named.join(large, "component", "left_anti") if some else named
    spread = small.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        neighbours: dict[str, list[str]] = defaultdict(list)
        for a, b in zip(group.a, group.b):
            neighbours[a].append(b)
            neighbours[b].append(a)
        mine = sorted(neighbours)[group.bucket.iloc[0] :: buckets]
        found = betweenness_from(neighbours, mine)
        return pd.DataFrame({"name": list(found), "score": list(found.values())}).astype({"name": object, "score": float})

    parts = spread.groupBy("component", "bucket").applyInPandas(search, "name string, score double").groupBy("name").agg(F.sum("score").alias("sum"))
    if some:
        parts = parts.unionAll(_by_rounds(named.join(large, "component", "left_semi"), most_rows))
    n = graph.nodes().agg(F.count("*").alias("n"))
    return parts.crossJoin(F.broadcast(n)).select("name", F.when(F.col("n") > 2, F.col("sum") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(F.col("sum")).alias("score"))  # n is one row


def bridges(graph: CodeGraph, top: int = 3) -> DataFrame:
    return betweenness(graph).where("score > 0").orderBy(F.desc("score"), "name").limit(top)


def louvain(edges: list[tuple[str, str, float]], seed: int) -> dict[str, int]:
    """Communities of a weighted graph by local moves and merging, in a seeded order of nodes. Edges may be loops."""
    r = random.Random(seed)
    links: dict[object, dict[object, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    member: dict[object, list[str]] = {x: [x] for x in links}
    while True:
        weight = sum(sum(v.values()) for v in links.values())
        if not weight:
            break
        of = {x: k for k, x in enumerate(sorted(links, key=str))}
        degree = {x: sum(links[x].values()) for x in links}
        inside = {of[x]: degree[x] for x in links}
        moved_any, moved = False, True
        while moved:
            moved = False
            nodes = sorted(links, key=str)
            r.shuffle(nodes)
            for x in nodes:
                near: dict[int, float] = defaultdict(float)
                for y, w in links[x].items():
                    if y != x:
                        near[of[y]] += w
                inside[of[x]] -= degree[x]
                gain = lambda c: near.get(c, 0.0) - degree[x] * inside[c] / weight  # noqa: B023, E731
                best = max(sorted(near), key=lambda c: (gain(c), -c), default=of[x])
                if best != of[x] and gain(best) > gain(of[x]) + 1e-12:
                    of[x] = best
                    moved = moved_any = True
                inside[of[x]] += degree[x]
        if not moved_any:
            break
        merged: dict[object, dict[object, float]] = defaultdict(lambda: defaultdict(float))
        groups: dict[object, list[str]] = defaultdict(list)
        for x, ys in links.items():
            groups[of[x]] += member[x]
            for y, w in ys.items():
                merged[of[x]][of[y]] += w
        links, member = merged, groups
    return {name: k for k, (_, names) in enumerate(sorted(member.items(), key=lambda kv: min(kv[1]))) for name in names}


def _merges(links: DataFrame, salt: int) -> DataFrame | None:
    """(x, y): nodes x to be merged into y, each such step a gain in modularity; None if no link has a gain.

    links: (group, a, b, w), loops included. Each node asks for its best neighbour; by coins, half of the nodes stay
    where they are and take others. A node that very many ask takes them in parts of a half, a quarter and so on,
    as long as the last of a part would still gain after all before it; where no part would, it takes its best.
    """
    ends = links.select("group", F.col("a").alias("x"), F.col("b").alias("y"), "w").unionAll(links.select("group", "b", "a", "w"))
    degree = ends.groupBy("group", "x").agg(F.sum("w").alias("k"))
    total = degree.groupBy("group").agg(F.sum("k").alias("total"))
    rows = ends.where("x <> y").join(degree.select("x", F.col("k").alias("kx")), "x").join(degree.select(F.col("x").alias("y"), F.col("k").alias("ky")), "y").join(total, "group")
    rows = rows.withColumn("gain", F.col("w") - F.col("kx") * F.col("ky") / F.col("total")).where("gain > 1e-9")
    best = written(rows.groupBy("x").agg(F.min_by(F.struct("y", "w", "kx", "ky", "total", "gain"), F.struct(-F.col("gain"), "y")).alias("r")).select("x", "r.*"))
    if not best.limit(1).count():
        return None
    coin = lambda c: F.pmod(F.xxhash64(F.lit(salt), F.col(c)), F.lit(2))
    part = F.floor(8 - F.log2(256 - F.pmod(F.xxhash64(F.lit(~salt), F.col("x")), F.lit(256))))  # 0 for half of them, 1 for a quarter
    asked = best.where((coin("x") == 1) & (coin("y") == 0)).withColumn("part", part)
    before = asked.groupBy("y", "part").agg(F.sum("kx").alias("k")).selectExpr("y", "part", "sum(k) over (partition by y order by part) as taken")  # at most nine rows a y
    asked = asked.join(before, ["y", "part"]).withColumn("fits", F.col("w") > F.col("kx") * (F.col("ky") + F.col("taken")) / F.col("total"))
    of_y = asked.groupBy("y").agg(F.max("fits").alias("any"), F.min_by("x", F.struct(-F.col("gain"), "x")).alias("first"))
    return asked.join(of_y, "y").where("fits or (not any and x = first)").select("x", "y")


def _partition(links: DataFrame, seed: int, most_edges: int) -> DataFrame:
    """(name, community): of each group of links (group, a, b, w) on its own; a community goes by one of its nodes.

    A group of at most `most_edges` links is one task of Louvain. Larger ones are merged by rounds until they are as
    small, or until no merge gains, when what is merged is a community.
    """
    links = written(links)
    first, member, salt = links, None, seed
    counted = lambda: links.groupBy("group").agg(F.count("*").alias("edges")).where(F.col("edges") > most_edges).select("group")
    while (large := counted()).limit(1).count():
        merges = _merges(links.join(large, "group", "left_semi"), salt)
        if merges is None:
            break
        merges = written(merges)
        salt += 1
        into = lambda c: merges.select(F.col("x").alias(c), F.col("y").alias(f"into_{c}"))  # noqa: B023, E731
        moved = links.join(into("a"), "a", "left").join(into("b"), "b", "left").select("group", F.coalesce("into_a", "a").alias("a"), F.coalesce("into_b", "b").alias("b"), "w")
        links = written(moved.select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("group", "a", "b").agg(F.sum("w").alias("w")))
        if member is None:
            member = first.select(F.col("a").alias("name")).unionAll(first.select("b")).distinct().withColumn("node", F.col("name"))
        member = written(member.join(merges.withColumnRenamed("x", "node"), "node", "left").select("name", F.coalesce("y", "node").alias("node")))

    def detect(group: pd.DataFrame) -> pd.DataFrame:
        found = louvain(sorted(zip(group.a, group.b, group.w)), seed)
        least: dict[int, str] = {}
        for name, c in found.items():
            least[c] = min(name, least.get(c, name))
        return pd.DataFrame({"node": list(found), "community": [least[c] for c in found.values()]})

    small = links if member is None else links.join(large, "group", "left_anti")
    found = small.groupBy("group").applyInPandas(detect, "node string, community string")
    if member is None:
        return found.withColumnRenamed("node", "name")
    return member.join(found, "node", "left").select("name", F.coalesce("community", "node").alias("community"))


def communities(graph: CodeGraph, seed: int = 42, most_edges: int = 1_000_000) -> DataFrame:
    """(id, name, size, cohesion): each node's community. Isolated nodes are alone; communities of over max(10, a quarter of the nodes) are split once.

    A connected component of at most `most_edges` edges is one task; larger ones are merged by rounds first. Ids
    follow size, then the first name.
    """
    nodes, edges = graph.nodes(), undirected(graph)
    n = nodes.count()
    largest = max(10, n // 4)
    named = edges.join(components(edges), F.col("a") == F.col("node"))
    one = F.lit(1.0).alias("w")
    whole = checkpointed(_partition(named.select(F.col("component").alias("group"), "a", "b", one), seed, most_edges))
    over = whole.groupBy(F.col("community").alias("group")).agg(F.count("*").alias("k")).where(F.col("k") > largest).select("group")  # four at most
    end = lambda c: whole.join(over.withColumnRenamed("group", "community"), "community", "left_semi").select(F.col("name").alias(c), F.col("community").alias(f"in_{c}"))
    within = edges.join(end("a"), "a").join(end("b"), "b").where("in_a = in_b").select(F.col("in_a").alias("group"), "a", "b", one)
    parts = _partition(within, seed + 1, most_edges).withColumnRenamed("community", "part")
    label = whole.join(parts, "name", "left").select("name", F.struct("community", F.coalesce("part", F.lit("")).alias("part")).alias("label"))
    alone = nodes.join(whole.select("name"), "name", "left_anti").select("name", F.struct(F.col("name").alias("community"), F.lit("").alias("part")).alias("label"))
    label = checkpointed(label.unionAll(alone))
    sizes = label.groupBy("label").agg(F.count("*").alias("size"), F.min("name").alias("first"))
    side = lambda c: label.select(F.col("name").alias(c), F.col("label").alias(f"label_{c}"))
    inner = edges.join(side("a"), "a").join(side("b"), "b").where("label_a = label_b").groupBy(F.col("label_a").alias("label")).agg(F.count("*").alias("inner"))
    ranked = sizes.join(inner, "label", "left").select("label", "size", "first", F.coalesce("inner", F.lit(0)).alias("inner"))
    # numbers without one task for all communities: ranges of the sort order, then a running count of whole ranges
    ranked = ranked.orderBy(F.desc("size"), "first").withColumn("at", F.monotonically_increasing_id()).select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    ranked = checkpointed(ranked)
    base = ranked.groupBy("range").agg(F.count("*").alias("k")).selectExpr("range", "coalesce(sum(k) over (order by range rows between unbounded preceding and 1 preceding), 0) as base")
    ids = ranked.join(base, "range").select("label", (F.col("base") + F.col("place")).alias("id"), "size", cohesion(F.col("size"), F.col("inner")).alias("cohesion"))
    return label.join(ids, "label").select("id", "name", "size", "cohesion")


def surprises(graph: CodeGraph, top: int = 10, of: DataFrame | None = None) -> DataFrame:
    """(source, target, score, reasons): edges between communities, and between a leaf and a hub; oriented as first called."""
    of = communities(graph) if of is None else of
    first = graph.calls.select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b"), "caller", "callee", "seq").where("a <> b")
    first = first.groupBy("a", "b").agg(F.min_by(F.struct("caller", "callee"), F.struct("seq", "caller", "callee")).alias("e"))
    d = degrees(graph)
    at = lambda c: of.select(F.col("name").alias(c), F.col("id").alias(f"id_{c}")).join(d.select(F.col("name").alias(c), F.col("degree").alias(f"degree_{c}")), c)
    rows = first.join(at("a"), "a").join(at("b"), "b")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("id_a") != F.col("id_b"), "cross-community"),
            F.when((F.least("degree_a", "degree_b") <= 2) & (F.greatest("degree_a", "degree_b") >= 5), "peripheral-to-hub"),
        )
    )
    out = rows.select(F.col("e.caller").alias("source"), F.col("e.callee").alias("target"), F.size(reasons).alias("score"), reasons.alias("reasons")).where("score > 0")
    return out.orderBy(F.desc("score"), "source", "target").limit(top)
