"""Analyses of a fact bundle: who calls whom, reach, paths, impact, dead code, cycles, layers, entry points, diff, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import escape_atom, extract_layer, format_list, quote_if_needed
from gneiss.operators.fixpoint import checkpointed, frontiers, on_cycles
from gneiss.sources.facts import CodeGraph

#: The order of the layers.
LAYERS = {"handlers": 0, "routes": 0, "controllers": 0, "services": 1, "repositories": 2, "db": 3, "models": 3}


def resolve_targets(graph: CodeGraph, target: str) -> DataFrame:
    """(node) that a user's name means: itself if it is a node; else, without a slash, all nodes that end in /name."""
    exact = F.col("name") == target
    nodes = graph.nodes()
    if "/" in target:
        return nodes.where(exact).select(F.col("name").alias("node"))
    found = nodes.where(exact | F.endswith("name", F.lit("/" + target))).select(F.col("name").alias("node"), exact.alias("exact"))
    best = found.agg(F.bool_or("exact").alias("any_exact"))
    return found.join(F.broadcast(best)).where("exact or not any_exact").select("node")  # best is one row


def _with_target(graph: CodeGraph, rows: DataFrame, column: str, target: str) -> DataFrame:
    """The rows whose column holds a node that target means, as resolve_targets has it, by filters alone."""
    exact = F.col(column) == target
    if "/" in target:
        return rows.where(exact)
    names = graph.defines.select("name").unionAll(graph.calls.select("caller")).unionAll(graph.calls.select("callee"))
    best = names.where(F.col("name") == target).agg((F.count("*") > 0).alias("any_exact"))
    found = rows.where(exact | F.endswith(F.col(column), F.lit("/" + target)))
    return found.join(F.broadcast(best)).where(exact | ~F.col("any_exact"))  # best is one row


def _directed(graph: CodeGraph, back: bool = False) -> DataFrame:
    a, b = ("callee", "caller") if back else ("caller", "callee")
    return graph.edges().select(F.col(a).alias("src"), F.col(b).alias("dst"))


def summary(graph: CodeGraph) -> DataFrame:
    """One row: files (of defines), functions (with methods), classes, call rows, imports, exports, hyperedges."""
    d = graph.defines.agg(F.count_distinct("file").alias("files"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    for name, df in (("call_edges", graph.calls), ("imports", graph.imports), ("exports", graph.exports), ("hyperedges", graph.hyperedges)):
        d = d.crossJoin(df.agg(F.count("*").alias(name)))  # one row by one row
    return d


def callers(graph: CodeGraph, target: str) -> DataFrame:
    """(name) of the distinct callers of what target means."""
    return _with_target(graph, graph.calls, "callee", target).select(F.col("caller").alias("name")).distinct()


def callees(graph: CodeGraph, source: str) -> DataFrame:
    return _with_target(graph, graph.calls, "caller", source).select(F.col("callee").alias("name")).distinct()


def reachability(graph: CodeGraph, source: str, target: str) -> DataFrame:
    """One row (reachable). A node reaches itself by an edge to itself only, another node by one edge or more."""
    edges = _directed(graph)
    a, b = checkpointed(resolve_targets(graph, source)), checkpointed(resolve_targets(graph, target))
    both, others = a.join(b, "node", "left_semi"), b.join(a, "node", "left_anti")
    hits = edges.where("src = dst").select(F.col("src").alias("node")).join(both, "node", "left_semi")
    hits = hits.unionAll(frontiers(edges, a, stop_at=others).select("node").join(others, "node", "left_semi"))
    if a.limit(2).count() > 1:  # a name of several nodes may mean source and target at once: does another of them lead here?
        hits = hits.unionAll(_led_to_by_another(edges, a).join(both, "node", "left_semi"))
    return hits.agg((F.count("*") > 0).alias("reachable"))


def _led_to_by_another(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of seeds that another seed leads to. One search: each node keeps the smallest and the largest seed that reach it."""
    edges = checkpointed(edges)
    held = checkpointed(seeds.select("node", F.col("node").alias("low"), F.col("node").alias("high")))
    while True:
        sent = held.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "low", "high")
        merged = held.unionAll(sent).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        held, before = checkpointed(merged), held
        if not held.join(before, ["node", "low", "high"], "left_anti").limit(1).count():
            return held.where("low <> node or high <> node").join(seeds, "node", "left_semi").select("node")


def path(graph: CodeGraph, source: str, target: str) -> list[str]:
    """A shortest chain of nodes from what source means to what target means; of equals, the smallest node before each step."""
    sources = [x.node for x in resolve_targets(graph, source).orderBy("node").collect()]
    targets = checkpointed(resolve_targets(graph, target))
    edges = _directed(graph)
    for s in sources:
        seed = graph.calls.sparkSession.createDataFrame([(s,)], "node string")
        other = targets.where(F.col("node") != s)
        reached = frontiers(edges, seed, stop_at=other)
        best = reached.join(other, "node").orderBy("depth", "node").limit(1).collect()
        if best:
            chain, at, depth = [best[0].node], best[0].parent, best[0].depth
            while depth > 1:
                chain.append(at)
                depth -= 1
                at = reached.where((F.col("node") == at) & (F.col("depth") == depth)).first().parent
            return [s, *reversed(chain)]
        if targets.where(F.col("node") == s).limit(1).count() and edges.where((F.col("src") == s) & (F.col("dst") == s)).limit(1).count():
            return [s, s]
    return []


def path_text(graph: CodeGraph, source: str, target: str) -> str:
    names = path(graph, source, target)
    spark = graph.calls.sparkSession
    return spark.range(1).select(format_list(F.transform(F.array(*map(F.lit, names)).cast("array<string>"), quote_if_needed))).first()[0] if names else ""


def impact(graph: CodeGraph, target: str) -> DataFrame:
    """(name) of all that lead to what target means; targets themselves only if an edge leads from one to itself."""
    targets = checkpointed(resolve_targets(graph, target))
    reached = frontiers(_directed(graph, back=True), targets).select("node")
    loops = _directed(graph).where("src = dst").select(F.col("src").alias("node")).join(targets, "node", "left_semi")
    return reached.join(targets, "node", "left_anti").unionAll(loops).select(F.col("node").alias("name"))


def dead_code(graph: CodeGraph, entry_points: list[str] | None = None) -> DataFrame:
    """(name) of functions that are never called and no entry point: one hop, so a ring that nobody calls isn't dead."""
    spark = graph.calls.sparkSession
    if entry_points:
        # all names at once: a node of the name, else, for names without a slash, all nodes whose last part it is
        asked = spark.createDataFrame([(e,) for e in entry_points], "asked string").distinct()
        nodes = graph.nodes()
        exact = nodes.join(asked, F.col("name") == F.col("asked")).select("asked", "name")
        loose = nodes.join(asked.where("not contains(asked, '/')").join(exact, "asked", "left_anti"), F.regexp_extract("name", "/([^/]*)$", 1) == F.col("asked")).select("name")
        entries = asked.select(F.col("asked").alias("name")).unionAll(loose)
    else:
        entries = graph.exports.select("name")
    functions = graph.defines.where("kind = 'function'").select("name").distinct()
    return functions.join(graph.calls.select(F.col("callee").alias("name")).distinct(), "name", "left_anti").join(entries.distinct(), "name", "left_anti")


def cycles(graph: CodeGraph) -> DataFrame:
    """(name) on a cycle of edges of which neither end is the name of a method."""
    methods = graph.defines.where("kind = 'method'").select("name").distinct()
    edges = _directed(graph)
    edges = edges.join(methods, F.col("src") == F.col("name"), "left_anti").join(methods, F.col("dst") == F.col("name"), "left_anti")
    return on_cycles(edges).select(F.col("node").alias("name"))


def layer_violations(graph: CodeGraph) -> DataFrame:
    """(caller, callee, caller_layer, callee_layer) of each call row that skips a layer downwards; a name's last define counts."""
    layer = graph.defines.groupBy("name").agg(F.max_by("file", F.struct("seq", "file")).alias("file")).select("name", extract_layer(F.col("file"), LAYERS).alias("layer")).where("layer is not null")
    order = F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))
    of = lambda side: layer.select(F.col("name").alias(side), F.col("layer").alias(f"{side}_layer"))
    rows = graph.calls.select("caller", "callee").join(of("caller"), "caller").join(of("callee"), "callee")
    return rows.where(order[F.col("callee_layer")] - order[F.col("caller_layer")] > 1).select("caller", "callee", "caller_layer", "callee_layer")


def entry_points(graph: CodeGraph) -> DataFrame:
    """(name): exports that aren't methods and nobody calls; without such, all exports that aren't methods; without any, functions that nobody calls."""
    methods = graph.defines.where("kind = 'method'").select("name").distinct()
    called = graph.calls.select(F.col("callee").alias("name"), F.lit(True).alias("called")).distinct()
    exports = graph.exports.select("name").distinct().join(methods, "name", "left_anti").join(called, "name", "left")
    functions = graph.defines.where("kind = 'function'").select("name").distinct().join(called, "name", "left")
    ranked = exports.select("name", F.when(F.col("called").isNull(), 0).otherwise(1).alias("rank")).unionAll(functions.where("called is null").select("name", F.lit(2).alias("rank")))
    best = ranked.agg(F.min("rank").alias("best"))
    # if an export wins at rank 0, others of rank 0 stay; at rank 1 all exports are of rank 1
    return ranked.join(F.broadcast(best)).where("rank = best").select("name").distinct().orderBy("name")


def undirected(graph: CodeGraph) -> DataFrame:
    """Distinct (a, b), a < b, without loops."""
    return graph.calls.select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")).where("a <> b").distinct()


def degrees(graph: CodeGraph) -> DataFrame:
    """(name, degree): distinct neighbours in either direction."""
    e = undirected(graph)
    return e.select(F.col("a").alias("name")).unionAll(e.select(F.col("b").alias("name"))).groupBy("name").agg(F.count("*").alias("degree"))


def all_keys(graph: CodeGraph) -> dict[str, DataFrame]:
    """By entity (node, edge, import, export, hyperedge) the keys (key) that tell whether two bundles differ, as often as they occur."""
    sep = F.lit("\t")
    return {
        "node": graph.defines.select(F.col("name").alias("key")).unionAll(graph.calls.select(F.explode(F.array("caller", "callee")).alias("key"))),
        "edge": graph.calls.select(F.concat("caller", sep, "callee").alias("key")),
        "import": graph.imports.select(F.concat("file", sep, "name", sep, "source").alias("key")),
        "export": graph.exports.select(F.concat("file", sep, "name").alias("key")),
        "hyperedge": graph.hyperedges.select(F.concat("id", sep, "relation", sep, F.array_join(F.array_sort("nodes"), ",")).alias("key")),
    }


def diff(before: CodeGraph, after: CodeGraph) -> DataFrame:
    """(change: added or removed, entity: node, edge, import, export or hyperedge, key): the symmetric difference.

    Each entity's keys of both sides are dealt once, with a mark of the side.
    """
    out, a, b = None, all_keys(before), all_keys(after)
    for entity in a:
        both = a[entity].withColumn("sides", F.lit(1)).unionAll(b[entity].withColumn("sides", F.lit(2)))
        rows = both.groupBy("key").agg(F.bit_or("sides").alias("sides")).where("sides < 3")
        rows = rows.select(F.when(F.col("sides") == 2, "added").otherwise("removed").alias("change"), F.lit(entity).alias("entity"), "key")
        out = rows if out is None else out.unionAll(rows)
    return out


def diff_summary(changes: DataFrame) -> str:
    """One line, such as: 1 new node, 2 new edges, 1 edge removed."""
    n = {(x.change, x.entity): x.n for x in changes.groupBy("change", "entity").agg(F.count("*").alias("n")).collect()}
    parts = []
    for entity in ("node", "edge", "import", "export", "hyperedge"):
        for change, text in (("added", "new {}"), ("removed", "{} removed")):
            if k := n.get((change, entity)):
                parts.append(f"{k} " + text.format(entity + "s" * (k != 1)))
    return ", ".join(parts) or "no changes"


#: Rules that go with the facts, in the dialect that operators.datalog evaluates.
RULES = """reaches(A, B) :- calls(A, B).
reaches(A, B) :- calls(A, M), reaches(M, B).
func_calls(A, B) :- calls(A, B), \\+ defines(_, A, method, _), \\+ defines(_, B, method, _).
func_reaches(A, B) :- func_calls(A, B).
func_reaches(A, B) :- func_calls(A, M), func_reaches(M, B).
dead(N) :- defines(_, N, function, _), \\+ calls(_, N), \\+ entry_point(N).
caller_of(T, C) :- calls(C, T).
callee_of(S, C) :- calls(S, C)."""


def fact_lines(graph: CodeGraph, entry_points: list[str] | None = None, insights: dict[str, DataFrame] | None = None) -> DataFrame:
    """(section, seq, line): the bundle as Prolog facts, in the order of sections and rows. Entry points default to the distinct exports.

    insights: DataFrames cohesion(id, cohesion), community(name, id), hub(name, degree), bridge(name, score).
    """
    atom = lambda c: escape_atom(F.col(c))
    fact = lambda name, *args: F.concat(F.lit(name + "("), F.concat_ws(", ", *args), F.lit(")."))
    spark = graph.calls.sparkSession
    declared = "defines/4 calls/2 imports/3 exports/2 contains/2 file/2 hyperedge/2 hyperedge_member/2 entry_point/1".split()
    sections = [
        spark.createDataFrame([(k, f":- dynamic({x}).") for k, x in enumerate(declared)], "seq long, line string"),
        graph.files.select("seq", fact("file", atom("path"), atom("language")).alias("line")),
        graph.defines.select("seq", fact("defines", atom("file"), atom("name"), atom("kind"), F.col("line").cast("string")).alias("line")),
        graph.calls.select("seq", fact("calls", atom("caller"), atom("callee")).alias("line")),
        graph.calls.where("callee_qn is not null").select("seq", fact("calls_qn", atom("caller"), atom("callee"), atom("callee_qn")).alias("line")),
        graph.imports.select("seq", fact("imports", atom("file"), atom("name"), atom("source")).alias("line")),
        graph.imports.where("resolved is not null").select("seq", fact("imports_resolved", atom("file"), atom("name"), atom("resolved")).alias("line")),
        graph.exports.select("seq", fact("exports", atom("file"), atom("name")).alias("line")),
        graph.contains.select("seq", fact("contains", atom("parent"), atom("child")).alias("line")),
        graph.hyperedges.select("seq", fact("hyperedge", atom("id"), atom("relation")).alias("line")),
        graph.hyperedges.where("label <> ''").select("seq", fact("hyperedge_label", atom("id"), atom("label")).alias("line")),
        graph.hyperedges.select("seq", F.col("id"), F.explode("nodes").alias("m")).select("seq", fact("hyperedge_member", atom("id"), atom("m")).alias("line")),
    ]
    if entry_points:
        sections.append(spark.createDataFrame(list(enumerate(entry_points)), "seq long, name string").select("seq", fact("entry_point", atom("name")).alias("line")))
    else:
        sections.append(graph.exports.groupBy("name").agg(F.min("seq").alias("seq")).select("seq", fact("entry_point", atom("name")).alias("line")))
    for name, columns in {"cohesion": ("id", "cohesion"), "community": ("name", "id"), "hub": ("name", "degree"), "bridge": ("name", "score")}.items():
        if insights and name in insights:
            df = insights[name]
            show = lambda c, df=df, name=name: atom(c) if dict(df.dtypes)[c] == "string" else (F.format_string("%.4f", F.col(c)) if name == "bridge" else F.col(c).cast("string"))
            sections.append(df.select(F.lit(0).cast("long").alias("seq"), fact(name, *(show(c) for c in columns)).alias("line")))
    sections.append(spark.createDataFrame(list(enumerate(RULES.split("\n"))), "seq long, line string"))
    out = None
    for k, s in enumerate(sections):
        s = s.select(F.lit(k).alias("section"), "seq", "line")
        out = s if out is None else out.unionAll(s)
    return out


def facts_text(graph: CodeGraph, entry_points: list[str] | None = None, most: int = 10 << 20, insights: dict[str, DataFrame] | None = None) -> str | dict:
    """The facts as one text; beyond `most` characters an error record instead, made before anything is gathered."""
    lines = fact_lines(graph, entry_points, insights)
    size, n = lines.agg(F.sum(F.length("line")), F.count("*")).first()
    size = (size or 0) + max(0, n - 1)
    if size > most:
        return {"error": f"the facts take {size} characters; the limit is {most}", "size": size, "limit": most}
    return "\n".join(x.line for x in lines.orderBy("section", "seq", "line").collect())
