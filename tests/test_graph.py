"""Graph analyses on small graphs, on random graphs against plain Python, and on the shapes that are deep or wide."""

import random
from collections import defaultdict

import pytest

from gneiss.operators import codemap, graph, insights
from gneiss.operators.fixpoint import components, on_cycles
from gneiss.sources.facts import CodeGraph


def of(spark, calls, **more):
    return CodeGraph.of(spark, calls=calls, **more)


def names(df, column="name"):
    return sorted(x[column] for x in df.collect())


def test_one_hop(spark):
    g = of(spark, [("a", "b"), ("c", "b"), ("a", "c"), ("x/f", "y/g"), ("z/f", "y/g")])
    assert names(graph.callers(g, "b")) == ["a", "c"]
    assert names(graph.callees(g, "a")) == ["b", "c"]
    assert names(graph.callers(g, "g")) == ["x/f", "z/f"]
    assert names(graph.callees(g, "f")) == ["y/g"]
    assert names(graph.callees(g, "q/f")) == []


def reach(spark, calls, a, b):
    return graph.reachability(of(spark, calls), a, b).first().reachable


def test_reachability(spark):
    assert reach(spark, [("a", "b"), ("b", "c")], "a", "c")
    assert not reach(spark, [("a", "b"), ("c", "d")], "a", "d")
    ring = [("a", "b"), ("b", "a"), ("s", "s")]
    assert not reach(spark, ring, "a", "a")
    assert reach(spark, ring, "s", "s")
    assert reach(spark, [("x/f", "m"), ("m", "y/f")], "f", "f")


def test_path(spark):
    g = of(spark, [("a", "b"), ("b", "c"), ("a", "z"), ("z", "d"), ("c", "d"), ("s", "s"), ("camelCase", "b")])
    assert graph.path(g, "a", "d") == ["a", "z", "d"]
    assert graph.path(g, "s", "s") == ["s", "s"]
    assert graph.path(g, "d", "a") == []
    assert graph.path_text(g, "camelCase", "c") == "[camelCase,b,c]"


def test_impact_and_dead(spark):
    g = of(spark, [("main", "used"), ("used", "deep"), ("r", "r")], defines=[("f", "main", "function", 1), ("f", "unused", "function", 2), ("f", "used", "function", 3), ("f", "r", "function", 4), ("f", "m", "method", 5)], exports=[("f", "main")])
    assert names(graph.impact(g, "deep")) == ["main", "used"]
    assert names(graph.impact(g, "r")) == ["r"]
    assert names(graph.dead_code(g)) == ["unused"]
    assert names(graph.dead_code(g, ["unused"])) == ["main"]
    assert names(graph.entry_points(g)) == ["main"]


def test_cycles(spark):
    assert names(graph.cycles(of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s")]))) == ["a", "b", "c", "s"]
    phantom = of(spark, [("loop", "solve"), ("solve", "loop")], defines=[("f", "solve", "method", 1), ("g", "solve", "method", 2)])
    assert names(graph.cycles(phantom)) == []


def test_layers(spark):
    d = [("src/handlers/h.ts", "h", "function", 1), ("src/db/d.ts", "d", "function", 1), ("src/services/s.ts", "s", "function", 1), ("old/db/h.ts", "moved", "function", 1), ("src/handlers/x.ts", "moved", "function", 2)]
    rows = graph.layer_violations(of(spark, [("h", "d"), ("h", "d"), ("h", "s"), ("d", "h"), ("moved", "d")], defines=d))
    assert sorted((x.caller, x.callee) for x in rows.collect()) == [("h", "d"), ("h", "d"), ("moved", "d")]


def test_diff(spark):
    changes = graph.diff(of(spark, [("a", "b")], exports=[("f", "a")]), of(spark, [("a", "c"), ("a", "b")]))
    assert {(x.change, x.entity, x.key) for x in changes.collect()} == {("added", "node", "c"), ("added", "edge", "a\tc"), ("removed", "export", "f\ta")}
    assert graph.diff_summary(changes) == "1 new node, 1 new edge, 1 export removed"


def test_summary_and_facts(spark):
    g = of(spark, [("a b", "c"), ("a b", "c")], defines=[("f.ts", "a b", "function", 3), ("f.ts", "K", "class", 4)], exports=[("f.ts", "c")], hyperedges=[("h", "l", ["a", "B"], "r")], files=[("f.ts", "typescript")])
    assert graph.summary(g).first().asDict() == {"files": 1, "functions": 1, "classes": 1, "call_edges": 2, "imports": 0, "exports": 1, "hyperedges": 1}
    text = graph.facts_text(g)
    for line in ("defines('f.ts', 'a b', function, 3).", "calls('a b', c).", "entry_point(c).", "hyperedge_member(h, 'B').", "hyperedge_label(h, l)."):
        assert line in text.split("\n")
    assert graph.facts_text(g, most=10)["limit"] == 10
    from gneiss.operators.datalog import solve

    assert solve(spark, text, "caller_of(c, X)")["answers"][0]["bindings"] == {"X": "a b"}
    assert [x["bindings"]["N"] for x in solve(spark, text, "dead(N)")["answers"]] == ["a b"]


def test_hubs_and_bridges(spark):
    star = of(spark, [("a", "center"), ("b", "center"), ("c", "center"), ("center", "d"), ("center", "e")])
    assert [tuple(x) for x in insights.hubs(star).collect()][0] == ("center", 5)
    ties = of(spark, [(x, y) for x in "xy" for y in ("zebra", "apple", "mango")])
    assert [x.name for x in insights.hubs(ties, 5).collect()] == ["x", "y", "apple", "mango", "zebra"]
    two = of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "bridge"), ("bridge", "d")])
    assert "bridge" in [x.name for x in insights.bridges(two).collect()]
    line = {x.name: x.score for x in insights.betweenness(of(spark, [("a", "b"), ("b", "c")])).collect()}
    assert line["b"] == pytest.approx(1.0) and line["a"] == 0


def test_communities(spark):
    two = of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")], defines=[("f", "alone", "function", 1)])
    rows = insights.communities(two).collect()
    by = defaultdict(set)
    for x in rows:
        by[x.id].add(x.name)
    assert sorted(map(sorted, by.values())) == [["a", "b", "c"], ["alone"], ["d", "e", "f"]]
    assert [sorted(by[k])[0] for k in sorted(by)] == ["a", "d", "alone"]
    assert {x.cohesion for x in rows if x.name != "alone"} == {1.0}
    s = insights.surprises(two).collect()
    assert [(x.source, x.target, x.reasons) for x in s] == [("c", "d", ["cross-community"])]
    again = insights.communities(two).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_leaf_and_hub(spark):
    g = of(spark, [("hub", x) for x in "abcde"] + [("leaf", "hub")])
    rows = {(x.source, x.target): x.reasons for x in insights.surprises(g).collect()}
    assert "peripheral-to-hub" in rows["leaf", "hub"]


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{k}" for k in range(25)]
    calls = [(r.choice(nodes), r.choice(nodes)) for _ in range(40)]
    out = defaultdict(set)
    for a, b in calls:
        out[a].add(b)

    def reached(starts):
        seen, todo = set(), list(starts)
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    g = of(spark, calls)
    ends = {x for e in calls for x in e}
    assert set(names(graph.cycles(g))) == {x for x in ends if x in reached([x])}
    target = calls[0][1]
    want = {x for x in ends if x != target and target in reached([x])} | ({target} if target in out[target] else set())
    assert set(names(graph.impact(g, target))) == want
    group = {x: x for x in ends}
    for _ in ends:
        for a, b in calls:
            group[a] = group[b] = min(group[a], group[b])
    edges = spark.createDataFrame(calls, "a string, b string")
    linked = {x.node: x.component for x in components(edges).collect()}
    assert all(linked.get(x, x) == group[x] for x in ends)
    neighbours = {x: sorted((out[x] | {y for y in ends if x in out[y]}) - {x}) for x in ends}
    exact = insights.betweenness_from(neighbours, sorted(ends))
    n = len(ends)
    got = {x.name: x.score for x in insights.betweenness(g).collect()}
    assert all(got.get(x, 0) == pytest.approx(exact[x] / ((n - 1) * (n - 2))) for x in ends if neighbours[x])


def test_wide(spark):
    rings = [(f"g{k}n{i}", f"g{k}n{(i + 1) % 15}") for k in range(20) for i in range(15)] + [(f"leaf{k}", f"g{k}n0") for k in range(20)]
    assert graph.cycles(of(spark, rings)).count() == 300
    star = of(spark, [("fn0", f"fn{k}") for k in range(1, 900)], defines=[("f", f"fn{k}", "function", k) for k in range(1000)], exports=[("f", "fn0")])
    assert graph.dead_code(star).count() == 100
    assert on_cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_code_map(spark):
    g = of(spark, [("a", "b")], defines=[("s/x.ts", "b", "variable", 1), ("s/x.ts", "a", "function", 9), ("s/x.ts", "K", "class", 20), ("t/y.ts", "q", "function", 1)], exports=[("s/x.ts", "a"), ("s/x.ts", "K"), ("s/x.ts", "b")], files=[("s/x.ts", "typescript", " A  file. ", 1500, 30), ("t/y.ts", "typescript", None, 10, 2)])
    rows = {x.path: x for x in codemap.overview(g, max_exports=2).collect()}
    assert [x.name for x in rows["s/x.ts"].top_exports] == ["K", "a"] and rows["s/x.ts"].export_count == 3 and rows["t/y.ts"].export_count == 0
    assert codemap.overview(g, ["s/*"]).count() == 1
    assert "- **s/x.ts** (typescript, 1.5K tokens) — A file.: `K`, `a`, `b`" in codemap.render(codemap.overview(g))
    assert codemap.file_detail(g, "s/x.ts")["exports"] == ["K", "a", "b"] and codemap.file_detail(g, "no") is None
    assert {(x.relation, x.name) for x in codemap.symbol_detail(g, "b").collect()} == {("define", "s/x.ts"), ("caller", "a")}
    assert {x.folder: x.files for x in codemap.directory_tree(codemap.overview(g)).collect()} == {"s": 1, "t": 1}
