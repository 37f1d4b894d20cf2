"""No caps: long paths, many alias lengths, wide ranges of integers, several nodes of one name."""

from gneiss.engine import Engine
from gneiss.operators import graph, logic, resolve
from gneiss.sources.facts import CodeGraph


def test_long_simple_path(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(10)] + [("n03", "n01"), ("n10", "n00")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    got = [x.path for x in logic.simple_paths(edges, "n00", "n10").collect()]
    assert got == [[f"n{k:02}" for k in range(11)]]
    assert logic.simple_paths(edges, "n00", "n10", 9).count() == 0


def test_many_alias_lengths(spark):
    aliases = spark.createDataFrame([("a" * k, f"t{k}/") for k in range(1, 1101)], "prefix string, target string")
    asked = spark.createDataFrame([("a" * 1050 + "x",), ("b",)], "source string")
    assert [tuple(x) for x in resolve.rewrite_alias(asked, aliases).collect()] == [("a" * 1050 + "x", "t1050/x")]


def test_wide_integers_are_decided(spark):
    text = "(declare-const n Int)(assert (and (>= n 0) (<= n 300000)))(assert (= (mod n 7) 3))(assert (> (* n n) {}))(check-sat)"
    e = Engine(spark)
    assert e.verify("z3", text.format(89_997_000_000))["status"] == "sat"
    assert e.verify("z3", text.format(90_000_000_000))["status"] == "unsat"


def test_one_name_of_several_nodes(spark):
    calls = [("a/f", "m"), ("m", "b/f"), ("c/g", "c/g"), ("d/h", "x"), ("e/h", "y")]
    g = CodeGraph.of(spark, calls=calls)
    assert [graph.reachability(g, n, n).first()[0] for n in ("f", "g", "h")] == [True, True, False]
    defines = [("x.ts", n, "function", 1) for n in ("a/f", "b/f", "k", "q/k", "z")]
    got = graph.dead_code(CodeGraph.of(spark, defines=defines), ["f", "k"]).collect()
    assert sorted(x.name for x in got) == ["q/k", "z"]


def test_deep_chains(spark):
    """Twenty calls in a row: more rounds than seen nodes are kept in parts."""
    g = CodeGraph.of(spark, calls=[(f"f{k}", f"f{k + 1}") for k in range(20)])
    assert graph.impact(g, "f20").count() == 20
    assert graph.reachability(g, "f0", "f20").first()[0] and not graph.reachability(g, "f1", "f0").first()[0]
