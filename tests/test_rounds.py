"""What doesn't fit a task goes by rounds: bounds of zero and one make small graphs take that way."""

import random
from collections import defaultdict

import pytest

from gneiss.operators import insights
from gneiss.operators.fixpoint import on_cycles
from gneiss.sources.facts import CodeGraph


def drawn(seed: int, nodes: int, edges: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    return [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(edges)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_by_colours(spark, seed):
    pairs = drawn(seed, 30, 38)
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)

    def reached(x):
        seen, todo = set(), [x]
        while todo:
            for y in after[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    want = sorted(x for x in list(after) if x in reached(x))
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert sorted(x.node for x in on_cycles(edges, small=0).collect()) == want
    assert sorted(x.node for x in on_cycles(edges).collect()) == want


def test_no_cycles_by_colours(spark):
    assert on_cycles(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), small=0).count() == 0


def test_betweenness_by_rounds(spark):
    g = CodeGraph.of(spark, calls=drawn(3, 14, 18) + [("x", "y"), ("y", "z")])
    want = {x.name: x.score for x in insights.betweenness(g).collect()}
    got = {x.name: x.score for x in insights.betweenness(g, most_edges=2, most_rows=100).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def modularity(pairs: set[tuple[str, str]], of: dict[str, int]) -> float:
    degree, inner = defaultdict(int), 0
    for a, b in pairs:
        degree[of[a]] += 1
        degree[of[b]] += 1
        inner += of[a] == of[b]
    return inner / len(pairs) - sum(d * d for d in degree.values()) / (2 * len(pairs)) ** 2


def test_communities_by_rounds(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "abcdef" for i in range(5) for j in range(i)]
    ring = [(f"{x}0", f"{y}1") for x, y in zip("abcdef", "bcdefa")]
    g = CodeGraph.of(spark, calls=cliques + ring)
    pairs = {(min(p), max(p)) for p in cliques + ring}
    whole = {x.name: x.id for x in insights.communities(g).collect()}
    rows = insights.communities(g, most_edges=20).collect()
    got = {x.name: x.id for x in rows}
    assert got.keys() == whole.keys() and sorted(set(got.values())) == list(range(len(set(got.values()))))
    assert modularity(pairs, got) > 0.8 * modularity(pairs, whole)


def test_communities_of_a_star_by_rounds(spark):
    """Very many ask one node: it takes them in a few rounds."""
    g = CodeGraph.of(spark, calls=[(f"leaf{k}", "hub") for k in range(40)])
    rows = insights.communities(g, most_edges=12).collect()
    assert len(rows) == 41 and max(x.size for x in rows) > 20
