"""Versions that go together, against all choices in plain Python."""

import itertools
import random

import pytest

from gneiss.operators import finite

PAIR = "package string, version int, other string, other_version int"


def support(candidates, pairs):
    """Drops versions one by one until each that is left has support for each tie."""
    both = {(p, v, q, w) for p, v, q, w in pairs} | {(q, w, p, v) for p, v, q, w in pairs}
    ties = {(p, q) for p, _, q, _ in both}
    left = set(candidates)
    while True:
        bad = next(((p, v) for p, v in left for a, q in ties if a == p and not any((p, v, q, w) in both for x, w in left if x == q)), None)
        if bad is None:
            return left
        left.remove(bad)


def whole(candidates, pairs, packages):
    both = {(p, v, q, w) for p, v, q, w in pairs} | {(q, w, p, v) for p, v, q, w in pairs}
    ties = [(p, q) for p, q in itertools.combinations(packages, 2) if any((a, b) == (p, q) for a, _, b, _ in both)]
    of = [[v for p, v in sorted(candidates) if p == name] for name in packages]
    found = (dict(zip(packages, vs)) for vs in itertools.product(*of))
    return sorted(tuple(c.values()) for c in found if all((p, c[p], q, c[q]) in both for p, q in ties))


@pytest.mark.parametrize("seed, ties", [(1, ["ab", "bc", "bd"]), (2, ["ab", "ac", "ad"]), (3, ["ab", "bc", "ca", "cd"]), (4, ["ba", "cb", "dc", "ad"])])
def test_random_ties(spark, seed, ties):
    r = random.Random(seed)
    candidates = sorted({(p, v) for p in "abcd" for v in range(6)} - {("b", 3)})
    pairs = [(p, v, q, w) for p, q in ties for v in range(6) for w in range(6) if r.random() < 0.22]
    rows, given = spark.createDataFrame([*candidates, *candidates[:3], (None, 1), ("a", None)], "package string, version int"), spark.createDataFrame([*pairs, *pairs[:5], (None, 1, "a", 2), ("a", 1, "b", None)], PAIR)
    left = support(candidates, pairs)
    assert {tuple(x) for x in finite.supported(rows, given).collect()} == left
    got = finite.choices(rows, given, list("abcd"))
    assert got.columns == list("abcd")
    assert sorted(tuple(x) for x in got.collect()) == whole(candidates, pairs, "abcd")


def test_a_long_cascade(spark):
    """Twenty packages in a row: the last one's only version has no candidate, so that all leave, one a round."""
    candidates = spark.createDataFrame([(f"k{k:02}", 0) for k in range(20)] + [("free", 7)], "package string, version int")
    pairs = spark.createDataFrame([(f"k{k:02}", 0, f"k{k + 1:02}", 0) for k in range(19)] + [("k19", 0, "k20", 0)], PAIR)
    assert [tuple(x) for x in finite.supported(candidates, pairs).collect()] == [("free", 7)]


def test_nothing_and_no_ties(spark):
    candidates, pairs = spark.createDataFrame([("a", 1), ("b", 1)], "package string, version int"), spark.createDataFrame([], PAIR)
    assert finite.supported(candidates.where("false"), pairs).count() == 0
    assert finite.supported(candidates, pairs).count() == 2
    with pytest.raises(ValueError):
        finite.choices(candidates, pairs, ["a", "b"])
