"""The nearest vectors of every vector against all pairs."""

import numpy as np

from gneiss.operators import neighbours


def plain(ids, m, k):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    return {(i, r + 1): round(x, 9) for i, row in zip(ids, s) for r, x in enumerate(np.sort(row)[::-1][:k]) if np.isfinite(x)}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "VISITS", 8)
    r = np.random.default_rng(4)
    groups = r.normal(size=(30, 8))
    m = np.concatenate([groups[k % 30] + 0.05 * r.normal(size=8) for k in range(900)] + [groups[0]] * 40).reshape(-1, 8)  # tight groups, 40 copies
    ids = [7 * k for k in range(len(m))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)] + [(-1, None), (-2, [0.0] * 8), (-3, [float("nan")] + [1.0] * 7)], "id long, vector array<double>")
    got = neighbours.nearest_to_each(df, 5, pivots=20).collect()
    assert {(x.id, x.rank): round(x.score, 9) for x in got} == plain(ids, m, 5)
    assert len(got) == 5 * len(m) and all(x.id != x.other for x in got)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "id long, vector array<double>")
    assert [(x.id, x.rank, x.other, round(x.score, 6)) for x in neighbours.nearest_to_each(df, 2).orderBy("id", "rank").collect()] == [
        (1, 1, 2, 0.707107), (1, 2, 3, -1.0), (2, 1, 1, 0.707107), (2, 2, 3, -0.707107), (3, 1, 2, -0.707107), (3, 2, 1, -1.0)
    ]
    assert neighbours.nearest_to_each(df.where("false"), 2).collect() == [] == neighbours.nearest_to_each(df, 0).collect()
