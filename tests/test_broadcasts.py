"""Tables that grow are joined by shuffles, also where files are so small that Spark's estimates allow a broadcast."""

import re

from gneiss.operators import neighbours
from gneiss.plans import catalog

SF = "/root/testdata/sf0.001"


def test_suffixes(spark):
    for name in ("j3_suffix_resolve", "j1_imports"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_vectors(spark, monkeypatch):
    """What is broadcast has a row a block or a partition: neither vectors nor radii."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    plans, real = [], neighbours.written
    show = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(neighbours, "written", lambda df: (show(df), real(df))[1])
    show(catalog.QUERIES["b6_nearest_to_each"](spark, SF))
    sent = [x for p in plans for x in re.findall(r"BroadcastExchange.*\n.*\n.*\n", p)]
    assert sent and not any(re.search(r"\bu#|\bv#|radius#", x) for x in sent)
