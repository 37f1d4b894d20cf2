"""Permissions by roles against plain Python, and how many rows their joins make."""

from gneiss.operators import logic


def joined(plan):
    """The most rows that a join of a plan has made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return joined(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return joined(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
    children = plan.children()
    return max([own, *(joined(children.apply(k)) for k in range(children.size()))])


def test_permissions(spark):
    inherits = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", None)]
    granted = [(r, "read", f"{r}{k % 3}") for r in "abcdx" for k in range(200)] + [("d", "read", "c1"), ("d", None, "n"), (None, "read", "none")]
    roles = [(k, "abcdey"[k % 6]) for k in range(300)] * 2 + [(1, "d"), (7, "a"), (7, "y"), (None, "a"), (None, "d"), (8, None)]
    above = {r: {r} for r in "abcdey"}
    for _ in inherits:
        for a, b in inherits:
            above[a] |= above.get(b, set())
    want = {(u, action, resource) for u, r in roles if r for to in above[r] for g, action, resource in granted if g == to}
    df = logic.permissions(spark.createDataFrame(roles, "user long, role string"), spark.createDataFrame(inherits, "role string, inherited string"), spark.createDataFrame(granted, "role string, action string, resource string"))
    rows = [tuple(x) for x in df.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert joined(df._jdf.queryExecution().executedPlan()) <= len(want)
