"""Receiver chains of any length."""

from gneiss.operators import resolve


def test_long_chains_resolve(spark):
    pending = spark.createDataFrame([(1, ["this"] + ["next"] * 11, "C0", None), (2, ["this", "next"], "C0", None)], "k int, receiver_chain array<string>, enclosing_class string, var_types map<string,string>")
    fields = spark.createDataFrame([(f"C{k}", "next", f"C{k + 1}") for k in range(11)], "class_name string, field string, type string")
    assert {(x.k, x.type) for x in resolve.resolve_chains(pending, fields).collect()} == {(1, "C11"), (2, "C1")}
