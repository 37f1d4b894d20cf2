"""Diagrams (flowchart, stateDiagram) as relations and as rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.scalars import escape_atom, normalize_id

#: A line's tokens, by kind: e(dge label), s(hape with a node's label), a(rrow), n(ame), x: anything else.
TOKENS = {"e": r"\|[^|]*\|", "s": r"[\[({]+[^\])}]*[\])}]+", "a": r"[-=][-=.]+[>ox]?", "n": r"[A-Za-z0-9_]+", "x": r"\S"}
#: The kinds that make an edge.
EDGE = "^ns?ae?ns?$"
PLACE = r"^(?:\[\*\]|[A-Za-z0-9_]+)$"
FLOW_RULES = "reaches(A, B) :- edge(A, B).\nreaches(A, B) :- edge(A, M), reaches(M, B)."
STATE_RULES = "can_reach(A, B) :- transition(A, B, _).\ncan_reach(A, B) :- transition(A, M, _), can_reach(M, B)."


def parse(diagrams: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, node, label; edges: id, kind, place, source, target, label) of many diagrams at once.

    kind is state for a diagram with a stateDiagram header, else flow. A node's label is the first one given.
    A transition without an event has the label auto.
    """
    state = F.regexp_like(F.col(text_col), F.lit(r"(?im)^\s*stateDiagram"))
    lines = diagrams.select(F.col(id_col).alias("id"), F.when(state, "state").otherwise("flow").alias("kind"), F.posexplode(F.split(text_col, "\n")).alias("place", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    lines = lines.where("line <> '' and line <> 'end'").where(~F.col("line").startswith("%%") & ~F.col("line").rlike(r"(?i)^(?:graph|flowchart|stateDiagram|subgraph)\b") & ~F.col("line").rlike(r"(?i)^stateDiagram"))
    none = F.lit(None).cast("string")
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    # flow: a line is an edge if its tokens, read by kind, have the form of one
    kind_of = lambda t: reduce(lambda e, k: F.when(t.rlike(f"^(?:{TOKENS[k]})$"), k).otherwise(e), reversed(list(TOKENS)), F.lit("x"))
    words = F.regexp_extract_all(F.regexp_replace("line", r"\s*;\s*$", ""), F.lit("|".join(TOKENS.values())), F.lit(0))
    flow = lines.where("kind = 'flow'").withColumn("tokens", F.transform(words, lambda t: F.struct(kind_of(t).alias("kind"), t.alias("t"))))
    flow = flow.where(F.array_join(F.transform("tokens", lambda x: x["kind"]), "").rlike(EDGE)).withColumn("arrow", F.array_position(F.transform("tokens", lambda x: x["kind"]), "a").cast("int"))
    of = lambda side, kind: F.get(F.filter(side, lambda x: x["kind"] == kind), F.lit(0))["t"]
    inside = lambda t: given(F.regexp_replace(F.regexp_replace(t, r"^[\[({]+", ""), r"[\])}]+$", ""))
    left, right = F.slice("tokens", F.lit(1), F.col("arrow") - 1), F.slice("tokens", F.col("arrow") + 1, F.size("tokens"))
    flow = flow.select("id", "kind", "place", of(left, "n").alias("a"), inside(of(left, "s")).alias("la"), of(right, "n").alias("b"), inside(of(right, "s")).alias("lb"), given(F.trim(of(right, "e"), F.lit("|"))).alias("label"))
    # state: what stands before the first arrow, between it and the first colon, and behind that
    after = F.expr("substr(line, instr(line, '-->') + 3)")
    states = lines.where("kind = 'state' and instr(line, '-->') > 0").select("id", "kind", "place", F.trim(F.substring_index("line", "-->", 1)).alias("a"), F.trim(F.substring_index(after, ":", 1)).alias("b"), F.when(after.contains(":"), F.substr(after, F.instr(after, ":") + 1)).alias("event"))
    states = states.where(F.col("a").rlike(PLACE) & F.col("b").rlike(PLACE)).select("id", "kind", "place", "a", none.alias("la"), "b", none.alias("lb"), F.coalesce(given(F.col("event")), F.lit("auto")).alias("label"))
    both = flow.unionAll(states)
    edges = both.select("id", "kind", "place", normalize_id(F.col("a")).alias("source"), normalize_id(F.col("b")).alias("target"), "label")
    ends = F.explode(F.array(F.struct((F.col("place") * 2).alias("at"), F.col("a").alias("raw"), F.col("la").alias("label")), F.struct((F.col("place") * 2 + 1).alias("at"), F.col("b").alias("raw"), F.col("lb").alias("label")))).alias("x")
    nodes = both.select("id", "kind", ends).select("id", "kind", normalize_id(F.col("x.raw")).alias("node"), "x.at", "x.label")
    nodes = nodes.groupBy("id", "kind", "node").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("at"))).alias("label"), F.min("at").alias("at"))
    return nodes, edges


def program(diagrams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, program): facts and rules of each diagram."""
    nodes, edges = parse(diagrams, id_col, text_col)
    atom = lambda c: escape_atom(F.col(c))
    fact = lambda name, *args: F.concat(F.lit(name + "("), F.concat_ws(", ", *args), F.lit(")."))
    node_line = F.when(F.col("kind") == "state", fact("state", atom("node"))).otherwise(fact("node", atom("node"), F.coalesce(atom("label"), atom("node"))))
    edge_line = F.when(F.col("kind") == "state", fact("transition", atom("source"), atom("target"), atom("label"))).otherwise(fact("edge", atom("source"), atom("target")))
    rows = nodes.select("id", "kind", F.lit(1).alias("section"), "at", node_line.alias("line"))
    rows = rows.unionAll(edges.select("id", "kind", F.lit(2), F.col("place"), edge_line))
    rows = rows.unionAll(edges.where("kind = 'flow' and label is not null").select("id", "kind", F.lit(3), F.col("place"), fact("edge_label", atom("source"), atom("target"), atom("label"))))
    made = rows.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("section", "at", "line"))).alias("x"))
    rules = F.when(F.col("kind") == "state", STATE_RULES).otherwise(FLOW_RULES)
    return made.select(F.col("id").alias(id_col), F.concat_ws("\n", F.transform("x", lambda x: x["line"]), rules).alias("program"))
