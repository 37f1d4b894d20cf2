"""More operators over the driver's tables: growing indexes, suffixes, receivers, diagrams, facts size, template use."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import graph, resolve
from gneiss.operators.lint import lint_column
from gneiss.operators.retrieval import BM25Index
from gneiss.operators.templates import Library
from gneiss.plans.graph_queries import HIER, LINES
from gneiss.plans.table_queries import _SOURCES_SQL, TOKENS, _sources
from gneiss.sources import mermaid
from gneiss.sources.bindings import hierarchy, table

SEARCHED = "which users may do what through roles and policies"


def b2_bm25_incremental(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark")
    index = BM25Index.build(d.where("item_id % 2 = 0"), "item_id", "text").add(d.where("item_id % 2 = 1"), "item_id", "text")
    index = index.remove(d.where("item_id % 3 = 0").select(F.col("item_id").alias("doc")))
    return index.idf.select("term", "df", F.round("idf", 9).alias("idf"))


def b4_template_search(spark, sf_dir):
    return Library.create(spark).search(SEARCHED, domain="authorization").select("name", F.round("score", 6).alias("score"))


def j3_suffix_resolve(spark, sf_dir):
    files, imports = _sources(spark, sf_dir)
    return resolve.suffix_resolve(imports.select("source"), resolve.suffix_index(files)).select("path").distinct()


def j7_receiver_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit("this"), F.concat(F.lit("f"), F.col("o_custkey") % 4)).alias("receiver_chain"), F.concat(F.lit("C"), F.col("o_custkey") % 25).alias("enclosing_class"), F.create_map().cast("map<string,string>").alias("var_types"))
    fields = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("C"), F.col("s_nationkey")).alias("class_name"), F.concat(F.lit("f"), F.col("s_suppkey") % 4).alias("field")).agg(F.min("s_name").alias("type"))
    return resolve.resolve_chains(o, fields).select("o_orderkey", "type")


def j8_qualified_callees(spark, sf_dir):
    """Calls of methods m<k> by orders; a method that one class alone contains belongs to it."""
    p = table(spark, sf_dir, "part")
    contains = p.select(F.col("p_brand").alias("parent"), F.concat(F.lit("m"), F.col("p_partkey") % 700).alias("child"), F.col("p_partkey").alias("seq")).distinct()
    calls = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("caller"), F.concat(F.lit("m"), F.col("l_partkey") % 700).alias("callee"), F.lit(None).cast("string").alias("callee_qn"), F.col("l_orderkey").alias("seq"))
    pending = calls.select("caller", "callee", "seq", F.array(F.lit("x")).alias("receiver_chain"), F.lit(None).cast("string").alias("enclosing_class"), F.create_map().cast("map<string,string>").alias("var_types"))
    fields = spark.createDataFrame([], "class_name string, field string, type string")
    methods = spark.createDataFrame([], "class_name string, method string, v string, owner string")
    return resolve.qualify_callees(calls, pending, fields, methods, contains).where("callee_qn is not null").select("caller", "callee_qn")


def s15_mermaid_edges(spark, sf_dir):
    """A state diagram for each user, from the user's events in their order."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "lead(event_type) over (partition by user_id order by ts, event_id) as next", "event_id").where("next is not null")
    lines = e.select("user_id", F.struct("event_id", F.concat(F.lit("  "), F.initcap("event_type"), F.lit(" --> "), F.initcap("next"), F.lit(" : e"), F.col("event_id") % 7).alias("line")).alias("x"))
    texts = lines.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("user_id", F.concat(F.lit("stateDiagram-v2\n"), F.concat_ws("\n", F.transform("x", lambda x: x["line"]))).alias("text"))
    _, edges = mermaid.parse(texts, "user_id", "text")
    return edges.groupBy(F.col("id").alias("user_id"), "source", "target", "label").agg(F.count("*").alias("n"))


def k8_facts_size(spark, sf_dir):
    lines = graph.fact_lines(hierarchy(spark, sf_dir))
    return lines.agg(F.sum(F.length("line") + 1).alias("size"), F.count("*").alias("n"))


def f14_lint(spark, sf_dir):
    """Whole texts as specifications of both solvers: strings and comments hide parentheses, fences and commands go."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit("prolog"), F.lit("z3"))).alias("solver"))
    spec = F.concat(F.lit("```"), F.col("solver"), F.lit("\n(check-sat) p("), F.col("text"), F.when(F.col("doc_id") % 3 == 0, ")").when(F.col("doc_id") % 3 == 1, "\n) % '( ;\" ("))
    x = lint_column(F.coalesce(spec, F.concat(F.lit("```\n("), "text")), F.col("solver"))
    return d.select("doc_id", "solver", x.alias("x")).select("doc_id", "solver", F.size("x.fixes").alias("fixes"), F.size(F.filter("x.errors", lambda e: e.contains("closed"))).alias("unclosed"))


def _library(spark, sf_dir):
    names = [x[0] for x in Library.create(spark).templates.select("name").orderBy("name").collect()]
    uses = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 14 + 1).cast("int")).alias("name"), (F.col("value") > 40).alias("success"), F.col("ts").alias("at"))
    return Library.create(spark, uses=uses)


def w2_template_uses(spark, sf_dir):
    return _library(spark, sf_dir).metadata().select("name", "reuse_count", "success_count")


def w4_promotable(spark, sf_dir):
    return _library(spark, sf_dir).promotable(3, 0.45).select("name")


QUERIES = {k: v for k, v in globals().items() if len(k) > 2 and k[0] in "bjskfw" and k[1].isdigit()}
_NAMES = "['association-rule-check','boundary-condition','collective-classification','config-equivalence','constraint-satisfaction','graph-reachability','invariant-check','permission-derivation','policy-contradiction','policy-reachability','rule-inference','schema-consistency','state-machine-deadlock','taint-propagation']"
_USES = f"SELECT ({_NAMES})[user_id % 14 + 1] AS name, count(*) AS reuse_count, count(*) FILTER (value > 40) AS success_count FROM events GROUP BY ALL"
ORACLE_SQL = {
    "b2_bm25_incremental": f"""WITH d AS (SELECT * FROM benchmark WHERE item_id % 3 <> 0), t AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM d), n AS (SELECT count(*) AS n FROM d)
        SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf FROM t, n GROUP BY term, n""",
    "j3_suffix_resolve": f"WITH {_SOURCES_SQL} SELECT path FROM files WHERE k > (SELECT min(k) FROM files)",
    "j7_receiver_types": """WITH f AS (SELECT s_nationkey AS c, s_suppkey % 4 AS f, min(s_name) AS type FROM supplier GROUP BY ALL)
        SELECT o_orderkey, type FROM orders LEFT JOIN f ON c = o_custkey % 25 AND f = o_custkey % 4""",
    "j8_qualified_callees": """WITH own AS (SELECT p_partkey % 700 AS m, min(p_brand) AS b FROM part GROUP BY m HAVING count(DISTINCT p_brand) = 1)
        SELECT 'o' || l_orderkey AS caller, b || '.m' || m AS callee_qn FROM lineitem JOIN own ON m = l_partkey % 700""",
    "s15_mermaid_edges": """SELECT user_id, event_type AS source, next AS target, 'e' || (event_id % 7) AS label, count(*) AS n
        FROM (SELECT user_id, event_type, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL GROUP BY ALL""",
    "k8_facts_size": f"WITH {HIER}, {LINES} SELECT sum(length(line) + 1)::BIGINT AS size, count(*) AS n FROM lines",
    "f14_lint": r"""WITH specs AS (SELECT doc_id, solver, CASE doc_id % 3 WHEN 0 THEN '(check-sat) p(' || text || ')' WHEN 1 THEN '(check-sat) p(' || text || chr(10) || ') % ''( ;" (' ELSE '(' || text END AS spec
          FROM documents, (VALUES ('prolog'), ('z3')) s(solver)),
        bare AS (SELECT doc_id, solver, CASE solver WHEN 'z3' THEN regexp_replace(replace(spec, '(check-sat)', ''), '"(?:[^"]|"")*"?|;[^\n]*', '', 'g')
          ELSE regexp_replace(spec, '%[^\n]*|/\*.*?(?:\*/|$)|''(?:[^''\\]|\\.|'''')*''?|"(?:[^"\\]|\\.|"")*"?', '', 'gs') END AS s FROM specs),
        p AS (SELECT doc_id, solver, regexp_replace(s, '[^()]', '', 'g') AS s FROM bare),
        c AS (SELECT doc_id, solver, i, sum(CASE substr(s, i, 1) WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id, solver ORDER BY i) AS depth FROM (SELECT doc_id, solver, s, unnest(range(1, length(s) + 1)) AS i FROM p)),
        e AS (SELECT doc_id, solver, min(depth) AS low, max_by(depth, i) AS last FROM c GROUP BY ALL)
      SELECT doc_id, solver, CASE WHEN solver = 'z3' AND doc_id % 3 < 2 THEN 2 ELSE 1 END AS fixes, CASE WHEN low >= 0 AND last > 0 THEN 1 ELSE 0 END AS unclosed FROM p LEFT JOIN e USING (doc_id, solver)""",
    "w2_template_uses": _USES,
    "w4_promotable": f"SELECT name FROM ({_USES}) WHERE reuse_count >= 3 AND success_count / reuse_count >= 0.45",
}
