"""Graph analyses over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import codemap, graph, insights, reach
from gneiss.sources import bindings
from gneiss.sources.bindings import hierarchy, hierarchy_calls, table, trade
from gneiss.sources.facts import CodeGraph

#: The views that the SQL shares.
HIER = """
calls AS (
  SELECT 'region/' || n_regionkey AS caller, 'nation/' || n_nationkey AS callee FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders
  UNION ALL SELECT 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem
  UNION ALL SELECT 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem
), edges AS (SELECT DISTINCT caller, callee FROM calls),
defines AS (
  SELECT 'src/routes/region.ts' AS file, 'region/' || r_regionkey AS name, 'class' AS kind, r_regionkey::INT AS line FROM region
  UNION ALL SELECT 'src/handlers/nation.ts', 'nation/' || n_nationkey, 'class', n_nationkey::INT FROM nation
  UNION ALL SELECT 'src/services/' || lower(c_mktsegment) || '.ts', 'customer/' || c_custkey, 'function', c_custkey::INT FROM customer
  UNION ALL SELECT 'src/repositories/' || o_orderstatus || '.ts', 'order/' || o_orderkey, 'function', o_orderkey::INT FROM orders
  UNION ALL SELECT 'src/db/part.ts', 'part/' || p_partkey, 'function', p_partkey::INT FROM part
  UNION ALL SELECT 'src/db/supplier.ts', 'supplier/' || s_suppkey, 'method', s_suppkey::INT FROM supplier
),
exports AS (SELECT 'src/services/' || lower(c_mktsegment) || '.ts' AS file, 'customer/' || c_custkey AS name FROM customer WHERE c_acctbal > 0),
imports AS (SELECT DISTINCT 'src/services/' || lower(c_mktsegment) || '.ts' AS file, 'nation' AS name, '../handlers/nation' AS source FROM customer),
nodes AS (SELECT name FROM defines UNION SELECT caller FROM calls UNION SELECT callee FROM calls)
"""
#: All lines of the hierarchy as facts: declarations, relations, entry points, rules.
_RELATIONS = "defines/4 calls/2 imports/3 exports/2 contains/2 file/2 hyperedge/2 hyperedge_member/2 entry_point/1".split()
LINES = (
    """lines AS (
  SELECT 'file(''' || file || ''', typescript).' AS line FROM (SELECT DISTINCT file FROM defines)
  UNION ALL SELECT 'defines(''' || file || ''', ''' || name || ''', ' || kind || ', ' || line || ').' FROM defines
  UNION ALL SELECT 'calls(''' || caller || ''', ''' || callee || ''').' FROM calls
  UNION ALL SELECT 'imports(''' || file || ''', ' || name || ', ''' || source || ''').' FROM imports
  UNION ALL SELECT 'exports(''' || file || ''', ''' || name || ''').' FROM exports
  UNION ALL SELECT 'contains(''nation/' || s_nationkey || ''', ''supplier/' || s_suppkey || ''').' FROM supplier
  UNION ALL SELECT 'entry_point(''' || name || ''').' FROM (SELECT DISTINCT name FROM exports)
"""
    + "".join(f"  UNION ALL SELECT '{x}'\n" for x in [*(f":- dynamic({r})." for r in _RELATIONS), *graph.RULES.split("\n")])
    + ")"
)
TRADE = """
calls AS (
  SELECT 'n' || c_nationkey AS caller, 'n' || s_nationkey AS callee FROM (
    SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s_nationkey) AS k FROM (
      SELECT c_nationkey, s_nationkey, sum(l_quantity::BIGINT) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey)) WHERE k <= 3
), edges AS (SELECT DISTINCT caller, callee FROM calls),
defines AS (SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'method' ELSE 'function' END AS kind FROM nation),
undirected AS (SELECT DISTINCT least(caller, callee) AS a, greatest(caller, callee) AS b FROM calls WHERE caller <> callee),
degrees AS (SELECT name, count(*) AS degree FROM (SELECT a AS name FROM undirected UNION ALL SELECT b FROM undirected) GROUP BY name)
"""


def g1_summary(spark, sf_dir):
    return graph.summary(hierarchy(spark, sf_dir))


def g2_callers(spark, sf_dir):
    return graph.callers(hierarchy(spark, sf_dir), "5")


def g3_callees(spark, sf_dir):
    return graph.callees(hierarchy(spark, sf_dir), "customer/7")


def g4_reachability(spark, sf_dir):
    return graph.reachability(hierarchy(spark, sf_dir), "region/1", "supplier/3")


def g4_reachability_suffix(spark, sf_dir):
    return graph.reachability(hierarchy(spark, sf_dir), "supplier/3", "2")


def g5_path(spark, sf_dir):
    names = graph.path(hierarchy(spark, sf_dir), "region/2", "supplier/5")
    return spark.createDataFrame([(k, x) for k, x in enumerate(names)], "place long, name string")


def g6_impact(spark, sf_dir):
    return graph.impact(hierarchy(spark, sf_dir), "supplier/1")


def g7_dead_code(spark, sf_dir):
    """Of the hierarchy without its nations: customers that no nation calls then, unless they are exported."""
    g = hierarchy(spark, sf_dir)
    return graph.dead_code(g.with_(calls=g.calls.where("not startswith(caller, 'nation/')")))


def g7_dead_code_entries(spark, sf_dir):
    return graph.dead_code(trade(spark, sf_dir), ["n1", "n2"])


def g8_cycles(spark, sf_dir):
    return graph.cycles(trade(spark, sf_dir))


def g9_layer_violations(spark, sf_dir):
    g = hierarchy(spark, sf_dir)
    skips = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    skips = skips.select(F.concat(F.lit("nation/"), F.col("c_nationkey")).alias("caller"), F.concat(F.lit("order/"), F.col("o_orderkey")).alias("callee"))
    calls = g.calls.select("caller", "callee", "callee_qn", "seq").unionByName(skips.selectExpr("*", "cast(null as string) as callee_qn", "0L as seq"))
    return graph.layer_violations(g.with_(calls=calls))


def g10_communities(spark, sf_dir):
    return insights.communities(trade(spark, sf_dir))


def g10_modularity(spark, sf_dir):
    """The communities' modularity, held against that of the regions and of one community for all."""
    g = trade(spark, sf_dir)
    regions = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_regionkey").cast("string").alias("id"))
    edges, degrees = graph.undirected(g), graph.degrees(g)
    m = edges.agg(F.count("*").alias("m"))

    def modularity(of):
        one, other = of.select(F.col("name").alias("a"), F.col("id").alias("x")), of.select(F.col("name").alias("b"), F.col("id").alias("y"))
        inner = edges.join(one, "a").join(other, "b").where("x = y").groupBy(F.col("x").alias("id")).agg(F.count("*").alias("inner"))
        total = degrees.join(of, "name").groupBy("id").agg(F.sum("degree").alias("degree"))
        parts = total.join(inner, "id", "left").crossJoin(F.broadcast(m))  # one row
        return parts.agg(F.sum(F.expr("coalesce(inner, 0) / m - pow(degree / (2 * m), 2)")).alias("q"))

    found = insights.communities(g).select("name", F.col("id").cast("string").alias("id"))
    both = modularity(found).crossJoin(modularity(regions).withColumnRenamed("q", "of_regions"))  # a row each
    return found.agg(F.count("*").alias("nodes"), F.count_distinct("name").alias("names")).crossJoin(both).select("nodes", "names", F.expr("q >= of_regions and q >= 0").alias("good"), F.round("of_regions", 9).alias("of_regions"))


def g11_hubs(spark, sf_dir):
    return insights.hubs(hierarchy(spark, sf_dir), 25)


def g12_bridges(spark, sf_dir):
    return insights.bridges(trade(spark, sf_dir)).select("name", F.round("score", 9).alias("score"))


def g13_surprises(spark, sf_dir):
    rows = insights.surprises(trade(spark, sf_dir))
    return rows.select("source", "target", "score", F.array_join("reasons", ",").alias("reasons"))


def g13_surprises_given(spark, sf_dir):
    """With the regions as communities."""
    regions = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), F.col("n_regionkey").alias("id"))
    rows = insights.surprises(trade(spark, sf_dir), 20, regions)
    return rows.select("source", "target", "score", F.array_join("reasons", ",").alias("reasons"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[CodeGraph, CodeGraph]:
    def of(where: str) -> CodeGraph:
        o = table(spark, sf_dir, "orders").where(where)
        calls = o.select(F.concat(F.lit("customer/"), F.col("o_custkey")).alias("caller"), F.concat(F.lit("priority/"), F.col("o_orderpriority")).alias("callee"))
        exports = o.where("o_totalprice > 200000").select(F.lit("orders.ts").alias("file"), F.concat(F.lit("customer/"), F.col("o_custkey")).alias("name"))
        return CodeGraph.of(spark, calls=calls, exports=exports)

    return of("o_orderdate < timestamp '1998-06-01'"), of("o_orderdate >= timestamp '1996-01-01'")


def g4_reach_pairs(spark, sf_dir):
    """For each order: does its customer reach one of the suppliers, and one of the regions the order?"""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier").count()
    to = F.concat(F.lit("supplier/"), F.col("o_orderkey") % n + 1)
    pairs = o.select(F.concat(F.lit("customer/"), "o_custkey").alias("a"), to.alias("b")).unionAll(o.select(F.concat(F.lit("region/"), F.col("o_orderkey") % 5), F.concat(F.lit("order/"), "o_orderkey")))
    edges = hierarchy_calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return reach.reach_pairs(edges, pairs).select("a", "b", "reaches")


def g14_diff(spark, sf_dir):
    return graph.diff(*halves(spark, sf_dir))


def g15_entry_points(spark, sf_dir):
    return graph.entry_points(hierarchy(spark, sf_dir))


def g15_entry_points_functions(spark, sf_dir):
    return graph.entry_points(trade(spark, sf_dir))


def g16_fact_lines(spark, sf_dir):
    return graph.fact_lines(hierarchy(spark, sf_dir)).select("line")


def g18_nodes(spark, sf_dir):
    return hierarchy(spark, sf_dir).nodes()


def g18_undirected(spark, sf_dir):
    return graph.undirected(trade(spark, sf_dir))


def g18_degrees(spark, sf_dir):
    return graph.degrees(hierarchy(spark, sf_dir))


def g19_overview(spark, sf_dir):
    return codemap.overview(hierarchy(spark, sf_dir)).select("path", "export_count", F.array_join(F.transform("top_exports", lambda x: x["name"]), ",").alias("top"))


def g20_file_detail(spark, sf_dir):
    return codemap.file_symbols(hierarchy(spark, sf_dir), "src/services/building.ts")


def g21_symbol_detail(spark, sf_dir):
    return codemap.symbol_detail(hierarchy(spark, sf_dir), "part/5")


def l5_transition_reach(spark, sf_dir):
    from gneiss.operators.fixpoint import closure

    t = bindings.transitions(spark, sf_dir).distinct()
    return closure(t.select(F.col("source").alias("src"), F.col("target").alias("dst"))).select(F.col("src").alias("source"), F.col("dst").alias("target"))


def _reach(name: str, start: str, edges: str = "edges") -> str:
    return f"{name} AS (SELECT callee AS node FROM {edges} WHERE {start} UNION SELECT e.callee FROM {name} r JOIN {edges} e ON e.caller = r.node)"


QUERIES = {k: v for k, v in globals().items() if k[0] in "gl" and k[1].isdigit()}
ORACLE_SQL = {
    "g1_summary": f"""WITH {HIER} SELECT count(DISTINCT file) AS files, count(*) FILTER (kind IN ('function', 'method')) AS functions,
        count(*) FILTER (kind = 'class') AS classes, (SELECT count(*) FROM calls) AS call_edges, (SELECT count(*) FROM imports) AS imports,
        (SELECT count(*) FROM exports) AS exports, 0::BIGINT AS hyperedges FROM defines""",
    "g2_callers": f"WITH {HIER} SELECT DISTINCT caller AS name FROM edges WHERE callee LIKE '%/5'",
    "g3_callees": f"WITH {HIER} SELECT callee AS name FROM edges WHERE caller = 'customer/7'",
    "g4_reachability": f"WITH RECURSIVE {HIER}, {_reach('r', "caller = 'region/1'")} SELECT count(*) > 0 AS reachable FROM r WHERE node = 'supplier/3'",
    "g4_reachability_suffix": f"WITH RECURSIVE {HIER}, {_reach('r', "caller = 'supplier/3'")} SELECT count(*) > 0 AS reachable FROM r WHERE node LIKE '%/2'",
    "g5_path": f"""WITH RECURSIVE {HIER}, levels(node, depth, parent) AS (
        SELECT 'region/2', 0, NULL UNION SELECT e.callee, l.depth + 1, NULL FROM levels l JOIN edges e ON e.caller = l.node WHERE l.depth < 6
      ), least_depth AS (SELECT node, min(depth) AS depth FROM levels GROUP BY node),
      steps AS (SELECT d.node, d.depth, min(p.node) AS parent FROM least_depth d JOIN edges e ON e.callee = d.node JOIN least_depth p ON p.node = e.caller AND p.depth = d.depth - 1 GROUP BY ALL),
      chain(node, depth) AS (SELECT node, depth FROM least_depth WHERE node = 'supplier/5' UNION ALL SELECT s.parent, c.depth - 1 FROM chain c JOIN steps s ON s.node = c.node AND s.depth = c.depth)
      SELECT depth::BIGINT AS place, node AS name FROM chain""",
    "g6_impact": f"WITH RECURSIVE {HIER}, r AS (SELECT caller AS node FROM edges WHERE callee = 'supplier/1' UNION SELECT e.caller FROM r JOIN edges e ON e.callee = r.node) SELECT node AS name FROM r WHERE node <> 'supplier/1'",
    "g7_dead_code": f"WITH {HIER} SELECT DISTINCT name FROM defines d WHERE kind = 'function' AND NOT EXISTS (FROM calls c WHERE c.callee = d.name AND c.caller NOT LIKE 'nation/%') AND NOT EXISTS (FROM exports e WHERE e.name = d.name)",
    "g7_dead_code_entries": f"WITH {TRADE} SELECT DISTINCT name FROM defines d WHERE kind = 'function' AND name NOT IN ('n1', 'n2') AND NOT EXISTS (FROM calls c WHERE c.callee = d.name)",
    "g8_cycles": f"""WITH RECURSIVE {TRADE}, fn AS (SELECT * FROM edges WHERE caller NOT IN (SELECT name FROM defines WHERE kind = 'method') AND callee NOT IN (SELECT name FROM defines WHERE kind = 'method')),
        r AS (SELECT caller, callee FROM fn UNION SELECT r.caller, f.callee FROM r JOIN fn f ON f.caller = r.callee) SELECT caller AS name FROM r WHERE caller = callee""",
    "g9_layer_violations": """SELECT 'nation/' || c_nationkey AS caller, 'order/' || o_orderkey AS callee, 'handlers' AS caller_layer, 'repositories' AS callee_layer FROM orders JOIN customer ON o_custkey = c_custkey""",
    "g11_hubs": f"""WITH {HIER}, u AS (SELECT DISTINCT least(caller, callee) AS a, greatest(caller, callee) AS b FROM calls WHERE caller <> callee)
        SELECT name, count(*) AS degree FROM (SELECT a AS name FROM u UNION ALL SELECT b FROM u) GROUP BY name ORDER BY degree DESC, name LIMIT 25""",
    "g4_reach_pairs": """WITH n AS (SELECT count(*) AS n FROM supplier), sells AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
        buys AS (SELECT DISTINCT o_custkey, s.l_suppkey FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN sells s ON s.l_partkey = l.l_partkey),
        asked AS (SELECT DISTINCT o_custkey, o_orderkey % n + 1 AS s FROM orders, n)
        SELECT 'customer/' || a.o_custkey AS a, 'supplier/' || s AS b, l_suppkey IS NOT NULL AS reaches FROM asked a LEFT JOIN buys b ON b.o_custkey = a.o_custkey AND l_suppkey = s
        UNION ALL SELECT 'region/' || o_orderkey % 5, 'order/' || o_orderkey, coalesce(n_regionkey = o_orderkey % 5, false)
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "g14_diff": """WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1998-06-01' AS early, o_orderdate >= TIMESTAMP '1996-01-01' AS late FROM orders),
      facts AS (
        SELECT 'node' AS entity, 'customer/' || o_custkey AS key, early, late FROM o UNION ALL SELECT 'node', 'priority/' || o_orderpriority, early, late FROM o
        UNION ALL SELECT 'edge', 'customer/' || o_custkey || chr(9) || 'priority/' || o_orderpriority, early, late FROM o
        UNION ALL SELECT 'export', 'orders.ts' || chr(9) || 'customer/' || o_custkey, early, late FROM o WHERE o_totalprice > 200000
      ), sides AS (SELECT entity, key, bool_or(early) AS early, bool_or(late) AS late FROM facts GROUP BY ALL)
      SELECT CASE WHEN late THEN 'added' ELSE 'removed' END AS change, entity, key FROM sides WHERE early <> late""",
    "g15_entry_points": f"WITH {HIER} SELECT DISTINCT name FROM exports WHERE NOT EXISTS (FROM calls WHERE callee = name) OR NOT EXISTS (FROM exports e WHERE NOT EXISTS (FROM calls WHERE callee = e.name))",
    "g15_entry_points_functions": f"WITH {TRADE} SELECT DISTINCT name FROM defines WHERE kind = 'function' AND NOT EXISTS (FROM calls WHERE callee = name)",
    "g16_fact_lines": f"WITH {HIER}, {LINES} SELECT line FROM lines",
    "g18_nodes": f"WITH {HIER} SELECT name FROM nodes",
    "g10_modularity": f"""WITH {TRADE}, e AS (SELECT DISTINCT a, b FROM undirected), m AS (SELECT count(*) AS m FROM e), r AS (SELECT 'n' || n_nationkey AS name, n_regionkey AS id FROM nation),
        d AS (SELECT name, count(*) AS degree FROM (SELECT a AS name FROM e UNION ALL SELECT b FROM e) GROUP BY name),
        t AS (SELECT id, sum(degree) AS degree FROM d JOIN r USING (name) GROUP BY id), i AS (SELECT x.id, count(*) AS n FROM e JOIN r x ON x.name = a JOIN r y ON y.name = b WHERE x.id = y.id GROUP BY x.id)
      SELECT (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM d) AS names, true AS good, round((SELECT sum(coalesce(i.n, 0) / m - pow(degree / (2 * m), 2)) FROM t LEFT JOIN i USING (id), m), 9) AS of_regions""",
    "g18_undirected": f"WITH {TRADE} SELECT a, b FROM undirected",
    "g18_degrees": f"""WITH {HIER}, u AS (SELECT DISTINCT least(caller, callee) AS a, greatest(caller, callee) AS b FROM calls WHERE caller <> callee)
        SELECT name, count(*) AS degree FROM (SELECT a AS name FROM u UNION ALL SELECT b FROM u) GROUP BY name""",
    "g12_bridges": f"""WITH RECURSIVE {TRADE}, adjacent AS (SELECT a, b FROM undirected UNION ALL SELECT b, a FROM undirected),
        walks AS (SELECT name AS s, name AS t, 0 AS k, 1.0::DOUBLE AS n FROM degrees UNION ALL SELECT s, b, k + 1, sum(n) FROM walks JOIN adjacent ON a = t WHERE k < 24 GROUP BY s, b, k),
        shortest AS (SELECT s, t, min(k) AS d, min_by(n, k) AS n FROM walks GROUP BY s, t),
        ways AS (SELECT x.t AS name, sum(x.n * y.n / z.n) AS score FROM shortest x JOIN shortest y ON y.s = x.t JOIN shortest z ON z.s = x.s AND z.t = y.t
          WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t AND x.d + y.d = z.d GROUP BY x.t),
        every AS (SELECT count(*) AS n FROM (SELECT name FROM defines UNION SELECT caller FROM calls UNION SELECT callee FROM calls))
      SELECT name, round(score / ((n - 1) * (n - 2)), 9) AS score FROM ways, every ORDER BY score DESC, name LIMIT 3""",
    "g13_surprises_given": f"""WITH {TRADE}, first AS (SELECT least(caller, callee) AS a, greatest(caller, callee) AS b, min((caller, callee)) AS e FROM calls WHERE caller <> callee GROUP BY ALL),
        region AS (SELECT 'n' || n_nationkey AS name, n_regionkey AS id FROM nation),
        marked AS (SELECT e, x.id <> y.id AS across, least(p.degree, q.degree) <= 2 AND greatest(p.degree, q.degree) >= 5 AS hub
          FROM first JOIN region x ON x.name = a JOIN region y ON y.name = b JOIN degrees p ON p.name = a JOIN degrees q ON q.name = b)
      SELECT e[1] AS source, e[2] AS target, across::INT + hub::INT AS score, concat_ws(',', CASE WHEN across THEN 'cross-community' END, CASE WHEN hub THEN 'peripheral-to-hub' END) AS reasons
      FROM marked WHERE across OR hub ORDER BY score DESC, source, target LIMIT 20""",
    "g19_overview": f"""WITH {HIER}, ranked AS (
        SELECT d.file, d.name, row_number() OVER (PARTITION BY d.file ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, line, d.name) AS k
        FROM defines d WHERE EXISTS (FROM exports e WHERE e.file = d.file AND e.name = d.name))
      SELECT f.file AS path, (SELECT count(DISTINCT name) FROM exports e WHERE e.file = f.file) AS export_count,
        coalesce((SELECT string_agg(name, ',' ORDER BY k) FROM ranked r WHERE r.file = f.file AND k <= 8), '') AS top FROM (SELECT DISTINCT file FROM defines) f""",
    "g20_file_detail": f"WITH {HIER} SELECT name, kind, line FROM defines WHERE file = 'src/services/building.ts'",
    "g21_symbol_detail": f"""WITH {HIER} SELECT 'define' AS relation, file AS name FROM defines WHERE name = 'part/5' UNION ALL SELECT 'caller', caller FROM edges WHERE callee = 'part/5' UNION ALL SELECT 'callee', callee FROM edges WHERE caller = 'part/5'""",
    "l5_transition_reach": """WITH RECURSIVE t AS (
        SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
        WHERE target IS NOT NULL), r AS (SELECT source, target FROM t UNION SELECT r.source, t.target FROM r JOIN t ON t.source = r.target) SELECT source, target FROM r""",
}
