"""Functions of specifications and templates, type environments, inherited methods and semantic search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import scalars
from gneiss.operators import codemap, finite, resolve, retrieval
from gneiss.operators.templates import Library, starters
from gneiss.plans.graph_queries import HIER
from gneiss.plans.more_queries import SEARCHED
from gneiss.plans.table_queries import QUERY, TOKENS
from gneiss.sources.bindings import hierarchy, table


def _at(values: list, key: str):
    """The value at a key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def f4_format_list(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(scalars.format_list(F.array_sort(F.collect_set(scalars.quote_if_needed(F.col("p_brand"))))).alias("brands"))


def f6_kind_priority(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.kind_priority(_at(["class", "interface", "function", "method", "variable", "type"], "p_partkey")).alias("priority"))


def f15_prolog_query(spark, sf_dir):
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  ?- a(X), b("), F.col("o_orderkey"), F.lit(").\n"))).when(F.col("o_orderkey") % 3 == 1, "").otherwise("?- old(Y).\n?-new(Z).\n")
    spec = F.concat(F.lit("a("), F.col("o_orderkey"), F.lit(").\n"), asked, F.lit("b."))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.prolog_query(spec).alias("x")).select("o_orderkey", "x.program", "x.query")


def f16_normalize_query(spark, sf_dir):
    query = F.concat(_at(["", "\t?- ", "  ?-"], "o_orderkey"), F.lit("p("), F.col("o_orderkey"), F.lit(")"), _at([".", " . ", "", "\n"], "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.normalize_query(query).alias("query"))


def f17_classify_feedback(spark, sf_dir):
    k, none = F.col("o_orderkey") % 8, F.array().cast("array<string>")
    status = _at(["error", "unsat", "unsat", "sat", "sat", "success", "success", "timeout"], "o_orderkey")
    core = F.when(k == 1, F.array(F.lit("r1"), F.lit("r2"))).otherwise(none)
    model = F.when(k == 3, F.create_map(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    answers = F.when(k == 5, F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("X = "), i.cast("string")))).otherwise(none)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.classify_feedback(status, F.lit("line 1"), core, model, answers).alias("message"))


def f18_prepare_smtlib(spark, sf_dir):
    spec = F.concat(F.lit("(check-sat)(assert p"), F.col("o_orderkey"), F.lit(")"), _at(["", "(set-option :timeout 5)"], "o_orderkey"), F.lit("( get-model )(exit)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.prepare_smtlib(spec).alias("spec"))


def _skeleton():
    return F.concat(F.lit("f({{SLOT:a}}, {{SLOT:s"), F.col("p_size") % 4, F.lit("}}) :- {{SLOT:a}}, {{ SLOT:no }}."))


def f19_slots(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(scalars.slot_names(_skeleton())).alias("place", "slot"))


def f21_kebab_case(spark, sf_dir):
    c = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.is_kebab(c).alias("plain"), scalars.is_kebab(F.concat(F.lower(c), F.lit("-"), "c_custkey")).alias("hyphened"), scalars.is_kebab(F.concat_ws("_", F.lit("a"), "c_custkey")).alias("underlined"))


def s14_variable_types(spark, sf_dir):
    """Variables of parts, bound by suppliers in a function's scope or, each third supplier, in a file's."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.expr(c))
    asked = table(spark, sf_dir, "part").select("p_partkey", name("f", "p_partkey % 25").alias("file"), name("g", "p_size % 7").alias("scope"), name("v", "p_partkey % 5").alias("name"))
    scope = F.when(F.col("s_suppkey") % 3 > 0, name("g", "s_suppkey % 7"))
    bindings = table(spark, sf_dir, "supplier").select(name("f", "s_nationkey").alias("file"), scope.alias("scope"), name("v", "s_suppkey % 5").alias("name"), F.col("s_name").alias("type"), F.col("s_suppkey").alias("seq"))
    return resolve.variable_types(asked, bindings).select("p_partkey", "type")


def j6_inherited_methods(spark, sf_dir):
    """Classes of nations that extend each other in circles of five."""
    extends = table(spark, sf_dir, "nation").selectExpr("'C' || n_nationkey as class_name", "'C' || (n_nationkey + 5) % 25 as parent")
    own = table(spark, sf_dir, "supplier").selectExpr("'C' || s_nationkey as class_name", "'m' || s_suppkey % 3 as method", "s_name as signature", "s_suppkey as seq")
    return resolve.inherited(own, extends, "method", "signature")


def b8_semantic_search(spark, sf_dir):
    corpus = table(spark, sf_dir, "documents").selectExpr("'doc/' || doc_id as id", "source as file", "'f' || doc_id as name", "1 as line", "text")
    return retrieval.semantic_search(spark, corpus, QUERY, 12, dimension=32).select("id", F.round("score", 9).alias("score"))


def c8_boundary_violations(spark, sf_dir):
    """At and next to the ends of each brand's range of sizes."""
    ends = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    near = ends.select("p_brand", "low", "high", F.explode(F.expr("array_distinct(array(low - 1, low, low + 1, high - 1, high, high + 1))")).alias("size"))
    return finite.counterexamples(near, "size between low and high", "size * 2 between 4 and 98").select("p_brand", "size")


def w3_learned_templates(spark, sf_dir):
    names = [x[0] for x in starters()]
    name = F.when(F.col("n_nationkey") % 5 == 0, _at(names, "n_nationkey")).otherwise(F.concat(F.lit("learned-"), "n_nationkey"))
    some = Library.create(spark).templates.limit(1).select([c for c in Library.create(spark).templates.columns if c not in ("name", "domain")])
    learned = table(spark, sf_dir, "nation").select(name.alias("name"), F.lit("learned").alias("domain")).crossJoin(F.broadcast(some))
    return Library.create(spark, learned=learned).templates.select("name", "domain")


def w6_slot_check(spark, sf_dir):
    defined = F.array(F.lit("a"), F.concat(F.lit("s"), F.col("p_partkey") % 3), F.lit("z"))
    x = table(spark, sf_dir, "part").select("p_partkey", scalars.slot_mismatch(_skeleton(), defined).alias("x"))
    return x.select("p_partkey", F.array_join("x.undefined", ",").alias("undefined"), F.array_join("x.unused", ",").alias("unused"))


def k11_map_lines(spark, sf_dir):
    rows = codemap.overview(hierarchy(spark, sf_dir), max_exports=2).withColumns({"language": F.lit("typescript"), "doc": F.lit(None).cast("string"), "token_estimate": F.length("path") * 70})
    return codemap.overview_lines(rows)


QUERIES = {k: v for k, v in globals().items() if len(k) > 2 and k[0] in "fsjbcwk" and k[1].isdigit()}
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_STARTERS = "starters(name, domain) AS (VALUES " + ", ".join(f"({_quoted(x[0])}, {_quoted(x[1])})" for x in starters()) + ")"
_TEXTS = "texts(name, domain, text) AS (VALUES " + ", ".join(
    f"({_quoted(n)}, {_quoted(d)}, {_quoted(' '.join([n, d, about, *(s[1] for s in slots), *(f'{a} {b}' for a, b in normal)]))})" for n, d, _, about, _, slots, normal, *_ in starters()
) + ")"
ORACLE_SQL = {
    "f4_format_list": "SELECT p_size, '[' || array_to_string(list_sort(list_distinct(list('''' || p_brand || ''''))), ',') || ']' AS brands FROM part GROUP BY p_size",
    "f6_kind_priority": "SELECT p_partkey, ([0, 0, 1, 2, 3, 4])[p_partkey % 6 + 1]::INT AS priority FROM part",
    "f15_prolog_query": """SELECT o_orderkey, 'a(' || o_orderkey || ').' || chr(10) || CASE WHEN o_orderkey % 3 = 2 THEN '?- old(Y).' || chr(10) ELSE '' END || 'b.' AS program,
        CASE o_orderkey % 3 WHEN 0 THEN 'a(X), b(' || o_orderkey || ').' WHEN 1 THEN 'true.' ELSE 'new(Z).' END AS query FROM orders""",
    "f16_normalize_query": "SELECT o_orderkey, 'p(' || o_orderkey || ')' AS query FROM orders",
    "f17_classify_feedback": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'The solver failed: line 1' WHEN 1 THEN 'Unsatisfiable; these assertions conflict: r1, r2'
        WHEN 2 THEN 'Unsatisfiable: the constraints contradict each other.' WHEN 3 THEN 'Satisfiable: x = ' || o_orderkey WHEN 4 THEN 'Satisfiable without any variable.'
        WHEN 5 THEN '7 solutions: X = 1; X = 2; X = 3; X = 4; X = 5 and 2 more' WHEN 6 THEN 'No solutions: check that facts and rules cover the query.'
        ELSE 'Unknown: the problem is outside of what can be decided here.' END AS message FROM orders""",
    "f18_prepare_smtlib": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '(set-option :timeout 30000)' || chr(10) || '(assert p' || o_orderkey || ')' ELSE '(assert p' || o_orderkey || ')(set-option :timeout 5)' END AS spec FROM orders",
    "f19_slots": "SELECT p_partkey, 0 AS place, 'a' AS slot FROM part UNION ALL SELECT p_partkey, 1, 's' || (p_size % 4) FROM part",
    "f21_kebab_case": """SELECT c_custkey, regexp_full_match(c_mktsegment, '[a-z][a-z0-9-]*') AS plain, regexp_full_match(lower(c_mktsegment) || '-' || c_custkey, '[a-z][a-z0-9-]*') AS hyphened,
        regexp_full_match('a_' || c_custkey, '[a-z][a-z0-9-]*') AS underlined FROM customer""",
    "s14_variable_types": """WITH b AS (SELECT s_nationkey AS f, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 7 END AS g, s_suppkey % 5 AS v, max_by(s_name, s_suppkey) AS type FROM supplier GROUP BY ALL)
        SELECT p_partkey, coalesce(i.type, o.type) AS type FROM part LEFT JOIN b i ON i.f = p_partkey % 25 AND i.g = p_size % 7 AND i.v = p_partkey % 5
        LEFT JOIN b o ON o.f = p_partkey % 25 AND o.g IS NULL AND o.v = p_partkey % 5""",
    "j6_inherited_methods": """WITH own AS (SELECT s_nationkey AS c, 'm' || (s_suppkey % 3) AS method, max_by(s_name, s_suppkey) AS signature FROM supplier GROUP BY ALL),
        r AS (SELECT n_nationkey AS k, c, method, signature, row_number() OVER (PARTITION BY n_nationkey, method ORDER BY d) AS place FROM nation, range(5) x(d) JOIN own ON c = (n_nationkey + 5 * d) % 25)
        SELECT 'C' || k AS class_name, method, signature, 'C' || c AS owner FROM r WHERE place = 1""",
    "b8_semantic_search": f"""WITH h AS (SELECT 'doc/' || doc_id AS id, sha256(text) AS h FROM documents UNION ALL SELECT NULL, sha256('{QUERY}')),
        e AS (SELECT id, [('0x' || substr(h, k * 2 + 1, 2))::INT / 128.0::DOUBLE - 1 FOR k IN range(32)] AS v FROM h)
        SELECT a.id, round(list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v))), 9) AS score FROM e a, e q WHERE a.id IS NOT NULL AND q.id IS NULL ORDER BY score DESC, a.id LIMIT 12""",
    "c8_boundary_violations": """WITH e AS (SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand)
        SELECT DISTINCT p_brand, size FROM (SELECT *, unnest([low, low + 1, high - 1, high]) AS size FROM e) WHERE size BETWEEN low AND high AND NOT size * 2 BETWEEN 4 AND 98""",
    "w3_learned_templates": f"WITH {_STARTERS} SELECT * FROM starters UNION ALL SELECT 'learned-' || n_nationkey, 'learned' FROM nation WHERE n_nationkey % 5 > 0",
    "w6_slot_check": """SELECT p_partkey, CASE WHEN p_size % 4 <> p_partkey % 3 THEN 's' || (p_size % 4) ELSE '' END AS undefined,
        CASE WHEN p_size % 4 <> p_partkey % 3 THEN 's' || (p_partkey % 3) || ',' ELSE '' END || 'z' AS unused FROM part""",
    "k11_map_lines": f"""WITH {HIER}, ranked AS (
        SELECT d.file, d.name, row_number() OVER (PARTITION BY d.file ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, line, d.name) AS k
        FROM defines d WHERE EXISTS (FROM exports e WHERE e.file = d.file AND e.name = d.name)),
        f AS (SELECT file, length(file) * 70 AS n FROM (SELECT DISTINCT file FROM defines))
      SELECT file AS path, '- **' || file || '** (typescript, ' || CASE WHEN n >= 1000 THEN ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'K' ELSE n::VARCHAR END || ' tokens)'
        || coalesce(': ' || (SELECT string_agg('`' || name || '`', ', ' ORDER BY k) FROM ranked r WHERE r.file = f.file AND k <= 2), '') AS line FROM f""",
    "b4_template_search": f"""WITH {_TEXTS}, d AS (SELECT name, domain, {TOKENS.format('text')} AS t FROM texts), n AS (SELECT count(*) AS n, avg(len(t)) AS avgl FROM d),
        tf AS (SELECT name, domain, len(t) AS l, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT unnest({TOKENS.format("'" + SEARCHED + "'")}) AS term)
        SELECT name, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgl))), 6) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term), n WHERE domain = 'authorization' GROUP BY name ORDER BY score DESC, name LIMIT 10""",
}
