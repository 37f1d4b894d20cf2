"""Scalar functions, retrieval, rules, constraints, resolution and cache operators over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gneiss.functions import scalars
from gneiss.operators import datalog, finite, logic, neighbours, resolve, retrieval
from gneiss.operators.fixpoint import shared_dir
from gneiss.operators.postings import StoredBM25
from gneiss.sources import cache
from gneiss.sources.bindings import table, transitions
from gneiss.sources.facts import CodeGraph

STOP = ", ".join(f"'{w}'" for w in scalars.STOPWORDS)
#: tokens of a text in SQL
TOKENS = f"list_filter(regexp_split_to_array(lower({{}}), '[^a-z0-9_]+'), lambda t: length(t) >= 2 AND NOT list_contains([{STOP}], t))"
QUERY = "the license under version the ereanon license"


def f1_glob(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(scalars.glob_match(F.col("url"), "https://*/**/*1*")).select("page_id")


def f2_escape_atom(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit("'\\\n"), F.col("c_name")).alias("s"))
    return t.select("c_custkey", scalars.escape_atom(F.col("s")).alias("quoted"), scalars.escape_atom(F.lower(F.regexp_replace("s", "[^A-Za-z0-9]", "_"))).alias("bare"), scalars.quote_if_needed(F.concat(F.lit("camelCase"), F.col("c_custkey"))).alias("camel"))


def f5_layer(spark, sf_dir):
    from gneiss.operators.graph import LAYERS

    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src\\"), F.element_at(F.array(*map(F.lit, [*LAYERS, "lib"])), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("/db/x.ts")).alias("path"))
    return p.select("p_partkey", scalars.extract_layer(F.col("path"), LAYERS).alias("layer"))


def f7_truncate_doc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.truncate_doc(F.col("text")).alias("doc"))


def f8_format_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.format_tokens(scalars.token_estimate(F.col("text"))).alias("tokens"))


def f9_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(scalars.tokenize(F.col("text"))).alias("place", "token"))


def f10_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.join(b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("other")), "item_id").select("item_id", F.round(scalars.word_jaccard(F.col("text"), F.col("other")), 9).alias("similarity"))


def f11_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(scalars.norm(F.col("embedding")), 6).alias("norm"), F.round(scalars.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("mirror"))


def f12_cohesion(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 9 as m", "p_size as e")
    return p.select("p_partkey", scalars.cohesion(F.col("m"), F.col("e")).alias("cohesion"))


def f13_normalize_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.normalize_id(F.concat(F.lit("-"), F.col("o_orderpriority"), F.lit("--!x"))).alias("id"))


def f22_common_segments(spark, sf_dir):
    """The longest common beginning of the paths of each file group, as joins: place by place while there is one segment."""
    p = table(spark, sf_dir, "part").select(F.col("p_size") % 5, F.format_string("src/g%d/a/%s/m%d", F.col("p_size") % 5, F.when(F.col("p_size") % 5 < 3, "same").otherwise(F.col("p_brand")), F.col("p_partkey"))).toDF("g", "url")
    n = p.groupBy("g").agg(F.count("*").alias("n"))
    seg = p.select("g", F.posexplode(F.split("url", "/")).alias("place", "segment")).groupBy("g", "place").agg(F.count("*").alias("have"), F.min("segment").alias("a"), F.max("segment").alias("b"))
    seg = seg.join(n, "g").selectExpr("g", "place", "a", "min(if(have = n and a = b, 1, 0)) over (partition by g order by place) as whole")
    return seg.where("whole = 1").groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "a"))), lambda x: x["a"]), "/").alias("common"))


def f23_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.snippet(F.col("text"), F.lit(2), 3).alias("snippet"))


def f24_mock_embedding(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(scalars.mock_embedding(F.col("text"), 40)).alias("place", "value"))


def s3_language(spark, sf_dir):
    names = [*scalars.EXTENSIONS, ".TXT", ".PY"]
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a.b/c"), F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))).alias("path"))
    return p.select("p_partkey", scalars.language_of(F.col("path")).alias("language"))


def s11_file_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.line_count(F.col("text")).alias("lines"), scalars.token_estimate(F.col("text")).alias("tokens"))


def k1_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.content_hash(F.col("text"), F.concat(F.lit("doc/"), F.col("doc_id"))).alias("hash"))


def _versions(spark, sf_dir):
    """Documents as files, of which every third has changed since the manifest was written."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("text").alias("content"), "doc_id")
    old = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    manifest = d.where("doc_id % 5 <> 0").select("path", scalars.content_hash(old, F.col("path")).alias("hash"), F.lit(cache.SCHEMA_VERSION).alias("version"))
    return cache.probe(d, manifest)


def k2_cache_hits(spark, sf_dir):
    return _versions(spark, sf_dir)[0].select("path")


def k2_cache_misses(spark, sf_dir):
    return _versions(spark, sf_dir)[1].select("path")


def k4_eviction(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("saved_at"))
    return cache.within_budget(o, 100_000_000).select("path", "size")


def k10_cached_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key"), scalars.mock_embedding(F.col("text"), 8).alias("vector")).dropDuplicates(["key"])
    hits, misses = retrieval.with_cached(d, known, 8)
    return hits.select("doc_id", F.lit("hit").alias("state")).unionAll(misses.select("doc_id", F.lit("miss").alias("state")))


def _index(spark, sf_dir):
    return retrieval.BM25Index.build(table(spark, sf_dir, "documents"), "doc_id", "text")


def b1_bm25_idf(spark, sf_dir):
    return _index(spark, sf_dir).idf.select("term", "df", F.round("idf", 9).alias("idf"))


def b3_bm25_search(spark, sf_dir):
    return _index(spark, sf_dir).search(QUERY, 20, digits=6)


def _stored_index(spark, sf_dir):
    """An index in three additions, the last of which brings back documents that were removed."""
    at = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    docs, index = table(spark, sf_dir, "documents"), StoredBM25(spark, at)
    index.add(docs.where("doc_id % 3 <> 0"), "doc_id", "text")
    index.add(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    index.remove(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("doc")))
    index.add(docs.where("doc_id % 5 = 0"), "doc_id", "text")
    return index


def b2_stored_idf(spark, sf_dir):
    return _stored_index(spark, sf_dir).idf().select("term", "df", F.round("idf", 9).alias("idf"))


def b3_stored_search(spark, sf_dir):
    return _stored_index(spark, sf_dir).search(QUERY, 20, digits=6)


def b6_nearest_to_each(spark, sf_dir):
    """The ten nearest of every vector. Equal scores may come in any order of ids, so ids aren't shown."""
    found = neighbours.nearest_to_each(table(spark, sf_dir, "embeddings"), 10, id_col="vec_id", vector_col="embedding")
    return found.select(F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def b5_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").alias("seq"))
    new = e.where("seq % 4 = 0").withColumn("vector", F.reverse("vector"))
    out = retrieval.upsert_vectors(e.where("seq % 3 <> 0").select("id", "vector"), new)
    return out.select("id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round("norm", 6).alias("norm"))


def b6_nearest(spark, sf_dir):
    q = [1.0 if k % 3 else -0.5 for k in range(64)]
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), q, 15, "vec_id", "embedding").select("id", F.round("score", 9).alias("score"))


def b7_search_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    g = CodeGraph.of(
        spark,
        defines=d.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("file"), F.concat(F.lit("f"), F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 2 == 0, "function").otherwise("class").alias("kind"), F.lit(2).alias("line"), F.col("source").alias("signature")),
        files=d.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("lang").alias("language"), F.when(F.col("lang") == "en", F.col("lang")).alias("file_doc")),
    )
    return retrieval.search_corpus(g, d.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("text").alias("content"))).select("id", "text")


def b10_near_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = d.where("doc_id = 7").first().text
    return retrieval.near_duplicate(_index(spark, sf_dir), d, text, "doc_id", "text", digits=6).select("id", F.round("similarity", 9).alias("similarity"))


def _supply(spark, sf_dir):
    """Supplier -> part for each line, part -> supplier for those that were returned."""
    s, p, back = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst")).distinct()


SUPPLY = """flows AS (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS src, CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS dst FROM lineitem)"""


def l4_reaches(spark, sf_dir):
    return logic.reaches(_supply(spark, sf_dir), "s1")


def l4_simple_paths(spark, sf_dir):
    t = transitions(spark, sf_dir).distinct().where("source <> target").toDF("src", "dst")
    return logic.simple_paths(t, "click", "purchase").select(F.array_join("path", ">").alias("path"))


def l7_neighbours(spark, sf_dir):
    return _supply(spark, sf_dir).where("src = 's1'").select("dst")


def l8_permissions(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    roles = t("customer").select(F.col("c_custkey").alias("user"), F.concat(F.lit("r"), F.col("c_nationkey")).alias("role"))
    inherits = t("nation").where("n_nationkey > 0").select(F.concat(F.lit("r"), F.col("n_nationkey")).alias("role"), F.concat(F.lit("r"), F.floor(F.col("n_nationkey") / 2)).alias("inherited"))
    # what a role may read: the bands of balances of its nation's suppliers
    granted = t("supplier").select(F.concat(F.lit("r"), F.col("s_nationkey")).alias("role"), F.lit("read").alias("action"), F.concat_ws("/", "s_nationkey", F.floor(F.col("s_acctbal") / 1000)).alias("resource"))
    return logic.permissions(roles, inherits, granted)


def l9_missing_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("caller"), F.col("role").alias("callee"))
    required = spark.createDataFrame([("user", "assistant"), ("user", "system")], "first string, second string")
    return logic.missing_pairs(c, required)


def l10_label_propagation(spark, sf_dir):
    seeds = spark.createDataFrame([("p7",), ("s3",)], "node string")
    return logic.propagate_label(_supply(spark, sf_dir).toDF("caller", "callee"), seeds)


def _taint(spark, sf_dir):
    named = lambda df, p, k: df.select(F.concat(F.lit(p), F.col(k)).alias("node"))
    t = lambda n: table(spark, sf_dir, n)
    return logic.taint(_supply(spark, sf_dir), named(t("supplier").where("s_suppkey <= 3"), "s", "s_suppkey"), named(t("part").where("p_size > 25"), "p", "p_partkey"), named(t("supplier").where("s_acctbal < 0"), "s", "s_suppkey"))


def l11_taint(spark, sf_dir):
    return _taint(spark, sf_dir)[0]


def l11_taint_violations(spark, sf_dir):
    return _taint(spark, sf_dir)[1]


def l1_datalog(spark, sf_dir):
    """Negation, recursion and comparison, through the rule language."""
    program = """
        moves(A, B) :- step(A, B), A \\= B.
        reach(A, B) :- moves(A, B).
        reach(A, C) :- moves(A, B), reach(B, C).
        state(A) :- step(A, _).
        state(B) :- step(_, B).
        never(A, B) :- state(A), state(B), \\+ reach(A, B).
        ok(A, B) :- reach(A, B), \\+ never(B, A).
    """
    steps = transitions(spark, sf_dir).distinct()
    known = datalog.evaluate(spark, datalog.parse(program), {"step/2": steps})
    return known["ok/2"].toDF("source", "target")


def c1_contradictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    key = ["l_suppkey", "l_returnflag", "l_linestatus"]
    return finite.contradictions(li.where("l_quantity > 49").select(key), li.where("l_quantity < 2").select(key))


def c2_access(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("principal"), F.col("l_returnflag").alias("action"), F.concat(F.lit("p"), F.col("l_partkey")).alias("resource"))
    return finite.can_access(p, "s1", "p1").withColumn("k", F.lit(1)).unionAll(finite.can_access(p, "s1", "nothing").withColumn("k", F.lit(2)))


def c3_config_difference(spark, sf_dir):
    return finite.differing_inputs(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.expr("p_size between 10 and 40"), F.expr("p_size >= 10 and p_size < 40 or p_size = 3")).select("p_partkey")


def c4_versions(spark, sf_dir):
    problem = finite.Problem(
        {"a": [1, 2, 3], "b": [1, 2, 3, 4], "c": [1, 2, 3]},
        {"dep": ("a < 2 or b >= 3", frozenset("ab")), "dep2": ("b < 3 or c >= 2", frozenset("bc")), "bad": ("not (c = 3 and a = 2)", frozenset("ac"))},
    )
    return finite.assignments(spark, problem)


def _packages(spark, sf_dir):
    """Twelve packages whose versions are the parts; each but the first depends on one of the others, as in a binary tree.

    Versions go together if large quantities of both parts are in one order.
    """
    side = lambda p: [F.concat(F.lit("p"), F.col(p) % 12).alias("package"), F.floor(F.col(p) / 12).alias("version")]
    candidates = table(spark, sf_dir, "part").select(*side("p_partkey"))
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_partkey")
    two = items.join(items.toDF("l_orderkey", "other_part"), "l_orderkey").where("l_partkey % 12 > 0 and other_part % 12 = floor((l_partkey % 12 - 1) / 2)")
    pairs = two.select(*side("l_partkey"), *(x.alias(n) for x, n in zip(side("other_part"), ("other", "other_version"))))
    return candidates, pairs


def c4_supported_versions(spark, sf_dir):
    return finite.supported(*_packages(spark, sf_dir))


def c4_choices(spark, sf_dir):
    return finite.choices(*_packages(spark, sf_dir), ["p0", "p1", "p2"])


def c5_schema_gaps(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("field")).agg(F.min("c_custkey").alias("min"), F.max("c_custkey").alias("max"))
    s = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey")).alias("field")).agg(F.min("s_suppkey").alias("min"), (F.max("s_suppkey") * 15).alias("max"))
    return finite.schema_gaps(c.withColumn("side", F.lit("a")).unionByName(s.withColumn("side", F.lit("b"))))


def c6_counterexamples(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    return finite.counterexamples(d, "l_quantity > 45", "l_extendedprice * (1 - l_discount) > 50000").select("l_orderkey", "l_linenumber")


def _machine(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = lambda c: F.concat_ws(":", F.col("o_orderstatus"), c)
    states = o.select(name("o_orderpriority").alias("state")).distinct()
    moves = o.join(o.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s2"), F.col("o_orderpriority").alias("p2"), F.col("o_orderkey").alias("o2")), (F.col("o_custkey") == F.col("k")) & (F.col("o2") == F.col("o_orderkey") + 1))
    return states, moves.select(name("o_orderpriority").alias("source"), F.concat_ws(":", "s2", "p2").alias("target")).distinct()


def c7_unreachable_states(spark, sf_dir):
    return finite.unreachable_states(*_machine(spark, sf_dir), "O:5-LOW")


def c7_dead_ends(spark, sf_dir):
    return finite.dead_ends(*_machine(spark, sf_dir))


def _sources(spark, sf_dir):
    """Files that import each other: part p imports, relative to its folder, part p + 1 by different spellings."""
    p = table(spark, sf_dir, "part")
    files = p.select(F.format_string("src/%s/m%d%s", F.regexp_replace("p_brand", "#", ""), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "/index.ts").when(F.col("p_partkey") % 3 == 1, ".ts").otherwise(".jsx")).alias("path"), F.col("p_partkey").alias("seq"))
    nxt = p.select((F.col("p_partkey") - 1).alias("k"), F.regexp_replace("p_brand", "#", "").alias("brand"))
    imports = p.join(nxt.hint("merge"), F.col("p_partkey") == F.col("k")).select(F.format_string("src/%s/main%d.ts", F.regexp_replace("p_brand", "#", ""), F.col("p_partkey")).alias("file"), F.lit("x").alias("name"), F.format_string("%s/%s/m%d", F.when(F.col("p_partkey") % 4 == 0, "@app").otherwise(".."), F.col("brand"), F.col("p_partkey") + 1).alias("source"))
    return files, imports


_SOURCES_SQL = """files AS (SELECT 'src/' || replace(p_brand, '#', '') || '/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.ts' ELSE '.jsx' END AS path, p_partkey AS k, replace(p_brand, '#', '') AS brand FROM part)"""


def j1_imports(spark, sf_dir):
    files, imports = _sources(spark, sf_dir)
    return resolve.resolve_imports(imports, files).select("file", "resolved")


def j4_aliased_imports(spark, sf_dir):
    files, imports = _sources(spark, sf_dir)
    aliases = spark.createDataFrame([("@app/", "src/"), ("@", "lib/")], "prefix string, target string")
    return resolve.resolve_imports(imports, files, aliases).select("file", "resolved")


def j2_suffix_index(spark, sf_dir):
    return resolve.suffix_index(_sources(spark, sf_dir)[0])


def j5_inherited_fields(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    extends = n.where("n_nationkey > 0").select(F.concat(F.lit("C"), F.col("n_nationkey")).alias("class_name"), F.concat(F.lit("C"), F.floor(F.col("n_nationkey") / 2)).alias("parent"))
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), F.col("s_nationkey")).alias("class_name"), F.concat(F.lit("f"), F.col("s_suppkey") % 4).alias("field"), F.col("s_name").alias("type"), F.col("s_suppkey").alias("seq"))
    return resolve.inherited(own, extends, "field", "type")


QUERIES = {k: v for k, v in globals().items() if len(k) > 2 and k[0] in "fskblcj" and k[1].isdigit()}
_LAYERS = "['handlers','routes','controllers','services','repositories','db','models','lib']"
_SQ = "'[' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ]+'"
ORACLE_SQL = {
    "f1_glob": "SELECT page_id FROM pages WHERE regexp_full_match(url, 'https://[^/]*/.*/[^/]*1[^/]*')",
    "f2_escape_atom": r"""SELECT c_custkey, '''' || replace(replace(replace(c_mktsegment || '''\' || chr(10) || c_name, '\', '\\'), '''', '\'''), chr(10), '\n') || '''' AS quoted,
        lower(regexp_replace(c_mktsegment || '''\' || chr(10) || c_name, '[^A-Za-z0-9]', '_', 'g')) AS bare, 'camelCase' || c_custkey AS camel FROM customer""",
    "f5_layer": f"SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN 'db' ELSE ({_LAYERS})[p_partkey % 8 + 1] END AS layer FROM part",
    "f7_truncate_doc": f"SELECT doc_id, CASE WHEN length(d) > 160 THEN substr(d, 1, 159) || '…' WHEN d <> '' THEN d END AS doc FROM (SELECT doc_id, trim(regexp_replace(text, {_SQ}, ' ', 'g')) AS d FROM documents)",
    "f8_format_tokens": "SELECT doc_id, CASE WHEN n >= 1000 THEN ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) || 'K' ELSE n::VARCHAR END AS tokens FROM (SELECT doc_id, ceil(length(text) / 3.5)::INT AS n FROM documents)",
    "f9_tokenize": f"SELECT item_id, (generate_subscripts(t, 1) - 1)::INT AS place, unnest(t) AS token FROM (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)",
    "f10_jaccard": f"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), {_SQ}), lambda x: x <> '')) AS w FROM benchmark)
        SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS similarity FROM w a JOIN w b ON a.item_id = b.item_id + 1""",
    "f11_norms": "SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN e])), 6) AS norm, round(list_dot_product(e, list_reverse(e)) / list_sum([x * x FOR x IN e]), 6) AS mirror FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    "f12_cohesion": "SELECT p_partkey, CASE WHEN m < 2 THEN 0.0 ELSE floor(p_size / (m * (m - 1) / 2) * 100 + 0.5) / 100 END::DOUBLE AS cohesion FROM (SELECT p_partkey, p_size, p_partkey % 9 AS m FROM part)",
    "f13_normalize_id": "SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(lower('-' || o_orderpriority || '--!x'), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS id FROM orders",
    "f22_common_segments": """WITH p AS (SELECT p_size % 5 AS g, string_split('src/g' || (p_size % 5) || '/a/' || CASE WHEN p_size % 5 < 3 THEN 'same' ELSE p_brand END || '/m' || p_partkey, '/') AS s FROM part), m AS (SELECT g, min(len(s)) AS n FROM p GROUP BY g),
        c AS (SELECT p.g, k, count(DISTINCT s[k]) AS d, min(s[k]) AS a FROM p JOIN m USING (g), range(1, 30) r(k) WHERE k <= m.n GROUP BY ALL)
        SELECT g, string_agg(a, '/' ORDER BY k) AS common FROM c WHERE k < coalesce((SELECT min(k) FROM c x WHERE x.g = c.g AND x.d > 1), 99) GROUP BY g""",
    "f23_snippet": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents",
    "f24_mock_embedding": "SELECT item_id, k::INT AS place, ('0x' || substr(sha256(text), (k % 32) * 2 + 1, 2))::INT / 128.0::DOUBLE - 1 AS value FROM benchmark, range(40) r(k)",
    "s3_language": "SELECT p_partkey, (["
    + ", ".join(f"'{v}'" for v in scalars.EXTENSIONS.values())
    + f", NULL, 'python'])[p_partkey % {len(scalars.EXTENSIONS) + 2} + 1] AS language FROM part",
    "s11_file_stats": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END::INT AS lines, ceil(length(text) / 3.5)::INT AS tokens FROM documents",
    "k1_content_hash": "SELECT doc_id, sha256(encode(text) || '\\x00'::BLOB || encode('doc/' || doc_id)) AS hash FROM documents",
    "k2_cache_hits": "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0",
    "k2_cache_misses": "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0",
    "k4_eviction": """SELECT path, size FROM (SELECT o_orderkey::VARCHAR AS path, trunc(o_totalprice)::BIGINT AS size,
        sum(trunc(o_totalprice)::BIGINT) OVER (ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC ROWS UNBOUNDED PRECEDING) AS upto FROM orders) WHERE upto <= 100000000""",
    "k10_cached_embeddings": "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 'hit' ELSE 'miss' END AS state FROM documents",
    "b1_bm25_idf": f"""WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
        SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf FROM t, n GROUP BY term, n""",
    "b3_bm25_search": f"""WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgl FROM d),
        tf AS (SELECT doc_id, len(t) AS l, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT unnest({TOKENS.format("'" + QUERY + "'")}) AS term)
        SELECT doc_id AS doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgl))), 6) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "b5_upsert": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_reverse(v) ELSE v END AS v FROM e WHERE vec_id % 3 <> 0 OR vec_id % 4 = 0)
        SELECT vec_id::VARCHAR AS id, round(v[1], 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM s""",
    "b6_nearest": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, [CASE WHEN k % 3 <> 0 THEN 1.0 ELSE -0.5 END::DOUBLE FOR k IN range(64)] AS q FROM embeddings)
        SELECT vec_id AS id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 9) AS score FROM e ORDER BY score DESC, id LIMIT 15""",
    "b7_search_corpus": """SELECT 'doc/' || doc_id || '#f' || doc_id || '#2' AS id,
        substr(concat_ws(chr(10), 'f' || doc_id, source, CASE WHEN lang = 'en' THEN lang END, array_to_string(list_slice(string_split(text, chr(10)), 2, 7), chr(10))), 1, 2000) AS text FROM documents WHERE doc_id % 2 = 0""",
    "l4_reaches": f"WITH RECURSIVE {SUPPLY}, r AS (SELECT dst AS node FROM flows WHERE src = 's1' UNION SELECT f.dst FROM r JOIN flows f ON f.src = r.node) SELECT node FROM r",
    "l4_simple_paths": """WITH RECURSIVE t AS (SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE source <> target)
, w AS (SELECT ['click'] AS p UNION ALL SELECT list_append(p, target) FROM w JOIN t ON source = p[-1] WHERE p[-1] <> 'purchase' AND NOT list_contains(p, target))
        SELECT array_to_string(p, '>') AS path FROM w WHERE p[-1] = 'purchase'""",
    "l7_neighbours": f"WITH {SUPPLY} SELECT dst FROM flows WHERE src = 's1'",
    "l8_permissions": """WITH RECURSIVE above AS (SELECT n_nationkey AS role, n_nationkey AS has FROM nation UNION SELECT role, (has // 2) FROM above WHERE has > 0)
        SELECT DISTINCT c_custkey AS user, 'read' AS action, s_nationkey || '/' || floor(s_acctbal / 1000)::BIGINT AS resource FROM customer JOIN above ON role = c_nationkey JOIN supplier ON s_nationkey = has""",
    "l9_missing_pairs": """WITH c AS (SELECT DISTINCT conv_id::VARCHAR AS func, role AS e FROM conversations), q(a, b) AS (VALUES ('user', 'assistant'), ('user', 'system'))
        SELECT DISTINCT func, b AS expected FROM c JOIN q ON e = a WHERE NOT EXISTS (FROM c x WHERE x.func = c.func AND x.e = q.b)""",
    "l10_label_propagation": f"WITH RECURSIVE {SUPPLY}, r AS (SELECT 'p7' AS node UNION SELECT 's3' UNION SELECT f.src FROM r JOIN flows f ON f.dst = r.node) SELECT node FROM r",
    "l1_datalog": """WITH RECURSIVE t AS (SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
        WHERE target IS NOT NULL), m AS (SELECT * FROM t WHERE source <> target), r AS (SELECT * FROM m UNION SELECT r.source, m.target FROM r JOIN m ON m.source = r.target)
        SELECT source, target FROM r WHERE EXISTS (FROM r x WHERE x.source = r.target AND x.target = r.source)""",
    "c1_contradictions": "SELECT l_suppkey, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity < 2",
    "c2_access": "SELECT count(*) > 0 AS reachable, 1 AS k FROM lineitem WHERE l_suppkey = 1 AND l_partkey = 1 UNION ALL SELECT false, 2",
    "c3_config_difference": "SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 40) <> (p_size >= 10 AND p_size < 40 OR p_size = 3)",
    "c4_versions": "SELECT a, b, c FROM range(1, 4) x(a), range(1, 5) y(b), range(1, 4) z(c) WHERE (a < 2 OR b >= 3) AND (b < 3 OR c >= 2) AND NOT (c = 3 AND a = 2)",
    "c5_schema_gaps": """WITH a AS (SELECT c_nationkey AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY n), b AS (SELECT s_nationkey AS n, min(s_suppkey) AS lo, max(s_suppkey) * 15 AS hi FROM supplier GROUP BY n)
        SELECT 'n' || n AS field, low, high, accepted_by FROM (
          SELECT a.n, a.lo AS low, least(b.lo - 1, a.hi) AS high, 'a' AS accepted_by FROM a JOIN b USING (n) WHERE a.lo < b.lo
          UNION ALL SELECT a.n, b.lo, least(a.lo - 1, b.hi), 'b' FROM a JOIN b USING (n) WHERE b.lo < a.lo
          UNION ALL SELECT a.n, greatest(b.hi + 1, a.lo), a.hi, 'a' FROM a JOIN b USING (n) WHERE a.hi > b.hi
          UNION ALL SELECT a.n, greatest(a.hi + 1, b.lo), b.hi, 'b' FROM a JOIN b USING (n) WHERE b.hi > a.hi)""",
    "c6_counterexamples": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND NOT l_extendedprice * (1 - l_discount) > 50000",
    "c7_unreachable_states": """WITH RECURSIVE m AS (SELECT DISTINCT a.o_orderstatus || ':' || a.o_orderpriority AS s, b.o_orderstatus || ':' || b.o_orderpriority AS t FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey = a.o_orderkey + 1),
        r AS (SELECT 'O:5-LOW' AS x UNION SELECT t FROM r JOIN m ON s = x) SELECT DISTINCT o_orderstatus || ':' || o_orderpriority AS state FROM orders WHERE o_orderstatus || ':' || o_orderpriority NOT IN (SELECT x FROM r)""",
    "c7_dead_ends": """WITH m AS (SELECT DISTINCT a.o_orderstatus || ':' || a.o_orderpriority AS s FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey = a.o_orderkey + 1)
        SELECT DISTINCT o_orderstatus || ':' || o_orderpriority AS state FROM orders WHERE o_orderstatus || ':' || o_orderpriority NOT IN (SELECT s FROM m)""",
    "j1_imports": f"WITH {_SOURCES_SQL} SELECT 'src/' || a.brand || '/main' || a.k || '.ts' AS file, CASE WHEN a.k % 4 <> 0 THEN b.path END AS resolved FROM files a JOIN files b ON b.k = a.k + 1",
    "j4_aliased_imports": f"WITH {_SOURCES_SQL} SELECT 'src/' || a.brand || '/main' || a.k || '.ts' AS file, b.path AS resolved FROM files a JOIN files b ON b.k = a.k + 1",
    "j2_suffix_index": f"""WITH {_SOURCES_SQL}, e AS (SELECT path, k, unnest([array_to_string(list_slice(string_split(path, '/'), j, 9), '/') FOR j IN range(1, len(string_split(path, '/')) + 1)]) AS e FROM files),
        v AS (SELECT path, k, e AS suffix FROM e UNION SELECT path, k, regexp_replace(e, '\\.[^./]+$', '') FROM e UNION SELECT path, k, regexp_replace(regexp_replace(e, '\\.[^./]+$', ''), '(^|/)index$', '') FROM e)
        SELECT suffix, min_by(path, k) AS path FROM v WHERE suffix <> '' GROUP BY suffix""",
    "j5_inherited_fields": """WITH RECURSIVE up AS (SELECT n_nationkey AS c, n_nationkey AS a, 0 AS d FROM nation UNION SELECT c, a // 2, d + 1 FROM up WHERE a > 0),
        own AS (SELECT s_nationkey AS c, 'f' || (s_suppkey % 4) AS field, max_by(s_name, s_suppkey) AS type FROM supplier GROUP BY ALL),
        r AS (SELECT up.c, field, type, up.a, row_number() OVER (PARTITION BY up.c, field ORDER BY d) AS k FROM up JOIN own ON own.c = up.a)
        SELECT 'C' || c AS class_name, field, type, 'C' || a AS owner FROM r WHERE k = 1""",
}
_TAINT_SQL = f"""WITH RECURSIVE {SUPPLY}, clean AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size > 25),
  r AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey <= 3 UNION SELECT f.dst FROM r JOIN flows f ON f.src = r.node WHERE r.node NOT IN (SELECT node FROM clean)) SELECT node FROM r"""
ORACLE_SQL["b6_nearest_to_each"] = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
  s AS (SELECT a.vec_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY score DESC))::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10"""
#: the tree of packages, from its leaves to the root and back, level by level
_LEVEL = "CASE WHEN {0} = 0 THEN 0 WHEN {0} < 3 THEN 1 WHEN {0} < 7 THEN 2 ELSE 3 END"
_PACKAGES_SQL = f"""WITH c AS (SELECT DISTINCT p_partkey % 12 AS k, p_partkey // 12 AS v FROM part),
  i AS (SELECT l_orderkey AS o, l_partkey % 12 AS k, l_partkey // 12 AS v FROM lineitem WHERE l_quantity > 25),
  pairs AS (SELECT DISTINCT a.k, a.v, b.k AS k2, b.v AS v2 FROM i a JOIN i b USING (o) WHERE a.k > 0 AND b.k = (a.k - 1) // 2),
  ties AS (SELECT DISTINCT k, k2 FROM pairs),
  up3 AS (SELECT * FROM c WHERE {_LEVEL.format("k")} = 3),
  """ + ",\n  ".join(
    f"""met{n} AS (SELECT x.k2 AS k, x.v2 AS v, count(DISTINCT x.k) AS n FROM pairs x JOIN up{n + 1} y ON y.k = x.k AND y.v = x.v GROUP BY ALL),
  up{n} AS (SELECT c.k, c.v FROM c LEFT JOIN met{n} USING (k, v) WHERE {_LEVEL.format("c.k")} = {n} AND coalesce(n, 0) = (SELECT count(*) FROM ties WHERE ties.k2 = c.k))"""
    for n in (2, 1, 0)
) + ",\n  down0 AS (SELECT k, v FROM up0),\n  " + ",\n  ".join(
    f"down{n} AS (SELECT u.k, u.v FROM up{n} u WHERE u.k NOT IN (SELECT k FROM ties) OR EXISTS (FROM pairs x JOIN down{n - 1} y ON y.k = x.k2 AND y.v = x.v2 WHERE x.k = u.k AND x.v = u.v))" for n in (1, 2, 3)
)
ORACLE_SQL["c4_supported_versions"] = _PACKAGES_SQL + " SELECT 'p' || k AS package, v AS version FROM (" + " UNION ALL ".join(f"SELECT k, v FROM down{n}" for n in range(4)) + ")"
ORACLE_SQL["c4_choices"] = _PACKAGES_SQL + """ SELECT r.v AS p0, a.v AS p1, b.v AS p2 FROM down0 r JOIN pairs a ON a.k = 1 AND a.v2 = r.v JOIN pairs b ON b.k = 2 AND b.v2 = r.v
  WHERE a.v IN (SELECT v FROM down1 WHERE k = 1) AND b.v IN (SELECT v FROM down1 WHERE k = 2)"""
ORACLE_SQL["b2_stored_idf"] = ORACLE_SQL["b1_bm25_idf"]
ORACLE_SQL["b3_stored_search"] = ORACLE_SQL["b3_bm25_search"]
ORACLE_SQL["l11_taint"] = _TAINT_SQL
ORACLE_SQL["l11_taint_violations"] = _TAINT_SQL + " WHERE node IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)"
ORACLE_SQL["b10_near_duplicates"] = f"""WITH top AS ({ORACLE_SQL["b3_bm25_search"].replace("'" + QUERY + "'", "(SELECT text FROM documents WHERE doc_id = 7)").replace("LIMIT 20", "LIMIT 3")}),
  w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), {_SQ}), lambda x: x <> '')) AS w FROM documents)
  SELECT a.doc_id AS id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS similarity FROM top JOIN w a ON a.doc_id = top.doc, w b
  WHERE b.doc_id = 7 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.7"""
