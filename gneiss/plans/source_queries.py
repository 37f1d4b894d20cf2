"""Source files written from the driver's tables and parsed again, cached extraction, snapshots, templates solved with tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import datalog, finite, graph, resolve, retrieval
from gneiss.operators.fixpoint import shared_dir
from gneiss.operators.templates import RELATED, Library, fill, starters
from gneiss.plans.graph_queries import ORACLE_SQL as GRAPH_SQL
from gneiss.plans.graph_queries import TRADE, halves
from gneiss.sources import extract
from gneiss.sources.bindings import hierarchy, table, trade
from gneiss.sources.cache import ExtractionCache
from gneiss.sources.extract.model import FileFacts
from gneiss.sources.facts import CodeGraph
from gneiss.streaming import incremental

TYPESCRIPT = """/** Supplier {k}. */
import { load{n} as pull } from './base{n}';
export class S{k} extends Base{n} {
  private db: Repo{k};
  get(id: number): string { return this.db.find(id) + pull(id); }
}
export function make{k}(x: S{k}): void { x.get({n}); low{k}(); }
function low{k}() { return "make() // {n}"; }
class Repo{k} { find(id: number) { return id; } }
"""
BASE = """export class Base{k} { open() { return load{k}(); } }
export function load{k}(x?: number) { return x; }
"""
PYTHON = '''"""Customer {k}."""
from lib.n{n} import load as pull
import os

class C{k}(Base):
    def run(self, x: int) -> int:
        return pull(x) + self.low(x)

    def low(self, x):
        return os.getpid()

async def main{k}(x=1):
    return apply(handler{k}, x)

def handler{k}(x):
    return C{k}()
'''
GO = """// Package s{k} sells.
package s{k}

import (
	"fmt"
	"example.com/n{n}/db"
)

type Shop{k} struct { id int }

func (s *Shop{k}) Run(x int) error { fmt.Println(low{k}(x), "get()"); return db.Open{n}() }

func low{k}(x int) int { return x }
"""
CLOJURE = """(ns shop.s{k} "Supplier {k}." (:require [shop.n{n} :as n]))
(def limit {k})
(defn handler [req] (-> req clean n/query))
(defn- clean [x] (inc (helper x)))
(defn helper [xs] (reduce add 0 (map clean xs)))
(defn pipe [] (comp clean n/save))
"""


def _files(rows: DataFrame, path: str, text: str, key: str, other: str | None = None) -> DataFrame:
    """A file (path, content) for each row: {k} and {n} of both templates stand for the row's key and its other key."""
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{k}"), F.col(key).cast("string")), F.lit("{n}"), F.col(other or key).cast("string"))
    return rows.select(filled(path).alias("path"), filled(text).alias("content"))


def _facts(g: CodeGraph) -> DataFrame:
    """All relations as (relation, file, a, b, c, n)."""

    def of(df: DataFrame, relation: str, file: str | None, a: str, b: str | None = None, c: str | None = None, n: str | None = None) -> DataFrame:
        text = lambda x: F.lit(None).cast("string") if x is None else F.col(x)
        return df.select(F.lit(relation).alias("relation"), text(file).alias("file"), F.col(a).alias("a"), text(b).alias("b"), text(c).alias("c"), (F.col(n) if n else F.lit(None)).cast("int").alias("n"))

    return (
        of(g.defines, "define", "file", "name", "kind", "signature", "line")
        .unionAll(of(g.calls, "call", None, "caller", "callee", "callee_qn"))
        .unionAll(of(g.imports, "import", "file", "name", "source", "resolved"))
        .unionAll(of(g.exports, "export", "file", "name"))
        .unionAll(of(g.contains, "contain", None, "parent", "child"))
        .unionAll(of(g.files, "file", "path", "language", "file_doc", None, "line_count"))
    )


def _script_files(spark, sf_dir) -> DataFrame:
    own = _files(table(spark, sf_dir, "supplier"), "src/s{k}.ts", TYPESCRIPT, "s_suppkey", "s_nationkey")
    return own.unionAll(_files(table(spark, sf_dir, "nation"), "src/base{k}.ts", BASE, "n_nationkey"))


def s5_script_facts(spark, sf_dir):
    """Aliased imports, receivers typed by a field and by a parameter, exports, strings that look like code."""
    return _facts(extract.extract(_script_files(spark, sf_dir)))


def s6_python_facts(spark, sf_dir):
    return _facts(extract.extract(_files(table(spark, sf_dir, "customer"), "pkg/c{k}.py", PYTHON, "c_custkey", "c_nationkey")))


def s7_go_facts(spark, sf_dir):
    return _facts(extract.extract(_files(table(spark, sf_dir, "supplier"), "go/s{k}.go", GO, "s_suppkey", "s_nationkey")))


def s8_clojure_facts(spark, sf_dir):
    """Threading, functions that call their first or all arguments, private definitions, aliases of namespaces."""
    return _facts(extract.extract(_files(table(spark, sf_dir, "supplier"), "shop/s{k}.clj", CLOJURE, "s_suppkey", "s_nationkey")))


def ledger_parser(path: str, text: str) -> FileFacts:
    """An adapter's parser: one name a line is a function, and calls the name before it."""
    f = FileFacts(path)
    names = text.split()
    for line, name in enumerate(names, 1):
        f.define(name, "function", line)
        f.call(name, names[line - 2] if line > 1 else None)
    return f


def s18_adapter_facts(spark, sf_dir):
    extract.register_adapter("ledger", (".ledger",), ledger_parser)
    try:
        return _facts(extract.extract(_files(table(spark, sf_dir, "orders"), "o{k}.ledger", "c{n}\no{k}\n", "o_orderkey", "o_custkey")))
    finally:
        extract.clear_adapters()


def k3_cached_facts(spark, sf_dir):
    """Files of nations and even suppliers are in the cache; the others, and one nation whose file has changed, are parsed."""
    from gneiss.engine import Engine

    e = Engine(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}")
    e.facts_of(_script_files(spark, sf_dir).where("path rlike 'base|[02468][.]ts$'"))
    now = F.when(F.col("path") == "src/base7.ts", "export function other() { load7(); }\n").otherwise(F.col("content"))
    out = _facts(e.facts_of(_script_files(spark, sf_dir).withColumn("content", now)))
    e.cache.clear()
    return out


def k2_parsed_again(spark, sf_dir):
    """Two saves, for which the budget is too small by the last eight files of the first: those have to be parsed again."""
    files = _files(table(spark, sf_dir, "nation"), "src/base{k}.ts", BASE, "n_nationkey")
    short, long = (len(BASE.replace("{k}", k)) for k in ("1", "11"))
    cache = ExtractionCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", budget=10 * short + 7 * long)
    for some in (files.where(F.length("path") == 13), files.where(F.length("path") == 12)):
        cache.save(some, extract.parse(some))
    again = cache.rows_of(files)[1].select("path").collect()
    cache.clear()
    return spark.createDataFrame(again, "path string")


def k6_snapshot_diff(spark, sf_dir):
    """A snapshot without the exports, replaced once, against now."""
    g = hierarchy(spark, sf_dir)
    cache = ExtractionCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}")
    cache.save_snapshot("before", g)
    cache.save_snapshot("before", g.with_(exports=g.exports.where("false")))
    return graph.diff(cache.load_snapshot("before"), g).select("change", "entity", "key")


def k6_snapshot_trees(spark, sf_dir):
    """Orders of two overlapping periods as two snapshots, compared by their digest trees."""
    cache = ExtractionCache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}")
    for name, g in zip(("before", "after"), halves(spark, sf_dir)):
        cache.save_snapshot(name, g)
    return cache.diff_snapshots("before", "after")


USER = """export class U{k} extends T{n} {
  run{k}(x: number) { return this.db.find(x); }
}
"""
TYPE = """export class T{k} { private db: R{k}{n}; }
class R{k}{n} { find(x: number) { return x; } }
"""


def j8_streamed_calls(spark, sf_dir):
    """Three batches of a stream: a file for each user of a batch, whose class extends that of the user's last event in it.

    The second batch changes the files of types with names of even length, and with them the calls of users it doesn't name.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = table(spark, sf_dir, "events").groupBy(F.expr("event_id % 3").alias("batch"), "user_id").agg(F.max_by("event_type", "event_id").alias("type"))
    types = table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("batch")).where("batch = 0 or length(event_type) % 2 = 0")
    for batch in range(3):
        files = _files(last.where(F.col("batch") == batch), "src/u{k}.ts", USER, "user_id", "type").unionAll(_files(types.where(F.col("batch") == batch), "src/t{k}.ts", TYPE, "event_type", "batch"))
        files.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("path string, content string").parquet(f"{at}/in")
        incremental.follow(stream, ExtractionCache(spark, f"{at}/cache"), f"{at}/out", f"{at}/progress").awaitTermination()
    return incremental.latest(spark, f"{at}/out").calls.select("caller", "callee", "callee_qn")


def f25_diff_text(spark, sf_dir):
    g = hierarchy(spark, sf_dir)
    return spark.createDataFrame([(graph.diff_summary(graph.diff(g.with_(exports=g.exports.where("false")), g)),)], "text string")


def k9_vector_store(spark, sf_dir):
    """Vectors that were saved and loaded."""
    at = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    retrieval.save_vectors(rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), at)
    return retrieval.load_vectors(spark, at).select("id", F.size("vector").alias("d"), F.round("norm", 6).alias("norm"))


def _template(name: str, **values: str) -> str:
    skeleton, slots = next((x[4], x[5]) for x in starters() if x[0] == name)
    return fill(skeleton, {s[0]: "" for s in slots} | values)


def _derived(spark, program: str, key: str, relations: dict[str, DataFrame]) -> DataFrame:
    return datalog.evaluate(spark, datalog.parse(program), relations, {key})[key]


def s16_association_rule(spark, sf_dir):
    """The template's rules: orders with a line of one flag of a pair without the other."""
    calls = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.col("l_returnflag").alias("b")).distinct()
    pairs = spark.createDataFrame([("R", "N"), ("A", "R")], "a string, b string")
    return _derived(spark, _template("association-rule-check"), "unpaired/3", {"calls/2": calls, "paired/2": pairs}).toDF("who", "a", "b")


def s16_taint(spark, sf_dir):
    """Nations' trade, from the nations of Europe; it reaches multiples of six and goes no further there; odd ones are sinks."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), "n_nationkey", "n_regionkey")
    flow = trade(spark, sf_dir).edges().toDF("a", "b")
    given = {"flow/2": flow, "source/1": nation.where("n_regionkey = 3").select("a"), "sanitizer/1": nation.where("n_nationkey % 6 = 0").select("a"), "sink/1": nation.where("n_nationkey % 2 = 1").select("a")}
    return _derived(spark, _template("taint-propagation"), "violation/1", given).toDF("node")


def s16_permissions(spark, sf_dir):
    """Customers hold their nation's role; each nation's role is above that of the next in its region; roles grant suppliers."""
    customer, nation, supplier = (table(spark, sf_dir, n) for n in ("customer", "nation", "supplier"))
    below = nation.alias("x").join(nation.alias("y"), F.expr("x.n_regionkey = y.n_regionkey and y.n_nationkey > x.n_nationkey")).groupBy(F.expr("'r' || x.n_nationkey as a")).agg(F.expr("'r' || min(y.n_nationkey) as b"))
    given = {
        "has_role/2": customer.where("c_mktsegment = 'BUILDING'").selectExpr("'c' || c_custkey as a", "'r' || c_nationkey as b"),
        "above/2": below,
        "grants/3": supplier.selectExpr("'r' || s_nationkey as a", "if(s_acctbal > 0, 'pay', 'ask') as b", "'region' || s_nationkey % 5 as c").distinct(),
    }
    return _derived(spark, _template("permission-derivation"), "may/3", given).toDF("who", "action", "what")


def c9_templates_solved(spark, sf_dir):
    """Each constraint template filled in, and what is found: a status, and the model where there is just one."""
    kinds = "(declare-datatypes ((Who 0) (Do 0) (What 0)) (((ann) (bob)) ((read) (write)) ((doc) (log))))"
    access = dict(type_declarations=kinds, principal_type="Who", action_type="Do", resource_type="What")
    numbers = "(declare-const x Int)\n(assert (and (>= x 0) (<= x 9)))"
    specs = {
        "policy-contradiction": _template("policy-contradiction", **access, allow_rules="(and (= principal bob) (not (= action read)))", deny_rules="(= resource log)"),
        "policy-reachability": _template("policy-reachability", **access, target_principal="ann", target_resource="doc", policies="(and (= principal bob) (= action read))"),
        "config-equivalence": _template("config-equivalence", declarations=numbers, config_a="(< x 5)", config_b="(<= x 5)"),
        "constraint-satisfaction": _template("constraint-satisfaction", declarations="(declare-const a Int)\n(declare-const b Int)", domains="(and (>= a 1) (<= a 3) (>= b 1) (<= b 3))", requirements="(> a b)", conflicts="(or (= a 3) (= b 3))"),
        "schema-consistency": _template("schema-consistency", declarations=numbers, schema_a="(> x 3)", schema_b="(> x 2)"),
        "invariant-check": _template("invariant-check", inputs=numbers, outputs="(declare-const y Int)\n(assert (and (>= y 0) (<= y 81)))", body="(= y (* x x))", precondition="(> x 1)", postcondition="(or (not (= y 9)))"),
        "state-machine-deadlock": _template("state-machine-deadlock", states="(declare-datatypes ((St 0)) (((new) (paid) (sent))))", state_type="St", transitions="(or (and (= here new) (= next paid)) (and (= here paid) (= next sent)))", from_state="new", to_state="sent"),
        "boundary-condition": _template("boundary-condition", declarations="(declare-const n Int)\n(assert (and (>= n 0) (<= n 4)))", index_type="Int", expression="(+ n 1)", guard="(and (>= index 0) (<= index 9))", violation="(> index 4)"),
    }
    rows = []
    for name, spec in specs.items():
        found = finite.solve_smtlib(spark, spec)
        rows.append((name, found["status"], ",".join(f"{k}={v}" for k, v in sorted((found.get("model") or {}).items()))))
    return spark.createDataFrame(rows, "template string, status string, model string")


PROGRAM = "reach(X, Y) :- edge(X, Y).\nreach(X, Z) :- edge(X, Y), reach(Y, Z).\nback(X) :- reach(X, X)."


def l2_batch(spark, sf_dir):
    """Several queries on one evaluation."""
    asked = ["reach(n0, X)", "back(X)", "edge(n3, n99)", "reach(X, n1), edge(n1, X)"]
    found = datalog.solve_all(spark, PROGRAM, asked, {"edge/2": trade(spark, sf_dir).edges().toDF("a", "b")})
    return spark.createDataFrame([(q, a["formatted"]) for q, x in zip(asked, found) for a in x["answers"]], "query string, answer string")


def l3_explain(spark, sf_dir):
    """What is derived on the way to an answer."""
    found = datalog.solve(spark, "two(X, Z) :- edge(X, Y), edge(Y, Z).\nround(X) :- two(X, X).", "round(X)", {"edge/2": trade(spark, sf_dir).edges().toDF("a", "b")}, explain=True)
    return spark.createDataFrame([(x,) for x in found["trace"]], "fact string")


def w1_templates(spark, sf_dir):
    return Library.create(spark).templates.select("name", "domain", "solver", F.size("slots").alias("slots"))


def j10_related(spark, sf_dir):
    library = Library.create(spark)
    return spark.createDataFrame([(a, b) for a in RELATED for b in library.related(a)], "name string, related string")


def s13_inherited_call_targets(spark, sf_dir):
    """Receivers of a chain of two fields, the second one inherited."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit("this"), F.lit("shop"), F.concat(F.lit("f"), F.col("o_custkey") % 3)).alias("receiver_chain"), F.concat(F.lit("O"), F.col("o_custkey") % 5).alias("enclosing_class"), F.create_map().cast("map<string,string>").alias("var_types"))
    shops = table(spark, sf_dir, "region").selectExpr("'O' || r_regionkey as class_name", "'shop' as field", "'N' || r_regionkey as type", "0L as seq")
    own = table(spark, sf_dir, "nation").where("n_nationkey >= 5").selectExpr("'N' || n_nationkey as class_name", "'f' || n_nationkey % 3 as field", "n_name as type", "cast(n_nationkey as bigint) as seq")
    extends = table(spark, sf_dir, "nation").where("n_nationkey < 20").selectExpr("'N' || n_nationkey as class_name", "'N' || (n_nationkey + 5) as parent")
    fields = resolve.inherited(shops.unionByName(own), extends, "field", "type")
    return resolve.resolve_chains(o, fields).select("o_orderkey", "type")


QUERIES = {k: v for k, v in globals().items() if len(k) > 2 and k[0] in "sklfcwj" and k[1].isdigit()}
_K, _N = "s_suppkey", "s_nationkey"


def _rows(source: str, *rows: tuple) -> str:
    """SELECTs over a table: each row is (relation, file, a, b, c, n) in SQL, where @ stands for ' || key || '."""
    keys = {"supplier": (_K, _N), "nation": ("n_nationkey", "n_nationkey"), "customer": ("c_custkey", "c_nationkey"), "orders": ("o_orderkey", "o_custkey")}[source]
    text = lambda x: "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''").replace("@k", f"' || {keys[0]} || '").replace("@n", f"' || {keys[1]} || '") + "'"
    return " UNION ALL ".join(f"SELECT {text(r)} AS relation, {text(f)} AS file, {text(a)} AS a, {text(b)} AS b, {text(c)} AS c, {'NULL' if n is None else n}::INT AS n FROM {source}" for r, f, a, b, c, n in rows)


_TS, _BASE = "src/s@k.ts", "src/base@k.ts"
_SCRIPT = _rows(
    "supplier",
    ("define", _TS, "S@k", "class", None, 3),
    ("define", _TS, "get", "method", "get(id: number): string", 5),
    ("define", _TS, "make@k", "function", "function make@k(x: S@k): void", 7),
    ("define", _TS, "low@k", "function", "function low@k()", 8),
    ("define", _TS, "Repo@k", "class", None, 9),
    ("define", _TS, "find", "method", "find(id: number)", 9),
    ("call", None, "get", "find", "Repo@k.find", None),
    ("call", None, "get", "load@n", None, None),
    ("call", None, "make@k", "get", "S@k.get", None),
    ("call", None, "make@k", "low@k", None, None),
    ("import", _TS, "load@n", "./base@n", "src/base@n.ts", None),
    ("export", _TS, "S@k", None, None, None),
    ("export", _TS, "make@k", None, None, None),
    ("contain", None, "S@k", "get", None, None),
    ("contain", None, "Repo@k", "find", None, None),
    ("file", _TS, "typescript", "Supplier @k.", None, 9),
)
_BASES = _rows(
    "nation",
    ("define", _BASE, "Base@k", "class", None, 1),
    ("define", _BASE, "open", "method", "open()", 1),
    ("define", _BASE, "load@k", "function", "function load@k(x?: number)", 2),
    ("call", None, "open", "load@k", None, None),
    ("export", _BASE, "Base@k", None, None, None),
    ("export", _BASE, "load@k", None, None, None),
    ("contain", None, "Base@k", "open", None, None),
    ("file", _BASE, "typescript", None, None, 2),
)
_OTHER = _rows(
    "nation",
    ("define", _BASE, "other", "function", "function other()", 1),
    ("call", None, "other", "load@k", None, None),
    ("export", _BASE, "other", None, None, None),
    ("file", _BASE, "typescript", None, None, 1),
).replace("FROM nation", "FROM nation WHERE n_nationkey = 7")
_PY, _GO, _CLJ = "pkg/c@k.py", "go/s@k.go", "shop/s@k.clj"
_clojure_call = lambda a, b: ("call", None, f"shop.s@k/{a}", b, None, None)
ORACLE_SQL = {
    "s5_script_facts": f"{_SCRIPT} UNION ALL {_BASES}",
    "k3_cached_facts": f"{_SCRIPT} UNION ALL {_BASES.replace('FROM nation', 'FROM nation WHERE n_nationkey <> 7')} UNION ALL {_OTHER}",
    "s6_python_facts": _rows(
        "customer",
        ("define", _PY, "C@k", "class", None, 5),
        ("define", _PY, "run", "method", "def run(self, x: int) -> int", 6),
        ("define", _PY, "low", "method", "def low(self, x)", 9),
        ("define", _PY, "main@k", "function", "def main@k(x=1)", 12),
        ("define", _PY, "handler@k", "function", "def handler@k(x)", 15),
        ("call", None, "run", "load", None, None),
        ("call", None, "run", "low", "C@k.low", None),
        ("call", None, "low", "getpid", None, None),
        ("call", None, "main@k", "apply", None, None),
        ("call", None, "main@k", "handler@k", None, None),
        ("call", None, "handler@k", "C@k", None, None),
        ("import", _PY, "load", "lib.n@n", None, None),
        ("import", _PY, "os", "os", None, None),
        ("contain", None, "C@k", "run", None, None),
        ("contain", None, "C@k", "low", None, None),
        ("file", _PY, "python", "Customer @k.", None, 16),
    ),
    "s7_go_facts": _rows(
        "supplier",
        ("define", _GO, "Shop@k", "class", None, 9),
        ("define", _GO, "Run", "method", "func (s *Shop@k) Run(x int) error", 11),
        ("define", _GO, "low@k", "function", "func low@k(x int) int", 13),
        ("call", None, "Run", "Println", None, None),
        ("call", None, "Run", "low@k", None, None),
        ("call", None, "Run", "Open@n", None, None),
        ("import", _GO, "fmt", "fmt", None, None),
        ("import", _GO, "db", "example.com/n@n/db", None, None),
        ("export", _GO, "Shop@k", None, None, None),
        ("export", _GO, "Run", None, None, None),
        ("contain", None, "Shop@k", "Run", None, None),
        ("file", _GO, "go", "Package s@k sells.", None, 13),
    ),
    "s8_clojure_facts": _rows(
        "supplier",
        ("define", _CLJ, "shop.s@k/limit", "variable", None, 2),
        ("define", _CLJ, "shop.s@k/handler", "function", "(defn handler [req])", 3),
        ("define", _CLJ, "shop.s@k/clean", "function", "(defn- clean [x])", 4),
        ("define", _CLJ, "shop.s@k/helper", "function", "(defn helper [xs])", 5),
        ("define", _CLJ, "shop.s@k/pipe", "function", "(defn pipe [])", 6),
        _clojure_call("handler", "shop.s@k/clean"),
        _clojure_call("handler", "shop.n@n/query"),
        _clojure_call("clean", "inc"),
        _clojure_call("clean", "shop.s@k/helper"),
        _clojure_call("helper", "reduce"),
        _clojure_call("helper", "add"),
        _clojure_call("helper", "map"),
        _clojure_call("helper", "shop.s@k/clean"),
        _clojure_call("pipe", "comp"),
        _clojure_call("pipe", "shop.s@k/clean"),
        _clojure_call("pipe", "shop.n@n/save"),
        ("import", _CLJ, "shop.n@n", "shop.n@n", None, None),
        *(("export", _CLJ, f"shop.s@k/{x}", None, None, None) for x in ("limit", "handler", "helper", "pipe")),
        ("file", _CLJ, "clojure", "Supplier @k.", None, 6),
    ),
    "s18_adapter_facts": _rows(
        "orders",
        ("define", "o@k.ledger", "c@n", "function", None, 1),
        ("define", "o@k.ledger", "o@k", "function", None, 2),
        ("call", None, "o@k", "c@n", None, None),
        ("file", "o@k.ledger", "ledger", None, None, 2),
    ),
    "k2_parsed_again": "SELECT 'src/base' || n_nationkey || '.ts' AS path FROM nation WHERE n_nationkey BETWEEN 10 AND 17",
    "k6_snapshot_diff": "SELECT 'added' AS change, 'export' AS entity, 'src/services/' || lower(c_mktsegment) || '.ts' || chr(9) || 'customer/' || c_custkey AS key FROM customer WHERE c_acctbal > 0",
    "k6_snapshot_trees": GRAPH_SQL["g14_diff"],
    "j8_streamed_calls": """WITH last AS (SELECT event_id % 3 AS batch, user_id, arg_max(event_type, event_id) AS type FROM events GROUP BY ALL),
        now AS (SELECT user_id, arg_max(type, batch) AS type FROM last GROUP BY user_id)
        SELECT 'run' || user_id AS caller, 'find' AS callee, 'R' || type || CASE WHEN length(type) % 2 = 0 THEN '1' ELSE '0' END || '.find' AS callee_qn FROM now""",
    "f25_diff_text": "SELECT count(*) || ' new exports' AS text FROM customer WHERE c_acctbal > 0",
    "k9_vector_store": "SELECT vec_id::VARCHAR AS id, len(e) AS d, round(sqrt(list_sum([x * x FOR x IN e])), 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)",
    "s16_association_rule": """WITH p(a, b) AS (VALUES ('R', 'N'), ('A', 'R'))
        SELECT DISTINCT 'o' || l_orderkey AS who, a, b FROM lineitem l JOIN p ON l_returnflag = a WHERE NOT EXISTS (FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = b)""",
    "s16_taint": f"""WITH RECURSIVE {TRADE}, t(node) AS (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 3
          UNION SELECT callee FROM t JOIN edges ON caller = node WHERE substr(node, 2)::INT % 6 <> 0)
        SELECT node FROM t WHERE substr(node, 2)::INT % 2 = 1""",
    "s16_permissions": """WITH RECURSIVE above AS (SELECT x.n_nationkey AS a, min(y.n_nationkey) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey > x.n_nationkey GROUP BY 1),
        holds(who, r) AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT who, b FROM holds JOIN above ON a = r)
        SELECT DISTINCT 'c' || who AS who, CASE WHEN s_acctbal > 0 THEN 'pay' ELSE 'ask' END AS action, 'region' || s_nationkey % 5 AS what FROM holds JOIN supplier ON s_nationkey = r""",
    "c9_templates_solved": """SELECT * FROM (VALUES ('policy-contradiction', 'sat', 'action=write,principal=bob,resource=log'), ('policy-reachability', 'unsat', ''), ('config-equivalence', 'sat', 'x=5'),
        ('constraint-satisfaction', 'sat', 'a=2,b=1'), ('schema-consistency', 'unsat', ''), ('invariant-check', 'sat', 'x=3,y=9'), ('state-machine-deadlock', 'unsat', ''), ('boundary-condition', 'sat', 'index=5,n=4')) v(template, status, model)""",
    "l2_batch": f"""WITH RECURSIVE {TRADE}, r(a, b) AS (SELECT caller, callee FROM edges UNION SELECT a, callee FROM r JOIN edges ON caller = b)
        SELECT 'reach(n0, X)' AS query, 'X = ' || b AS answer FROM r WHERE a = 'n0' UNION ALL SELECT 'back(X)', 'X = ' || a FROM r WHERE a = b
        UNION ALL SELECT 'reach(X, n1), edge(n1, X)', 'X = ' || a FROM r JOIN edges ON caller = 'n1' AND callee = a WHERE b = 'n1'""",
    "l3_explain": f"""WITH {TRADE}, two AS (SELECT DISTINCT x.caller AS a, y.callee AS b FROM edges x JOIN edges y ON x.callee = y.caller)
        SELECT 'two(' || a || ', ' || b || ')' AS fact FROM two UNION ALL SELECT 'round(' || a || ')' FROM two WHERE a = b""",
    "w1_templates": "SELECT * FROM (VALUES " + ", ".join(f"('{x[0]}', '{x[1]}', '{x[2]}', {len(x[5])})" for x in starters()) + ") v(name, domain, solver, slots)",
    "j10_related": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in RELATED.items() for b in bs) + ") v(name, related)",
    "s13_inherited_call_targets": """WITH RECURSIVE up(c, p, depth) AS (SELECT r_regionkey, r_regionkey, 0 FROM region UNION ALL SELECT c, p + 5, depth + 1 FROM up WHERE p < 20),
        fields AS (SELECT c, n_nationkey % 3 AS f, arg_min(n_name, depth) AS type FROM up JOIN nation ON n_nationkey = p WHERE p >= 5 GROUP BY ALL)
        SELECT o_orderkey, type FROM orders LEFT JOIN fields ON c = o_custkey % 5 AND f = o_custkey % 3""",
}
