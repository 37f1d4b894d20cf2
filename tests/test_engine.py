"""Sources, resolution, rules, constraints, retrieval, catalog, and the query surface."""

import pytest
from pyspark.sql import functions as F

from gneiss.engine import Engine
from gneiss.functions import scalars
from gneiss.operators import datalog, finite, resolve, retrieval
from gneiss.operators.lint import lint_column, lint_spec
from gneiss.operators.templates import RELATED, Correction, Library, starters
from gneiss.plans.review import review_plan
from gneiss.sources import cache, extract, mermaid
from gneiss.sources.config import strip_jsonc, tsconfig_aliases

SOURCES = [
    ("src/server.ts", "/** Serves. */\nimport { query as ask } from './db';\nimport { Repo } from '@app/repo';\nexport class Server extends Base {\n  private repo: Repo;\n  handle(x: Request) { this.repo.find(x); ask(); helper(); }\n}\nfunction helper() {}\nexport function main() { process.on('x', helper); }\n"),
    ("src/db.ts", "export function query() { return connect(); }\nfunction connect() {}\n"),
    ("src/repo/index.ts", "export class Repo { find(x: number) { return x; } }\n"),
    ("src/other.ts", "export class Other { find() {} }\n"),
    ("tool.py", '"""Tool."""\nimport os\n\nclass A:\n    def run(self, x: int) -> int:\n        return helper(x)\n\ndef helper(x):\n    return os.path.join(x)\n'),
    ("main.go", 'package main\nimport "fmt"\ntype T struct {}\nfunc (t *T) Run() { fmt.Println(low()) }\nfunc low() int { return 1 }\n'),
    ("core.clj", "(ns app.core (:require [app.db :as db]))\n(defn handler [req] (-> req clean (db/query)))\n(defn- clean [x] x)\n"),
    ("notes.txt", "nothing"),
]


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame(SOURCES, "path string, content string")
    return extract.extract(files, spark.createDataFrame([("@app/", "src/")], "prefix string, target string"))


def pairs(df, *columns):
    return {tuple(x[c] for c in columns) for x in df.collect()}


def test_extraction(facts):
    assert {("Server", "class"), ("handle", "method"), ("helper", "function"), ("main", "function"), ("A", "class"), ("run", "method"), ("T", "class"), ("Run", "method"), ("low", "function"), ("app.core/handler", "function")} <= pairs(facts.defines, "name", "kind")
    calls = pairs(facts.calls, "caller", "callee")
    assert {("handle", "find"), ("handle", "query"), ("handle", "helper"), ("main", "on"), ("main", "helper"), ("query", "connect"), ("run", "helper"), ("helper", "join"), ("Run", "Println"), ("Run", "low")} <= calls
    assert {("app.core/handler", "app.core/clean"), ("app.core/handler", "app.db/query")} <= calls
    assert ("handle", "ask") not in calls
    assert {("Server", "handle"), ("A", "run"), ("T", "Run")} <= pairs(facts.contains, "parent", "child")
    exports = pairs(facts.exports, "name")
    assert {("Server",), ("main",), ("Run",), ("app.core/handler",)} <= exports and ("app.core/clean",) not in exports and ("helper",) not in exports
    assert {("query", "./db", "src/db.ts"), ("Repo", "@app/repo", "src/repo/index.ts"), ("os", "os", None)} <= pairs(facts.imports, "name", "source", "resolved")
    assert ("handle", "find", "Repo.find") in pairs(facts.calls, "caller", "callee", "callee_qn")
    files = {x.path: x for x in facts.files.collect()}
    assert "notes.txt" not in files and files["src/server.ts"].file_doc == "Serves." and files["src/server.ts"].line_count == 9 and files["core.clj"].language == "clojure"
    assert files["tool.py"].token_estimate == -(-len(SOURCES[4][1]) * 2 // 7)
    rows = facts.defines.where("name = 'run'").collect()
    assert rows[0].signature == "def run(self, x: int) -> int"


def test_adapters():
    from gneiss.sources.extract.model import FileFacts

    def parser(path, text):
        f = FileFacts(path)
        f.define(text.strip(), "function", 1)
        return f

    extract.register_adapter("toy", (".toy", ".ts"), parser)
    try:
        assert extract.extension_languages()[".toy"] == "toy" and extract.extension_languages()[".ts"] == "typescript"
        assert ".toy" in extract.supported_extensions()
    finally:
        extract.clear_adapters()


def test_read_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f(): pass\n")
    found, warnings = extract.read_files(spark, [str(tmp_path / "a.py"), str(tmp_path / "gone.py")])
    assert pairs(found, "content") == {("def f(): pass\n",)}
    assert pairs(warnings, "path", "reason") == {(str(tmp_path / "gone.py"), "can't be read")}
    with pytest.raises(ValueError):
        extract.read_files(spark, [str(tmp_path / "gone.py")])


def test_inheritance_and_chains(spark):
    extends = spark.createDataFrame([("C", "B"), ("B", "A"), ("X", "Y"), ("Y", "X")], "class_name string, parent string")
    own = spark.createDataFrame([("A", "f", "T1", 1), ("B", "f", "T2", 2), ("A", "g", "T3", 3), ("Y", "h", "T4", 4), ("A", "g", "T5", 9)], "class_name string, field string, type string, seq long")
    got = pairs(resolve.inherited(own, extends, "field", "type"), "class_name", "field", "type", "owner")
    assert {("C", "f", "T2", "B"), ("C", "g", "T5", "A"), ("X", "h", "T4", "Y"), ("A", "f", "T1", "A")} <= got
    fields = spark.createDataFrame([("C", "r", "R"), ("R", "s", "S")], "class_name string, field string, type string")
    pending = spark.createDataFrame([(1, ["this", "r", "s"], "C", {}), (2, ["v", "s"], None, {"v": "R"}), (3, ["v", "no"], None, {"v": "R"}), (4, ["u"], None, {})], "k int, receiver_chain array<string>, enclosing_class string, var_types map<string,string>")
    assert pairs(resolve.resolve_chains(pending, fields), "k", "type") == {(1, "S"), (2, "S"), (3, None), (4, None)}


def test_variable_types(spark):
    bindings = spark.createDataFrame([("f", "g", "x", "A", 1), ("f", None, "x", "B", 2), ("f", None, "y", "C", 3), ("f", None, "y", "D", 4)], "file string, scope string, name string, type string, seq long")
    asked = spark.createDataFrame([("f", "g", "x"), ("f", "h", "x"), ("f", "g", "y"), ("f", "g", "z"), ("f", None, "x")], "file string, scope string, name string")
    assert pairs(resolve.variable_types(asked, bindings), "scope", "name", "type") == {("g", "x", "A"), ("h", "x", "B"), ("g", "y", "D"), ("g", "z", None), (None, "x", "B")}


def test_services(spark):
    from gneiss.functions.services import Replies, embedder

    ask = Replies("none").on("tax", "yes").on("^q", lambda: "made")
    assert [ask("s", [m]) for m in ("tax", "quick", "other")] == ["yes", "made", "none"] and len(ask.asked) == 3
    texts = spark.createDataFrame([("ab",), ("c",), ("ab",), (None,)], "t string")
    got = [x.v for x in texts.select(embedder(lambda part: [[float(len(p)), 1.0] for p in part], 2, 1)(F.col("t")).alias("v")).collect()]
    assert got == [[2.0, 1.0], [1.0, 1.0], [2.0, 1.0], None]


def test_suffixes(spark):
    files = spark.createDataFrame([("src/a/util.ts", 1), ("lib/a/util.ts", 2), ("src/pkg/index.ts", 3)], "path string, seq long")
    index = resolve.suffix_index(files)
    assert {("a/util", "src/a/util.ts"), ("util.ts", "src/a/util.ts"), ("pkg", "src/pkg/index.ts"), ("lib/a/util", "lib/a/util.ts")} <= pairs(index, "suffix", "path")
    asked = spark.createDataFrame([("../x/a/util.js",), ("deep/pkg",), ("none",)], "source string")
    assert pairs(resolve.suffix_resolve(asked, index), "source", "path") == {("../x/a/util.js", "src/a/util.ts"), ("deep/pkg", "src/pkg/index.ts")}


def test_tsconfig(tmp_path):
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "@lib/*": ["lib/*", "x/*"],},}} // end')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base", /* "no": 1 */ "url": "http://x"}')
    assert tsconfig_aliases(str(tmp_path)) == [("@lib/", "src/lib/"), ("@/", "src/")]
    assert strip_jsonc('{"a": "//x", }') == '{"a": "//x" }'


def test_cache_and_snapshots(spark, tmp_path, facts):
    c = cache.ExtractionCache(spark, f"file://{tmp_path}", "k")
    files = spark.createDataFrame(SOURCES[:2], "path string, content string")
    assert cache.probe(files, c.manifest())[1].count() == 2
    c.save(files)
    hits, misses = cache.probe(files.union(spark.createDataFrame([("src/db.ts", "changed")], "path string, content string")), c.manifest())
    assert (hits.count(), misses.count()) == (2, 1)
    assert cache.probe(files, c.manifest().withColumn("version", F.lit(0)))[0].count() == 0
    e = Engine(spark, f"file://{tmp_path}")
    e.graph(facts, "summary", save_snapshot="one")
    assert e.cache.list_snapshots() == ["one"]
    assert e.graph(facts, "diff", against="one").count() == 0
    assert e.cache.delete_snapshot("one") and e.cache.load_snapshot("one") is None
    for bad in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            e.cache.save_snapshot(bad, facts)
    for call in (dict(analysis="none"), dict(analysis="impact"), dict(analysis="diff", against="gone"), dict(analysis="diff", against="x", save_snapshot="x")):
        with pytest.raises(ValueError):
            e.graph(facts, **call)
    c.clear()
    assert c.manifest().count() == 0


def answers(r, v="X"):
    assert r["status"] == "success", r
    return [a["bindings"][v] for a in r["answers"]]


def test_datalog(spark):
    program = "edge(a, b). edge(b, c). edge(c, a). edge(c, 'D d').  % facts\nreach(X, Y) :- edge(X, Y).\nreach(X, Y) :- edge(X, Z), reach(Z, Y).\nonly(X) :- edge(_, X), \\+ edge(X, _).\nbig(X) :- n(X), X > 2. n(1). n(10). n(2)."
    assert answers(datalog.solve(spark, program, "reach(a, X).")) == ["D d", "a", "b", "c"]
    assert answers(datalog.solve(spark, program, "?- only(X).")) == ["D d"]
    assert answers(datalog.solve(spark, program, "big(X), X \\= 11")) == ["10"]
    assert datalog.solve(spark, program, "reach(a, c)")["answers"][0]["formatted"] == "true"
    assert datalog.solve(spark, program, "reach('D d', X)")["answers"] == []
    assert datalog.solve(spark, program, "edge(X, Y), Y = c")["answers"][0]["formatted"] == "X = b, Y = c"
    trace = datalog.solve(spark, program, "big(X)", explain=True)["trace"]
    assert "big(10)" in trace and "reach(a, a)" in trace
    for bad in ("p(X) :- q(X", "p([a]).", "p(X) :- q(X), !.", "p(f(x)).", "p(X).", "p(X) :- q(Y).", "p(X) :- q(X), \\+ r(Z).", "a(X) :- n(X), \\+ b(X). b(X) :- n(X), \\+ a(X). n(1)."):
        assert datalog.solve(spark, bad, "p(X)")["status"] == "error", bad
    both = datalog.solve_all(spark, program, ["only(X)", "broken(", "big(X)"])
    assert [x["status"] for x in both] == ["success", "error"]


def test_taint_rules(spark):
    program = """flows(user_input, parse_body). flows(parse_body, validate). flows(validate, build_query). flows(build_query, execute_sql). flows(parse_body, log_request).
      source(user_input). clean(validate). sink(execute_sql). sink(log_request).
      tainted(X) :- source(X). tainted(Y) :- tainted(X), flows(X, Y), \\+ clean(X). bad(X) :- tainted(X), sink(X)."""
    assert answers(datalog.solve(spark, program, "tainted(X)")) == ["log_request", "parse_body", "user_input", "validate"]
    assert answers(datalog.solve(spark, program, "bad(X)")) == ["log_request"]


def test_mermaid(spark):
    e = Engine(spark)
    flow = "graph TD\n  A[Start here] -->|yes| B(Do it)\n  B --> C\n  %% no\n  C ==> A;\n"
    assert answers(e.verify("prolog", flow, "reaches(a, X)", form="mermaid")) == ["a", "b", "c"]
    assert answers(e.verify("prolog", flow, "node(a, X)", form="mermaid")) == ["Start here"]
    assert answers(e.verify("prolog", flow, "edge_label(a, b, X)", form="mermaid")) == ["yes"]
    state = "stateDiagram-v2\n  [*] --> Idle\n  Idle --> Run : go\n  Run --> [*]"
    assert answers(e.verify("prolog", state, "transition(idle, run, X)", form="mermaid")) == ["go"]
    assert answers(e.verify("prolog", state, "transition(start_end, idle, X)", form="mermaid")) == ["auto"]
    assert "run" in answers(e.verify("prolog", state, "can_reach(start_end, X)", form="mermaid"))
    nodes, edges = mermaid.parse(spark.createDataFrame([(1, flow), (2, state)], "id int, text string"), "id", "text")
    assert edges.count() == 6 and nodes.count() == 6


def test_constraints(spark):
    solve = lambda text: finite.solve_smtlib(spark, text)
    assert solve("") == {"status": "sat", "model": {}}
    pigeon = "".join(f"(declare-const t{k} Int)(assert (and (>= t{k} 1) (<= t{k} 2)))" for k in range(3)) + "(assert (! (distinct t0 t1 t2) :named different))"
    assert solve(pigeon)["status"] == "unsat" and "different" in solve(pigeon)["core"]
    lib = "(declare-const a Int)(declare-const b Int)(assert (or (= a 1) (= a 2)))(assert (or (= b 1) (= b 3)))(assert (=> (>= a 2) (>= b 3)))(assert (= a 2))"
    assert solve(lib)["model"] == {"a": "2", "b": "3"}
    roles = "(declare-datatypes ((R 0)) (((admin) (viewer))))(declare-const r R)(declare-const p Bool)(assert (= r viewer))(assert (not (= p (= r admin))))"
    assert solve(roles)["model"] == {"r": "viewer", "p": "true"}
    assert solve("(declare-const x Int)(assert (> x 5))(assert (< (* x x) 0))")["status"] == "unknown"
    assert solve("(declare-const x Int)(assert (> x 5))")["status"] == "sat"
    assert solve("(declare-const x (_ BitVec 8))(assert (= x x))")["status"] == "error"
    assert solve("(assert (and")["status"] == "error"


def test_problem_suite(spark):
    rules = spark.createDataFrame([("auditor", "read", "billing", "allow"), ("auditor", "read", "billing", "deny"), ("admin", "write", "docs", "allow"), ("admin", "read", "docs", "deny")], "role string, action string, resource string, effect string")
    key = ["role", "action", "resource"]
    assert pairs(finite.contradictions(rules.where("effect = 'allow'").select(key), rules.where("effect = 'deny'").select(key)), *key) == {("auditor", "read", "billing")}
    schema = spark.createDataFrame([("a", "age", 13, 120), ("b", "age", 18, 120), ("a", "name", 3, 30), ("b", "name", 3, 20), ("a", "same", 1, 2), ("b", "same", 1, 2)], "side string, field string, min int, max int")
    assert pairs(finite.schema_gaps(schema), "field", "low", "high", "accepted_by") == {("age", 13, 17, "a"), ("name", 21, 30, "a")}
    states = spark.createDataFrame([(s,) for s in ("draft", "review", "archived", "deleted")], "state string")
    moves = spark.createDataFrame([("draft", "review"), ("review", "draft"), ("review", "archived"), ("deleted", "draft")], "source string, target string")
    assert pairs(finite.unreachable_states(states, moves, "draft"), "state") == {("deleted",)}
    assert pairs(finite.dead_ends(states, moves), "state") == {("archived",)}


def test_retrieval(spark):
    texts = spark.createDataFrame([(0, "data flow analysis of taint"), (1, "role permission flow"), (2, "the a of"), (3, None)], "id int, text string")
    index = retrieval.BM25Index.build(texts, "id", "text")
    hits = index.search("data flow flow taint").collect()
    assert [x.doc for x in hits] == [0, 1] and index.search("nothing").count() == 0
    import math

    idf = lambda df: math.log((4 - df + 0.5) / (df + 0.5) + 1)
    part = lambda n: 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / (7 / 4)))
    assert hits[1].score == pytest.approx(2 * idf(2) * part(3))
    store = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0])], "id string, vector array<double>")
    assert [x.id for x in retrieval.nearest(store, [0.9, 0.1, 0.0], 5).collect()] == ["a", "b"]
    assert retrieval.nearest(store, [0.0, 0.0, 0.0], 5).count() == retrieval.nearest(store, [1.0, 0.0, 0.0], 0).count() == 0
    new = spark.createDataFrame([("a", [9.0, 9.0, 9.0], 1), ("a", [0.0, 1.0, 0.0], 2)], "id string, vector array<double>, seq long")
    assert retrieval.upsert_vectors(store, new).where("id = 'a'").first().vector == [0.0, 1.0, 0.0]
    assert retrieval.remove_vectors(store, ["a"]).count() == 2
    with pytest.raises(ValueError):
        retrieval.upsert_vectors(store, spark.createDataFrame([("q", [1.0], 1)], new.schema))
    files = spark.createDataFrame(SOURCES, "path string, content string")
    best = Engine(spark).search("x", files, top_k=500)
    assert best.count() <= 100 and {"id", "score", "file", "name", "line", "text"} == set(best.columns)


def test_templates(spark):
    lib = Library.create(spark)
    assert lib.templates.count() == 14 and {x[0] for x in starters()} == set(RELATED)
    assert lib.search("taint data flow sinks").first().name == "taint-propagation"
    assert {x.solver for x in lib.search("rules facts", solver="prolog").collect()} == {"prolog"}
    for ok in (True, True, False):
        lib = lib.record_use("rule-inference", ok)
    assert pairs(lib.promotable(), "name", "reuse_count", "success_count") == {("rule-inference", 3, 2)}
    assert lib.promote("rule-inference").promotable().count() == 0
    good = {"name": "my-check", "domain": "d", "solver": "z3", "signature": "something of its own", "skeleton": "{{SLOT:x}}", "slots": [{"name": "x", "description": "d", "format": "f"}], "normalizations": [{"source": "s", "transform": "t"}]}
    lib, errors = lib.craft(good)
    assert errors == [] and lib.get("my-check").count() == 1 and lib.remove("my-check").get("my-check").count() == 0
    bad = good | {"name": "No Good", "solver": "x", "slots": [{"name": "y", "description": "d", "format": ""}], "normalizations": []}
    assert len(lib.validate(bad)) == 6
    assert lib.validate(good) == ["my-check is there already"]
    e = Engine(spark)
    assert e.formalize("find contradictions in access rules")["template"] == "policy-contradiction"
    assert e.learn(good)["added"] and not e.learn(good)["added"]
    done = e.solve("derive what follows from facts and business rules", fill=lambda _: "```prolog\np(a)\n```", fix=lambda s, r, k: s + ".", query="p(X)")
    assert done["converged"] and done["rounds"] == 2
    loop = Correction(3).run("x", lambda s: {"status": "error", "error": "e"}, lambda s, r, k: s)
    assert not loop["converged"] and loop["rounds"] == 1


def test_lint(spark):
    got = lint_spec("```smt2\n(set-logic QF_LIA)\n(assert (= \"a ) b\" x)) ; )\n(check-sat)\n```", "z3")
    assert got["errors"] == [] and len(got["fixes"]) == 3 and got["spec"].startswith("(assert")
    assert lint_spec("(assert (= x 1)", "z3")["errors"] and lint_spec("x)", "z3")["errors"] and lint_spec(" ", "z3")["errors"]
    assert lint_spec("p('it''s (') :- q. % )", "prolog")["errors"] == []
    assert lint_spec("p(a", "prolog")["errors"] == ["no clause ends with a period", "1 parentheses are not closed"]
    assert "SLOT:x" in lint_spec("{{SLOT:x}} p.", "prolog")["errors"][0]
    rows = spark.createDataFrame([("p(a).", "prolog"), ("(", "z3")], "s string, k string").select(lint_column(F.col("s"), F.col("k")).alias("x")).collect()
    assert [len(r.x.errors) for r in rows] == [0, 1]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.glob_match(F.lit("a/b/c.ts"), "a/**/*.ts")) and not one(scalars.glob_match(F.lit("a/b/c.ts"), "a/*.ts"))
    assert one(scalars.escape_atom(F.lit("it's\n"))) == "'it\\'s\\n'" and one(scalars.escape_atom(F.lit("aB"))) == "'aB'" and one(scalars.quote_if_needed(F.lit("aB"))) == "aB"
    assert [one(scalars.cohesion(F.lit(n), F.lit(e))) for n, e in ((3, 3), (4, 2), (1, 0))] == [1.0, 0.33, 0.0]
    assert [one(scalars.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    q = one(scalars.prolog_query(F.lit("a.\n?- p(X).\nb.")))
    assert (q.program, q.query) == ("a.\nb.", "p(X).") and one(scalars.normalize_query(F.lit(" ?- p(X). "))) == "p(X)"
    assert one(scalars.prolog_query(F.lit("a."))).query == "true."
    assert ":timeout" in one(scalars.prepare_smtlib(F.lit("(assert true)(check-sat)"))) and "check-sat" not in one(scalars.prepare_smtlib(F.lit("(check-sat)")))
    assert scalars.common_ancestor(["a/b/c.ts", "a/b/d/e.ts"]) == "a/b" and scalars.common_ancestor(["a/b.ts"]) == "a"
    empty = F.array().cast("array<string>")
    none = F.create_map().cast("map<string,string>")
    assert "conflict: a" in one(scalars.classify_feedback(F.lit("unsat"), F.lit(""), F.array(F.lit("a")), none, empty))
    assert one(scalars.normalize_id(F.lit("[*]"))) == "start_end" and one(scalars.normalize_id(F.lit("--"))) in ("node", "_", "")


def test_review():
    plan = review_plan(["a"], "security", delta_against="main")
    assert plan["phases"][0]["phase"].startswith("0.") and len(plan["phases"]) == 5 and "taint-propagation" in plan["suggested_templates"]
    assert len(review_plan(["a"])["phases"]) == 7
    for bad in (([], "all"), (["a"], "none")):
        with pytest.raises(ValueError):
            review_plan(*bad)
