"""The extraction cache: only changed files are parsed, the oldest go beyond the budget, what a crash leaves doesn't count."""

import pytest
from pyspark.sql import functions as F

from gneiss.engine import Engine
from gneiss.operators import datalog, graph
from gneiss.operators.numbering import numbered
from gneiss.operators.templates import Correction, fill, starters
from gneiss.sources import digests, extract
from gneiss.sources.cache import ExtractionCache, bucket_of
from gneiss.sources.facts import CodeGraph

FILES = [("a.py", "def one():\n    return two()\n"), ("b.py", "def two():\n    return 2\n"), ("notes.txt", "nothing")]


def names(g):
    return sorted(x.name for x in g.defines.collect())


def test_only_changed_files_are_parsed(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}")
    files = spark.createDataFrame(FILES, "path string, content string")
    assert names(e.facts_of(files)) == ["one", "two"]
    asked = []
    parse = extract.parse
    monkeypatch.setattr(extract, "parse", lambda f: asked.append(sorted(x.path for x in f.collect())) or parse(f))
    again = e.facts_of(files)
    assert names(again) == ["one", "two"] and not asked
    assert {(x.caller, x.callee) for x in again.calls.collect()} == {("one", "two")}
    changed = files.withColumn("content", F.when(F.col("path") == "b.py", "def three(): pass\n").otherwise(F.col("content")))
    assert names(e.facts_of(changed)) == ["one", "three"] and asked == [["b.py"]]
    assert names(e.facts_of(files)) == ["one", "two"] and len(asked) == 1


def test_a_save_without_its_manifest_does_not_count(spark, tmp_path):
    c = ExtractionCache(spark, f"file://{tmp_path}", "k")
    files = spark.createDataFrame(FILES[:1], "path string, content string")
    c.save(files, extract.parse(files))
    (at,) = (tmp_path / "k" / "saves").iterdir()
    (at / "manifest" / "_SUCCESS").unlink()
    assert c.manifest().count() == 0 and c.rows_of(files)[1].count() == 1
    c.save(files, extract.parse(files))
    c.save(files, extract.parse(files))  # twice, counts once
    assert c.rows_of(files)[0].where("relation = 'defines'").count() == 1
    c.clear()
    assert c.manifest().count() == 0


def test_warnings_reach_the_caller(spark, tmp_path):
    at = tmp_path / "x.py"
    at.write_text("def f(): pass\n")
    e = Engine(spark)
    assert names(e.facts_of([str(at), str(tmp_path / "gone.py")])) == ["f"]
    assert [x.reason for x in e.warnings.collect()] == ["can't be read"]


def test_snapshot_is_replaced(spark, tmp_path):
    c = ExtractionCache(spark, f"file://{tmp_path}", "k")
    g = extract.extract(spark.createDataFrame(FILES[:1], "path string, content string"))
    c.save_snapshot("s", g)
    c.save_snapshot("s", g.with_(defines=g.defines.where("false")))
    assert names(c.load_snapshot("s")) == [] and c.list_snapshots() == ["s"]
    assert len(list((tmp_path / "k" / "snapshots" / "s").glob("0*"))) == 1


def test_two_bundles_are_dealt_once(spark):
    """Each entity's keys of both sides go through one shuffle; a key without a value is equal to itself."""
    files = [spark.createDataFrame(FILES[:k], "path string, content string") for k in (1, len(FILES))]
    a, b = (extract.extract(x) for x in files)
    df = graph.diff(a, b)
    keys = [{(e, x.key) for e, rows in graph.all_keys(g).items() for x in rows.collect()} for g in (a, b)]
    want = {("added", *x) for x in keys[1] - keys[0]} | {("removed", *x) for x in keys[0] - keys[1]}
    got = [tuple(x) for x in df.collect()]
    assert set(got) == want and len(got) == len(want)
    loaded = [CodeGraph.of(spark, calls=[("f", None), ("f", "g"), ("f", "g")], imports=[("x", "y", None)]) for _ in range(2)]
    df = graph.diff(*loaded)
    assert df.collect() == []
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 5


def test_slots_and_repairs(spark):
    with pytest.raises(KeyError):
        fill("{{SLOT:a}}", {})
    out = Engine(spark).lint("z3", "```\n(check-sat)\n```lisp\n(assert true)\n```")
    assert out["spec"] == "(assert true)" and out["errors"] == []
    assert not Correction(rounds=0).run("x", None, None)["converged"]


def test_rows_are_numbered_in_order_over_any_number_of_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2100")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(2500).selectExpr("concat('f', lpad(id % 40, 2, '0'), '.py') as path", "cast(id div 40 as int) as k", "'x' as relation")
        got = numbered(rows, ["path", "k", "relation"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [x.seq for x in sorted(got, key=lambda x: (x.path, x.k))] == list(range(2500))


def test_taint_stops_behind_a_sanitizer(spark):
    """The template's rules: what sanitizes is tainted itself, what comes after it isn't."""
    slots = {
        "flow_facts": "flow(user_input, parse_body). flow(parse_body, validate). flow(validate, build_query). flow(build_query, execute_sql). flow(user_input, log_request).",
        "taint_sources": "source(user_input).", "sanitizers": "sanitizer(validate).", "sinks": "sink(execute_sql). sink(log_request).",
    }
    program = fill(next(x[4] for x in starters() if x[0] == "taint-propagation"), slots)
    ask = lambda q: sorted(x["formatted"] for x in datalog.solve(spark, program, q)["answers"])
    assert ask("tainted(X)") == ["X = log_request", "X = parse_body", "X = user_input", "X = validate"]
    assert ask("violation(X)") == ["X = log_request"]


def _files(root):
    """Parquet files by bucket."""
    out = {}
    for x in (root / "k" / "saves").rglob("*.parquet"):
        out.setdefault(int(x.parent.name.removeprefix("bucket=")), set()).add(str(x))
    return out


def test_saves_and_evictions_touch_their_buckets_only(spark, tmp_path):
    text = "def f{0}():\n    return {0}\n"
    files = [(f"src/m{k:02d}.py", text.format(k + 10)) for k in range(40)]
    size = len(files[0][1])
    c = ExtractionCache(spark, f"file://{tmp_path}", "k", budget=44 * size)
    df = spark.createDataFrame(files, "path string, content string")
    bucket = {x.path: x.b for x in df.select("path", bucket_of("path").alias("b")).collect()}
    c.save(df, extract.parse(df))
    first = _files(tmp_path)
    assert set(first) == set(bucket.values())
    some = df.where("path in ('src/m03.py', 'src/m31.py')").withColumn("content", F.replace("content", F.lit("return "), F.lit("return 1")))
    c.save(some, extract.parse(some))
    second = _files(tmp_path)
    touched = {bucket["src/m03.py"], bucket["src/m31.py"]}
    assert {b for b in second if second[b] != first.get(b)} == touched
    assert c.rows_of(df)[1].count() == 0  # both contents of a path are known
    # six more: four of the oldest go, by the clock; of the buckets only those that are half out of date are rewritten
    more = spark.createDataFrame([(f"lib/n{k}.py", text.format(k + 60)) for k in range(6)], "path string, content string")
    c.save(more, extract.parse(more))
    gone = sorted(x.path for x in c.rows_of(df)[1].collect())
    assert gone == [f"src/m{k:02d}.py" for k in range(len(gone))] and len(gone) >= 4
    third = _files(tmp_path)
    added = {x.b for x in more.select(bucket_of("path").alias("b")).distinct().collect()}
    assert {b for b in third if third[b] != second.get(b)} <= added | {bucket[p] for p in gone} | touched
    assert sum(x.size for x in c.manifest().collect()) <= c.budget
    untouched = set(first) - added - {bucket[p] for p in gone} - touched
    assert untouched and all(third[b] == first[b] for b in untouched)
    names_ = sorted(x.a for x in c.rows_of(df)[0].where("relation = 'defines'").collect())
    assert names_ == [f"f{k + 10}" for k in range(len(gone), 40)]


def test_trees_read_only_leaves_that_differ(spark, tmp_path):
    many = [("a", f"f{k}", "function", k) for k in range(3000)]
    before = CodeGraph.of(spark, defines=many, exports=[("a", f"f{k}") for k in range(100)])
    after = CodeGraph.of(spark, defines=[*many[1:], ("a", "new", "function", 1)], exports=[("a", f"f{k}") for k in range(100)])
    c = ExtractionCache(spark, f"file://{tmp_path}", "k")
    c.save_snapshot("before", before)
    c.save_snapshot("after", after)
    found = c.diff_snapshots("before", "after")
    assert sorted(tuple(x) for x in found.collect()) == sorted(tuple(x) for x in graph.diff(before, after).collect()) == [("added", "node", "new"), ("removed", "node", "f0")]
    trees = [f"{c.at}/snapshots/{x}/00000001/tree" for x in ("before", "after")]
    leaves = digests.differing_leaves(spark, *trees)
    assert {e for e, _ in leaves} == {"node"} and 1 <= len(leaves) <= 2
    keys = digests.keys_of(spark, trees[0], leaves)
    assert keys.count() < 20
    read = {tuple(x.rsplit("/", 3)[1:3]) for (x,) in keys.select(F.input_file_name()).collect()}
    assert read <= {("entity=node", f"part={n // digests.FOLDER}") for _, n in leaves}
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "(entity" in plan.split("PartitionFilters")[1] and "leaf" in plan.split("PushedFilters")[1]
    assert c.diff_snapshots("before", "before").collect() == []
    with pytest.raises(ValueError):
        c.diff_snapshots("before", "never")
