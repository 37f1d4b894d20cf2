from gneiss.sources import extract
from gneiss.sources.cache import ExtractionCache
from gneiss.streaming import incremental


def test_incremental(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one(): pass\n")
    cache = ExtractionCache(spark, f"file://{tmp_path}/cache", "k")

    def step():
        q = incremental.follow(incremental.source(spark, f"file://{src}", "*.py"), cache, f"file://{tmp_path}/out", f"file://{tmp_path}/at")
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(x.name for x in incremental.latest(spark, f"file://{tmp_path}/out", cache).defines.collect())

    assert step() == ["one"]
    (src / "b.py").write_text("def two(): pass\n")
    assert step() == ["one", "two"]
    assert step() == ["one", "two"]


BATCHES = [
    {
        "src/base.ts": "export class Base { private db: RepoA; go() { return 1; } }\nclass RepoA { find(x: number) { return x; } save() { return 2; } }\nclass RepoB { find(x: number) { return x; } }\n",
        "src/user.ts": "import { Base } from './base';\nimport { help } from './lib';\nexport class User extends Base { run() { this.db.find(1); help(); } }\n",
        "src/mid.ts": "import { User } from './user';\nclass Mid extends User { walk(u: User) { this.db.find(2); u.run(); this.run(); this.go(); } }\n",
        "src/apart.ts": "class Apart { one: Apart; two() { this.one.two(); } }\nfunction keep(q) { q.save(); }\n",
        "notes.txt": "nothing to parse",
    },
    {  # another type of an inherited field, a second class with save, a file that an import was waiting for
        "src/base.ts": "// moved down a line\nexport class Base { private db: RepoB; go() { return 1; } }\nclass RepoA { find(x: number) { return x; } save() { return 2; } }\nclass RepoB { find(x: number) { return x; } save() { return 3; } }\n",
        "src/lib.ts": "export function help() { return later(); }\n",
        "src/apart.ts": "class Apart { one: Apart; two() { this.one.two(); } }\nfunction keep(q) { q.save(); }\n",
    },
    {  # another parent, a method less, a class that declares the field itself, a save less
        "src/mid.ts": "import { Base } from './base';\nclass Mid extends Base { walk(u: User) { this.db.find(2); u.run(); this.run(); this.go(); } }\n",
        "src/user.ts": "import { Base } from './base';\nexport class User extends Base { db: RepoA; fly() { this.db.find(1); } }\n",
        "src/base.ts": "export class Base { private db: RepoB; go() { return 1; } }\nclass RepoA { find(x: number) { return x; } }\nclass RepoB { find(x: number) { return x; } save() { return 3; } }\n",
        "src/lib/index.ts": "",
    },
]


def rows(graph):
    return {name: sorted((tuple(x) for x in getattr(graph, name).collect()), key=str) for name in ("defines", "calls", "imports", "exports", "contains", "files")}


def test_facts_of_batches_are_those_of_one_extraction(spark, tmp_path):
    facts = incremental.Facts(spark, f"file://{tmp_path}/facts")
    cache = ExtractionCache(spark, f"file://{tmp_path}/cache", "k")
    now = {}
    for k, files in enumerate(BATCHES):
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        now |= files
        facts.add(df, k, cache)
        whole = extract.extract(spark.createDataFrame(list(now.items()), "path string, content string"))
        assert rows(facts.graph()) == rows(whole)
        if k == 1:
            keys = facts._log("calls", "keys", "caller string, callee string", [1]).collect()
            # not the calls within a class, or those of functions, that nothing in the batch touches
            assert {(x.caller, x.callee) for x in keys} == {("run", "find"), ("walk", "find"), ("keep", "save"), ("help", "later")}
            facts.add(df, 1, cache)  # once more, after a failure
            assert rows(facts.graph()) == rows(whole)
