"""The query surface: what a user calls, with checked arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.operators import codemap, datalog, finite, graph, insights, retrieval
from gneiss.operators.fixpoint import checkpointed
from gneiss.operators.lint import lint_spec
from gneiss.operators.templates import Correction, Library
from gneiss.plans.review import review_plan
from gneiss.sources import extract, mermaid
from gneiss.sources.cache import ExtractionCache
from gneiss.sources.facts import CodeGraph

#: Analyses and the arguments that each must have.
ANALYSES = {
    "summary": (), "callers": ("target",), "callees": ("target",), "reachability": ("source", "target"), "path": ("source", "target"), "impact": ("target",), "dead-code": (), "cycles": (), "layer-violation": (),
    "communities": (), "hubs": (), "bridges": (), "surprises": (), "diff": ("against",), "entry-points": (), "facts": (),
}


class Engine:
    def __init__(self, spark: SparkSession, cache_root: str | None = None, library: Library | None = None):
        self.spark = spark
        self.cache = ExtractionCache(spark, cache_root) if cache_root else None
        self._library = library
        self.warnings: DataFrame | None = None

    @property
    def library(self) -> Library:
        self._library = self._library or Library.create(self.spark)
        return self._library

    def facts_of(self, files: list[str] | DataFrame) -> CodeGraph:
        """The facts of files: paths, or a DataFrame (path, content). With a cache folder, only changed files are parsed.

        self.warnings then has (path, reason) of paths that were left out.
        """
        self.warnings = None
        if not isinstance(files, DataFrame):
            files, self.warnings = extract.read_files(self.spark, files)
        if not self.cache:
            return extract.extract(files)
        known, misses = self.cache.rows_of(files)
        known = checkpointed(known)  # before an eviction can delete what it is read from
        if not misses.limit(1).count():
            return extract.extract(files, parsed=known)
        parsed = checkpointed(extract.parse(misses))
        self.cache.save(misses, parsed)
        return extract.extract(files, parsed=known.unionByName(parsed))

    def graph(self, facts: CodeGraph, analysis: str, *, target: str | None = None, source: str | None = None, entry_points: list[str] | None = None, against: str | None = None, save_snapshot: str | None = None, include_insights: bool = False, top: int = 10):
        """A DataFrame; for path a list of names, for facts a text."""
        if analysis not in ANALYSES:
            raise ValueError(f"unknown analysis {analysis}; known are {', '.join(ANALYSES)}")
        given = {"target": target, "source": source, "against": against}
        missing = [a for a in ANALYSES[analysis] if not given[a]]
        if missing:
            raise ValueError(f"{analysis} needs {', '.join(missing)}")
        if (against or save_snapshot) and not self.cache:
            raise ValueError("snapshots need a cache folder")
        if against and against == save_snapshot:
            raise ValueError("a snapshot can't be compared with and replaced at once")
        before = self.cache.load_snapshot(against) if analysis == "diff" else None
        if analysis == "diff" and before is None:
            raise ValueError(f"there is no snapshot {against}")
        if save_snapshot:
            self.cache.save_snapshot(save_snapshot, facts)
        if analysis == "facts":
            more = None
            if include_insights:
                of = insights.communities(facts)
                more = {"cohesion": of.select("id", "cohesion").distinct(), "community": of.select("name", "id"), "hub": insights.hubs(facts), "bridge": insights.bridges(facts)}
            return graph.facts_text(facts, entry_points, insights=more)
        return {
            "summary": lambda: graph.summary(facts),
            "callers": lambda: graph.callers(facts, target),
            "callees": lambda: graph.callees(facts, target),
            "reachability": lambda: graph.reachability(facts, source, target),
            "path": lambda: graph.path(facts, source, target),
            "impact": lambda: graph.impact(facts, target),
            "dead-code": lambda: graph.dead_code(facts, entry_points),
            "cycles": lambda: graph.cycles(facts),
            "layer-violation": lambda: graph.layer_violations(facts),
            "communities": lambda: insights.communities(facts),
            "hubs": lambda: insights.hubs(facts, top),
            "bridges": lambda: insights.bridges(facts),
            "surprises": lambda: insights.surprises(facts, top),
            "diff": lambda: graph.diff(before, facts),
            "entry-points": lambda: graph.entry_points(facts),
        }[analysis]()

    def map(self, facts: CodeGraph, mode: str = "overview", *, path: str | None = None, name: str | None = None, include: list[str] | None = None, max_exports: int = 8):
        if mode == "overview":
            return codemap.overview(facts, include, max_exports)
        if mode == "file" and path:
            return codemap.file_detail(facts, path)
        if mode == "symbol" and name:
            return codemap.symbol_detail(facts, name)
        raise ValueError("mode is overview, file with a path, or symbol with a name")

    def search(self, query: str, files: DataFrame, top_k: int = 10, embed=None, embed_key: str | None = None, dimension: int = 64) -> DataFrame:
        """Functions and methods by the meaning of their text; with a cache folder, texts are parsed and embedded once."""
        facts = self.facts_of(files) if self.cache else extract.extract(files)
        corpus = retrieval.search_corpus(facts, files)
        # one folder for each function that embeds: vectors of different ones aren't comparable
        vectors = retrieval.VectorCache(self.spark, f"{self.cache.at}/vectors/{embed_key or 'own'}", dimension) if self.cache and (embed is None or embed_key) else None
        return retrieval.semantic_search(self.spark, corpus, query, top_k, embed, dimension, vectors)

    def verify(self, solver: str, text: str, query: str | None = None, queries: list[str] | None = None, form: str = "prolog", explain: bool = False, relations: dict[str, DataFrame] | None = None):
        """A result, or a list of results for queries. form: prolog, or mermaid for a diagram."""
        if solver == "z3":
            return finite.solve_smtlib(self.spark, text)
        if solver != "prolog":
            raise ValueError("solver is z3 or prolog")
        if form == "mermaid":
            text = mermaid.program(self.spark.createDataFrame([(0, text)], "id int, text string"), "id", "text").first().program
        if queries:
            return datalog.solve_all(self.spark, text, queries, relations)
        if not query:
            raise ValueError("a query is needed")
        return datalog.solve(self.spark, text, query, relations, explain)

    def lint(self, solver: str, text: str) -> dict:
        """Repairs until one more pass changes nothing; fixes are those of all passes."""
        out = lint_spec(text, solver)
        fixes = list(out["fixes"])
        while out["fixes"] and (again := lint_spec(out["spec"], solver))["spec"] != out["spec"]:
            out = again
            fixes += again["fixes"]
        return out | {"fixes": fixes}

    def templates(self, query: str | None = None, name: str | None = None, domain: str | None = None, solver: str | None = None) -> DataFrame:
        if name:
            return self.library.get(name)
        if query:
            return self.library.search(query, domain, solver)
        return self.library.templates

    def formalize(self, problem: str) -> dict:
        return self.library.formalize(problem)

    def craft(self, template: dict) -> list[str]:
        self._library, errors = self.library.craft(template)
        return errors

    def solve(self, problem: str, fill=None, fix=None, query: str = "true.") -> dict:
        """fill: (instructions) to a specification; fix: (text, result, round) to a better one. Without fill: how to fill the template."""
        plan = self.formalize(problem)
        if fill is None:
            return plan
        t = self.library.get(plan["template"]).first()
        linted = lambda s: self.lint(t.solver, s)["spec"] if s else s
        again = (lambda *x: linted(fix(*x))) if fix else (lambda *_: None)
        out = Correction().run(linted(fill(plan["instructions"])), lambda s: self.verify(t.solver, s, query), again)
        self._library = self.library.record_use(t.name, out["converged"])
        return plan | out

    def learn(self, template: dict) -> dict:
        """Adds a template unless one is alike, then promotes those that have proved good."""
        errors = self.library.validate(template)
        words = " ".join([template.get("name", ""), template.get("domain", ""), template.get("signature", "")])
        if not errors and self.library.is_duplicate(words):
            errors = ["a template is much alike"]
        if not errors:
            errors = self.craft(template)
        promoted = [x.name for x in self.library.promotable().select("name").collect()]
        for name in promoted:
            self._library = self.library.promote(name)
        return {"added": not errors, "errors": errors, "promoted": promoted}

    def review(self, files: list[str], focus: str = "all", entry_points: list[str] | None = None, delta_against: str | None = None) -> dict:
        return review_plan(files, focus, entry_points, delta_against)
