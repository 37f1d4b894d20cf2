"""The catalog of specification templates: search, use, learning, crafting."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.scalars import is_kebab
from gneiss.operators.retrieval import BM25Index, near_duplicate

SCHEMA = (
    "name string, domain string, solver string, signature string, skeleton string, slots array<struct<name:string,description:string,format:string>>,"
    " normalizations array<struct<source:string,transform:string>>, tips array<string>, example string"
)
USES = "name string, success boolean, at timestamp"
META = "name string, promoted boolean"

#: Name, domain, solver, slots of the templates that are always there. What they say is ours.
_STARTERS = (
    ("policy-contradiction", "authorization", "z3", "Find a request that access rules both allow and deny", "type_declarations principal_type action_type resource_type allow_rules deny_rules", "access rules"),
    ("policy-reachability", "authorization", "z3", "Decide whether a principal can get at a resource under the policies", "type_declarations principal_type resource_type action_type policies target_principal target_resource", "access policies"),
    ("config-equivalence", "configuration", "z3", "Find an input for which two configurations behave differently", "declarations config_a config_b", "firewall or routing settings"),
    ("constraint-satisfaction", "dependency", "z3", "Choose package versions that meet all requirements and exclusions", "declarations domains requirements conflicts", "package manifests"),
    ("schema-consistency", "validation", "z3", "Find a value that one validation schema accepts and another rejects", "declarations schema_a schema_b", "form and server validation"),
    ("rule-inference", "rules", "prolog", "Derive what follows from facts by business rules", "facts rules", "business rules"),
    ("graph-reachability", "analysis", "prolog", "Decide whether one node leads to another in a directed graph", "edges", "import, call or data-flow graphs"),
    ("permission-derivation", "authorization", "prolog", "Derive what users may do through a hierarchy of roles", "role_assignments role_hierarchy permissions", "role bindings"),
    ("invariant-check", "verification", "z3", "Find an input that meets the precondition and breaks the postcondition", "inputs outputs body precondition postcondition", "functions with contracts"),
    ("state-machine-deadlock", "verification", "z3", "Check transitions of a state machine", "states state_type transitions from_state to_state", "workflows"),
    ("boundary-condition", "verification", "z3", "Find a value at the edge of a range that breaks a bound", "declarations index_type expression guard violation", "loops and array accesses"),
    ("association-rule-check", "verification", "prolog", "Find functions that call one part of a required pair without the other", "call_facts required_pairs", "paired operations such as lock and unlock"),
    ("collective-classification", "analysis", "prolog", "Spread labels from callees to their callers", "call_facts seeds label", "sensitive or failing functions"),
    ("taint-propagation", "analysis", "prolog", "Follow tainted data to sinks unless a sanitizer stops it", "flow_facts taint_sources sanitizers sinks", "data flow from user input"),
)
#: Which template helps after which.
RELATED = {
    "policy-contradiction": ("policy-reachability", "permission-derivation"),
    "policy-reachability": ("policy-contradiction", "permission-derivation"),
    "permission-derivation": ("policy-contradiction", "policy-reachability"),
    "schema-consistency": ("config-equivalence", "constraint-satisfaction"),
    "config-equivalence": ("schema-consistency",),
    "constraint-satisfaction": ("schema-consistency",),
    "graph-reachability": ("rule-inference",),
    "rule-inference": ("graph-reachability", "permission-derivation"),
    "invariant-check": ("boundary-condition", "state-machine-deadlock"),
    "state-machine-deadlock": ("invariant-check", "association-rule-check"),
    "boundary-condition": ("invariant-check", "schema-consistency"),
    "association-rule-check": ("taint-propagation", "collective-classification"),
    "collective-classification": ("taint-propagation", "association-rule-check"),
    "taint-propagation": ("association-rule-check", "collective-classification", "graph-reachability"),
}


#: What each template says around its slots: declarations, assertions and rules.
_SKELETONS = {
    "policy-contradiction": """; a request that both an allowing and a denying rule cover
{{SLOT:type_declarations}}
(declare-const principal {{SLOT:principal_type}})
(declare-const action {{SLOT:action_type}})
(declare-const resource {{SLOT:resource_type}})
(assert {{SLOT:allow_rules}})
(assert {{SLOT:deny_rules}})""",
    "policy-reachability": """; some action on the resource that the policies let the principal take
{{SLOT:type_declarations}}
(declare-const principal {{SLOT:principal_type}})
(declare-const action {{SLOT:action_type}})
(declare-const resource {{SLOT:resource_type}})
(assert (= principal {{SLOT:target_principal}}))
(assert (= resource {{SLOT:target_resource}}))
(assert {{SLOT:policies}})""",
    "config-equivalence": """; an input that the two settings decide differently
{{SLOT:declarations}}
(assert (not (= {{SLOT:config_a}} {{SLOT:config_b}})))""",
    "constraint-satisfaction": """; versions within their ranges that meet every requirement and no conflict
{{SLOT:declarations}}
(assert {{SLOT:domains}})
(assert {{SLOT:requirements}})
(assert (not {{SLOT:conflicts}}))""",
    "schema-consistency": """; a value that the first schema takes and the second refuses
{{SLOT:declarations}}
(assert {{SLOT:schema_a}})
(assert (not {{SLOT:schema_b}}))""",
    "rule-inference": """% facts, and the rules that derive more of them
{{SLOT:facts}}
{{SLOT:rules}}""",
    "graph-reachability": """% edge(From, To)
{{SLOT:edges}}
reach(A, B) :- edge(A, B).
reach(A, C) :- edge(A, B), reach(B, C).""",
    "permission-derivation": """% has_role(User, Role); above(Senior, Junior); grants(Role, Action, Resource)
{{SLOT:role_assignments}}
{{SLOT:role_hierarchy}}
{{SLOT:permissions}}
holds(U, R) :- has_role(U, R).
holds(U, J) :- holds(U, S), above(S, J).
may(U, A, O) :- holds(U, R), grants(R, A, O).""",
    "invariant-check": """; an input with which the body breaks what should hold after it
{{SLOT:inputs}}
{{SLOT:outputs}}
(assert {{SLOT:precondition}})
(assert {{SLOT:body}})
(assert (not {{SLOT:postcondition}}))""",
    "state-machine-deadlock": """; a step between the two states; none means that the second isn't next to the first
{{SLOT:states}}
(declare-const here {{SLOT:state_type}})
(declare-const next {{SLOT:state_type}})
(assert (= here {{SLOT:from_state}}))
(assert (= next {{SLOT:to_state}}))
(assert {{SLOT:transitions}})""",
    "boundary-condition": """; a value that passes the guard and is out of bounds
{{SLOT:declarations}}
(declare-const index {{SLOT:index_type}})
(assert (= index {{SLOT:expression}}))
(assert {{SLOT:guard}})
(assert {{SLOT:violation}})""",
    "association-rule-check": """% calls(Function, Callee); paired(First, Second)
{{SLOT:call_facts}}
{{SLOT:required_pairs}}
unpaired(F, A, B) :- paired(A, B), calls(F, A), \\+ calls(F, B).""",
    "collective-classification": """% calls(Function, Callee); seed(Function)
{{SLOT:call_facts}}
{{SLOT:seeds}}
{{SLOT:label}}(F) :- seed(F).
{{SLOT:label}}(F) :- calls(F, G), {{SLOT:label}}(G).""",
    "taint-propagation": """% flow(From, To); source(Node); sanitizer(Node); sink(Node)
{{SLOT:flow_facts}}
{{SLOT:taint_sources}}
{{SLOT:sanitizers}}
{{SLOT:sinks}}
tainted(X) :- source(X).
tainted(Y) :- tainted(X), flow(X, Y), \\+ sanitizer(X).
violation(X) :- tainted(X), sink(X).""",
}
#: Slots that hold a name or a type, and those that hold declarations; the others of a solver hold a term.
_NAMED = {"principal_type", "action_type", "resource_type", "state_type", "index_type", "target_principal", "target_resource", "from_state", "to_state"}
_DECLARED = {"type_declarations", "declarations", "inputs", "outputs", "states"}


def _shape(solver: str, slot: str) -> str:
    if slot == "label":
        return "the name of a predicate"
    if solver == "prolog":
        return "Prolog facts or rules, each with a period"
    return "one name" if slot in _NAMED else "SMT-LIB declarations" if slot in _DECLARED else "one SMT-LIB term"


def starters() -> list[tuple]:
    rows = []
    for name, domain, solver, signature, slots, source in _STARTERS:
        names = slots.split()
        rows.append((name, domain, solver, signature, _SKELETONS[name], [(s, f"the {s.replace('_', ' ')}", _shape(solver, s)) for s in names], [(source, f"write {source} as " + ", ".join(names).replace("_", " "))], None, None))
    return rows


def fill(skeleton: str, values: dict[str, str]) -> str:
    """A specification: each slot replaced by its value; a slot without one is an error."""
    return re.sub(r"\{\{SLOT:(\w+)\}\}", lambda m: values[m[1]], skeleton)


@dataclass(frozen=True)
class Library:
    """Immutable: templates, an append-only log of uses, and promotions. Each change gives a new library."""

    templates: DataFrame
    uses: DataFrame
    meta: DataFrame

    @classmethod
    def create(cls, spark: SparkSession, learned: DataFrame | None = None, uses: DataFrame | None = None, meta: DataFrame | None = None) -> Library:
        """The starters, and learned templates; of equal names the starter counts."""
        base = spark.createDataFrame(starters(), SCHEMA)
        if learned is not None:
            base = base.unionByName(learned.join(base.select("name"), "name", "left_anti").select(*base.columns))
        return cls(base, uses if uses is not None else spark.createDataFrame([], USES), meta if meta is not None else spark.createDataFrame([], META))

    def metadata(self) -> DataFrame:
        """(name, reuse_count, success_count, last_used, promoted) of all templates."""
        used = self.uses.groupBy("name").agg(F.count("*").alias("reuse_count"), F.count_if("success").alias("success_count"), F.max("at").alias("last_used"))
        promoted = self.meta.groupBy("name").agg(F.bool_or("promoted").alias("promoted"))
        out = self.templates.select("name").join(used, "name", "left").join(promoted, "name", "left")
        return out.select("name", F.coalesce("reuse_count", F.lit(0)).alias("reuse_count"), F.coalesce("success_count", F.lit(0)).alias("success_count"), "last_used", F.coalesce("promoted", F.lit(False)).alias("promoted"))

    def get(self, name: str) -> DataFrame:
        return self.templates.where(F.col("name") == name).join(self.metadata(), "name")

    def related(self, name: str) -> list[str]:
        return list(RELATED.get(name, ()))

    def texts(self) -> DataFrame:
        parts = [F.col("name"), F.col("domain"), F.col("signature"), F.array_join(F.transform("slots", lambda s: s["description"]), " "), F.array_join(F.transform("normalizations", lambda n: F.concat_ws(" ", n["source"], n["transform"])), " ")]
        return self.templates.select("name", F.concat_ws(" ", *parts).alias("text"))

    def search(self, query: str, domain: str | None = None, solver: str | None = None, limit: int = 10) -> DataFrame:
        """Best first, with score; domain and solver filter before the limit."""
        hits = BM25Index.build(self.texts(), "name", "text").search(query, 1 << 30)
        out = hits.withColumnRenamed("doc", "name").join(self.templates, "name")
        for column, value in (("domain", domain), ("solver", solver)):
            out = out.where(F.col(column) == value) if value else out
        return out.orderBy(F.desc("score"), "name").limit(limit)

    def record_use(self, name: str, success: bool) -> Library:
        spark = self.templates.sparkSession
        return replace(self, uses=self.uses.unionByName(spark.createDataFrame([(name, success)], "name string, success boolean").withColumn("at", F.current_timestamp())))

    def add(self, template: DataFrame) -> tuple[Library, bool]:
        """A library with the template, and whether it was new."""
        new = template.join(self.templates.select("name"), "name", "left_anti").select(*self.templates.columns)
        if not new.limit(1).count():
            return self, False
        return replace(self, templates=self.templates.unionByName(new)), True

    def remove(self, name: str) -> Library:
        keep = F.col("name") != name
        return Library(self.templates.where(keep), self.uses.where(keep), self.meta.where(keep))

    def promote(self, name: str) -> Library:
        spark = self.templates.sparkSession
        return replace(self, meta=self.meta.unionByName(spark.createDataFrame([(name, True)], META)))

    def promotable(self, least_uses: int = 3, least_rate: float = 0.6) -> DataFrame:
        m = self.metadata()
        return m.where(~F.col("promoted") & (F.col("reuse_count") >= least_uses)).where(F.col("success_count") / F.col("reuse_count") >= least_rate)

    def is_duplicate(self, text: str) -> bool:
        texts = self.texts()
        return near_duplicate(BM25Index.build(texts, "name", "text"), texts, text, "name", "text").limit(1).count() > 0

    def validate(self, template: dict) -> list[str]:
        """What keeps a template out."""
        errors = [f"{k} is missing" for k in ("name", "domain", "solver", "signature", "skeleton") if not isinstance(template.get(k), str) or not template[k]]
        if template.get("solver") not in ("z3", "prolog"):
            errors.append("solver must be z3 or prolog")
        name = template.get("name")
        if isinstance(name, str) and name:
            spark = self.templates.sparkSession
            if not spark.range(1).select(is_kebab(F.lit(name))).first()[0]:
                errors.append("name must be lower-case words with hyphens")
            if self.templates.where(F.col("name") == name).limit(1).count():
                errors.append(f"{name} is there already")
        for key, parts in (("slots", ("name", "description", "format")), ("normalizations", ("source", "transform"))):
            found = template.get(key)
            if not isinstance(found, list) or not found:
                errors.append(f"{key} must not be empty")
            else:
                errors += [f"{key}[{k}] needs {', '.join(parts)}" for k, x in enumerate(found) if not all(x.get(p) for p in parts)]
        if isinstance(template.get("skeleton"), str) and isinstance(template.get("slots"), list):
            used, defined = set(re.findall(r"\{\{SLOT:(\w+)\}\}", template["skeleton"])), {s.get("name") for s in template["slots"]}
            errors += [f"slot {s} is used, but not defined" for s in sorted(used - defined)] + [f"slot {s} is defined, but not used" for s in sorted(defined - used, key=str)]
        return errors

    def craft(self, template: dict) -> tuple[Library, list[str]]:
        errors = self.validate(template)
        if errors:
            return self, errors
        spark = self.templates.sparkSession
        row = tuple(template.get(k) if k not in ("slots", "normalizations") else [tuple(x.values()) for x in template[k]] for k in self.templates.columns)
        return self.add(spark.createDataFrame([row], SCHEMA))[0], []

    def formalize(self, problem: str) -> dict:
        """The best template for a problem, else the first, and how to fill it."""
        best = self.search(problem, limit=1).limit(1).collect() or self.templates.orderBy("name").limit(1).collect()
        t = best[0]
        lines = [f"Template {t.name} ({t.solver}): {t.signature}", "", t.skeleton, "", "Slots:", *(f"- {s.name}: {s.description} ({s.format})" for s in t.slots)]
        lines += ["Sources:", *(f"- {n.source}: {n.transform}" for n in t.normalizations)] + [f"Note: {x}" for x in t.tips or []]
        return {"template": t.name, "instructions": "\n".join(lines), "related": self.related(t.name)}


@dataclass
class Correction:
    """Runs solve and fix in turns until an answer is good, the text comes back unchanged, or the rounds are used up."""

    rounds: int = 5
    history: list[dict] = field(default_factory=list)

    def run(self, spec: str, solve, fix) -> dict:
        """solve: text to result; fix: (text, result, round) to a new text or None."""
        for k in range(self.rounds):
            result = solve(spec)
            self.history.append({"spec": spec, "result": result})
            if result["status"] != "error":
                return {"converged": True, "rounds": k + 1, "result": result, "history": self.history}
            new = fix(spec, result, k)
            if not new or any(new == h["spec"] for h in self.history):
                break
            spec = new
        return {"converged": False, "rounds": len(self.history), "result": self.history[-1]["result"] if self.history else {"status": "error", "error": "no rounds"}, "history": self.history}
