"""A Datalog subset of Prolog: facts, rules, stratified negation, comparisons. Each relation is a DataFrame.

Strata are evaluated bottom-up, recursive ones semi-naively: a round joins only what the last round found. So rules
terminate on cycles, where a goal-directed evaluation without tables wouldn't. Anything else (lists, compound terms,
arithmetic, cut) is an error, never an empty answer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.fixpoint import checkpointed

MOST_ANSWERS, MOST_TRACE, MOST_ROUNDS = 1000, 500, 100_000
_TOKEN = re.compile(
    r"(?P<skip>\s+|%[^\n]*|/\*.*?\*/)|(?P<op>:-|\?-|\\\+|\\==|\\=|=:=|=<|>=|==|=|<|>|[(),;!|\[\]/+*]|->)|(?P<num>-?\d+(?:\.\d+)?)|(?P<end>\.(?=\s|%|$))|(?P<atom>[a-z]\w*)|(?P<var>[A-Z_]\w*)|(?P<quoted>'(?:[^'\\]|\\.|'')*')",
    re.DOTALL,
)
_COMPARE = {"=": "=", "==": "=", "=:=": "=", "\\=": "<>", "\\==": "<>", "<": "<", ">": ">", "=<": "<=", ">=": ">="}


class DatalogError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    value: str
    is_var: bool


@dataclass(frozen=True)
class Literal:
    name: str
    args: tuple[Term, ...]
    negated: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}/{len(self.args)}"

    def names(self) -> list[str]:
        return [a.value for a in self.args if a.is_var and a.value != "_"]


@dataclass(frozen=True)
class Rule:
    head: Literal
    body: tuple[Literal, ...]


@dataclass
class Program:
    facts: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise DatalogError(f"can't read the program at: {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = self.unnamed = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("eof", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value:
            raise DatalogError(f"expected {value!r}, found {t[1] or 'the end'!r}")
        self.at += 1
        return t

    def term(self) -> Term:
        kind, text = self.take()
        if kind == "var":
            return Term(text, True)
        if kind == "num":
            return Term(text, False)
        if kind in ("atom", "quoted"):
            if self.peek()[1] == "(":
                raise DatalogError(f"unsupported: the compound term {text}(...)")
            return Term(_unquote(text) if kind == "quoted" else text, False)
        raise DatalogError(f"unsupported: {text or 'the end'!r} as a term")

    def literal(self) -> Literal:
        negated = self.peek()[1] == "\\+"
        if negated:
            self.take()
        at = self.at
        kind, text = self.take()
        if kind in ("atom", "quoted") and self.peek()[1] == "(":
            self.take("(")
            args = [self.term()]
            while self.peek()[1] == ",":
                self.take()
                args.append(self.term())
            self.take(")")
            return Literal(_unquote(text) if kind == "quoted" else text, tuple(args), negated)
        if kind == "atom" and self.peek()[1] not in _COMPARE:
            return Literal(text, (), negated)
        self.at = at
        left = self.term()
        _, op = self.take()
        if op not in _COMPARE:
            raise DatalogError(f"unsupported: {op!r} in a body")
        return Literal(op, (left, self.term()), negated)

    def body(self) -> tuple[Literal, ...]:
        out = [self.literal()]
        while self.peek()[1] == ",":
            self.take()
            out.append(self.literal())
        if self.peek()[1] in (";", "->", "!", "|"):
            raise DatalogError(f"unsupported: {self.peek()[1]!r}")
        return tuple(out)


def _unquote(text: str) -> str:
    body = text[1:-1].replace("''", "'")
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), body, flags=re.DOTALL)


def parse(text: str) -> Program:
    r, out = _Reader(text), Program()
    while r.peek()[0] != "eof":
        if r.peek()[1] == ":-":
            while r.peek()[0] not in ("end", "eof"):
                r.take()
            r.take()
            continue
        head, body = r.literal(), ()
        if r.peek()[1] == ":-":
            r.take()
            body = r.body()
        if r.take()[0] != "end":
            raise DatalogError(f"a clause of {head.name} does not end with a period")
        if head.negated or head.name in _COMPARE:
            raise DatalogError("a clause needs a predicate as its head")
        if body:
            out.rules.append(Rule(head, body))
        elif head.names() or any(a.is_var for a in head.args):
            raise DatalogError(f"unsupported: the fact {head.name} with variables")
        else:
            out.facts.setdefault(head.key, []).append(tuple(a.value for a in head.args))
    return out


def _columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)] or ["unit"]


def _bind(df: DataFrame, literal: Literal) -> DataFrame:
    """The relation with a column for each variable of the literal; constants and repeated variables are conditions."""
    first: dict[str, str] = {}
    for c, a in zip(_columns(len(literal.args)), literal.args):
        if not a.is_var:
            df = df.where(F.col(c) == a.value)
        elif a.value != "_":
            if a.value in first:
                df = df.where(F.col(c) == F.col(first[a.value]))
            else:
                first[a.value] = c
    return df.select(*(F.col(c).alias(v) for v, c in first.items())).distinct() if first else df.select(F.lit(1).alias("unit")).limit(1)


def _join(a: DataFrame | None, b: DataFrame) -> DataFrame:
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns and c != "unit"]
    b = b.drop("unit") if b.columns != ["unit"] else b
    if shared:
        return a.join(b, shared)
    return a.crossJoin(b.drop("unit") if b.columns == ["unit"] else b)  # the rule itself asks for all pairs


def _rule(spark: SparkSession, rule: Rule, relation, delta_at: int | None = None, delta: DataFrame | None = None) -> DataFrame:
    """The head's tuples. delta_at: that body literal reads delta instead of its relation."""
    out, later = None, []
    for k, x in enumerate(rule.body):
        if x.name in _COMPARE or x.negated:
            later.append(x)
        else:
            out = _join(out, _bind(delta if k == delta_at else relation(x), x))
    out = spark.range(1).select(F.lit(1).alias("unit")) if out is None else out
    waiting = later
    while waiting:
        rest = []
        for x in waiting:
            unbound = [v for v in x.names() if v not in out.columns]
            if x.name in _COMPARE and not x.negated:
                if len(unbound) == 1 and x.name == "=":
                    known = next(a for a in x.args if a.value != unbound[0] or not a.is_var)
                    out = out.withColumn(unbound[0], F.col(known.value) if known.is_var else F.lit(known.value))
                elif unbound:
                    rest.append(x)
                else:
                    out = out.where(_compare(x))
            elif x.name in _COMPARE:
                if unbound:
                    rest.append(x)
                else:
                    out = out.where(~_compare(x))
            elif unbound:
                raise DatalogError(f"unsafe: {unbound[0]} in the negation of {x.name} is not bound")
            else:
                b = _bind(relation(x), Literal(x.name, x.args))
                shared = [c for c in b.columns if c != "unit"]
                out = out.join(b, shared, "left_anti") if shared else out.crossJoin(b.agg(F.count("*").alias("#n"))).where("`#n` = 0").drop("#n")
        if len(rest) == len(waiting):
            raise DatalogError(f"unsafe: a variable of a comparison in a rule of {rule.head.name} is not bound")
        waiting = rest
    for a in rule.head.args:
        if a.is_var and a.value not in out.columns:
            raise DatalogError(f"unsafe: {a.value} in the head of {rule.head.name} is not bound")
    made = [(F.col(a.value) if a.is_var else F.lit(a.value)).alias(c) for c, a in zip(_columns(len(rule.head.args)), rule.head.args)]
    return out.select(*(made or [F.lit(1).alias("unit")])).distinct()


def _compare(x: Literal):
    a, b = (F.col(t.value) if t.is_var else F.lit(t.value) for t in x.args)
    if x.name in ("=", "==", "\\=", "\\=="):
        return (a == b) if x.name in ("=", "==") else (a != b)
    a, b = a.try_cast("double"), b.try_cast("double")
    return F.coalesce({"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[_COMPARE[x.name]], F.lit(False))


def strata(rules: list[Rule]) -> list[set[str]]:
    """Derived predicates in the order of evaluation, those that depend on each other together."""
    derived = {r.head.key for r in rules}
    level = dict.fromkeys(derived, 0)
    for _ in range(len(derived) + 1):
        changed = False
        for r in rules:
            for x in r.body:
                if x.key in derived and level[r.head.key] < level[x.key] + x.negated:
                    level[r.head.key] = level[x.key] + x.negated
                    changed = True
        if not changed:
            break
    else:
        raise DatalogError("negation is not stratified")
    reach = {p: {x.key for r in rules if r.head.key == p for x in r.body if x.key in derived} for p in derived}
    for _ in derived:
        for p in derived:
            reach[p] |= set().union(*(reach[q] for q in reach[p]), set())
    groups: list[set[str]] = []
    for p in sorted(derived, key=lambda p: (level[p], len(reach[p] | {p}), p)):
        if not any(p in g for g in groups):
            groups.append({p} | {q for q in derived if q in reach[p] and p in reach[q]})
    return groups


def evaluate(spark: SparkSession, program: Program, relations: dict[str, DataFrame] | None = None, only: set[str] | None = None, rounds: int = MOST_ROUNDS) -> dict[str, DataFrame]:
    """All relations by name/arity. relations: DataFrames by name/arity that come with the program's facts; only: what is asked for, with all it needs."""
    known: dict[str, DataFrame] = {}
    for key, df in (relations or {}).items():
        known[key] = df.select(*(F.col(c).cast("string").alias(n) for c, n in zip(df.columns, _columns(len(df.columns))))).distinct()
    for key, rows in program.facts.items():
        n = int(key.rpartition("/")[2])
        df = spark.createDataFrame(rows if n else [(1,)], ", ".join(f"{c} string" for c in _columns(n)) if n else "unit int").distinct()
        known[key] = known[key].unionAll(df).distinct() if key in known else df

    def relation(x: Literal) -> DataFrame:
        if x.key not in known:
            n = len(x.args)
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in _columns(n)) if n else "unit int")
        return known[x.key]

    needed = {r.head.key for r in program.rules}
    if only is not None:
        needed, todo = set(), list(only)
        while todo:
            p = todo.pop()
            if p not in needed:
                needed.add(p)
                todo += [x.key for r in program.rules if r.head.key == p for x in r.body]
    for group in strata(program.rules):
        group &= needed
        rules = [r for r in program.rules if r.head.key in group]
        for p in group:
            parts = [_rule(spark, r, relation) for r in rules if r.head.key == p and not any(x.key in group for x in r.body)]
            for part in parts:
                known[p] = known[p].unionAll(part).distinct() if p in known else part
        recursive = [r for r in rules if any(x.key in group for x in r.body)]
        if not recursive:
            continue
        delta = {p: checkpointed(known[p]) for p in group if p in known}
        known.update(delta)
        for _ in range(rounds):
            fresh: dict[str, DataFrame] = {}
            for r in recursive:
                for k, x in enumerate(r.body):
                    if x.key in delta and not x.negated:
                        part = _rule(spark, r, relation, k, delta[x.key])
                        fresh[r.head.key] = fresh[r.head.key].unionAll(part) if r.head.key in fresh else part
            delta = {}
            for p, df in fresh.items():
                df = df.distinct()
                df = checkpointed(df.join(known[p], df.columns, "left_anti") if p in known else df)
                if df.limit(1).count():
                    delta[p] = df
                    known[p] = known[p].unionAll(df) if p in known else df
            if not delta:
                break
        else:
            raise DatalogError("the limit of rounds was reached")
    return known


def solve(spark: SparkSession, program: str, query: str, relations: dict[str, DataFrame] | None = None, explain: bool = False, known: dict[str, DataFrame] | None = None) -> dict:
    """status success with answers (bindings, formatted), at most MOST_ANSWERS; or error. explain: derived tuples too."""
    try:
        parsed = parse(program)
        text = re.sub(r"^\s*\?-", "", query).strip()
        reader = _Reader(text if text.endswith(".") else text + ".")
        body = reader.body()
        if reader.take()[0] != "end" or reader.peek()[0] != "eof":
            raise DatalogError("the query can't be read")
        names = tuple(Term(v, True) for v in dict.fromkeys(v for x in body if not x.negated for v in x.names()) if not v.startswith("_"))
        if body == (Literal("true", ()),):
            return {"status": "success", "answers": [{"bindings": {}, "formatted": "true"}]}
        known = known if known is not None else evaluate(spark, parsed, relations, {x.key for x in body} if not explain else None)

        def relation(x: Literal) -> DataFrame:
            return known[x.key] if x.key in known else spark.createDataFrame([], ", ".join(f"{c} string" for c in _columns(len(x.args))) if x.args else "unit int")

        rows = _rule(spark, Rule(Literal("answer", names), body), relation)
        found = rows.orderBy(*rows.columns).limit(MOST_ANSWERS).collect()
        answers = []
        for x in found:
            bindings = {n.value: x[c] for n, c in zip(names, rows.columns)} if names else {}
            answers.append({"bindings": bindings, "formatted": ", ".join(f"{k} = {v}" for k, v in bindings.items()) or "true"})
        out = {"status": "success", "answers": answers}
        if explain:
            trace = []
            for key in sorted({r.head.key for r in parsed.rules}):
                if key in known and len(trace) < MOST_TRACE:
                    trace += [f"{key.rpartition('/')[0]}({', '.join(map(str, x))})" for x in known[key].orderBy(*known[key].columns).limit(MOST_TRACE - len(trace)).collect()]
            out["trace"] = trace
        return out
    except DatalogError as e:
        return {"status": "error", "error": str(e)}


def solve_all(spark: SparkSession, program: str, queries: list[str], relations: dict[str, DataFrame] | None = None) -> list[dict]:
    """A result for each query on one evaluation of the program; stops after the first error."""
    out = []
    try:
        known = evaluate(spark, parse(program), relations)
    except DatalogError as e:
        return [{"status": "error", "error": str(e)}]
    for q in queries:
        out.append(solve(spark, program, q, relations, known=known))
        if out[-1]["status"] == "error":
            break
    return out
