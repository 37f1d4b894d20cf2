"""Constraints over finite domains, as joins and filters; and a subset of SMT-LIB that maps to them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.fixpoint import frontiers, written


def contradictions(allow: DataFrame, deny: DataFrame) -> DataFrame:
    """Requests (the shared columns) that are both allowed and denied."""
    return allow.distinct().intersect(deny.select(allow.columns).distinct())


def can_access(policies: DataFrame, principal: str, resource: str) -> DataFrame:
    """One row (reachable): whether any policy (principal, action, resource) lets the principal at the resource."""
    return policies.where((F.col("principal") == principal) & (F.col("resource") == resource)).agg((F.count("*") > 0).alias("reachable"))


def differing_inputs(domain: DataFrame, a: Column, b: Column) -> DataFrame:
    """Inputs of a domain on which two configurations differ; none: they are equivalent over it."""
    return domain.where(~a.eqNullSafe(b))


def schema_gaps(rules: DataFrame) -> DataFrame:
    """(field, low, high, accepted_by): values that one side accepts and the other rejects; rules: (side, field, min, max), sides `a` and `b`.

    Integer fields; a missing limit is open and yields no gap beyond the other's limits.
    """
    a = rules.where("side = 'a'").select("field", F.col("min").alias("a_min"), F.col("max").alias("a_max"))
    b = rules.where("side = 'b'").select("field", F.col("min").alias("b_min"), F.col("max").alias("b_max"))
    both = a.join(b, "field")
    gap = lambda low, high, who: F.struct(low.alias("low"), high.alias("high"), F.lit(who).alias("accepted_by"))
    c = F.col
    parts = F.array_compact(
        F.array(
            F.when(c("a_min") < c("b_min"), gap(c("a_min"), F.least(c("b_min") - 1, c("a_max")), "a")),
            F.when(c("b_min") < c("a_min"), gap(c("b_min"), F.least(c("a_min") - 1, c("b_max")), "b")),
            F.when(c("a_max") > c("b_max"), gap(F.greatest(c("b_max") + 1, c("a_min")), c("a_max"), "a")),
            F.when(c("b_max") > c("a_max"), gap(F.greatest(c("a_max") + 1, c("b_min")), c("b_max"), "b")),
        )
    )
    return both.select("field", F.explode(parts).alias("g")).select("field", "g.low", "g.high", "g.accepted_by")


def counterexamples(domain: DataFrame, precondition: str, postcondition: str) -> DataFrame:
    """Inputs that meet the first condition and break the second. Says nothing beyond the domain."""
    return domain.where(F.expr(precondition) & ~F.expr(postcondition))


def unreachable_states(states: DataFrame, transitions: DataFrame, initial: str) -> DataFrame:
    """(state) that no way from the initial one leads to; transitions: (source, target)."""
    spark = states.sparkSession
    seeds = spark.createDataFrame([(initial,)], "node string")
    edges = transitions.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seen = frontiers(edges, seeds).select(F.col("node").alias("state")).unionAll(seeds.select(F.col("node").alias("state")))
    return states.select("state").distinct().join(seen, "state", "left_anti")


def dead_ends(states: DataFrame, transitions: DataFrame) -> DataFrame:
    return states.select("state").distinct().join(transitions.select(F.col("source").alias("state")), "state", "left_anti")


def _both_ways(pairs: DataFrame) -> DataFrame:
    there = pairs.select("package", "version", "other", "other_version")
    return there.unionAll(pairs.select("other", "other_version", "package", "version")).distinct()


def supported(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(package, version) of the candidates that stay once each version without support is gone.

    pairs: (package, version, other, other_version), the versions that go together, in either order. Packages are tied
    if any pair names both; those without ties keep all versions. A version is supported if, for each package tied to
    its own, it goes with a version that is left. Where ties form a tree or several, each version that stays is part of a
    whole choice; with cycles of ties it needn't be. Rows with nulls are left out; repeated rows count once.
    The supporters of a version are counted once for each tie. A round sends on only what the versions that left in the
    round before took away, so the work follows the pairs of the versions that leave.
    """
    version, tie = ["package", "version"], ["package", "version", "other"]
    candidates = candidates.select(*version).dropna().distinct()
    both = written(_both_ways(pairs.select(*tie, "other_version").dropna()))
    ties = both.select("package", "other").distinct()
    of = candidates.select(F.col("package").alias("other"), F.col("version").alias("other_version"))
    known = written(both.join(of, ["other", "other_version"], "left_semi").join(candidates, version, "left_semi"))
    counts = known.groupBy(*tie).agg(F.count("*").alias("n"))
    wanted = written(candidates.join(ties, "package").join(counts, tie, "left").select(*tie, F.coalesce("n", F.lit(0)).alias("n")))
    gone = written(wanted.where("n = 0").select(*version).distinct())
    left, taken, parts = gone, None, 1
    while gone.limit(1).count():
        lost = gone.toDF("other", "other_version").join(known, ["other", "other_version"]).groupBy(*tie).agg(F.count("*").alias("k"))
        lost = written(lost)
        taken = lost if taken is None else taken.unionAll(lost)
        now = taken.join(lost.select(*tie), tie, "left_semi").groupBy(*tie).agg(F.sum("k").alias("k"))
        gone = written(now.join(wanted, tie).where("n <= k").select(*version).distinct().join(left, version, "left_anti"))
        left, parts = left.unionAll(gone), parts + 1
        if parts == 16:  # one table again, so that plans don't grow with the rounds
            left, taken, parts = written(left), written(taken.groupBy(*tie).agg(F.sum("k").alias("k"))), 1
    return candidates.join(left, version, "left_anti")


def choices(candidates: DataFrame, pairs: DataFrame, packages: list[str]) -> DataFrame:
    """All choices of a version for each of `packages`, a column each, that go together; other ties only reduce the versions.

    Versions without support leave first, so where ties form a tree no join makes a row that a later one drops. The
    packages have to be tied together, directly or by others of the list.
    """
    pairs = written(pairs.select("package", "version", "other", "other_version").dropna().distinct())
    stay = written(supported(candidates, pairs))
    end = lambda c: stay.select(F.col("package").alias(c), F.col("version").alias(f"{c}_version"))
    both = _both_ways(pairs).where(F.col("package").isin(packages) & F.col("other").isin(packages))
    ties = {(x.package, x.other) for x in both.select("package", "other").distinct().collect()}  # at most the square of the list
    both = both.withColumnRenamed("version", "package_version").join(end("package"), ["package", "package_version"], "left_semi").join(end("other"), ["other", "other_version"], "left_semi")
    both = written(both)
    rows = stay.where(F.col("package") == packages[0]).select(F.col("version").alias(packages[0]))
    placed, rest = [packages[0]], list(packages[1:])
    while rest:
        q = next((q for q in rest if any((p, q) in ties for p in placed)), None)
        if q is None:
            raise ValueError(f"{', '.join(rest)}: not tied to {', '.join(placed)}")
        first, *others = [p for p in placed if (p, q) in ties]
        of = lambda p: both.where((F.col("package") == p) & (F.col("other") == q)).select(F.col("package_version").alias(p), F.col("other_version").alias(q))  # noqa: B023, E731
        rows = rows.join(of(first), first)
        for p in others:
            rows = rows.join(of(p), [p, q], "left_semi")
        placed.append(q)
        rest.remove(q)
    return rows.select(*packages)


@dataclass
class Problem:
    """variables: name to its values; constraints: name to (SQL condition, variables in it); whole: whether domains leave nothing out."""

    variables: dict[str, list | range] = field(default_factory=dict)
    constraints: dict[str, tuple[str, frozenset[str]]] = field(default_factory=dict)
    whole: bool = True


def _parts(spark: SparkSession, values: range) -> int:
    """A product of domains multiplies their partitions, so that a small domain gets one."""
    return max(1, min(spark.sparkContext.defaultParallelism, len(values) >> 16))


def assignments(spark: SparkSession, problem: Problem, names: list[str] | None = None) -> DataFrame:
    """All assignments that meet the named constraints (all by default); each constraint filters as soon as its variables are there."""
    left = {k: problem.constraints[k] for k in (names if names is not None else problem.constraints)}
    order = sorted(problem.variables, key=lambda v: len(problem.variables[v]))
    rows, bound = spark.range(0, 1, 1, 1).select(), set()
    for v in order:
        values = problem.variables[v]
        kind = "boolean" if values and isinstance(values[0], bool) else "long" if values and isinstance(values[0], int) else "string"
        one = spark.range(values.start, values.stop, 1, _parts(spark, values)).toDF(v) if isinstance(values, range) else spark.createDataFrame([(x,) for x in values], f"`{v}` {kind}").coalesce(1)
        for k in [k for k, (_, used) in left.items() if used == {v}]:
            one = one.where(left.pop(k)[0])
        bound.add(v)
        ready = [left.pop(k)[0] for k in [k for k, (_, used) in left.items() if used <= bound]]
        # a domain is a list in the problem's text; what a product of domains doesn't meet is dropped in the join
        rows = rows.crossJoin(one) if not ready else rows.join(one, reduce(lambda a, b: a & b, map(F.expr, ready)))
    for condition, _ in left.values():
        rows = rows.where(condition)
    return rows


def solve(spark: SparkSession, problem: Problem) -> dict:
    """status sat with a model, unsat with a minimal core, or unknown where the domains were only a sample."""
    found = assignments(spark, problem).limit(1).collect()
    if found:
        return {"status": "sat", "model": {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in found[0].asDict().items()}}
    if not problem.whole:
        return {"status": "unknown"}
    core = list(problem.constraints)
    for name in list(core):
        rest = [k for k in core if k != name]
        if not assignments(spark, problem, rest).limit(1).count():
            core = rest
    return {"status": "unsat", "core": core}


_TOKEN = re.compile(r';[^\n]*|"(?:[^"]|"")*"|\|[^|]*\||[()]|[^\s();"|]+')
_COMPARE = {"<": "<", "<=": "<=", ">": ">", ">=": ">="}


class Unsupported(ValueError):
    pass


def _forms(text: str) -> list:
    stack: list[list] = [[]]
    for t in _TOKEN.findall(text):
        if t.startswith(";"):
            continue
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) < 2:
                raise Unsupported("a parenthesis closes that was never opened")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise Unsupported("a parenthesis is not closed")
    return stack[0]


def parse_smtlib(text: str, sample: int = 20) -> Problem:
    """Bool, enumerations and Int with asserted limits. An Int without both limits is sampled around 0 and its limits, so unsat becomes unknown."""
    problem, kinds, enums, asserts = Problem(), {}, {}, []
    ignored = {"check-sat", "get-model", "set-logic", "set-option", "exit", "get-unsat-core", "set-info"}
    for form in _forms(text):
        head = form[0] if isinstance(form, list) and form else form
        if head == "declare-datatypes":
            for (name, _), constructors in zip(form[1], form[2]):
                enums[name] = [c[0] if isinstance(c, list) else c for c in constructors]
        elif head == "declare-const" or (head == "declare-fun" and form[2] == []):
            kinds[form[1]] = form[-1]
        elif head == "assert":
            asserts.append(form[1])
        elif head not in ignored:
            raise Unsupported(f"{head} is outside of what can be decided here")
    values = {v: k for k, names in enums.items() for v in names}

    def sql(e) -> tuple[str, frozenset[str]]:
        if isinstance(e, str):
            if e in kinds:
                return f"`{e}`", frozenset([e])
            if e in values:
                return f"'{e}'", frozenset()
            if re.fullmatch(r"-?\d+|true|false", e):
                return e, frozenset()
            raise Unsupported(f"{e} is not declared")
        op, args = e[0], [sql(x) for x in e[1:]]
        used = frozenset().union(*(u for _, u in args))
        x = [a for a, _ in args]
        if op == "=":
            return "(" + " AND ".join(f"{a} = {b}" for a, b in zip(x, x[1:])) + ")", used
        if op == "distinct":
            return "(" + " AND ".join(f"{a} <> {b}" for k, a in enumerate(x) for b in x[k + 1 :]) + ")", used
        if op in ("and", "or"):
            return ("(" + f" {op.upper()} ".join(x) + ")") if x else ("true" if op == "and" else "false"), used
        if op == "not":
            return f"(NOT {x[0]})", used
        if op == "=>":
            return f"((NOT {x[0]}) OR {x[1]})", used
        if op == "xor":
            return f"({x[0]} <> {x[1]})", used
        if op == "ite":
            return f"(CASE WHEN {x[0]} THEN {x[1]} ELSE {x[2]} END)", used
        if op in _COMPARE:
            return "(" + " AND ".join(f"{a} {_COMPARE[op]} {b}" for a, b in zip(x, x[1:])) + ")", used
        if op == "-" and len(x) == 1:
            return f"(-{x[0]})", used
        if op in ("+", "-", "*"):
            return "(" + f" {op} ".join(x) + ")", used
        if op == "mod":
            return f"pmod({x[0]}, {x[1]})", used
        raise Unsupported(f"{op} is outside of what can be decided here")

    low: dict[str, int] = {}
    high: dict[str, int] = {}
    number = lambda e: int(e) if isinstance(e, str) and re.fullmatch(r"-?\d+", e) else -int(e[1]) if isinstance(e, list) and len(e) == 2 and e[0] == "-" and isinstance(e[1], str) and e[1].isdigit() else None

    def limits(e) -> None:
        if not isinstance(e, list) or not e:
            return
        if e[0] == "and":
            for x in e[1:]:
                limits(x)
        elif e[0] in (*_COMPARE, "=") and len(e) == 3:
            for op, a, b in ((e[0], e[1], e[2]), ({"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}[e[0]], e[2], e[1])):
                n = number(b)
                if isinstance(a, str) and kinds.get(a) == "Int" and n is not None:
                    if op in (">", ">=", "="):
                        low[a] = max(low.get(a, n), n)
                    if op in ("<", "<=", "="):
                        high[a] = min(high.get(a, n), n)
        elif e[0] == "or" and all(isinstance(x, list) and len(x) == 3 and x[0] == "=" and x[1] == e[1][1] and number(x[2]) is not None for x in e[1:]):
            name, found = e[1][1], [number(x[2]) for x in e[1:]]
            if kinds.get(name) == "Int":
                low[name], high[name] = max(low.get(name, min(found)), min(found)), min(high.get(name, max(found)), max(found))

    for k, e in enumerate(asserts):
        name = f"a{k}"
        if isinstance(e, list) and e and e[0] == "!":
            name = e[e.index(":named") + 1] if ":named" in e else name
            e = e[1]
        limits(e)
        problem.constraints[name] = sql(e)
    for v, kind in kinds.items():
        if kind == "Bool":
            problem.variables[v] = [False, True]
        elif kind in enums:
            problem.variables[v] = enums[kind]
        elif kind == "Int":
            if v in low and v in high:
                problem.variables[v] = range(low[v], high[v] + 1)  # listed by Spark, however many
            else:
                problem.whole = False
                around = {0, *([low[v]] if v in low else []), *([high[v]] if v in high else [])}
                problem.variables[v] = sorted({a + d for a in around for d in range(-sample, sample + 1)})
        else:
            raise Unsupported(f"{kind} is outside of what can be decided here")
    return problem


def solve_smtlib(spark: SparkSession, text: str) -> dict:
    if not text.strip():
        return {"status": "sat", "model": {}}
    try:
        return solve(spark, parse_smtlib(text))
    except Unsupported as e:
        return {"status": "error", "error": str(e)}
    except (IndexError, ValueError, TypeError) as e:
        return {"status": "error", "error": f"the text can't be read: {e}"}
