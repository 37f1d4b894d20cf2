"""Resolution: import specifiers to files, path suffixes, aliases, inherited fields and methods, receiver chains, qualified callees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.fixpoint import closure

#: Extensions tried, in this order.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Types whose methods are the language's own.
BUILTIN_TYPES = ("Array", "Map", "Set", "WeakMap", "WeakSet", "Promise", "String", "Number", "Boolean", "Object", "Function", "RegExp", "Date", "Error", "Symbol", "BigInt", "JSON", "Math", "Buffer")


def normalize_path(path: Column) -> Column:
    """Resolves . and .. segments."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def candidates(base: Column, extensions: tuple[str, ...] = IMPORT_EXTENSIONS) -> Column:
    """array of struct(rank, path): the path with each extension, then its index files. A JavaScript ending also stands for its source."""
    bare = F.regexp_replace(base, r"\.(?:js|jsx|mjs|cjs)$", "")
    tries = [base, *(F.concat(bare, F.lit(e)) for e in extensions), *(F.concat(base, F.lit("/index" + e)) for e in extensions)]
    return F.array(*(F.struct(F.lit(k).alias("rank"), t.alias("path")) for k, t in enumerate(tries)))


def rewrite_alias(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source, rewritten) for specifiers that an alias (prefix, target) begins: the longest prefix wins.

    All beginnings of each distinct specifier are looked up as equal strings, whatever the number of aliases.
    """
    keys = F.transform(F.sequence(F.lit(0), F.length("source")), lambda n: F.left("source", n))
    hit = specifiers.select("source").distinct().select("source", F.explode(keys).alias("prefix")).join(aliases, "prefix")
    best = hit.groupBy("source").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("x"))
    return best.select("source", F.concat("x.target", F.substr(F.col("source"), F.length("x.prefix") + 1)).alias("rewritten"))


def folder_of(file: str) -> Column:
    return F.when(F.col(file).contains("/"), F.regexp_replace(file, "/[^/]*$", "")).otherwise("")


def import_candidates(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(folder, source, rank, path): the paths that each distinct specifier of a folder could mean."""
    asked = imports.select(folder_of("file").alias("folder"), "source").distinct()
    relative = asked.where(F.col("source").rlike(r"^\.\.?(/|$)")).select("folder", "source", normalize_path(F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.col("source"))).alias("base"))
    if aliases is not None:
        other = asked.where(~F.col("source").rlike(r"^\.\.?(/|$)"))
        relative = relative.unionAll(other.join(rewrite_alias(other, aliases), "source").select("folder", "source", normalize_path(F.col("rewritten")).alias("base")))
    return relative.select("folder", "source", F.explode(candidates(F.col("base"))).alias("t")).select("folder", "source", "t.rank", "t.path")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports with `resolved`: a relative specifier, or one that an alias rewrites, to the first candidate file; exact case before any case.

    Each distinct (folder, specifier) is resolved once. A bare specifier without an alias stays unresolved.
    """
    rows = imports.withColumn("folder", folder_of("file"))
    tries = import_candidates(imports, aliases)
    paths = files.select(F.col("path").alias("file_path")).distinct()
    exact = tries.join(paths.hint("merge"), F.col("path") == F.col("file_path")).withColumn("loose", F.lit(0))
    loose = tries.join(paths.hint("merge"), F.lower("path") == F.lower("file_path")).withColumn("loose", F.lit(1))
    best = exact.unionAll(loose).groupBy("folder", "source").agg(F.min_by("file_path", F.struct("loose", "rank", "file_path")).alias("found"))
    return rows.join(best.hint("merge"), ["folder", "source"], "left").select(*[c for c in imports.columns if c != "resolved"], F.col("found").alias("resolved"))


def suffix_index(files: DataFrame) -> DataFrame:
    """(suffix, path): every path by each of its endings, as it is, without extension, and without /index; the first file by seq wins."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    rows = files.select("path", "seq", F.explode(ends).alias("end"))
    bare = F.regexp_replace("end", r"\.[^./]+$", "")
    rows = rows.select("path", "seq", F.explode(F.array_distinct(F.array("end", bare, F.regexp_replace(bare, "(^|/)index$", "")))).alias("suffix")).where("suffix <> ''")
    return rows.groupBy("suffix").agg(F.min_by("path", F.struct("seq", "path")).alias("path"))


def suffix_resolve(specifiers: DataFrame, index: DataFrame) -> DataFrame:
    """(source, path): the longest ending of a specifier that some file has; for each ending with extensions, as an index file, then bare."""
    clean = F.regexp_replace(F.replace(F.regexp_replace("source", r"^(?:\.\.?/)+", ""), F.lit("\\"), F.lit("/")), r"\.(?:js|jsx|mjs|cjs)$", "")
    parts = F.split(clean, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((k - 1).alias("dropped"), F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("end")))
    rows = specifiers.select("source").distinct().select("source", F.explode(ends).alias("e")).where("e.end <> ''")
    tries = rows.select("source", "e.dropped", F.explode(candidates(F.col("e.end"))).alias("t"))
    tries = tries.select("source", "dropped", F.when(F.col("t.rank") == 0, 99).otherwise(F.col("t.rank")).alias("rank"), F.col("t.path").alias("suffix"))
    # both sides have many rows a row read, which Spark's estimates for a broadcast don't know of
    return tries.join(index.hint("merge"), "suffix").groupBy("source").agg(F.min_by("path", F.struct("dropped", "rank")).alias("path"))


def ancestors(extends: DataFrame) -> DataFrame:
    """(class_name, ancestor, depth), the class itself at depth 0; cycles end where they would repeat. extends: (class_name, parent)."""
    from gneiss.operators.fixpoint import checkpointed

    edges = extends.select("class_name", "parent").distinct()
    every = edges.select("class_name").union(edges.select("parent")).distinct()
    found = every.select("class_name", F.col("class_name").alias("ancestor"), F.lit(0).alias("depth"))
    frontier, depth = checkpointed(found), 0
    found = frontier
    while True:
        depth += 1
        step = frontier.join(edges.select(F.col("class_name").alias("ancestor"), "parent"), "ancestor").select("class_name", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        frontier = checkpointed(step.join(found.select("class_name", "ancestor"), ["class_name", "ancestor"], "left_anti"))
        if not frontier.limit(1).count():
            return found
        found = found.unionAll(frontier)


def inherited(own: DataFrame, extends: DataFrame, member: str, value: str) -> DataFrame:
    """(class_name, member, value, owner): own members and those of the nearest ancestor that has them; later rows (seq) win within a class."""
    latest = own.groupBy("class_name", member).agg(F.max_by(value, "seq").alias(value))
    above = ancestors(extends.unionAll(own.select("class_name", F.col("class_name").alias("parent")))).where("class_name = ancestor or depth > 0")
    rows = above.join(latest.withColumnRenamed("class_name", "ancestor"), "ancestor")
    best = rows.groupBy("class_name", member).agg(F.min_by(F.struct(F.col(value), F.col("ancestor")), F.struct("depth", "ancestor")).alias("x"))
    return best.select("class_name", member, F.col("x").getField(value).alias(value), F.col("x.ancestor").alias("owner"))


def resolve_chains(pending: DataFrame, fields: DataFrame) -> DataFrame:
    """pending with `type`: this/self is the enclosing class, another first step the type of that variable; each further step is a field of the type before.

    pending: receiver_chain array<string>, enclosing_class, var_types map<string,string>; fields: (class_name, field, type).
    """
    head = F.get("receiver_chain", F.lit(0))
    rows = pending.withColumn("type", F.when(head.isin("this", "self"), F.col("enclosing_class")).otherwise(F.try_element_at("var_types", head)))
    longest = rows.agg(F.max(F.size("receiver_chain"))).first()[0] or 0
    lookup = fields.select(F.col("class_name").alias("of"), F.col("field").alias("step"), F.col("type").alias("next"))
    for k in range(1, longest):
        step = F.get("receiver_chain", F.lit(k))
        rows = rows.withColumn("wanted", step).join(lookup, (F.col("type") == F.col("of")) & (F.col("wanted") == F.col("step")), "left")
        rows = rows.withColumn("type", F.when(F.col("wanted").isNull(), F.col("type")).otherwise(F.col("next"))).drop("of", "step", "next", "wanted")
    return rows


def variable_types(asked: DataFrame, bindings: DataFrame) -> DataFrame:
    """asked (file, scope, name) with `type`: the binding in the function's scope, else the file's (a null scope); later rows (seq) win.

    bindings: (file, scope, name, type, seq).
    """
    latest = bindings.groupBy("file", "scope", "name").agg(F.max_by("type", "seq").alias("type"))
    inner = latest.where("scope is not null").withColumnRenamed("type", "inner_type")
    outer = latest.where("scope is null").select("file", "name", F.col("type").alias("outer_type"))
    rows = asked.join(inner, ["file", "scope", "name"], "left").join(outer, ["file", "name"], "left")
    return rows.select(*asked.columns, F.coalesce("inner_type", "outer_type").alias("type"))


def qualify_callees(calls: DataFrame, pending: DataFrame, fields: DataFrame, methods: DataFrame, contains: DataFrame) -> DataFrame:
    """calls with callee_qn: by the receiver's type and the class that declares the method; else by the only owner of the method's name.

    methods: (class_name, method, owner), with inherited ones; contains: (parent, child). The k-th pending call of a
    (caller, callee) fills the k-th call row that has no name yet.
    """
    typed = resolve_chains(pending, fields)
    known = methods.select(F.col("class_name").alias("type"), F.col("method").alias("callee"), "owner")
    only = lambda df, a, b: df.select(F.col(a).alias("callee"), F.col(b).alias("o")).groupBy("callee").agg(F.min("o").alias("o"), F.count_distinct("o").alias("n")).where("n = 1").drop("n")
    by_parent = only(contains, "child", "parent").withColumnRenamed("o", "by_parent")
    by_method = only(methods.where("class_name = owner"), "method", "owner").withColumnRenamed("o", "by_method")
    foreign = F.array(*map(F.lit, BUILTIN_TYPES))
    rows = typed.join(known, ["type", "callee"], "left").join(by_parent, "callee", "left").join(by_method, "callee", "left")
    qn = F.when(F.col("type").isNotNull() & F.array_contains(foreign, F.col("type")), F.lit(None).cast("string")).otherwise(F.coalesce("owner", "by_parent", "by_method"))
    rows = rows.select("caller", "callee", "seq", qn.alias("class")).where("class is not null")
    rows = rows.selectExpr("caller", "callee", "class || '.' || callee as qn", "row_number() over (partition by caller, callee order by seq) as k")
    open_ = calls.selectExpr("*", "row_number() over (partition by caller, callee, callee_qn is null order by seq) as k")
    out = open_.join(rows, ["caller", "callee", "k"], "left")
    return out.select("caller", "callee", F.coalesce("callee_qn", "qn").alias("callee_qn"), "seq")


def reachable_classes(extends: DataFrame) -> DataFrame:
    """All (class_name, ancestor) by the closure, without depth."""
    return closure(extends.select(F.col("class_name").alias("src"), F.col("parent").alias("dst"))).select(F.col("src").alias("class_name"), F.col("dst").alias("ancestor"))
