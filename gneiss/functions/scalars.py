"""Scalar functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that search ignores.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into "
    "through during before after above below between and but or not no nor so if then than that this these those it its"
).split()
#: Languages by extension.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyw": "python", ".go": "go", ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure", ".edn": "clojure",
}


def glob_pattern(pattern: str) -> str:
    """A glob as an anchored regular expression: ** any text, * any text without a slash, ? one character but a slash."""
    out = []
    for token in re.findall(r"\*\*|.", pattern, re.DOTALL):
        out.append({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token))
    return "^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_pattern(pattern))


def escape_atom(s: Column) -> Column:
    """A Prolog atom: bare if it looks like one, else quoted."""
    quoted = s
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return F.when(s.rlike("^[a-z][a-z0-9_]*$"), s).otherwise(F.concat(F.lit("'"), quoted, F.lit("'")))


def quote_if_needed(s: Column) -> Column:
    """As escape_atom, but camelCase stays bare: for names inside lists."""
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(s.rlike("^[a-z][a-zA-Z0-9_]*$"), s).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def format_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def extract_layer(path: Column, layers: dict[str, int]) -> Column:
    """The first segment of a path that names a layer; null without."""
    known = F.array(*map(F.lit, layers))
    return F.get(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: F.array_contains(known, s)), F.lit(0))


def kind_priority(kind: Column) -> Column:
    return F.when(kind.isin("class", "interface"), 0).when(kind == "function", 1).when(kind == "method", 2).when(kind == "variable", 3).otherwise(4)


def truncate_doc(doc: Column, most: int = 160) -> Column:
    """White space collapsed; longer than `most`: cut, with an ellipsis; empty: null."""
    flat = F.trim(F.regexp_replace(doc, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).when(F.length(flat) > 0, flat)


def format_tokens(n: Column) -> Column:
    """Thousands to one digit, halves up, in whole numbers."""
    tenths = F.floor((n + 50) / 100)
    return F.when(n >= 1000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words, of lower-cased words between white space; 0 if neither has any."""
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cohesion(members: Column, inner_edges: Column) -> Column:
    """Inner edges over all pairs, to two digits, halves up; below two members 0."""
    return F.when(members < 2, F.lit(0.0)).otherwise(F.floor(inner_edges / (members * (members - 1) / 2) * 100 + 0.5) / 100)


def normalize_id(s: Column) -> Column:
    """The node id of a diagram as an atom."""
    body = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9_]", "_"), "_+", "_")
    body = F.regexp_replace(body, "^_|_$", "")
    return F.when(s == "[*]", F.lit("start_end")).when(body == "", F.lit("node")).otherwise(body)


def token_estimate(content: Column) -> Column:
    return F.ceil(F.length(content) / 3.5).cast("int")


def line_count(content: Column) -> Column:
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + F.when(F.endswith(content, F.lit("\n")), 0).otherwise(1)
    return F.when(content == "", 0).otherwise(n).cast("int")


def language_of(path: Column) -> Column:
    """By the extension, lower-cased; null for others."""
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return known[F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))]


def content_hash(content: Column, path: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), F.unhex(F.lit("00")), path.cast("binary")), 256)


def snippet(content: Column, line: Column, lines: int = 6) -> Column:
    """`lines` lines from a line, which counts from 1."""
    return F.array_join(F.slice(F.split(content, "\n"), F.greatest(line, F.lit(1)), F.lit(lines)), "\n")


def mock_embedding(text: Column, dimension: int) -> Column:
    """A deterministic vector of a text: the bytes of its hash, over 128, less 1, again and again."""
    h = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(i) / 128 - 1)


def _stripped(s: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def prolog_query(spec: Column) -> Column:
    """struct(program, query): the last line that begins with ?- is the query; without one, true."""
    lines = F.split(spec, "\n")
    at = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*\?-"), i).otherwise(-1)))
    rest = F.filter(lines, lambda x, i: i != at)
    return F.when(at >= 0, F.struct(F.array_join(rest, "\n").alias("program"), _stripped(F.substr(_stripped(F.element_at(lines, at + 1)), F.lit(3))).alias("query"))).otherwise(F.struct(spec.alias("program"), F.lit("true.").alias("query")))


def normalize_query(query: Column) -> Column:
    bare = F.regexp_replace(_stripped(query), r"^\?-\s*", "")
    return _stripped(F.regexp_replace(bare, r"\.\s*$", ""))


def prepare_smtlib(spec: Column, timeout_ms: int = 30_000) -> Column:
    """Commands that the solver adds itself are dropped; a time limit is set if there is none."""
    out = spec
    for command in (r"check-sat", r"get-model", r"get-unsat-core", r"exit", r"set-option\s+:produce-unsat-cores\s+\w+"):
        out = F.regexp_replace(out, rf"\(\s*{command}\s*\)", "")
    return F.when(out.rlike(r":timeout\b"), out).otherwise(F.concat(F.lit(f"(set-option :timeout {timeout_ms})\n"), out))


def is_kebab(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9-]*$")


def slot_names(skeleton: Column) -> Column:
    """The distinct names of a skeleton's slots, in their order."""
    return F.array_distinct(F.regexp_extract_all(skeleton, F.lit(r"\{\{SLOT:(\w+)\}\}"), F.lit(1)))


def slot_mismatch(skeleton: Column, defined: Column) -> Column:
    """struct(undefined, unused): slots of the skeleton without a definition, and definitions without a slot."""
    used = slot_names(skeleton)
    return F.struct(F.array_except(used, defined).alias("undefined"), F.array_except(defined, used).alias("unused"))


def classify_feedback(status: Column, error: Column, core: Column, model: Column, answers: Column) -> Column:
    """What a result means for whoever corrects the specification. core, answers: arrays of text; model: a map."""
    entries = F.transform(F.map_entries(model), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))
    n = F.size(answers)
    more = F.when(n > 5, F.concat(F.lit(" and "), (n - 5).cast("string"), F.lit(" more"))).otherwise("")
    return (
        F.when(status == "error", F.concat(F.lit("The solver failed: "), error))
        .when((status == "unsat") & (F.size(core) > 0), F.concat(F.lit("Unsatisfiable; these assertions conflict: "), F.array_join(core, ", ")))
        .when(status == "unsat", F.lit("Unsatisfiable: the constraints contradict each other."))
        .when((status == "sat") & (F.size(entries) > 0), F.concat(F.lit("Satisfiable: "), F.array_join(entries, ", ")))
        .when(status == "sat", F.lit("Satisfiable without any variable."))
        .when((status == "success") & (n == 0), F.lit("No solutions: check that facts and rules cover the query."))
        .when(status == "success", F.concat(n.cast("string"), F.lit(" solutions: "), F.array_join(F.slice(answers, 1, 5), "; "), more))
        .otherwise(F.lit("Unknown: the problem is outside of what can be decided here."))
    )


def common_ancestor(paths: list[str]) -> str:
    """The longest path of segments that all paths begin with; for one file its folder."""
    parts = [p.replace("\\", "/").split("/") for p in paths]
    if not parts:
        return ""
    parts = [p[:-1] for p in parts]
    n = 0
    while all(len(p) > n for p in parts) and len({p[n] for p in parts}) == 1:
        n += 1
    return "/".join(parts[0][:n])
