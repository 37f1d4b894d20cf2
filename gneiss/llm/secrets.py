"""Secret scans: patterns, and a battery of randomness tests for tokens that no pattern names. DataFrame functions only.

A token's encoding is inferred from its characters. Against its alphabet of m symbols three tests are made: chi-squared
uniformity of the symbols, runs above and below the alphabet's middle, and serial correlation of neighbours. The
chi-squared statistic is a linear function of the number of pairs of equal symbols; at 20 characters over 64 symbols
its distribution is far from the normal one, so it is referred to the shifted gamma distribution that has the exact
mean, variance and skewness of that number at the token's length. A token is a candidate while no test, after
Bonferroni's correction, rejects randomness. Its evidence is how much likelier uniform symbols make it than a model of
ordinary tokens (letters by frequency, steps between classes of characters): the chance that the model reaches a ratio
of r is at most 1 / r. The Benjamini-Hochberg procedure then holds the false-discovery rate within each stratum of
lengths, over all documents.

Tokens are sought outside the matches of the assign pattern. A run of token characters is tested whole, split at '/',
split at '_' and '-', and split at all of these; the way to split whose candidates have most evidence together is taken.
All work on a text or token is linear in its length, but for sorting and for running totals by doubling.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut, once, running_totals

#: Fixed patterns. Leftmost runs of a class: those long enough are the same as the runs of the open pattern that are.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs, and the parts of them between '/', between '_' and '-', and between all three; '=' only pads.
PARTS = tuple("[A-Za-z0-9" + more + "]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?" for more in ("+/_-", "+_-", "+/", "+"))
TOKEN = PARTS[0]
#: What a base span has of a token, also where the assign pattern cut its end off.
KNOWN = f"{HEX}|{ACCESS}|AKIA[A-Z0-9]*$"
KINDS = ("assign", "access", "hex", "random")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, what a token of it looks like, its symbols.
ENCODINGS = (
    ("hex", r"^(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+=*$", _UPPER + "234567"),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Frequency of letters in 10,000, and steps between classes: ordinary tokens, and those in capitals.
LETTERS = dict(zip(_LOWER, (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)))
STEPS = (
    {"LL": 0.9, "LU": 0.02, "LD": 0.03, "LS": 0.05, "UL": 0.6, "UU": 0.3, "UD": 0.05, "US": 0.05, "DD": 0.8, "DL": 0.06, "DU": 0.06, "DS": 0.08, "SL": 0.6, "SU": 0.2, "SD": 0.15, "SS": 0.05},
    {"LL": 0.3, "LU": 0.6, "LD": 0.05, "LS": 0.05, "UL": 0.01, "UU": 0.9, "UD": 0.04, "US": 0.05, "DD": 0.8, "DL": 0.01, "DU": 0.11, "DS": 0.08, "SL": 0.05, "SU": 0.75, "SD": 0.15, "SS": 0.05},
)
STRATA = (24, 32, 48, 64)  # lengths at which a stratum begins, after the first
BINS = 400  # tenths of evidence, the logarithm to base 10 of the likelihood ratio


def _upper_tail(z: Column) -> Column:
    """P(N > z), to 0.3 % of itself."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / 2.5066282746 / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51))
    return F.when(z >= 0, tail).otherwise(1 - tail)


_PLACED = "array<struct<t:string,start:int>>"


def _found(text: Column, pattern: str) -> Column:
    """struct(m: matches of a pattern, b: what stands before each, and after the last)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))


def _placed(pieces: Column, starts: Column) -> Column:
    return once(starts, lambda s: F.zip_with(pieces, F.slice(s, F.lit(1), F.size(pieces)), lambda t, at: F.struct(t.alias("t"), at.alias("start"))))


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, F.length)


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern and where each starts, in code points."""
    zero = F.array(F.lit(0))
    placed = once(_found(text, pattern), lambda x: _placed(x["m"], running_totals(F.zip_with(_lengths(x["b"]), F.concat(zero, _lengths(x["m"])), lambda b, m: b + m))))
    return F.when(text.rlike(pattern), placed.cast(_PLACED)).otherwise(F.array().cast(_PLACED))


def _between(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern, and where it starts."""
    zero = F.array(F.lit(0))
    whole = F.array(F.struct(text.alias("t"), F.lit(0).alias("start")))
    steps = lambda x: F.zip_with(F.slice(_lengths(x["b"]), F.lit(1), F.size(x["m"])), _lengths(x["m"]), lambda b, m: b + m)
    placed = once(_found(text, pattern), lambda x: _placed(x["b"], running_totals(F.concat(zero, steps(x)))))
    return F.when(text.rlike(pattern), placed.cast(_PLACED)).otherwise(whole.cast(_PLACED))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["t"])).alias("end"))).cast(_SPAN)


def _assign_spans(text: Column) -> Column:
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
    marked = F.zip_with(_matches(text, ASSIGN), long_enough, lambda x, w: F.struct(x["t"].alias("t"), x["start"].alias("start"), w.alias("w")))
    return _spans(F.filter(marked, lambda x: x["w"]), 0)


def _log_text(token: Column) -> Column:
    """The logarithm of the probability of a token, in the likelier model of ordinary tokens."""
    n = F.length(token)
    without = lambda of, c: F.length(F.replace(of, c, F.lit("")))
    score = F.array(*(F.lit(math.log(0.9 * x / 10_010 + 0.1 / 26)) for x in LETTERS.values()))
    letters = once(
        F.lower(token),
        lambda low: F.aggregate(F.zip_with(F.array(*(F.lit(c) for c in LETTERS)), score, lambda c, s: (n - without(low, c)) * s), F.lit(0.0), lambda a, x: a + x),
    )
    digits = n - F.length(F.translate(token, _DIGITS, ""))
    symbols = F.length(F.translate(token, _UPPER + _LOWER + _DIGITS, ""))
    classes = F.translate(token, _UPPER + _LOWER + _DIGITS + "+/_-", "U" * 26 + "L" * 26 + "D" * 10 + "S" * 4)

    def steps(kinds: Column) -> Column:
        counts = {k: F.regexp_count(kinds, F.lit(f"{k[0]}(?={k[1]})")) for k in STEPS[0]}
        return once(F.struct(*(c.alias(k) for k, c in counts.items())), lambda c: F.greatest(*(sum((c[k] * math.log(v) for k, v in t.items()), F.lit(0.0)) for t in STEPS)))

    return letters + digits * math.log(0.1) + symbols * math.log(0.25) + once(classes, steps)


def _pairs_z(pairs: Column, n: Column, m: Column) -> Column:
    """The normal quantile of P(number of pairs of equal symbols >= pairs) among n symbols drawn from m, by the first three moments."""
    all_, p = n * (n - 1) / 2, 1 / m
    moments = once(F.struct((all_ * p).alias("mean"), F.sqrt(all_ * p * (1 - p)).alias("sigma"), (1 - 2 * p + 2 * (n - 2) * p).alias("third")), lambda s: F.struct(((pairs - 0.5 - s["mean"]) / s["sigma"]).alias("z"), (2 * s["sigma"] / s["third"]).alias("root_k")))
    gamma = lambda s: F.when(s["z"] <= -s["root_k"], -9.0).otherwise(3 * s["root_k"] * (F.cbrt(1 + s["z"] / s["root_k"]) - 1 + 1 / (9 * s["root_k"] * s["root_k"])))
    return once(moments, gamma)


def _battery(token: Column) -> Column:
    """struct(random: whether randomness stands, evidence) of a token; null if it has no encoding."""
    which = reduce(lambda e, k: F.when(token.rlike(ENCODINGS[k][1]), k).otherwise(e), reversed(range(len(ENCODINGS))), F.lit(None).cast("int"))
    alphabets = F.array(*(F.lit(e[2]) for e in ENCODINGS))
    shape = F.struct(F.rtrim(token, F.lit("=")).alias("t"), F.element_at(alphabets, which + 1).alias("a"))

    def counted(s: Column) -> Column:
        n = F.length(s["t"])
        counts = F.transform(F.split(s["a"], ""), lambda c: n - F.length(F.replace(s["t"], c, F.lit(""))))
        places = F.transform(F.split(s["t"], ""), lambda c: F.instr(s["a"], c))
        return F.struct(s["t"].alias("t"), n.cast("double").alias("n"), F.length(s["a"]).cast("double").alias("m"), counts.alias("c"), places.alias("x"))

    def tests(s: Column) -> Column:
        n, m = s["n"], s["m"]
        half = F.floor(m / 2).cast("int")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        numbered = lambda f: total(F.transform(s["c"], lambda c, i: f(c, (i + 1).cast("double"))))
        walk = F.aggregate(
            F.slice(s["x"], F.lit(2), F.size(s["x"])),
            F.struct(F.element_at(s["x"], 1).alias("last"), F.lit(0.0).alias("products"), F.lit(1.0).alias("runs")),
            lambda a, x: F.struct(x.alias("last"), (a["products"] + a["last"] * x).alias("products"), (a["runs"] + ((x > half) != (a["last"] > half)).cast("double")).alias("runs")),
        )
        return F.struct(
            n.alias("n"),
            m.alias("m"),
            total(F.transform(s["c"], lambda c: c * (c - 1) / 2.0)).alias("pairs"),
            numbered(lambda c, i: c * i).alias("sum"),
            numbered(lambda c, i: c * i * i).alias("squares"),
            total(F.slice(s["c"], half + 1, half)).alias("above"),
            walk.alias("walk"),
            (F.element_at(s["x"], 1) + F.element_at(s["x"], -1)).alias("ends"),
            F.greatest(F.lit(0.0), -_log_text(s["t"]) - n * F.log(m)).alias("log_ratio"),
        )

    def scores(s: Column) -> Column:
        n = s["n"]
        mean, both = s["sum"] / n, 2 * s["above"] * (n - s["above"])
        z = F.struct(mean.alias("mean"), (s["squares"] - n * mean * mean).alias("spread"), (1 + both / n).alias("runs"), (both * (both - n) / (n * n * (n - 1))).alias("runs_var"))

        def three(t: Column) -> Column:
            lagged = s["walk"]["products"] - t["mean"] * (2 * s["sum"] - s["ends"]) + (n - 1) * t["mean"] * t["mean"]
            serial_z = (lagged / F.greatest(t["spread"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)
            runs_z = F.when(t["runs_var"] > 0, (s["walk"]["runs"] - t["runs"]) / F.sqrt(F.greatest(t["runs_var"], F.lit(1e-9)))).otherwise(9.0)
            return F.array(_pairs_z(s["pairs"], n, s["m"]), F.abs(runs_z), F.abs(serial_z))

        tails = F.transform(once(z, three), lambda x, i: F.when(i == 0, 1).otherwise(2) * _upper_tail(x))
        return F.struct((3 * F.array_min(tails) > 0.001).alias("random"), (s["log_ratio"] / math.log(10)).alias("evidence"))

    return once(shape, lambda s: F.when(s["a"].isNotNull() & (F.length(s["t"]) >= 20), once(once(counted(s), tests), scores)))


def _candidates(run: Column) -> Column:
    """The candidates of a run (t, start), as (start, end, evidence): those of the way to split it that has most evidence."""
    kind = "array<struct<way:int,t:string,start:int>>"
    whole = F.array(F.struct(F.lit(0).alias("way"), run["t"].alias("t"), F.lit(0).alias("start"))).cast(kind)
    way = lambda k: F.transform(_matches(run["t"], PARTS[k]), lambda x: F.struct(F.lit(k).alias("way"), x["t"].alias("t"), x["start"].alias("start")))
    split = F.concat(*(way(k) for k in range(1, len(PARTS))))
    parts = F.filter(F.when(run["t"].rlike("[/_-]"), F.concat(whole, split.cast(kind))).otherwise(whole), lambda x: ~x["t"].rlike(KNOWN))
    tested = F.transform(parts, lambda x: F.struct(x["way"].alias("way"), (run["start"] + x["start"]).alias("start"), (run["start"] + x["start"] + F.length(x["t"])).alias("end"), _battery(x["t"]).alias("b")))
    random = F.transform(F.filter(tested, lambda x: x["b"]["random"]), lambda x: F.struct(x["way"].alias("way"), x["start"].alias("start"), x["end"].alias("end"), x["b"]["evidence"].alias("evidence")))

    def best(found: Column) -> Column:
        ways = F.transform(F.sequence(F.lit(0), F.lit(len(PARTS) - 1)), lambda k: F.filter(found, lambda x: x["way"] == k))
        weighed = F.transform(ways, lambda w, k: F.struct(F.aggregate(w, F.lit(0.0), lambda a, x: a + x["evidence"]).alias("evidence"), (-k).alias("k"), w.alias("w")))
        return F.array_max(weighed)["w"]

    return once(random, best)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.001) -> DataFrame:
    """One row per row of docs: id_col, base and added: arrays of (start, kind, end), in code points, end exclusive; kind counts KINDS.

    added: tokens whose randomness stands, discovered at a false-discovery rate of `rate` within their stratum of
    lengths, that meet no base span. Null texts are empty. Repeated rows are rows like others. Extra columns are not
    read. An empty table gives no rows. Texts, tokens and numbers of matches may be of any size. The counts behind the
    discoveries are a table of at most (len(STRATA) + 1) * (BINS + 1) rows; nothing else leaves the executors.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = F.concat(_assign_spans(text), _spans(_matches(text, ACCESS), 1), _spans(_matches(text, HEX), 2))
    runs = F.flatten(
        F.transform(
            F.filter(_between(text, ASSIGN), lambda x: x["t"].rlike(TOKEN)),
            lambda x: F.transform(_matches(x["t"], TOKEN), lambda y: F.struct(y["t"].alias("t"), (x["start"] + y["start"]).alias("start"))),
        )
    )
    stratum = lambda n: sum((F.when(n >= k, 1).otherwise(0) for k in STRATA), F.lit(0))
    found = F.transform(
        F.flatten(F.transform(runs, _candidates)),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum(x["end"] - x["start"]).alias("stratum"), F.least(F.lit(BINS), F.floor(10 * x["evidence"])).cast("int").alias("bin")),
    )
    candidate = "array<struct<start:int,end:int,stratum:int,bin:int>>"
    found = F.when(text.rlike(TOKEN), found.cast(candidate)).otherwise(F.array().cast(candidate))
    rows = cut(rows.select("id", F.array_sort(base).alias("base"), found.alias("found")))
    counts = rows.select(F.explode("found").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n")).collect()
    least = []
    for s in range(len(STRATA) + 1):
        bins = {c.bin: c.n for c in counts if c.stratum == s}
        total, below, first = sum(bins.values()), 0, BINS + 1
        for b in range(BINS, -1, -1):
            below += bins.get(b, 0)
            if below and 10 ** (-b / 10) <= rate * below / total:
                first = b
        least.append(first)
    limit = F.array(*(F.lit(x) for x in least))
    added = F.filter("found", lambda x: x["bin"] >= F.element_at(limit, x["stratum"] + 1))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return rows.select(F.col("id").alias(id_col), "base", added.cast(_SPAN).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
