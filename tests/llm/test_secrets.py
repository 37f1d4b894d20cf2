"""Added spans against plain Python, texts and tokens of any size, and the null distribution by simulation."""

import math
import random
import re
import string
import time

from pyspark.sql import functions as F

from gneiss.llm import secrets
from tests.llm.test_texts import base_spans, make

LETTERS = string.ascii_letters + string.digits + "+/"


def tail(z):
    x = abs(z)
    t = math.exp(-x * x / 2) / 2.5066282746 / (0.661 * x + 0.339 * math.sqrt(x * x + 5.51))
    return t if z >= 0 else 1 - t


def pairs_z(pairs, n, m):
    all_, p = n * (n - 1) / 2, 1 / m
    sigma = math.sqrt(all_ * p * (1 - p))
    root = 2 * sigma / (1 - 2 * p + 2 * (n - 2) * p)
    z = (pairs - 0.5 - all_ * p) / sigma
    return -9.0 if z <= -root else 3 * root * ((1 + z / root) ** (1 / 3) - 1 + 1 / (9 * root * root))


def battery(token):
    """(randomness stands, evidence) of a token, or None."""
    t = token.rstrip("=")
    a = next((e[2] for e in secrets.ENCODINGS if re.match(e[1], token)), None)
    if a is None or len(t) < 20:
        return None
    n, m, x = len(t), len(a), [a.index(c) + 1 for c in t]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = sum((u - mean) * (v - mean) for u, v in zip(x, x[1:])) / max(spread, 1e-9)
    high = [v > m // 2 for v in x]
    both = 2 * sum(high) * (n - sum(high))
    var = both * (both - n) / (n * n * (n - 1))
    runs_z = (1 + sum(u != v for u, v in zip(high, high[1:])) - 1 - both / n) / math.sqrt(var) if var > 0 else 9.0
    z = pairs_z(sum(t.count(c) * (t.count(c) - 1) / 2 for c in a), n, m)
    p = min(tail(z), 2 * tail(abs(runs_z)), 2 * tail(abs((serial + 1 / n) * math.sqrt(n))))
    kind = "".join("L" if c.islower() else "U" if c.isupper() else "D" if c.isdigit() else "S" for c in t)
    single = sum(math.log(0.9 * secrets.LETTERS[c] / 10_010 + 0.1 / 26) if c in secrets.LETTERS else math.log(0.1 if c.isdigit() else 0.25) for c in t.lower())
    text = single + max(sum(math.log(s[kind[k : k + 2]]) for k in range(n - 1)) for s in secrets.STEPS)
    return 3 * p > 0.001, max(0.0, -text - n * math.log(m)) / math.log(10)


def candidates(text):
    out, begin, pieces = [], 0, []
    for match in re.finditer(secrets.ASSIGN, text, re.ASCII):
        pieces.append((begin, text[begin : match.start()]))
        begin = match.end()
    for at, piece in [*pieces, (begin, text[begin:])]:
        for run in re.finditer(secrets.TOKEN, piece):
            ways = []
            for k, p in enumerate(secrets.PARTS):
                parts = [(0, run[0])] if k == 0 else [(q.start(), q[0]) for q in re.finditer(p, run[0])] if re.search("[/_-]", run[0]) else []
                tested = [(at + run.start() + o, at + run.start() + o + len(t), battery(t)) for o, t in parts if not re.search(secrets.KNOWN, t)]
                good = [(b, e, v[1]) for b, e, v in tested if v and v[0]]
                ways.append((sum(v for _, _, v in good), -k, good))
            out += max(ways, key=lambda w: w[:2])[2]
    return out


def added(texts, rate=0.001):
    found = [[(b, e, sum(e - b >= s for s in secrets.STRATA), min(secrets.BINS, math.floor(10 * v))) for b, e, v in candidates(t or "")] for t in texts]
    limit = {}
    for s in range(len(secrets.STRATA) + 1):
        bins = [x[3] for f in found for x in f if x[2] == s]
        limit[s] = min((b for b in range(secrets.BINS + 1) if (k := sum(v >= b for v in bins)) and 10 ** (-b / 10) <= rate * k / len(bins)), default=secrets.BINS + 1)
    return [[(b, 3, e) for b, e, s, v in f if v >= limit[s]] for f in found]


def test_added_spans(spark):
    r = random.Random(11)
    token = lambda n, a=LETTERS: "".join(r.choice(a) for _ in range(n))
    fronts = ["", "x=", "https://a.b/c/", "KEY=", "some_name_", "a/b/", "token: ", "secret = '", "é😀"]
    texts = [f"word {r.choice(fronts)}{token(r.choice([20, 22, 30, 40, 64, 90]), r.choice([LETTERS, string.digits + 'abcdef', string.ascii_uppercase + '234567', string.ascii_letters + string.digits + '-_']))} end {token(r.randint(1, 40))}" for _ in range(150)]
    texts += [f"{token(25)}/{token(40)}_{token(30)} AKIA{token(16, string.ascii_uppercase)} {token(40, string.digits + 'abcdef')}{token(20)}== x" for _ in range(20)]
    texts += ["internationalization_of_everything/and/its/paths getUserNameFromDatabase2 a1" * 3, "aaaaaaaaaaaaaaaaaaaaaaaaa1A bbbbbbbbbbbbbbbbbbbbbbbbb 11111111111111111111111A", None, "", texts[0]]
    got = {x.doc_id: x for x in secrets.scan(make(spark, list(enumerate(texts)))).collect()}
    want = added(texts)
    assert sum(map(len, want)) > 100
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == base_spans(t or "")
        assert [tuple(s) for s in got[i].added] == want[i], t


def test_any_size(spark):
    r = random.Random(1)
    long = "".join(r.choice(LETTERS) for _ in range(300_000))
    many = "token=abcdef12 " * 60_000 + "".join(r.choice(LETTERS) for _ in range(44))
    began = time.monotonic()
    got = {x.doc_id: x for x in secrets.scan(make(spark, [(0, f"data {long} end"), (1, many), (2, "x " * 100_000), (3, "a" * 500_000)])).collect()}
    assert time.monotonic() - began < 100
    assert [tuple(s) for s in got[0].added] == [(5, 3, 300_005)]
    assert len(got[1].base) == 60_000 and tuple(got[1].base[-1]) == (59_999 * 15, 0, 59_999 * 15 + 14) and len(got[1].added) == 1
    assert not got[2].added and not got[3].added and not got[3].base[1:]


def test_the_null_holds_at_short_lengths(spark):
    """Random tokens are rejected about as rarely as the level says, at lengths where a chi-squared table would be off."""
    r = random.Random(3)
    for n in (20, 32, 64):
        for a in (string.digits + "abcdef", LETTERS):
            over = sum(tail(pairs_z(sum(t.count(c) * (t.count(c) - 1) / 2 for c in set(t)), n, len(a))) < 0.01 for t in (r.choices(a, k=n) for _ in range(6000)))
            assert over < 6000 * 0.016, (n, len(a), over)
    df = spark.createDataFrame([(float(p), float(n), float(m)) for p, n, m in [(0, 20, 64), (9, 20, 64), (40, 40, 16)]], "p double, n double, m double")
    for x in df.select("*", secrets._pairs_z(F.col("p"), F.col("n"), F.col("m")).alias("z")).collect():
        assert math.isclose(x.z, pairs_z(x.p, x.n, x.m), rel_tol=1e-9)
