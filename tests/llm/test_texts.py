"""Operators on texts against plain Python, on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gneiss.llm import pii, secrets
from gneiss.llm.decontam import contamination, decontaminate
from gneiss.llm.sharding import shard_rows
from gneiss.llm.simhash import covering_masks, keep_one, simhash_groups
from gneiss.llm.substring import remove_repeated

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, fp int"


def make(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, 2) for i, t in texts], schema)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(30)]
    passage = " ".join(r.choice(words) for _ in range(50))
    out = list(base)
    out += [base[0], base[0], base[1] + " tail", base[2].replace("w3 ", "W3 ", 1)]
    out += [f"{a}\t{passage}\n{b}" for a, b in zip(base[3:8], base[8:13])]
    out += ["a " * 300, "a " * 40, "x y " * 100, None, None, "", "  ", "ein", " ".join(r.choice(words) for _ in range(20_000)), "é\x85ü " * 50]
    rows = list(enumerate(out))
    return [*rows, rows[0], (5, "another text with an id that is there already"), (None, base[4]), (None, None)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_repeated_windows(spark, texts):
    count = collections.Counter()
    for _, t in texts:
        w = split(t)
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = collections.Counter()
    for i, t in texts:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    for rounds in (1, 2, 3):
        got = collections.Counter(map(tuple, remove_repeated(make(spark, texts), rounds=rounds).collect()))
        assert got == want


def test_simhash(spark, texts):
    def print_of(t):
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, print_of(t)) for i, t in texts]
    group = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    first = {}
    for k, (i, _) in zip(group, prints):
        if i is not None:
            first[k] = min(first.get(k, i), i)
    want = collections.Counter((i, f"{p:016x}", first.get(k)) for k, (i, p) in zip(group, prints))
    docs = make(spark, texts)
    assert collections.Counter(map(tuple, simhash_groups(docs).collect())) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(group))


def test_covering_masks_lose_no_pair():
    r = random.Random(0)
    for radius in (1, 2, 3):
        tables = covering_masks(radius)
        for _ in range(500):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), radius):
                y ^= 1 << b
            assert any(x & m == y & m for m, _ in tables)


def test_hot_buckets_are_dealt_again(spark):
    from gneiss.llm.common import components
    from gneiss.llm.simhash import fingerprint_links

    prints = [0] + [1 << a for a in range(63)] + [1 << a | 1 << b for a in range(0, 40, 3) for b in range(a)]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = fingerprint_links(df, hot=3).collect()
    assert all((x.a ^ x.b).bit_count() <= 2 for x in links)
    assert components(spark.createDataFrame(links)).select("component").distinct().count() == 1


def fold(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, texts, block_bytes):
    r = random.Random(5)
    items = [(k, " ".join(split(r.choice([t for _, t in texts if t and len(t) > 80]))[:n]).upper()) for k, n in enumerate([40, 13, 14, 20, 60, 5, 1])]
    items += [(0, items[0][1]), (7, None), (8, ""), (9, "Nowhere found words " * 5), (None, items[1][1]), (10, items[1][1])]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = collections.Counter()
    for i, t in texts:
        w, found = fold(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        want[i, len(w), sum(hit), tuple(sorted(str(x) for x in found if x is not None)), sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    docs, tests = make(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, tests, ["doc_id"], block_bytes=block_bytes).collect()
    assert collections.Counter((x.row.doc_id, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in got) == want
    by_item = collections.defaultdict(list)
    for i, t in items:
        by_item[i].append(fold(t))
    for x in got:
        words = fold(dict((i, t) for i, t in texts if i == x.row.doc_id and len(fold(t)) == x.n_words).get(x.row.doc_id))
        for m in x.matches:
            assert any(words[m.begin : m.begin + m.words] == w[m.item_begin : m.item_begin + m.words] for w in by_item[int(m["item"]) if m["item"] else None])
        assert x.longest == max((m.words for m in x.matches), default=0)
        longest = 0  # by brute force, of those of at least a window
        for w in (w for v in by_item.values() for w in v if w):
            for a in range(len(w)):
                for b in range(len(words) if len(words) < 500 else 0):
                    n = 0
                    while a + n < len(w) and b + n < len(words) and w[a + n] == words[b + n]:
                        n += 1
                    longest = max(longest, n if n >= min(13, len(w)) else 0)
        assert longest == x.longest or len(words) >= 500
    clean = decontaminate(docs, tests, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in want.items() if not k[4])


def base_spans(text):
    out = []
    assign_ = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign_, text, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    r = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda n, a=letters: "".join(r.choice(a) for _ in range(n))
    key = [token(44) for _ in range(20)]
    rows = [f"é😀 some words {k} and more" for k in key]
    rows += [
        'secret=token:abcdef password = "hunter2!" API_KEY: abcdefgh, apikey=x1',
        "AKIA" + "Q7" * 8 + " AKIA123 " + "0123456789abcdef" * 2 + " token=" + "f00d" * 8,
        "internationalization-of-everything/and/its/paths/in/this/text and_a_long_snake_case_name_here",
        "ſecret=abcdefgh pasſword=abcdefgh toKen=abcdefgh",
        "",
        None,
    ]
    rows += [f"plain{'text' * (k % 9)} of_ordinary_words_number_{k}_and_so_on" for k in range(60)]
    docs = make(spark, list(enumerate(rows)))
    got = {x.doc_id: x for x in secrets.scan(docs).select("*", secrets.joined(F.concat("base", "added")).alias("spans")).collect()}
    for i, t in enumerate(rows):
        assert [tuple(s) for s in got[i].base] == base_spans(t or ""), t
    found = sum([s.start == r_.index(k) and s.end == s.start + 44 for s in got[i].added] == [True] for i, (k, r_) in enumerate(zip(key, rows)))
    assert found >= 18
    assert not any(got[i].added for i in range(22, len(rows)))
    assert got[0].spans.startswith("random:")


def test_empty_tables(spark):
    none = make(spark, [])
    tests = spark.createDataFrame([], "item_id long, text string")
    assert remove_repeated(none).count() == simhash_groups(none).count() == keep_one(none).count() == 0
    assert contamination(none, tests, ["doc_id"]).count() == shard_rows(none).count() == 0
    assert secrets.scan(none).count() == pii.pseudonymize(none, "k").count() == 0
