"""Prefix doubling over sampled suffixes, against all strings of a table in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from gneiss.llm import ranks
from gneiss.llm.common import stored, stored_by
from gneiss.llm.ranks import numbered, sorted_groups, sorted_kinds
from gneiss.llm.suffixes import Anchors, ranked_blocks, remove_repeated_bytes


def plain(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and not b for g, b in zip(gone, b"\0" + gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts_of(kind, r):
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzäß漢 ") for _ in range(n))
    if kind == "passages":
        shared = [word(r.choice([40, 60, 150, 400])) for _ in range(12)]
        texts = [word(r.randrange(90)).join(r.choices(shared, k=r.randrange(1, 5))) + word(r.randrange(60)) for _ in range(80)]
        return texts + [t[r.randrange(5) : len(t) - r.randrange(5)] for t in texts[:20]] + texts[:3] + [texts[0]] * 30
    if kind == "periodic":
        return ["a" * 500, "a" * 40, "a" * 39, "ab" * 100, "ba" * 60 + "c" + "ab" * 30, "a" * 30 + "b" + "a" * 30, "b" + "a" * 45, "abc" * 200 + "d" + "abc" * 30] + ["xyz" * 13 + "k", "xyz" * 13 + "k"]
    if kind == "few letters":
        return ["".join(r.choice("ab") for _ in range(r.randrange(300))) for _ in range(60)]
    return [None, None, "", "", " ", "short", "short", "漢字" * 40, "é" * 100, "\x00" * 80, "q" * 40]


@pytest.mark.parametrize("kind, reach", [("passages", None), ("passages", 3), ("periodic", None), ("periodic", 3), ("few letters", 7), ("odd", None)])
def test_against_plain_python(spark, kind, reach):
    texts = texts_of(kind, random.Random(7))
    df = spark.createDataFrame([(k % 5 or None, t, "clash", k) for k, t in enumerate(texts)], "doc_id int, text string, k0 string, at int")
    got = remove_repeated_bytes(df, least=40, reach=reach).collect()
    want = plain(texts, 40)
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) for x in got) == Counter((k % 5 or None, *w) for k, w in enumerate(want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(df).collect() == []


def test_groups_across_partitions(spark):
    """One group holds most rows and is cut between partitions; partitions without rows; groups at their edges."""
    r = random.Random(3)
    rows = [(7, 7, k) for k in range(5000)] + [(r.randrange(60), r.randrange(3), 5000 + k) for k in range(500)] + [(100 + k, 0, 6000 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "x long, y long, z long").repartition(7)
    got = sorted_groups(df, ["x", "y"], ["z"]).collect()
    order = sorted(rows)
    count = Counter((x, y) for x, y, _ in rows)
    first = {}
    for n, (x, y, _) in enumerate(order):
        first.setdefault((x, y), n)
    assert sorted((x.number, x.x, x.y, x.z, x.start, x.alone) for x in got) == [(n, x, y, z, first[x, y], count[x, y] == 1) for n, (x, y, z) in enumerate(order)]
    some = sorted_groups(df, ["x", "y"], ["z"], whole=False).collect()
    several = [(x, y, z) for x, y, z in order if count[x, y] > 1]
    assert [x.z for x in sorted(some, key=lambda x: x.number)] == [z for *_, z in several]
    starts = {}
    for x, (a, b, _) in zip(sorted(some, key=lambda x: x.number), several):
        assert starts.setdefault((a, b), x.start) == x.start
    assert len(set(starts.values())) == len(starts) and list(starts.values()) == sorted(starts.values())
    assert sorted_groups(df.where("x < 0"), ["x", "y"], ["z"]).collect() == []
    assert sorted(x.number for x in numbered(df).collect()) == list(range(len(rows)))


def test_rounds_of_doubling(spark):
    """Names of 1, 4, 16 ... phrases, in half as many rounds as by twos; a text goes over several batches."""
    r = random.Random(5)
    texts = [[r.randrange(3) for _ in range(r.randrange(1, 60))] for _ in range(30)] + [[7] * 70, [7] * 66]
    rows = [(x, t, at, 2 + x) for t, text in enumerate(texts) for at, x in enumerate(text)]
    most = 500
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        rounds = [x.collect() for x in ranked_blocks(stored(spark.createDataFrame(rows, "x long, t long, at int, size int")), most)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(rounds) == 4 and not rounds[3]  # 7 repeats 64 times, in 576 bytes
    for level, got in enumerate(rounds):
        width = 4**level
        blocks = {(t, at): tuple(text[at : at + width]) for t, text in enumerate(texts) for at in range(len(text) - width + 1)}
        blocks = {k: v for k, v in blocks.items() if sum(v) + 2 * width <= most}
        count = Counter(blocks.values())
        assert {(x.t, x.at): x["size"] for x in got} == {k: sum(v) + 2 * width for k, v in blocks.items() if count[v] > 1}
        names = {}
        assert all(names.setdefault(blocks[x.t, x.at], x.name) == x.name for x in got)
        assert len(set(names.values())) == len(names)


def test_texts_in_buckets(spark):
    """Texts that were written by t aren't shuffled for a join by t."""
    texts = stored_by(spark.range(500).selectExpr("id as t", "cast(id as string) as text"), "t")
    found = spark.range(0, 1000, 2).groupBy(F.col("id").alias("t")).agg(F.count("*").alias("n"))
    joined = texts.join(found.hint("shuffle_hash"), "t", "left")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((x.t, x.text, x.n) for x in joined.collect()) == [(k, str(k), None if k % 2 else 1) for k in range(500)]
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("gneiss_")]


def test_kinds_across_pieces(spark):
    """Names and kinds that go over pieces and partitions; names of one kind, of settled kinds only, and of mixed kinds."""
    r = random.Random(11)
    rows = [(5, 1, 1, k, False) for k in range(900)]  # one hot kind
    rows += [(6, k // 2, 0, 1000 + k, False) for k in range(600)]  # a hot name, all settled
    rows += [(7, k, 3, 2000 + k, k != 250) for k in range(400)]  # a hot name with one kind that isn't settled
    rows += [(8, k, 3, 3000 + k, True) for k in range(200)]
    rows += [(20 + r.randrange(150), r.randrange(3), r.randrange(2), 4000 + k, r.random() < 0.3) for k in range(700)]
    kinds = {}
    for x in sorted(rows, key=lambda x: x[:4]):
        kinds.setdefault(x[:3], []).append(x)
    # whether a row of a kind is known is told by its first one where it is alone
    settled = {k: len(v) > 1 or v[0][4] for k, v in kinds.items()}
    mixed = {name for name, _, _ in kinds if len(of := [k for k in kinds if k[0] == name]) > 1 and not all(settled[k] for k in of)}
    want = set()
    for k, v in kinds.items():
        for n, x in enumerate(v):
            found, asked = len(v) > 1 and not x[4], n == 0 and k[0] in mixed
            if found or asked:
                want.add((x[3], found, len(v) > 1 or x[4], asked))
    df = spark.createDataFrame(rows, "name long, x long, y long, z long, known boolean").repartition(5)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most, piece in ((16, 1), (7, 40), (10000, 1 << 17)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = sorted_kinds(df, "name", ["x", "y"], ["z"], "known", piece).collect()
            assert len(got) == len(want) and {(x.z, x.found, x.settled, x.asked) for x in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sorted_kinds(df.where("name < 0"), "name", ["x", "y"], ["z"], "known").collect() == []


def test_one_sort_for_each_kind_of_rows(spark, monkeypatch):
    """Runs, groups and strings are sorted once each, and what is written of them is without their digests and without rows that occur once."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = word(300)
    texts = [word(250) + shared[r.randrange(40) :] + word(250) for _ in range(20)] + [word(900) for _ in range(20)]
    written = []
    monkeypatch.setattr(ranks, "stored", lambda df: written.append(stored(df)) or written[-1])
    got = remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), with_text=False).collect()
    assert sum(x.n_removed for x in got) == sum(w[1] for w in plain(texts, 200))
    last = [x for x in written if "x" not in x.columns]
    assert [{"i", "t", "settled" if k else "several"} <= {*x.columns} for k, x in enumerate(last)] == [True] * 3
    assert not any({"e0", "f0", "w0", "name", "c"} & {*x.columns} for x in last)


def test_runs_of_anchors():
    """Runs are where the anchors of the first and last stretch change, byte by byte."""
    r = random.Random(4)
    for least, reach in ((40, 16), (40, 3), (200, 96)):
        texts = [bytes(r.choice(b"abc") for _ in range(r.randrange(least, 700))) for _ in range(12)] + [b"a" * least, b"ab" * least]
        a = Anchors(texts, least, reach)
        span = reach + 7
        want = []
        base = 0
        for t, text in enumerate(texts):
            hashes = (np.ndarray((len(text) - 7,), "<u8", text, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            of = [k + int(np.argmin(hashes[k : k + reach])) for k in range(len(text) - span + 1)]
            at = sorted(set(of))
            assert [x - base for x in a.at[a.begins[t] : a.begins[t + 1]].tolist()] == at
            pairs = [(at.index(of[k]), at.index(of[k + least - span])) for k in range(len(text) - least + 1)]
            for k, p in enumerate(pairs):
                if k and p == pairs[k - 1]:
                    want[-1][2] += 1
                else:
                    want.append([t, base + k, 1, *p])
            base += len(text)
        assert [list(x) for x in zip(*(c.tolist() for c in a.runs()))] == want
