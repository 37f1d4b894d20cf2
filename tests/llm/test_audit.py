"""The filters' audit against plain Python: odd tables, copies, and parts whose hashes are equal though their texts aren't."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from gneiss.llm import audit as audits


def plain(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    judged = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails += "E" * (i is not None and least.get(t, i) < i)
        judged.append((s or "", set(fails), i in good, i in toxic))
    out, shapley = {}, {}
    for part in {x[0] for x in judged}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in judged if x[0] == part]
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                mine = [x for x in judged if x[0] == part and f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                out[part, order, k + 1] = (len(left), len(removed), len(mine) - len(removed), sum(x[1] == {f} for x in mine), sum(x[2] for x in removed), sum(x[3] for x in removed))
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def result(df):
    rows = df.collect()
    found = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in rows}
    assert len(found) == len(rows)
    return found


def tables(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(["alpha", "beta", "Gamma", "DELTA", "漢字", "x|y", "é", "100%"] + [f"w{k}" for k in range(99)]) for _ in range(n))
    texts = [text(r.choice([1, 49, 50, 80, 200])) for _ in range(40)] + [None, "", " ", "A", "a" * 63, "a" * 64, "a" * 65, "a" * 319 + "b", "a" * 319 + "c", "\t\n\x0b", "   ", "word " * 30_000]
    docs = [(k, t, f"s{k % 2}") for k, t in enumerate(texts)] + [(100 + k, r.choice(texts), r.choice(["s0", None, ""])) for k in range(60)]
    docs += [(7, texts[7], "s0")] * 3 + [(7, texts[8], "s1"), (None, texts[3], "s1"), (None, texts[3], None), (500, "only here", "s0")]
    labels = [(k, k % 2, k % 3) for k in range(60)] + [(7, 1, 1), (7, 0, 0), (8, None, None), (None, 1, 1), (9999, 1, 1), (500, 1, None)]
    df = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, source string, mask int, length string")
    return docs, labels, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_against_plain_python(spark):
    docs, labels, df, marks = tables(spark)
    assert result(audits.audit(df, marks)) == plain(docs, labels)
    assert result(audits.audit(df, marks.where("false"))) == plain(docs, [])
    assert audits.audit(df.where("false"), marks).collect() == []


def test_texts_decide_where_hashes_clash(spark, monkeypatch):
    docs, labels, df, marks = tables(spark)
    monkeypatch.setattr(audits, "part_of", lambda rounds=None: [F.col("length"), F.lit(0).cast("long").alias("part_hash")])
    assert result(audits.audit(df, marks)) == plain(docs, labels)


def test_blocks_cover_a_text(spark):
    for n in (0, 1, 63, 64, 65, 320, 321, 1344, 1345, 100_000):
        t = ("0123456789é" * (n // 11 + 1))[:n]
        df = spark.createDataFrame([(t,)], "t string")
        sizes, at = [], 0
        while at < n:
            sizes.append(min(64 * 4 ** len(sizes), n - at))
            at += sizes[-1]
        want = df.select(F.array(*[F.xxhash64(F.substring("t", sum(sizes[:k]) + 1, s)) for k, s in enumerate(sizes)]) if sizes else F.array().cast("array<bigint>")).first()[0]
        assert df.select(audits.block_hashes(F.col("t"))).first()[0] == want
