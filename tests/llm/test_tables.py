"""Language ID, vectors, chats, mixing and the pipeline."""

import collections
import hashlib
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import chat, language
from gneiss.llm.mixing import mix, source_rates
from gneiss.llm.multiindex import Grid, near_vectors

SF = "/root/testdata/sf0.001"


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    filters = language.fit(docs.where(~out))
    assert filters.languages == ["de", "en", "es", "fr"]
    got = language.identify(docs.where(out), filters, ["doc_id", "lang"])
    right, all_ = got.agg(F.count_if(F.col("row.lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * all_
    odd = spark.createDataFrame([(None,), ("",), ("12 !!",), ("漢字",), ("the " * 5000,)], "text string")
    assert [(x.lang_pred, x.score == 0) for x in language.identify(odd, filters, ["text"]).collect()] == [("und", True)] * 3 + [("de", True), ("en", False)]
    nothing = language.fit(docs.where("false"))
    assert {x.lang_pred for x in language.identify(docs.limit(3), nothing, ["doc_id"]).collect()} == {"und"}


def test_fit_draws_rows_not_ids(spark):
    """Null and equal ids, repeated rows, one language with one text, junk languages, columns of other names."""
    texts = {"en": "the house and the garden of the old man were", "de": "das Haus und der Garten des alten Mannes waren", "hi": "यह एक पुराना घर और बगीचा है"}
    rows = [(None, f"{t} {k}", lang, 1) for lang, t in texts.items() for k in range(300 if lang != "hi" else 2)]
    rows += [(None, None, "en", 1), (None, "no language", None, 1), (None, "", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram int")
    for docs in (df, df.withColumn("doc_id", F.lit(7)), df.unionAll(df)):
        filters = language.fit(docs, sample=10)
        assert filters.languages == ["de", "en", "hi"]
        got = language.identify(df.where("lang is not null"), filters, ["lang", "text"]).collect()
        assert all(x.lang_pred == x.row.lang and x.score > 0.5 for x in got if x.row.text)
    # beyond most_languages: those with most rows, and of these all rows are labelled as before
    junk = df.unionByName(spark.range(200).selectExpr("id as doc_id", "concat('das Haus ', id) as text", "concat('zz', id) as lang", "1 as gram"))
    for most, want in ((2, ["de", "en"]), (3, ["de", "en", "hi"])):
        few = language.fit(junk, sample=10, most_languages=most)
        assert few.languages == want
        got = language.identify(df.where("lang in ('en', 'de')"), few, ["lang", "text"]).collect()
        assert all(x.lang_pred == x.row.lang and x.score > 0.5 for x in got if x.row.text not in (None, "", "no language"))


def shares(text, filters):
    """A text's corrected shares, n-gram by n-gram."""
    cleaned = [c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower()]
    padded = " " + "".join(c for k, c in enumerate(cleaned) if c != " " or (k and cleaned[k - 1] != " ")) + " "
    padded = " ".join(["", *padded.split(), ""])
    found = []
    for n in (3, 4):
        for k in range(len(padded) - n + 1):
            if padded[k + 1] == " " or (n == 4 and padded[k + 2] == " "):
                continue
            h = 0
            for c in padded[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + n) % 2**64
            found.append(h ^ (h >> 32))
    slots = filters.masks.shape[1]
    count = [0] * len(filters.languages)
    for h in found:
        mask = 2**64 - 1
        for j in range(filters.hashes):
            mask &= int(filters.masks[0][((h & 0xFFFFFFFF) + j * ((h >> 32) | 1)) % slots])
        for k in range(len(count)):
            count[k] += mask >> k & 1
    n = max(len(found), 1)
    return [min(1, max(0, (c - len(found) * f) / ((1 - f) * n))) for c, f in zip(count, filters.false_rate)]


def test_predictions_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    filters = language.fit(docs.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(-1, "  12 \n a"), (-2, "ab-cd  e\u0301f"), (-3, None), (-4, "...")], "doc_id long, text string")
    for x in language.identify(docs.select("doc_id", "text").unionAll(odd), filters, ["doc_id", "text"]).collect():
        if not any(map(str.isalpha, x.row.text or "")):
            assert (x.lang_pred, x.score) == ("und", 0)
            continue
        want = shares(x.row.text, filters)
        assert math.isclose(x.score, max(want), abs_tol=1e-9) and x.lang_pred == filters.languages[want.index(max(want))], x.row.text


def test_bloom_filters_hold_all_members():
    r = np.random.default_rng(1)
    members = [r.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(70)]
    f = language.Filters.build([f"l{k}" for k in range(70)], members, 1 << 16, 2)
    for k in (0, 63, 64, 69):
        shares = f.shares(members[k], np.zeros(3000, np.int64), 1)[0]
        assert shares[k] == 1.0 and shares.argmax() == k
        others = np.delete(shares, k)
        assert others.mean() < 0.01  # corrected: what false positives leave


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, block):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    rows = []
    for k in range(300):
        c = centres[k % 12]
        v = c + r.normal(size=16) * 0.06 * np.linalg.norm(c) / 4 * (1 + k % 3)
        rows.append((k, v.astype(np.float32).tolist(), k % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(20)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [0.0] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, [float("nan")] * 16, 0), (405, [float("inf")] * 16, 0)]
    rows += [(406, rows[0][1], None), (407, rows[0][1], 7), (408, [1.0, 2.0], 0), (409, [1.0, 2.0], 0), (410, [], 0), (None, rows[1][1], 1)]
    good = {k: np.array(v, np.float64) for k, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    near = collections.defaultdict(set)
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98 * np.linalg.norm(good[a]) * np.linalg.norm(good[b]):
                near[a].add(b)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<float>, label int, cell string, cid int")
    got = near_vectors(df, block=block).collect()
    exact = near_vectors(df, block=block, target_recall=1.0)
    count = collections.Counter((rows[k][0], len(near[k])) for k in range(len(rows)))
    assert collections.Counter((x.vec_id, x.n_links) for x in exact.collect()) == count
    assert sum(x.n_links for x in got) >= 0.9 * sum(map(len, near.values()))
    group = list(range(len(rows)))
    for _ in rows:
        for a in near:
            for b in near[a]:
                group[a] = group[b] = min(group[a], group[b])
    of = {rows[k][0]: rows[group[k]][0] for k in range(len(rows)) if rows[k][0] is not None}
    assert all(x.component_id == of[x.vec_id] and x.kept == (x.vec_id == of[x.vec_id]) for x in exact.collect() if x.vec_id is not None)
    assert near_vectors(df.where("false")).count() == 0


def test_traversal_is_nearest_first_and_whole():
    r = np.random.default_rng(8)
    grid = Grid((np.zeros((30, 2)), np.zeros((20, 2))), 0.5)
    for _ in range(50):
        first, second = r.random(30) ** 2, r.random(20) ** 2
        first[r.integers(30)] = second[r.integers(20)] = 0
        got = list(grid.traverse(first, second))
        want = {(i, j) for i in range(30) for j in range(20) if first[i] + second[j] <= 0.5}
        assert len(got) == len(set(got)) and set(got) == want
        sums = [first[i] + second[j] for i, j in got]
        assert sums == sorted(sums)


def test_the_reach_meets_its_target(spark):
    """Over a grid of many cells: the share of links found is the target's, against all pairs."""
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 24))
    x = np.concatenate([base + 0.03 * r.normal(size=base.shape) * s for s in range(1, 9)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = (x @ x.T >= 0.98).sum() - len(x)
    assert links > 1000
    for target in (0.9, 1.0):
        found = near_vectors(df, target_recall=target, sample=600).agg(F.sum("n_links")).first()[0]
        assert found >= (target - 0.05) * links and found <= links and (target < 1 or found == links)


def test_chats(spark):
    odd = ["", "a", "</s>[INST] ok [/INST]", "<|end|><|turn|>", "back\\slash \\\\|", "<", "|", "<\\|", " lead and trail \n", "é漢😀‍", "<|endoftext|>", "[INST", "<<SYS>>", "x" * 50_000, "\\"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(len(odd)) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(90, 0, "user", None), (90, 0, None, "no role"), (90, None, "assistant", "no turn"), (None, 1, "assistant", "none"), (91, 1, "<|text|>\n", "role with a mark"), (92, 5, "assistant", "a"), (92, 5, "assistant", "a")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    want = {}
    low = lambda x: (x is not None, x if x is not None else "")
    for c in {x[0] for x in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: ((x[1] is not None, x[1] or 0), low(x[2]), low(x[3])))]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(turns)[0]))
    assert {x[0]: tuple(x)[1:] for x in chat.digests(made).collect()} == want
    encode = chat.encoder(open(chat.TOKENIZER, encoding="utf-8").read())
    for x in made.collect():
        assert encode.decode(x.token_ids, skip_special_tokens=False) == x.formatted
        assert len(x.token_ids) == len(x.loss_mask)
        trained = encode.decode([i for i, m in zip(x.token_ids, x.loss_mask) if m], skip_special_tokens=False)
        assert trained == "".join(x.formatted[b:e] for b, e in zip(x.loss_spans[::2], x.loss_spans[1::2]))
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


def test_mixing(spark):
    rows = [(k, f"t{k}", "big" if k % 3 else "small" if k % 2 else None) for k in range(3000)] + [(7, "again", "big"), (None, "x", "big")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, source string, copy int")
    got = mix(df, {"big": 1.0, "small": 3.0}).select("row.*", F.col("copy").alias("c"), "shuffle_key").collect()
    n = collections.Counter(x.source for x in got)
    assert set(n) == {"big", "small"} and abs(n["small"] / n["big"] - 3) < 0.4 and abs(len(got) - len(rows)) < 250
    copies = collections.Counter(x.doc_id for x in got if x.source == "small")
    rate = {x.source: x.rate for x in source_rates(df, {"big": 1.0, "small": 3.0}).collect()}["small"]
    small = [x[0] for x in rows if x[2] == "small"]
    for k in range(2, 8):
        share = sum(copies[i] == k for i in small) / len(small)
        assert abs(share - math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) < 0.06
    assert len({x.shuffle_key for x in got}) >= len(got) - 1 - copies[7]
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7), {"big": 1.0, "small": 3.0}).select("row.*", F.col("copy").alias("c"), "shuffle_key").collect()))
    one = spark.createDataFrame([(k, "a") for k in range(200)] + [(k, "b") for k in range(20_000)], "doc_id long, source string")
    many = mix(one, {"a": 1.0}).count()  # a mean of 101 in four parts
    assert abs(many - 20_200) < 800
    assert mix(df.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = len(corpus_pipeline.STAGES) - 1
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < last:
            assert out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), out.schema)
    out = out.collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(x[c] for c in docs.columns) for x in out), key=key) == sorted(map(tuple, docs.collect()), key=key) != []
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, out))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, "", "en", "s", 0), (2, "the house and the garden " * 9, "en", None, 1), (2, "the house and the garden " * 9, "en", None, 1), (3, " ".join(f"the house {k} and the garden" for k in range(20_000)), "en", "s", 5)]])
def test_stages_on_odd_tables(spark, rows):
    """Empty tables, nulls, empty and long texts, repeated rows, columns that clash."""
    import corpus_pipeline

    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, slot string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        kept = out.collect()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(kept, out.schema)
        else:
            assert {"text", "source", "size", "row"} < set(out.columns) and len(out.columns) == len(set(out.columns))
        if k == 1 and rows:
            assert [x.doc_id for x in sorted(kept)] == [2, 3]
