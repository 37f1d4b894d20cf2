"""Persisted retrieval: postings in blocks, and vectors of texts that are known."""

import random
from collections import Counter

from pyspark.sql import functions as F

from gneiss.engine import Engine
from gneiss.functions.scalars import mock_embedding
from gneiss.operators import postings, retrieval
from gneiss.operators.postings import StoredBM25
from gneiss.operators.retrieval import BM25Index, VectorCache


def ranked(df):
    return [(x.doc, round(x.score, 9)) for x in df.collect()]


def corpus(spark, n=3000):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(r.choices(words, [60 - j for j in range(60)], k=r.choice([3, 8, 20, 60, 200])))) for k in range(n)]
    return spark.createDataFrame(texts + [(n, None), (n + 1, ""), (n + 2, "rare w1 w1 w1"), (n + 3, "the of and")], "doc long, text string")


def test_stored_search_is_exact_and_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    docs = corpus(spark)
    index = StoredBM25(spark, f"file://{tmp_path}/index")
    assert index.search("w1").collect() == [] and index.totals == (0, 0.0)
    index.add(docs.where("doc % 2 = 0"), "doc", "text")
    index.add(docs.where("doc % 2 = 1"), "doc", "text")
    skipped = 0
    for gone in (None, docs.where("doc % 7 = 3 or doc = 3002")):
        if gone is not None:
            index.remove(gone.select("doc"))
            docs = docs.join(gone, "doc", "left_anti")
        plain = BM25Index.build(docs, "doc", "text")
        for query in ("w1", "w3 w50 w50", "rare w1", "W0 the unknown", "the", "unknown", " ".join(f"w{k}" for k in range(12))):
            assert ranked(index.search(query, 7)) == ranked(plain.search(query, 7)), query
            skipped += index.skipped
        a, b = (sorted((x.term, x.df, round(x.idf, 9)) for x in df.collect()) for df in (index.idf(), plain.idf.select("term", "df", "idf")))
        assert a == b
    assert skipped > 100
    index.add(gone, "doc", "text")  # back again
    assert index.totals[0] == 3004


def test_terms_are_counted_within_a_row(spark, tmp_path):
    texts = {k: " ".join(random.Random(k).choices("abc", k=k)) for k in range(9)}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    for x in df.select("doc", postings.counted(F.filter(F.split("text", " "), lambda t: t != "")).alias("x")).collect():
        want = sorted(Counter(texts[x.doc].split()).items())
        assert (x.x.length, list(zip(x.x.terms, x.x.tfs))) == (x.doc, want)
    StoredBM25(spark, f"file://{tmp_path}/index").add(df, "doc", "text")
    assert sorted(x.name for x in (tmp_path / "index/segments/1").iterdir() if x.is_dir()) == ["blocks", "docs", "terms", "totals"]  # no rows of single postings


def test_equal_scores_go_by_the_smaller_doc(spark, tmp_path, monkeypatch):
    """Two texts whose scores differ by less than half of the last digit, the better one with the larger id."""
    monkeypatch.setattr(postings, "BLOCK", 1)
    texts = [(k, "word " + "other " * (10 + k)) for k in range(200, 400)] + [(1, "word " * 3 + "more " * 6001), (2, "word " * 3 + "more " * 6000)]
    docs = spark.createDataFrame(texts, "doc long, text string")
    index = StoredBM25(spark, f"file://{tmp_path}/index")
    index.add(docs, "doc", "text")
    plain = BM25Index.build(docs, "doc", "text")
    exact = {x.doc: x.score for x in plain.search("word", 202).collect()}
    assert 0 < exact[2] - exact[1] < 5e-7 and round(exact[1], 6) == round(exact[2], 6)
    want = sorted(((d, round(s, 6)) for d, s in exact.items()), key=lambda x: (-x[1], x[0]))
    at = want.index((1, round(exact[1], 6))) + 1
    for search in (index.search, plain.search):
        assert [tuple(x) for x in search("word", at, digits=6).collect()] == want[:at]
        assert search("word", at).collect()[-1].doc == 2


def test_search_opens_the_buckets_of_its_terms(spark, tmp_path):
    index = StoredBM25(spark, f"file://{tmp_path}/index")
    index.add(corpus(spark, 50), "doc", "text")
    files = index.blocks(["w1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in files
    (wanted,) = index._buckets(["w1"])
    read = {x.split("bucket=")[1].split("/")[0] for (x,) in index.blocks(["w1"]).select(F.input_file_name()).distinct().collect()}
    assert read == {str(wanted)}
    plan = index.blocks(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan


def test_known_texts_are_not_embedded_again(spark, tmp_path, monkeypatch):
    put, added = VectorCache.put, []
    monkeypatch.setattr(VectorCache, "put", lambda self, keyed: added.append(keyed.count()) or put(self, keyed))
    rows = [(f"f#{k}", "f", f"n{k}", k, f"text {k % 5}", k) for k in range(9)]
    df = spark.createDataFrame(rows, "id string, file string, name string, line int, text string, seq long")

    def found(d, cached, dimension=8):
        cache = VectorCache(spark, f"file://{tmp_path}/vectors", dimension) if cached else None
        rows = retrieval.semantic_search(spark, d, "text 3", 4, lambda c: mock_embedding(c, dimension), dimension, cache)
        return [(x.id, round(x.score, 9)) for x in rows.collect()]

    assert found(df, True) == found(df, True) == found(df, False) and added == [5]
    more = df.unionAll(spark.createDataFrame([("g#1", "g", "m", 1, "text 77", 1)], df.schema))
    assert found(more, True) == found(more, False) and added == [5, 1]
    assert found(df, True, 4) == found(df, False, 4) and added == [5, 1, 5]  # of another length
    assert found(df, True) == found(df, False) and len(added) == 3


def test_engine_search_keeps_vectors(spark, tmp_path, monkeypatch):
    put, added = VectorCache.put, []
    monkeypatch.setattr(VectorCache, "put", lambda self, keyed: added.append(keyed.count()) or put(self, keyed))
    files = spark.createDataFrame([("a.py", "def one():\n    return 1\n\ndef two():\n    return one()\n")], "path string, content string")
    e = Engine(spark, f"file://{tmp_path}")
    want = [(x.id, round(x.score, 9)) for x in Engine(spark).search("one", files).collect()]
    for _ in range(2):
        assert [(x.id, round(x.score, 9)) for x in e.search("one", files).collect()] == want
    assert added == [2]
