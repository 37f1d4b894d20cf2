"""The pipeline's near-duplicate stage against all pairs in plain Python."""

import collections
import random

from gneiss.llm.similar import similar_links
from tests.llm.test_texts import make, split


def shingles(text):
    w = split((text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if same and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    best = {}
    for g, (i, _) in zip(group, rows):
        best[g] = min(best.get(g, i), i, key=lambda x: (x is None, x or 0))
    return collections.Counter(best.values())


def test_near_copies_leave(spark):
    import corpus_pipeline

    r = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for _ in range(20):  # pairs with a few words changed: similarities from 0.68 to 1
        base = [r.choice(words) for _ in range(200)]
        copy = list(base)
        for p in r.sample(range(200), r.randint(0, 8)):
            copy[p] = r.choice(words)
        rows += [base, copy]
    center = [r.choice(words) for _ in range(200)]
    for _ in range(60):  # one large group: close to its centre, some pairs of it are not close to one another
        copy = list(center)
        for p in r.sample(range(200), r.randint(1, 5)):
            copy[p] = r.choice(words)
        rows.append(copy)
    rows = [" ".join(x) for x in rows] + ["", None, "a b", "A  b", "a b c", rows[0][:1][0], "x " * 30, "x " * 31]
    r.shuffle(rows)
    rows = [*enumerate(rows), (None, rows[3]), (7, rows[8])]
    got = corpus_pipeline.simhash_dedup(spark, make(spark, rows), "")
    assert got.columns == make(spark, []).columns
    assert collections.Counter(x.doc_id for x in got.collect()) == kept(rows)
    assert corpus_pipeline.simhash_dedup(spark, make(spark, []), "").count() == 0


def test_large_buckets_lose_no_link(spark):
    import numpy as np

    sets = [np.arange(k, k + 30, dtype=np.uint64) for k in range(0, 3 * 20, 3)]  # a chain: only neighbours are similar
    order = list(range(20))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(n, bytearray(sets[k].tobytes())) for n, k in enumerate(order)], "node long, hashes binary")
    links = {(max(x), min(x)) for x in similar_links(df.selectExpr("1L as key", "node"), df, 0.8).collect()}
    assert links == {(max(order.index(k), order.index(k + 1)), min(order.index(k), order.index(k + 1))) for k in range(19)}


def test_common_parts_of_sets(monkeypatch):
    import numpy as np

    from gneiss.llm import similar

    monkeypatch.setattr(similar, "COLUMNS", 7)
    r = np.random.default_rng(3)
    x, y = ([np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in r.integers(0, 40, k)] for k in (9, 13))
    assert similar.common(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


def test_blocks_lose_no_link(spark, monkeypatch):
    """A bucket of groups that hubs don't settle: many chains whose neighbours alone are similar, over many blocks."""
    import numpy as np

    from gneiss.llm import similar

    monkeypatch.setattr(similar, "BLOCK", 7)
    sets, order = [], list(range(80))
    for chain in range(8):
        sets += [np.arange(1000 * chain + 3 * k, 1000 * chain + 3 * k + 30, dtype=np.uint64) for k in range(10)]
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(n, bytearray(sets[k].tobytes())) for n, k in enumerate(order)], "node long, hashes binary")
    links = similar.similar_links(df.selectExpr("1L as key", "node"), df, 0.8)
    assert all(similar.jaccard(sets[order[x.a]], sets[order[x.b]]) >= 0.8 for x in links.collect())
    groups = collections.defaultdict(set)
    for x in similar.components(links).collect():
        groups[x.component].add(order[x.node] // 10)
    assert sorted(map(sorted, groups.values())) == [[k] for k in range(8)]
    assert similar.components(links).count() == 80


def test_simhash_proposes(spark, monkeypatch):
    """Without any band in common, texts whose fingerprints differ in at most three bits are linked if their sets are similar."""
    import numpy as np

    import corpus_pipeline
    from gneiss.llm import similar

    r = random.Random(4)
    rows = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(6)]
    rows += [f"{t} w{k}" for k, t in enumerate(rows)]  # one shingle more
    sets = [similar.shingle_set(t.encode()) for t in rows]
    bits = [(similar.fingerprint_hashes(sets[k]) ^ similar.fingerprint_hashes(sets[k + 6])).bit_count() for k in range(6)]
    assert max(bits) <= similar.RADIUS
    pairs = similar.simhash_pairs(spark.createDataFrame([(k, similar.fingerprint_hashes(s) - (1 << 63)) for k, s in enumerate(sets)], "node long, fp long"))
    assert {frozenset((x.a, x.b)) for x in pairs.collect()} == {frozenset((k, k + 6)) for k in range(6)}
    monkeypatch.setattr(similar, "band_keys", lambda hashes: hashes.sum(dtype=np.uint64, keepdims=True).view(np.int64))
    got = corpus_pipeline.simhash_dedup(spark, make(spark, list(enumerate(rows))), "")
    assert sorted(x.doc_id for x in got.collect()) == list(range(6))


def test_fingerprints_do_not_decide(spark):
    from gneiss.llm import similar

    sets = spark.createDataFrame([(k, bytearray(b"".join(x.to_bytes(8, "little") for x in s))) for k, s in enumerate([range(10), range(9), range(20, 30)])], "node long, hashes binary")
    pairs = similar.simhash_pairs(spark.createDataFrame([(0, 5), (1, 5), (2, 4)], "node long, fp long"))
    assert {(x.a, x.b) for x in similar._verified(pairs, sets, 0.8).collect()} == {(1, 0)}
