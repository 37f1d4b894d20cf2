"""The trie of conversations against plain Python: shared prefixes, hot turns, long conversations, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from gneiss.llm import trie


def plain_trie(paths):
    """paths: {conversation: [(role, text)]}"""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    children = {n: [] for n in members}
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        saved[n] = (len(members[n]) - 1) * words(n) + sum(saved[x] for x in children[n])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n)).encode()).hexdigest())
        for n, m in members.items()
    )


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + x[h[c] :] for c, x in own.items()}


def conversations(kind, r):
    if kind == "odd":
        rows = [(1, None, None, None), (1, None, "user", ""), (1, 2, "user", "a b"), (1, 2, "user", "a b"), (1, 2, "assistant", "a b"), (None, 1, "user", "x"), (2, 5, "", "only"), (40, 1, "user", "first"), (41, 1, "user", "alone"), (59, -1, "user", "x"), (61, 1, "a", "bc"), (62, 1, "ab", "c")]
        return rows + [(20, 0, "user", "漢字 é x\t\ny " * 2000)]
    if kind == "long":
        rows = [(c, k, "user", f"t{k % 7 if k < 1500 else k}") for c in (3, 4) for k in range(2600 + c)]
        return rows + [(5, k, "user", "same") for k in range(70)] + [(6, k, "user", "same") for k in range(64)]
    turns = [(r.choice(["user", "assistant"]), r.choice(["hello there", "yes", "", "tell me more please"])) for _ in range(3)]
    return [(c, k, *r.choice(turns)) for c in range(150) for k in range(r.choice([1, 1, 2, 3, 5, 9]))] + [(1000 + c, 0, "user", "the same question") for c in range(200)]


@pytest.mark.parametrize("kind", ["odd", "long", "shared"])
def test_trie_against_plain_python(spark, kind):
    rows = conversations(kind, random.Random(2))
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, name string, d int")
    turns, ids = trie.rebuilt(trie.ordered_turns(df))
    got = [tuple(x) for x in trie.prefix_trie(turns, ids).drop("turn_name").collect()]
    assert sorted(got, key=str) == sorted(plain_trie(plain_rebuilt(rows)), key=str)


def test_turnless_and_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = trie.ordered_turns(none)
    assert trie.prefix_trie(turns, turns.select("conv")).collect() == []
    one = trie.prefix_trie(turns, spark.createDataFrame([(9,), (3,), (3,)], "conv long")).first()
    assert (one.conv_id, one.depth, one.parent_conv_id, one.n_convs, one.n_children, one.n_leaves, one.saved_tokens, one.ends_sha256) == (3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,9").hexdigest())
