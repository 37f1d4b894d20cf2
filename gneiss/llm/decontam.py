"""Benchmark decontamination by suffix arrays over the training documents.

The documents are worked in shards (a few MB of text each). The suffixes of a shard's word sequence are sorted by
prefix doubling; each test suffix that begins a window is binary-searched in that array, which gives all places where
its window occurs as one range. Places that follow one another in a document and in an item are one verbatim match, as
long as it can be, with its locations. Only stretches that can hold a window are sorted: each of their short runs of
words (a few words, as many as fit a 64-bit key) occurs in some test.

The benchmark, a stated query set, goes to the shards in blocks of bounded size. One block is a narrow pass over the
documents. Of several, each is a pass of its own that writes the texts it hits, and these are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_bytes, stored

#: Bytes to words: A-Z lower-cased; all ASCII but digits and letters separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Tests:
    """The suffixes of a block of benchmark items, side by side: words by number, 0 after each item."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = []
        words, item, offset, width, starts = [], [], [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = len(ids)
            if not n:
                continue
            w = min(window, n)
            words += [*ids, 0]
            item.append(np.full(n + 1, len(self.items), np.int32))
            offset.append(np.arange(n + 1, dtype=np.int32))
            width.append(np.full(n + 1, w, np.int32))
            starts.append(np.arange(n + 1) <= n - w)
            self.items.append(name)
        self.any = bool(words)
        if not self.any:
            return
        self.item, self.offset, self.width = np.concatenate(item), np.concatenate(offset), np.concatenate(width)
        self.suffixes = np.flatnonzero(np.concatenate(starts))  # those that begin a window
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.per = 63 // self.bits
        self.shortest, self.longest = int(self.width.min()), int(self.offset.max())
        self.gram = min(self.per, self.shortest)
        self.keys = self.pack(np.array(words, np.int64))
        self.grams = self.keys >> (self.bits * (self.per - self.gram))
        self.known = np.unique(self.grams[self.suffixes])
        inner = self.grams[self.full(self.keys, self.gram)]
        self.members = np.unique(inner)

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """By position: the next `per` words in one number, zeros from the first 0 on; and zeros behind the end."""
        key, alive = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        padded = np.append(ids, np.zeros(self.per, np.int64))
        for j in range(self.per):
            x = padded[j : j + len(ids)]
            alive &= x != 0
            key = (key << self.bits) | np.where(alive, x, 0)
        return np.append(key, np.zeros(self.longest + self.per + 1, np.int64))

    def full(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Positions with n words before a 0."""
        return np.flatnonzero((keys >> (self.bits * (self.per - n))) & ((1 << self.bits) - 1))

    def _sorted(self, keys: np.ndarray, n: int) -> np.ndarray:
        """The suffix array of n positions: sorted by their words up to the first 0, as far as any item reaches."""
        _, rank = np.unique(keys[:n], return_inverse=True)
        h = self.per
        while h < self.longest and rank.max(initial=0) + 1 < n:
            after = np.append(rank[h:] + 1, np.zeros(min(h, n), np.int64))
            _, finer = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)
            if finer.max() == rank.max():
                break
            rank, h = finer, 2 * h
        return np.argsort(rank, kind="stable")

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, test suffix) of every occurrence of every window in ids, where 0 is a word that no item has."""
        none = np.zeros(0, np.int64)
        if not self.any or not len(ids):
            return none, none
        grams = self.pack(ids)[: len(ids)] >> (self.bits * (self.per - self.gram))
        place = np.minimum(np.searchsorted(self.members, grams), len(self.members) - 1)
        member = self.members[place] == grams
        edges = np.flatnonzero(np.diff(np.concatenate([[0], member.astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        keep = end - begin >= self.shortest - self.gram + 1
        begin, end = begin[keep], end[keep] + self.gram - 1
        if not len(begin):
            return none, none
        size = end - begin + 1  # with a 0 after each stretch
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        words = ids[np.minimum(at, len(ids) - 1)]
        words[np.cumsum(size) - 1] = 0
        keys = self.pack(words)
        order = self._sorted(keys, len(words))
        mine = np.unique(keys[: len(words)] >> (self.bits * (self.per - self.gram)))
        t = self.suffixes
        spot = np.minimum(np.searchsorted(mine, self.grams[t]), len(mine) - 1)
        t = t[mine[spot] == self.grams[t]]
        low, high = self._bound(keys, order, t, False), self._bound(keys, order, t, True)
        count = high - low
        return at[order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]], np.repeat(t, count)

    def _bound(self, keys: np.ndarray, order: np.ndarray, t: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all test suffixes at once, by the words of their windows: the first place whose suffix isn't less (after: is greater)."""
        low, high = np.zeros(len(t), np.int64), np.full(len(t), len(order), np.int64)
        width = self.width[t]
        columns = -(-int(width.max(initial=0)) // self.per)
        shift = [self.bits * np.clip(self.per - (width - c * self.per), 0, self.per) for c in range(columns)]
        want = [self.keys[np.minimum(t + c * self.per, len(self.keys) - 1)] >> shift[c] for c in range(columns)]
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(order) - 1)
            less, even = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for c in range(columns):
                x = keys[np.minimum(order[mid] + c * self.per, len(keys) - 1)] >> shift[c]
                less |= even & (x < want[c])
                even &= x == want[c]
            if after:
                less |= even
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return low


_MATCH = pa.struct([("item", pa.string()), ("begin", pa.int32()), ("item_begin", pa.int32()), ("words", pa.int32())])
_FOUND = "n_words long, n_hit long, spans array<int>, items array<string>, longest int, matches array<struct<item:string,begin:int,item_begin:int,words:int>>"
_NAMES = ["n_words", "n_hit", "spans", "items", "longest", "matches"]


def _covered(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The stretches (begin, end) that intervals, sorted by begin, cover together."""
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    fresh = np.append(True, begin[1:] > reach[:-1])
    return np.stack([begin[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]], axis=1)


def _shard(tests: Tests, texts: list[bytes | None]) -> list[tuple]:
    """The values of _FOUND for each text of a shard."""
    known = tests.vocabulary.get
    parts, limits = [np.zeros(0, np.int64)], [0]
    for t in texts:
        words = words_of(t)
        parts += [np.fromiter(map(known, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
        limits.append(limits[-1] + len(words) + 1)
    out = [(limits[k + 1] - limits[k] - 1, 0, [], [], 0, []) for k in range(len(texts))]
    at, suffix = tests.search(np.concatenate(parts))
    if not len(at):
        return out
    item, diagonal, width = tests.item[suffix], at - tests.offset[suffix], tests.width[suffix]
    order = np.lexsort((at, diagonal, item))
    at, item, diagonal, width = at[order], item[order], diagonal[order], width[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    words = np.diff(np.append(first, len(at))) + width[first] - 1
    begin, item, diagonal = at[first], item[first], diagonal[first]
    order = np.argsort(begin, kind="stable")
    begin, item, diagonal, words = begin[order], item[order], diagonal[order], words[order]
    cuts = np.searchsorted(begin, limits)
    for k in np.flatnonzero(np.diff(cuts)):
        mine = slice(cuts[k], cuts[k + 1])
        b, n = begin[mine] - limits[k], words[mine]
        spans = _covered(b, b + n)
        named = [tests.items[i] for i in item[mine]]
        matches = [dict(zip(("item", "begin", "item_begin", "words"), x)) for x in zip(named, b.tolist(), (begin[mine] - diagonal[mine]).tolist(), n.tolist())]
        out[k] = (out[k][0], int((spans[:, 1] - spans[:, 0]).sum()), spans.ravel().tolist(), sorted({x for x in named if x is not None}), int(n.max()), matches)
    return out


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.list_(_MATCH)]
    return [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]


def _scan(sent, hits_only: bool):
    """From (row, text): row, and what _FOUND says of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = sent.value
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in by_bytes(raw):
                found = _shard(tests, raw[a:b])
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_columns(found)], names=["row", *_NAMES])
                yield out.filter(pa.array([x[1] > 0 for x in found])) if hits_only else out

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, n_words, found: list of what the blocks found): one answer for each text."""
    for batch in batches:
        rows = []
        for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            pairs = np.array(sorted(p for x in found for p in zip(x["spans"][::2], x["spans"][1::2])), np.int64).reshape(-1, 2)
            spans = _covered(pairs[:, 0], pairs[:, 1])
            matches = sorted((m for x in found for m in x["matches"]), key=lambda m: m["begin"])
            rows.append((n, int((spans[:, 1] - spans[:, 0]).sum()), spans.ravel().tolist(), sorted({i for x in found for i in x["items"]}), max(x["longest"] for x in found), matches))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], names=["row", *_NAMES])


def contamination(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 4 << 20
) -> DataFrame:
    """One row per row of docs: row (a struct of the carried columns), n_words, n_hit, items, spans, longest, matches, contaminated.

    A document word inside any occurrence of a window of `window` item words (a shorter item is one window) is hit.
    spans: the hit stretches (first word, end, first word, end ...). matches: the verbatim matches of at least a
    window, each as long as it can be: item, begin (word of the document), item_begin, words; longest: the most
    words of one. items: distinct ids of the items with occurring windows, as sorted strings (null ids hit and
    match, but aren't listed). contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null or empty texts have no words;
    items without words have no window; empty tables give no rows or no hits. Repeated rows are rows like others,
    repeated items count once by id. Extra columns are only carried, inside the struct, where no name can clash.
    block_bytes: the most benchmark text that is broadcast at once (an item is never split).
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    text = F.col(text_col).alias("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text)

    def block_of(b: int):
        block = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(Tests([(x.item, x.text.encode()) for x in block.collect()], window))

    def scanned(df: DataFrame, sent, hits_only: bool) -> DataFrame:
        return df.mapInArrow(_scan(sent, hits_only), f"row {df.schema['row'].dataType.simpleString()}, {_FOUND}")

    if blocks == 1:
        out = scanned(rows, block_of(0), False)
    else:
        # what a text hits depends on the text only: hits are kept by its hash and size, one block after the other
        mark = F.struct(F.xxhash64(text_col).alias("h"), F.octet_length(text_col).alias("n")).alias("row")
        hits = None
        for b in range(blocks):
            found = stored(scanned(docs.select(mark, text), block_of(b), True).dropDuplicates(["row"]))
            hits = found if hits is None else hits.unionAll(found)
        hits = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("spans", "items", "longest", "matches")).alias("found"))
        hits = stored(hits.mapInArrow(_joined, f"row struct<h:bigint,n:int>, {_FOUND}")).withColumnRenamed("row", "of").drop("n_words")
        counted = scanned(docs.select(F.struct(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), mark.alias("of")).alias("row"), text), spark.sparkContext.broadcast(Tests([], window)), False)
        counted = counted.select("row.row", "row.of", "n_words")
        none = {"n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>"), "longest": F.lit(0), "matches": F.array().cast(hits.schema["matches"].dataType)}
        out = counted.join(hits, "of", "left").select("row", "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))
    return out.select("row", "n_words", "n_hit", "items", "spans", "longest", "matches", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without its contaminated rows."""
    return contamination(docs, benchmark, docs.columns, **options).where("not contaminated").select("row.*")
