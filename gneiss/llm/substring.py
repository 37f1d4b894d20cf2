"""Removal of long word sequences that occur more than once, by recompression.

Recompression rounds name runs of one symbol and then pairs of neighbouring symbols (those whose first symbol is of
the left class and second of the right class in this round). A name is a 64-bit hash of what it stands for, so it is
global without any exchange: equal stretches of words get equal interior symbols wherever they are. Names only
propose; a shared name never removes a word by itself.

How far the symbols inside a window are fixed by its own words is followed exactly: each round gives up the outermost
run, and the outermost symbol if its class lets it pair with a neighbour outside. Among the fixed high-level symbols
of its first half each window takes the one with the smallest hash. Equal windows so take the same symbol at the same
place; windows with none (long runs) take their first word. Windows next to each other that take the same symbol form
a span, and spans, not windows, go to the shuffle:

1. key (hash of the words from the symbol on, as many as surely lie in each of its windows): counted over all rows;
2. rows whose key occurs once are done: none of their windows occurs again;
3. if all rows of a key have one span hash, all their windows repeat;
4. for keys with several spans, one row of each distinct span gives its windows' hashes, which are counted.

Spans that repeat within one load of a task are settled there, and one row of them goes on: a text of one repeated
word, or a passage with very many copies, sends few rows.

Every step is a grouped count that combines before the shuffle, or a join that can be split when skewed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_bytes, stored

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class _Names(dict):
    """Word to 64-bit name."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of stretches of words: a polynomial modulo 2 ** 64 in an odd base over the words' 64-bit names."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self.inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * power[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, length) -> np.ndarray:
        x = (self.sums[begin + length] - self.sums[begin]) * self.inverse[begin]
        return _mix(x ^ (np.asarray(length, np.uint64) * _U(0xD6E8FEB86659FD93)))


def recompress(names: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, the word each begins at, first fixed symbol by window start, end of the fixed symbols by window end)."""
    n = len(names)
    symbols, begin = names, np.arange(n)
    first, end = np.arange(n + 1), np.arange(n + 1)
    for r in range(rounds):
        m = len(symbols)
        starts = np.ones(m + 1, bool)  # of runs
        starts[1:m] = symbols[1:] != symbols[:-1]
        run = np.cumsum(starts) - 1
        at = np.flatnonzero(starts[:m])
        length = np.diff(np.append(at, m)).astype(np.uint64)
        symbols = np.where(length > _U(1), _mix(symbols[at] ^ (length * _U(0xA24BAED4963EE407))), symbols[at])
        begin = begin[at]
        m = len(symbols)
        first = np.minimum(run[first] + 1, m)
        end = run[np.maximum(end - 1, 0)]
        right = (_mix(symbols ^ _U(0x9FB21C651E98DF25 + r)) & _U(1)).astype(bool)
        starts = np.ones(m + 1, bool)
        starts[1:m] = ~(right[1:] & ~right[:-1])
        new = np.cumsum(starts) - 1
        right = np.append(right, False)
        first = new[np.minimum(first + right[first], m)]
        end = new[end - ((end > 0) & ~right[end - 1])]
        at = np.flatnonzero(starts[:m])
        two = np.append(at[1:], m) - at == 2
        other = symbols[np.minimum(at + 1, m - 1)]
        symbols = np.where(two, _mix(symbols[at] * _U(0xC2B2AE3D27D4EB4F) + (other ^ _U(0x165667B19E3779F9))), symbols[at])
        begin = begin[at]
    return symbols, begin, first, end


def spans(names: np.ndarray, limits: np.ndarray, window: int, rounds: int):
    """Of texts side by side (limits: where each begins, and the end): arrays key, span hash, text, first window (in its text), windows."""
    n = len(names)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    half = (window - 1) // 2
    kept = window - half
    text = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    starts = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    symbols, begin, first, end = recompress(names, rounds)
    low = first[starts]
    high = np.minimum(end[starts + window], np.searchsorted(begin, starts + half, "right"))
    rank = _mix(symbols ^ _U(0x632BE59BD9B4E019))
    best = np.arange(len(symbols))
    size = np.maximum(high - low, 0)
    chosen = starts.copy()  # without a fixed symbol: the first word
    step = 1
    while True:
        here = np.flatnonzero((size >= step) & (size < 2 * step))
        if len(here):
            x, y = best[low[here]], best[high[here] - step]
            chosen[here] = begin[np.where(rank[x] <= rank[y], x, y)]
        if step > window:
            break
        other = best[np.minimum(np.arange(len(best)) + step, len(best) - 1)]
        best = np.where(rank[best] <= rank[other], best, other)
        step *= 2
    cuts = np.ones(len(starts), bool)
    cuts[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(cuts)
    count = np.diff(np.append(at, len(starts)))
    hashes = Hashes(names)
    i = starts[at]
    return hashes.of(chosen[at], kept), hashes.of(i, count + window - 1), text[i], i - limits[text[i]], count


def _pieces(text: bytes | None, most: int = 1 << 20) -> Iterator[bytes]:
    """A text cut between words into pieces of about `most` bytes."""
    at = 0
    while text and at < len(text):
        end = at + most
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def _named(text: bytes | None, cache: _Names) -> np.ndarray:
    parts = [np.zeros(0, np.uint64)]
    for piece in _pieces(text):
        words = piece.split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts)


def _loads(texts: list, cache: _Names, window: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """(words, limits, text and first word of each stretch) of about `most` words; what a window takes depends on its words only, so long texts go in overlapping parts."""
    parts, owner, total = [], [], 0
    for k, t in enumerate(texts):
        names = _named(t, cache)
        for at in range(0, max(1, len(names) - window + 1), most):
            part = names[at : at + most + window - 1]
            if len(part) >= window:
                parts.append(part)
                owner.append((k, at))
                total += len(part)
            if total >= most:
                yield np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array(owner)
                parts, owner, total = [], [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array(owner)


def _combined(key, span, text, first, count):
    """Spans that occur more than once here are settled: their windows, as few stretches, have c = 0; one row, with c = 2, tells the others."""
    order = np.lexsort((span, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (span[order[1:]] != span[order[:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    many = np.bincount(group) > 1
    settled = many[group]
    keep = np.ones(len(order), bool)
    keep[order[~fresh]] = False
    c = np.where(settled, 2, 1)
    at = np.flatnonzero(settled)
    if not len(at):
        return key, span, c, text, first, count
    joins = np.zeros(len(at), bool)  # to the stretch before
    joins[1:] = (text[at[1:]] == text[at[:-1]]) & (first[at[1:]] == first[at[:-1]] + count[at[:-1]])
    begin = np.flatnonzero(~joins)
    sums = np.add.reduceat(count[at], begin)
    none = np.arange(len(begin), dtype=np.uint64)
    # a key of its own: the stretch meets no other in the join and goes to any partition
    own = _mix(none ^ (first[at[begin]].astype(np.uint64) << _U(32)) ^ key[at[begin]])
    return tuple(np.concatenate(x) for x in ((key[keep], own), (span[keep], none), (c[keep], np.zeros(len(begin), np.int64)), (text[keep], text[at[begin]]), (first[keep], first[at[begin]]), (count[keep], sums)))


def _span_rows(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Names()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for names, limits, owner in _loads(texts, cache, window):
                with np.errstate(over="ignore"):
                    key, span, part, first, count = spans(names, limits, window, rounds)
                    key, span, c, part, first, count = _combined(key, span, part, first, count)
                text = pa.array(owner[part, 0])
                first = first + owner[part, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(c.astype(np.int32)), batch.column(0).take(text), batch.column(1).take(text), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["key", "span", "c", "id", "tid", "i", "n"],
                )

    return run


def _window_rows(window: int):
    """From (text, wanted: list of {key, span, c, i, n}): a row for each window of the wanted spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Names()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in by_bytes(texts, 1 << 20):
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                for k in range(a, b):
                    x = batch.column(1)[k].values
                    key, span, c, i, n = (x.field(f).to_numpy(zero_copy_only=False) for f in ("key", "span", "c", "i", "n"))
                    with np.errstate(over="ignore"):
                        hashes = Hashes(_named(texts[k], cache))
                        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        h = hashes.of(np.repeat(i.astype(np.int64), n) + offset, window)
                    for column, values in zip(out, (np.repeat(key, n), h.view(np.int64), np.repeat(span, n), offset.astype(np.int32), np.repeat(c, n))):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "h", "span", "offset", "c"])

    return run


def _removal_rows(window: int, text_too: bool):
    """From (id, text, found: list of {i, n, offsets}): the result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            total, removed, digest, kept_text = [], [], [], []
            for k, t in enumerate(texts):
                found = batch.column(2)[k].values
                stretches = _covered(found, window) if found is not None and len(found) else None
                n = gone = 0
                sha, kept, between = hashlib.sha256(), [], b""
                for piece in _pieces(t.as_py()):
                    words = piece.split()
                    if stretches is not None:
                        x = np.clip(stretches - n, 0, len(words))
                        marks = np.zeros(len(words) + 1, np.int64)
                        np.add.at(marks, x[0], 1)
                        np.add.at(marks, x[1], -1)
                        stays = np.cumsum(marks[:-1]) <= 0
                        n += len(words)
                        gone += len(words) - int(stays.sum())
                        words = list(compress(words, stays.tolist()))
                    else:
                        n += len(words)
                    if words:
                        part = between + b" ".join(words)
                        between = b" "
                        sha.update(part)
                        if text_too:
                            kept.append(part)
                total.append(n)
                removed.append(gone)
                digest.append(sha.hexdigest())
                kept_text.append(b"".join(kept))
            out = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if text_too:
                out.append(pa.array(kept_text, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _covered(found: pa.StructArray, window: int) -> np.ndarray:
    """Stretches of words (begins, ends) that the found windows cover; a span without offsets is all windows of it."""
    i, n = (found.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("i", "n"))
    offsets = found.field("offsets")
    whole = offsets.is_null().to_numpy(zero_copy_only=False)
    rest = offsets.filter(pa.array(~whole))
    at = np.repeat(i[~whole], rest.value_lengths().to_numpy(zero_copy_only=False)) + rest.flatten().to_numpy(zero_copy_only=False)
    return np.stack([np.concatenate([i[whole], at]), np.concatenate([i[whole] + n[whole] + window - 1, at + window])])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, rounds: int = 2, with_text: bool = True) -> DataFrame:
    """Removes each word covered by a window of `window` words that also starts elsewhere in docs.

    One row per row of docs: id_col, n_words, n_removed, kept_sha256, and with_text kept_text (kept words joined by
    one space). Words are what ASCII white space separates, unchanged. Null texts have no words. Repeated rows are
    rows like others, so all their windows repeat. Rows are told apart by id and text together: ids may be null or
    repeated. Other columns are not read. An empty table gives no rows. Long texts are worked in overlapping parts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_span_rows(window, rounds), f"key long, span long, c int, id {kind}, tid long, i int, n int")
    shared = found.where("c > 0").groupBy("key").agg(F.sum("c").alias("of_key")).where("of_key > 1").select("key", F.lit(True).alias("shared"))
    mine = stored(found.join(shared, "key", "left").where("shared or c = 0").drop("shared"))
    mixed = mine.where("c > 0").groupBy("key").agg(F.min("span").alias("x"), F.max("span").alias("y")).where("x <> y").select("key", F.lit(True).alias("mixed"))
    open_ = stored(mine.where("c > 0").join(mixed, "key", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))))
    wanted = (
        open_.where("mixed")
        .groupBy("key", "span")
        .agg(F.sum("c").alias("c"), F.min(F.struct("tid", "id", "i", "n")).alias("x"))
        .groupBy("x.tid", "x.id")
        .agg(F.collect_list(F.struct("key", "span", "c", F.col("x.i").alias("i"), F.col("x.n").alias("n"))).alias("wanted"))
    )
    same = lambda x, y: (x["tid"] == y["tid"]) & x["id"].eqNullSafe(y["id"])
    windows = stored(
        rows.join(wanted, same(rows, wanted)).select("text", "wanted").mapInArrow(_window_rows(window), "key long, h long, span long, offset int, c long")
    )
    again = windows.groupBy("key", "h").agg(F.sum("c").alias("of_window")).where("of_window > 1").select("key", "h")
    offsets = windows.join(again, ["key", "h"]).groupBy("key", "span").agg(F.collect_set("offset").alias("offsets"))
    resolved = mine.where("c = 0").unionByName(open_.where("not mixed").drop("mixed")).select("tid", "id", "i", "n", F.lit(None).cast("array<int>").alias("offsets"))
    partly = open_.where("mixed").join(offsets, ["key", "span"]).select("tid", "id", "i", "n", "offsets")
    # a set: rows alike in text and id, however many, have the same spans, which combine before the shuffle
    by_text = resolved.unionAll(partly).groupBy("tid", "id").agg(F.collect_set(F.struct("i", "n", "offsets")).alias("found"))
    made = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = rows.join(by_text, same(rows, by_text), "left").select(rows["id"], "text", "found").mapInArrow(_removal_rows(window, with_text), made)
    return out.withColumnRenamed("id", id_col)
