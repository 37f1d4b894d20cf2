"""Removal of long byte strings that occur more than once, by distributed prefix doubling over sampled suffixes.

Sorting all suffixes of a corpus costs several numbers a byte. Suffixes at anchors are enough: of each stretch of
`reach` grams (8 bytes each) the one with the smallest hash is an anchor, so any stretch of `reach + 7` bytes holds
an anchor that depends on these bytes alone. Anchors cut a text into phrases. In a string of `least` bytes (200) let L
be the anchor of its first stretch and R that of its last one: equal strings have L and R at the same places, and the
same phrases between them, wherever they lie.

1. Prefix doubling, two doublings a round. The pairs (anchor, digest of its phrase) are sorted over all partitions and
   ranked: a rank is the place of the first equal pair. Anchors whose rank is theirs alone leave. Then the ranks at an
   anchor and 1, 2 and 3 phrases on, as one digest, are sorted and ranked again, then those 4, 8 and 12 phrases on and
   so forth, until all are unique or the phrases exceed `least` bytes.
2. Strings with the same L and R form a run. The ranks of its phrases name what lies between L and R: four blocks of a
   power of four of phrases that overlap. A run without a rank for them occurs nowhere else.
3. Runs are sorted by a digest of all their bytes. Runs that are equal as a whole repeat as a whole.
4. Where runs of one name differ, near the ends of repeated passages, one run of each kind is cut into groups of
   GROUP strings by their place relative to L. What all strings of a group share (its core) is sorted and ranked:
   a group whose core is unique is done. Groups that are equal as a whole repeat as a whole.
5. Where groups of one core differ, their strings are sorted and ranked one by one.

Runs, groups and strings are sorted once, by their name and digest together (sorted_kinds), and only those that repeat or
that have to be cut are written again.

What is removed is decided by digests of 128 bits (BLAKE2b), which are taken as equality. Ranks, names and cores are made
of digests of 64 bits: where two of these meet by chance, more is compared, and the result is the same. A hot phrase, run or string never is one
task's work: sorts are cut between rows of the same rank, and texts that are copies are judged once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_bytes, dropped_table, freed, stored, stored_by
from gneiss.llm.ranks import sorted_groups, sorted_kinds

_GRAM = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Blocks that one round of prefix doubling joins.
_JOINED = 4
#: Bytes of texts that a task works on together; a longer text is a load of its own.
LOAD = 512 << 10
#: Strings of a run that are looked at together where runs differ.
GROUP = 8


class Anchors:
    """Anchors, phrases and runs of texts, one after the other in one array of bytes.

    at: places of anchors; begins: for each text the number of its first anchor, and one more at the end.
    """

    def __init__(self, texts: list[bytes], least: int, reach: int):
        self.data, self.least = b"".join(texts), least
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.data)
        low = np.ndarray((n - _GRAM + 1,), "<u8", self.data, strides=(1,)) * _FACTOR
        low &= _HIGH
        low |= np.arange(len(low), dtype=np.uint64)  # of equal hashes the first
        size = 1
        while size * 2 <= reach:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
        span = reach + _GRAM - 1
        # low holds the anchor of the stretch that begins here; new: where it is another one than before, in a text
        new = np.flatnonzero(low[1:] != low[:-1]) + 1
        text = self._text(new)
        new = new[(new > self.starts[text]) & (new <= self.ends[text] - span)]
        self.new = np.sort(np.append(new, self.starts))  # texts have at least `least` bytes
        self.at = (low[self.new] & ~_HIGH).astype(np.int64)
        self.begins = np.append(np.searchsorted(self.new, self.starts), len(self.at))
        self.far = least - span  # where the last stretch of a string begins

    def _text(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def _number(self, stretches: np.ndarray) -> np.ndarray:
        """The numbers of the anchors of the stretches that begin there."""
        return np.searchsorted(self.new, stretches, side="right") - 1

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, text, number in it, bytes) of phrases: all anchors but each text's last one begin one."""
        keep = np.ones(len(self.at), bool)
        keep[self.begins[1:] - 1] = False
        k = np.flatnonzero(keep)
        text = np.searchsorted(self.begins, k, side="right") - 1
        a, b = self.at[k], self.at[k + 1]
        return _marks(self.data, a, b), text, k - self.begins[text], b - a

    def runs(self) -> tuple[np.ndarray, ...]:
        """(text, first string, strings, number of L, number of R) of runs, numbers within the text."""
        last = self.ends - self.least
        text = self._text(self.new)
        # a run begins where L or R is another anchor than before
        first = np.unique(np.concatenate([self.new[self.new <= last[text]], (self.new - self.far)[self.new - self.far >= self.starts[text]]]))
        text = self._text(first)
        count = np.append(first[1:], 0)
        ends = np.append(text[1:] != text[:-1], True)
        count[ends] = last[text[ends]] + 1
        return text, first, count - first, self._number(first) - self.begins[text], self._number(first + self.far) - self.begins[text]


def _digests(data: bytes, begins: np.ndarray, ends: np.ndarray, salts: np.ndarray | None = None) -> np.ndarray:
    """Two longs a stretch of bytes, taken as its identity; salts (longs) tell equal stretches apart."""
    hash_ = hashlib.blake2b
    found = [hash_(data[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())]
    return _salted(b"".join(found), salts)


def _marks(data: bytes, begins: np.ndarray, ends: np.ndarray, salts: np.ndarray | None = None) -> np.ndarray:
    """A long a stretch by a faster hash, for stretches that only propose: what is removed is decided by _digests."""
    hash_ = xxhash.xxh3_64_digest
    found = np.frombuffer(b"".join([hash_(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]), "<u8")
    return (found if salts is None else found ^ (salts.astype(np.uint64) * _FACTOR)).view("<i8")


def _mixed(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A long for the longs of each row, in this order; it only proposes, like _marks."""
    out = first.astype(np.uint64)
    for x in more:
        out = (out ^ (out >> np.uint64(29))) * _FACTOR
        out = ((out ^ (out >> np.uint64(32))) * _FACTOR) ^ x.astype(np.uint64)
    out = (out ^ (out >> np.uint64(29))) * _FACTOR
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _salted(digests: bytes, salts: np.ndarray | None) -> np.ndarray:
    found = np.frombuffer(digests, "<u8").reshape(-1, 2).copy()
    if salts is not None:
        found[:, 1] ^= salts.astype(np.uint64) * _FACTOR  # different salts stay different: the factor is odd
    return found.view("<i8")


def _loads(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows of a column of texts that have at least `least` bytes, and these texts, load by load."""
    texts = column.cast(pa.binary()).to_pylist()
    for a, b in by_bytes(texts, LOAD):
        rows = [k for k in range(a, b) if len(texts[k]) >= least]
        if rows:
            yield np.array(rows), [texts[k] for k in rows]


def _phrase_rows(least: int, reach: int):
    """From (t, text): (x, t, at, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _loads(batch.column(1), least):
                marks, text, number, size = Anchors(texts, least, reach).phrases()
                row = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays([pa.array(marks), batch.column(0).take(row), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32))], names=["x", "t", "at", "size"])

    return run


def _joined_rows(width: int, least: int):
    """From (t, at, name, size) of blocks of `width` phrases, sorted by t and at: (x, t, at, size) of blocks of four times as many."""

    def joined(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, at, name, size = (c.to_numpy() for c in pa.Table.from_batches(batches).columns)
        if not len(t):
            return
        code = (np.cumsum(np.append(0, t[1:] != t[:-1])) << 32) + at
        names, total, keep = [name], size.copy(), np.ones(len(t), bool)
        for j in range(1, _JOINED):
            want = code + j * width
            p = np.minimum(np.searchsorted(code, want), len(code) - 1)
            # a block of which a part is unique is unique; one of more bytes than a string has is in none
            keep &= code[p] == want
            names.append(name[p])
            total = total + size[p]
        keep = np.flatnonzero(keep & (total <= least))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(*(x[keep] for x in names))), pa.array(t[keep]), pa.array(at[keep]), pa.array(total[keep].astype(np.int32))], names=["x", "t", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last text, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(0).to_numpy()
            cut = int(np.searchsorted(t, t[-1]))
            if held and not cut and held[0].column(0)[0].as_py() == t[0]:
                held.append(batch)
                continue
            yield from joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield from joined(held)

    return run


def _run_rows(least: int, reach: int):
    """From (t, several, text, names: list of {code: level << 34 and number, name}): the runs whose phrases have names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(3)
            bounds, fields = names.offsets.to_numpy(), names.values
            codes, name = (fields.field(f).to_numpy() for f in ("code", "name"))
            for rows, texts in _loads(batch.column(2), least):
                a = Anchors(texts, least, reach)
                runs = a.runs()
                k = runs[4] - runs[3]
                m = (np.frexp(k)[1] - 1) // 2  # four blocks of 4 ** m phrases cover k of them
                width = np.left_shift(1, 2 * m.astype(np.int64))
                # names of this load's texts, in one sorted list of (text, level, number)
                of = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
                owner = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
                code = (owner << 40) + codes[of]
                order = np.argsort(code, kind="stable")
                code, known = code[order], name[of][order]
                begin, keep, blocks = (runs[0] << 40) + (m.astype(np.int64) << 34) + runs[3], np.arange(len(k)), []
                for j in range(_JOINED):
                    want = (begin + np.minimum(j * width, k - width))[keep]
                    p = np.minimum(np.searchsorted(code, want), len(code) - 1)
                    there = code[p] == want
                    keep, blocks = keep[there], [*(x[there] for x in blocks), known[p[there]]]
                if not len(keep):
                    continue
                name_of = _mixed(k[keep], *blocks)
                text, first, count, left = (x[keep] for x in runs[:4])
                place = a.at[left + a.begins[text]] - first  # of L in the first string
                digests = _digests(a.data, first, first + count - 1 + least, (place << 32) + count)
                row = pa.array(rows[text])
                columns = [digests[:, 0].copy(), digests[:, 1].copy(), name_of, (first - a.starts[text]).astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(place.astype(np.int32)), *(batch.column(c).take(row) for c in range(2))], names=["e0", "e1", "name", "i", "n", "place", "t", "several"]
                )

    return run


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple]:
    """From (t, text, wanted: list of structs), load by load: the texts as one, and for each of `wanted` its row, the begin of its text, and its fields."""
    wanted = batch.column(2)
    bounds, fields = wanted.offsets.to_numpy(), [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in wanted.values.flatten()]
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    for a, b in by_bytes(texts, LOAD):
        size = np.array([len(x) for x in texts[a:b]], np.int64)
        owner = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        yield b"".join(texts[a:b]), owner + a, (np.cumsum(size) - size)[owner], *(x[bounds[a] : bounds[b]] for x in fields)


def _group_rows(least: int):
    """From (t, text, wanted: list of {i, n, place, settled}): (c, f0, f1, i, n, settled, t) of groups of strings.

    place: of L in the first string of the run. c: digest of the core, which all strings of a whole group hold, also
    where the run has only some of them; f: of all bytes and of which strings there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, row, base, i, count, left, mark in _wanted(batch):
                at = base + i + left  # of L; a string is `least` bytes from 0 .. left bytes before it on
                top, low = left // GROUP, (left - count + 1) // GROUP
                groups = top - low + 1
                owner = np.repeat(np.arange(len(i)), groups)
                number = top[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups))
                most = np.minimum(left[owner], number * GROUP + GROUP - 1)
                fewest = np.maximum((left - count + 1)[owner], number * GROUP)
                begin, strings = at[owner] - most, most - fewest + 1
                core = at[owner] - number * GROUP
                c = _marks(data, core, core + least - GROUP + 1, number)
                f = _digests(data, begin, begin + strings - 1 + least, (most << 32) + strings)
                columns = [c, f[:, 0].copy(), f[:, 1].copy(), (begin - base[owner]).astype(np.int32), strings.astype(np.int32), mark[owner] > 0]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(pa.array(row[owner]))], names=["c", "f0", "f1", "i", "n", "settled", "t"])

    return run


def _string_rows(least: int):
    """From (t, text, wanted: list of {i, n, settled}): (w0, w1, i, settled, t), a row for each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, row, base, i, count, mark in _wanted(batch):
                owner = np.repeat(np.arange(len(i)), count)
                at = np.repeat(base + i - np.cumsum(count) + count, count) + np.arange(len(owner))
                for a in range(0, len(at), 1 << 16):
                    some, of = at[a : a + (1 << 16)], owner[a : a + (1 << 16)]
                    digests = _digests(data, some, some + least)
                    columns = [digests[:, 0].copy(), digests[:, 1].copy(), (some - base[of]).astype(np.int32), mark[of] > 0]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(pa.array(row[of]))], names=["w0", "w1", "i", "settled", "t"])

    return run


def _kept_rows(least: int, text_too: bool):
    """From (k0, k1, copies, text, found: list of longs, i << 32 and n): the result by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, digest, kept_text = [], [], [], [], []
            bounds, found = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            for r, text in enumerate(batch.column(3).cast(pa.binary())):
                data = text.as_py()
                if batch.column(2)[r].as_py() > 1:
                    begins, ends = (np.array([0]), np.array([len(data)])) if len(data) >= least else (np.zeros(0, np.int64),) * 2
                elif bounds[r] == bounds[r + 1]:
                    begins = ends = np.zeros(0, np.int64)
                else:
                    part = np.sort(found[bounds[r] : bounds[r + 1]])
                    begins = part >> 32
                    ends = np.maximum.accumulate(begins + (part & 0xFFFFFFFF) - 1 + least)
                    new = np.ones(len(begins), bool)
                    new[1:] = begins[1:] > ends[:-1]
                    begins, ends = begins[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
                kept = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(data)]))
                size.append(len(data))
                gone.append(len(data) - len(kept))
                spans.append(len(begins))
                digest.append(hashlib.sha256(kept).hexdigest())
                if text_too:
                    kept_text.append(kept)
            out = [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["k0", "k1", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if text_too:
                out.append(pa.array(kept_text, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def text_key(text: Column) -> list[Column]:
    """128 bits of a text's SHA-256 as two longs."""
    half = lambda at: F.conv(F.substring(F.sha2(text, 256), at, 16), 16, -10).cast("long")
    return [half(1).alias("k0"), half(17).alias("k1")]


def ranked_blocks(phrases: DataFrame, least: int) -> list[DataFrame]:
    """(t, at, name, size) for blocks of 1, 4, 16 ... phrases from an anchor on: ranks that aren't unique, by prefix doubling."""
    out, blocks = [], phrases
    while True:
        ranked = sorted_groups(blocks, ["x"], ["t", "at"], whole=False).select("t", "at", F.col("start").alias("name"), "size")
        dropped_table(blocks)
        freed(phrases.sparkSession)
        out.append(ranked)
        if ranked.isEmpty():
            return out
        in_texts = ranked.repartition("t").sortWithinPartitions("t", "at")
        blocks = stored(in_texts.mapInArrow(_joined_rows(_JOINED ** (len(out) - 1), least), "x long, t long, at int, size int"))


def _asked(texts: DataFrame, in_order: DataFrame, columns: list[str]) -> DataFrame:
    """(t, text, wanted: list of columns) of the rows that sorted_kinds asks for."""
    wanted = in_order.where("asked").groupBy("t").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return texts.join(wanted.hint("shuffle_hash"), "t").select("t", "text", "wanted")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, reach: int | None = None, with_text: bool = True) -> DataFrame:
    """Removes each byte covered by a string of `least` bytes that also starts elsewhere in docs.

    One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, and with_text kept, the bytes that are
    left (binary: a string may begin or end inside of a character). Texts are taken as UTF-8, null ones as empty;
    those shorter than `least` stay. Repeated rows are rows like others, so texts that occur twice are removed whole.
    Rows are told apart by their texts alone: ids may be null or repeated. Other columns are not read. An empty table
    gives no rows. reach: grams of which one is an anchor, at most (least - 7) // 2, which is taken without it.
    """
    spark = docs.sparkSession
    reach = reach or max(1, (least - _GRAM + 1) // 2)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *text_key(text), text.alias("text"))
    # t, a number for each distinct text, is written with it
    texts = rows.groupBy("k0", "k1").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = stored_by(texts.withColumn("t", F.monotonically_increasing_id()), "t")
    long = texts.where(f"octet_length(text) >= {least}")
    phrases = stored(long.select("t", "text").mapInArrow(_phrase_rows(least, reach), "x long, t long, at int, size int"))
    ranked = ranked_blocks(phrases, least)
    names = reduce(DataFrame.unionAll, [blocks.select("t", (F.lit(level << 34) + F.col("at")).alias("code"), "name") for level, blocks in enumerate(ranked)])
    names = names.groupBy("t").agg(F.collect_list(F.struct("code", "name")).alias("names"))
    made = "e0 long, e1 long, name long, i int, n int, place int, t long, several boolean"
    in_names = long.join(names.hint("shuffle_hash"), "t").select("t", F.expr("copies > 1").alias("several"), "text", "names")
    runs = stored(in_names.mapInArrow(_run_rows(least, reach), made))
    for blocks in ranked:
        dropped_table(blocks)
    in_order = sorted_kinds(runs, "name", ["e0", "e1"], ["t", "i"], "several")
    dropped_table(runs)
    freed(spark)
    # one run of each kind, where kinds of one name differ
    groups = _asked(long, in_order, ["i", "n", "place", "settled"])
    groups = stored(groups.mapInArrow(_group_rows(least), "c long, f0 long, f1 long, i int, n int, settled boolean, t long"))
    of_core = sorted_kinds(groups, "c", ["f0", "f1"], ["t", "i"], "settled")
    dropped_table(groups)
    # one group of each kind, where groups of one core differ
    strings = _asked(long, of_core, ["i", "n", "settled"])
    strings = stored(strings.mapInArrow(_string_rows(least), "w0 long, w1 long, i int, settled boolean, t long"))
    again = sorted_kinds(strings, "w0", ["w1"], ["t", "i"], "settled").withColumn("n", F.lit(1))
    dropped_table(strings)
    freed(spark)
    found = reduce(DataFrame.unionAll, [x.where("found").select("t", F.expr("shiftleft(cast(i as long), 32) + n").alias("span")) for x in (in_order, of_core, again)])
    found = found.groupBy("t").agg(F.collect_list("span").alias("found"))
    made = "k0 long, k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    by_text = texts.join(found.hint("shuffle_hash"), "t", "left").select("k0", "k1", "copies", "text", "found").mapInArrow(_kept_rows(least, with_text), made)
    return rows.select("id", "k0", "k1").join(by_text, ["k0", "k1"]).drop("k0", "k1").withColumnRenamed("id", id_col)
