"""Language identification by bit-sliced Bloom filters of character n-grams.

The table has one bit mask of languages per slot: bit l of a slot belongs to the Bloom filter of language l. The
slots of an n-gram's hashes, combined by AND, so are the mask of all languages whose filter holds it. A text's
n-grams are looked up, the masks' bits counted per language, and the counts corrected for each filter's rate of
false positives; the language with the largest corrected share decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_bytes

_U = np.uint64
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Letters, and the marks that stand with letters in many scripts."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hash, text) of all 3- and 4-grams of letters, a stretch of other characters being one blank, as are a text's ends."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + "".join(t + " " for t in lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    lengths = [len(t) + 1 for t in lowered]
    text = np.append(0, np.repeat(np.arange(len(texts)), lengths))
    keep = letter | np.append(False, letter[:-1])
    keep[0] = True
    c = np.where(letter, codes, 32).astype(np.uint64)[keep]
    text = text[keep]
    out, of = [], []
    for n in (3, 4):
        if len(c) < n:
            continue
        h = c[: len(c) - n + 1].copy()
        for j in range(1, n):
            h = h * _U(0x100000001B3) + c[j : len(c) - n + 1 + j]
        inner = c[1 : len(c) - n + 2] != 32
        if n == 4:
            inner &= c[2 : len(c) - n + 3] != 32
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + _U(n)
        out.append((h ^ (h >> _U(32)))[inner])
        of.append(text[1 : len(c) - n + 2][inner])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class Filters:
    """masks: (words of 64 languages, slots); fill: each language's rate of false positives."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    hashes: int

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray], slots: int, hashes: int) -> Filters:
        masks = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
        rate = np.zeros(len(languages))
        for k, found in enumerate(members):
            for at in cls._slots(found, slots, hashes):
                masks[k // 64][at] |= _U(1 << (k % 64))
            rate[k] = ((masks[k // 64] >> _U(k % 64)) & _U(1)).mean() ** hashes
        return cls(languages, masks, rate, hashes)

    @staticmethod
    def _slots(found: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
        a, b = found & _U(0xFFFFFFFF), (found >> _U(32)) | _U(1)
        return [((a + _U(k) * b) & _U(slots - 1)).astype(np.int64) for k in range(hashes)]

    def shares(self, found: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """(texts, languages): corrected shares of the n-grams of n texts."""
        at = self._slots(found, self.masks.shape[1], self.hashes)
        total = np.bincount(of, minlength=n)[:n]
        hits = np.zeros((n, len(self.languages)))
        for w in range(len(self.masks)):
            mask = self.masks[w][at[0]]
            for x in at[1:]:
                mask &= self.masks[w][x]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                has = ((mask >> _U(k % 64)) & _U(1)).astype(bool)
                hits[:, k] = np.bincount(of[has], minlength=n)[:n]
        expected = total[:, None] * self.false_rate
        return np.clip((hits - expected) / np.maximum((1 - self.false_rate) * np.maximum(total, 1)[:, None], 1e-9), 0, 1)


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = 2000, least: float = 0.01, slots: int = 1 << 20, hashes: int = 2, most_languages: int = 1024
) -> Filters:
    """Learns from about `sample` texts of each language (those with the smallest hashes of key and text; all where there are fewer).

    An n-gram enters the filter of each language of which at least `least` of the sampled texts, and two, hold it and
    hold it at least half as often as in the language where it is most frequent. What reaches the driver is bounded
    by languages * (n-grams in a text) / least. Rows with a null text or language teach nothing; keys may be null or
    repeated; of rows alike in key and text all are drawn or none, and the smallest hash of a language always is. Extra
    columns are not read. An empty table gives filters of no language. Of more than `most_languages` values of the
    language those with most rows are learned, ties by name: filters take slots / 8 bytes for each.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key_col), F.col(text_col)), 11) / F.lit(float(1 << 53))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), hashed.alias("h"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    counts = {x.lang: x.n for x in counted}
    languages = sorted(counts)
    if not languages:
        return Filters.build([], [], slots, hashes)
    limits = {x.lang: max(x.first, min(1.0, sample / x.n)) for x in counted}
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, limits[k])))
    drawn = rows.where(F.col("h") <= F.try_element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for a, b in by_bytes(texts, 1 << 20):
                with np.errstate(over="ignore"):
                    found, of = grams(texts[a:b])
                o = np.lexsort((found, of))
                found, of = found[o], of[o]
                fresh = np.ones(len(o), bool)
                fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
                found, of = found[fresh], of[fresh]
                for k in sorted(set(langs[a:b])):
                    g, n = np.unique(found[langs[a:b][of] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([k for k in langs.tolist()], pa.string()), pa.array([0] * len(langs), pa.int64()), pa.array([1] * len(langs), pa.int64())], names=["lang", "gram", "n"])

    seen = drawn.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # n-gram 0 stands for the texts; its row holds the number of sampled texts; a language has at least count * share of them, so this filter only drops what the next one would
    floor = F.create_map(*(F.lit(x) for k in languages for x in (k, float(max(2.0, 0.5 * least * min(sample, counts[k]))))))
    got = seen.where((F.col("gram") == 0) | (F.col("n") >= F.element_at(floor, F.col("lang")))).toPandas()
    size = got[got.gram == 0].set_index("lang").n.reindex(languages).fillna(0)
    got = got[got.gram != 0].copy()
    got["rate"] = got.n / size.loc[got.lang].to_numpy()
    got = got[(got.rate >= least) & (got.n >= 2)]
    got = got[got.rate >= 0.5 * got.groupby("gram").rate.transform("max")]
    members = [got[got.lang == k].gram.to_numpy().view(np.uint64) for k in languages]
    return Filters.build(languages, members, slots, hashes)


def identify(docs: DataFrame, filters: Filters, carry: list[str], text_col: str = "text") -> DataFrame:
    """(row: a struct of the carried columns, lang_pred, score) for each row of docs.

    Whole texts count. lang_pred is UNKNOWN, with score 0, if the text is null or has no letter, or nothing was
    learned; ties go to the first language by name. Texts with letters but without any known n-gram get the first
    language and score 0. Empty tables give no rows; repeated rows are rows like others; extra columns are only carried.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filters = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [], []
            for a, b in by_bytes(texts, 1 << 20):
                with np.errstate(over="ignore"):
                    found, of = grams(texts[a:b])
                shares = known.shares(found, of, b - a) if known.languages else np.zeros((b - a, 1))
                best = shares.argmax(axis=1)
                for k, t in enumerate(texts[a:b]):
                    if not known.languages or not t or not any(map(str.isalpha, t)):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        names.append(known.languages[best[k]])
                        scores.append(float(shares[k, best[k]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
