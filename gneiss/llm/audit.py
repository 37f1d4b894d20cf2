"""How filters overlap: what each removes in every order of application, and what it removes alone.

Four filters judge a text by itself, the fifth whether a smaller id has the same text. Equal texts are found by
refining a partition. Texts are split by their length in code points, then by the hash of their first block, of the
first two, and so on; a text that is alone in its part is done. Blocks grow fourfold, so few rounds reach the end of
the longest text, and only numbers travel. The texts of parts that are left are then compared in full: a part whose
texts prove equal is one group, others are told apart by the texts themselves.

A document is then no more than a mask of the filters it fails. Masks are counted by part of the corpus, and all
orders follow from these counts: what a filter removes depends on the set of filters before it, not on their order.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import dropped_table, stored

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Code points of a text's first block.
BLOCK = 64


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (short), B (repetitive), C (capitals) and D (markup characters)."""
    words = F.array_remove(F.split(text, SPACE), "")  # without a lambda, so that the plan makes the array once for A and B
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def block_hashes(text: Column, block: int = BLOCK) -> Column:
    """Hashes of a text's successive blocks of block, 4 * block, 16 * block ... code points."""
    whole = lambda x: F.least(x, F.lit(2.0**31 - 2)).cast("int")
    begin = lambda k: whole((F.pow(F.lit(4), k) - 1) / 3 * block) + 1
    count = F.ceil(F.log(4.0, F.length(text) * 3 / block + 1)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), count), lambda k: F.substring(text, begin(k), whole(F.pow(F.lit(4), k) * block)))
    # the logarithm may be off by a rounding: a block too many is empty and goes
    return F.transform(F.filter(hashes, lambda b: b != ""), lambda b: F.xxhash64(b))


def part_of(rounds: int | None = None) -> list[Column]:
    """The part that a text is in after so many rounds (None: after all of its blocks)."""
    return [F.col("length"), F.xxhash64("blocks" if rounds is None else F.slice("blocks", 1, rounds)).alias("part_hash")]


def repeated_parts(rows: DataFrame) -> DataFrame:
    """(length, part_hash) of the last parts that hold more than one row of (length, blocks)."""
    most = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    alive = rows.select("length", "blocks")
    made = None
    for k in range(most + 1):
        part = alive.withColumns({"part_length": F.col("length"), "part_hash": part_of(k)[1]})
        several = part.groupBy("part_length", "part_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        if k == most:
            return several.withColumnRenamed("part_length", "length")
        last, alive = made, stored(part.join(several, ["part_length", "part_hash"], "left_semi").select("length", "blocks"))
        made = alive
        if last is not None:
            dropped_table(last)


def smaller_ids(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(length, part_hash, text, least): the smallest id by repeated text; text is null where a part has just one."""
    parts = stored(repeated_parts(rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.length(text).alias("length"), block_hashes(text).alias("blocks"))
    read = read.select("id", "text", *part_of())
    groups = read.join(parts, ["length", "part_hash"], "left_semi").groupBy("length", "part_hash", "text").agg(F.min("id").alias("least"))
    by_part = stored(groups.withColumn("text_hash", F.sha2("text", 256)))
    texts = by_part.groupBy("length", "part_hash").agg(F.count("*").alias("texts"))
    return by_part.join(texts, ["length", "part_hash"]).select("length", "part_hash", F.when(F.col("texts") > 1, F.col("text")).alias("text"), "least")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, mask): a row per row of docs. Bit k of mask is set if it fails the k-th filter of ABCDE.

    Null texts are empty. A row fails E if a row with a smaller id has an identical text, whatever happens to that
    row; rows with equal ids don't make each other fail, and a null id is neither smaller nor larger than another.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(failures(text))), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.length(text).alias("length"),
        block_hashes(text).alias("blocks"), mask.cast("int").alias("mask"),
    )
    rows = stored(rows)
    groups = stored(smaller_ids(docs, rows, id_col, text_col))
    fails = lambda least: F.col("mask") + F.when(F.coalesce(F.col("id") > least, F.lit(False)), 1 << 4).otherwise(0)
    parts = rows.select("id", "source", "mask", *part_of())
    alike = groups.where("text is null").select("length", "part_hash", "least")
    out = parts.join(alike, ["length", "part_hash"], "left").withColumn("mask", fails(F.col("least"))).select("id", "source", "mask", "length", "part_hash")
    split = groups.where("text is not null")
    if not split.limit(1).count():
        return out.select("id", "source", "mask")
    # parts whose texts differ, though their hashes don't: their rows are read again and judged by their texts
    keys = split.select("length", "part_hash").distinct()
    again = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), text.alias("text"), F.length(text).alias("length"), block_hashes(text).alias("blocks"), mask.cast("int").alias("mask"))
    again = again.select("id", "source", "mask", "text", *part_of()).join(split, ["length", "part_hash", "text"], "inner").withColumn("mask", fails(F.col("least")))
    return out.join(keys, ["length", "part_hash"], "left_anti").select("id", "source", "mask").unionAll(again.select("id", "source", "mask"))


def _sets() -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(bit of a filter, bits of those before it, [(order, step)]) for each filter and each set of others."""
    out = []
    for f in range(len(FILTERS)):
        rest = [k for k in range(len(FILTERS)) if k != f]
        for n in range(len(rest) + 1):
            for before in combinations(rest, n):
                after = [k for k in rest if k not in before]
                orders = ["".join(FILTERS[k] for k in (*x, f, *y)) for x in permutations(before) for y in permutations(after)]
                out.append((1 << f, sum(1 << k for k in before), [(o, n + 1) for o in orders]))
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per source, order of the filters and step: counts of documents, and the filter's Shapley sum.

    docs needs a column `source` (null: empty string), labels has id_col, quality and toxic; a document is good if
    any of its labels has quality 1, toxic likewise; labels without an id belong to none. Each row of docs counts, repeated ones too. Other columns are
    not read. An empty table gives no rows.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    judged = masks(docs, id_col, text_col).join(marks, "id", "left")
    counts = judged.groupBy(F.col("source").alias("part"), "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("bad") == 1).alias("bad"))
    # at most 32 masks a source from here on
    sets = F.array(*(F.struct(F.lit(f).alias("bit"), F.lit(b).alias("before")) for f, b, _ in _sets()))
    each = counts.withColumn("set", F.explode(sets)).select("part", "mask", "n", "good", "bad", "set.*")
    failed, met = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, of="n": F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")
    steps = each.groupBy("part", "bit", "before").agg(
        total(~failed & ~met).alias("kept"), total(failed & ~met).alias("removed"), total(failed & met).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(failed & ~met, "good").alias("good_lost"), total(failed & ~met, "bad").alias("toxic_lost"),
    )
    orders = F.create_map(*(x for f, b, o in _sets() for x in (F.lit(f * 32 + b), F.array(*(F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step")) for name, step in o)))))
    steps = steps.withColumn("orders", F.element_at(orders, F.col("bit") * 32 + F.col("before")))
    shapley = steps.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.size("orders")).alias("shapley"))
    steps = steps.join(shapley, ["part", "bit"]).withColumn("o", F.explode("orders"))
    return steps.select("part", "o.filter_order", "o.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
