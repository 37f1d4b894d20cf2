"""Numbers for rows and groups of rows, over all partitions, without a group or a table in one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import stored

#: monotonically_increasing_id gives a partition's number above this bit, and the row's place in it below.
_SHIFT = 33
#: Rows of a partition that sorted_kinds looks at together, at least.
PIECE = 1 << 17


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """rows with a column that numbers them 0, 1, 2 ... without gaps. The rows are written once."""
    at = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", _SHIFT)
    # a row for each partition
    before = at.groupBy(piece.alias("_piece")).agg(F.count("*").alias("n")).selectExpr("_piece", "coalesce(sum(n) over (order by _piece rows between unbounded preceding and 1 preceding), 0) as _base")
    return at.join(F.broadcast(before), piece == F.col("_piece")).withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1)).drop("_at", "_piece", "_base")


def named(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """rows with a dense number for each distinct value of keys, which hold no nulls."""
    return rows.join(numbered(rows.select(*keys).distinct(), name), keys)


def _local_groups(keys: list[str], whole: bool):
    """Adds to sorted rows, by partition, the place of the first row of each row's group, and whether it is alone in it.

    _edge marks the first and the last row of the partition.
    Not whole: rows that are alone, and whose neighbours are rows of the partition, are left out, and places count the
    others; keys are kept in the first and last row of the partition only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the next one; begun: whether it begins a group, start: of its group, place: of the next row
        held, begun, start, place = None, True, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(rows.num_rows, bool)
            for k in keys:
                x = rows.column(rows.schema.get_field_index(k)).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            new[0] = begun
            alone = new[:-1] & new[1:]
            stays = np.ones(len(alone), bool) if whole else ~alone
            if place == 0 and len(stays):
                stays[0] = True  # the group of a partition's first row may have begun before it
            at = place + np.cumsum(stays) - 1
            first = np.maximum.accumulate(np.where(new[:-1], at, start))
            if stays.any():
                yield _with(rows.slice(0, len(alone)), first, alone, stays, None if whole else keys, place == 0)
            place += int(stays.sum())
            held, begun = rows.slice(rows.num_rows - 1, 1), bool(new[-1])
            start = place if begun else int(first[-1]) if len(first) else start
        if held is not None:
            yield _with(held, np.array([start]), np.array([begun]), np.ones(1, bool), None, True)

    return run


def _with(rows: pa.RecordBatch, start: np.ndarray, alone: np.ndarray, stays: np.ndarray, keys: list[str] | None, first: bool) -> pa.RecordBatch:
    edge = np.zeros(len(start), bool)
    edge[0] = first
    columns = [*rows.columns, pa.array(start.astype(np.int64)), pa.array(alone), pa.array(edge)]
    if not stays.all():
        keep = pa.array(stays)
        columns = [c.filter(keep) for c in columns]
    for name in keys or []:
        k = rows.schema.get_field_index(name)
        gone = np.ones(len(columns[k]), bool)
        gone[0] = not first
        columns[k] = pa.array(columns[k].to_numpy(), mask=gone)
    return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "_start", "_alone", "_edge"])


def sorted_groups(rows: DataFrame, keys: list[str], ties: list[str], whole: bool = True) -> DataFrame:
    """rows, sorted over all partitions by keys, then ties, with number, start and alone.

    number: the row's place in the order, from 0. start: that of the first row with the same keys (longs without
    nulls), so equal keys have equal starts, and starts are ordered as keys are. alone: whether no other row has the
    same keys. Partitions are cut by keys and ties, so a group of any size is spread over tasks; each task looks at
    its rows as they stream by, and what a group needs to know of other tasks follows from a row for each of them.
    The sorted rows are written once. Not whole: only rows that aren't alone, without the keys, numbered by themselves.
    """
    spark = rows.sparkSession
    in_order = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
    made = in_order.mapInArrow(_local_groups(keys, whole), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _start long, _alone boolean, _edge boolean")
    at = stored(made.withColumn("_at", F.monotonically_increasing_id()))
    edges = sorted(at.where("_edge").select("_at", "_start", *(F.col(f"`{k}`") for k in keys)).collect(), key=lambda x: x["_at"])
    # a row for each partition of the sort
    found, base, begun, before = [], 0, 0, None
    for _, ends in groupby(edges, lambda x: x["_at"] >> _SHIFT):
        first, *_, last = [*ends] * 2
        x, y = ([r[k] for k in keys] for r in (first, last))
        goes_on = before is not None and before == x
        if goes_on:
            found[-1][4] = True
        else:
            begun = base
        # start of the group that the first row is in; whether it began earlier; whether the last group goes on
        found.append([first["_at"] >> _SHIFT, base, begun, goes_on, False, last["_start"]])
        if x != y:
            begun = base + last["_start"]
        base, before = base + (last["_at"] & ((1 << _SHIFT) - 1)) + 1, y
    known = spark.createDataFrame(found, "_piece long, _base long, _begun long, _before boolean, _after boolean, _last long")
    out = at.join(F.broadcast(known), F.shiftright("_at", _SHIFT) == F.col("_piece"))
    out = out.select(
        *[F.col(f"`{c}`") for c in rows.columns if whole or c not in keys],
        (F.col("_base") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1)).alias("number"),
        F.when(F.col("_start") == 0, F.col("_begun")).otherwise(F.col("_base") + F.col("_start")).alias("start"),
        (F.col("_alone") & ~((F.col("_start") == 0) & F.col("_before")) & ~((F.col("_start") == F.col("_last")) & F.col("_after"))).alias("alone"),
    )
    return out if whole else out.where("not alone").drop("alone")


def _kinds_of(rows: pa.Table, name: str, keys: list[str], known: str, piece: int) -> pa.RecordBatch:
    """What a piece of sorted rows tells of its kinds; its first and last name may be those of other pieces too."""
    n, column = rows.num_rows, {c: rows.column(c).to_numpy() for c in (name, *keys, known)}
    new_name = np.ones(n, bool)
    new_name[1:] = column[name][1:] != column[name][:-1]
    first = new_name.copy()
    first[1:] |= np.logical_or.reduce([column[c][1:] != column[c][:-1] for c in keys])
    begins, kind = np.flatnonzero(first), np.cumsum(first) - 1
    one = np.diff(np.append(begins, n)) == 1
    name_of = (np.cumsum(new_name) - 1)[begins]
    unsettled = one & ~column[known][begins]
    kinds, left = np.bincount(name_of), np.bincount(name_of, weights=unsettled).astype(int)
    alone, of = one[kind], name_of[kind]
    asked = first & ((kinds > 1) & (left > 0))[of]
    sides = of == 0, of == of[-1]
    stays = (~alone & ~column[known]) | asked | sides[0] | sides[1]
    marks = sum(x.astype(np.int32) << b for b, x in enumerate((alone, first, asked, *sides, kind == 0, kind == kind[-1])))
    # name and keys of the first and of the last row; see _between
    edges = [column[c][k] for k in (0, -1) for c in (name, *keys)]
    begun, ended, same = unsettled[0], unsettled[-1], len(kinds) == 1
    edges += [len(one), same, kinds[0], left[0] - begun - (ended if same else 0), begun, kinds[-1], left[-1] - ended, ended]
    keep = np.flatnonzero(stays)  # the last row is of the last name
    rest = rows.select([c for c in rows.column_names if c not in (name, *keys)]).take(pa.array(keep))
    offsets = np.zeros(len(keep) + 1, np.int32)
    offsets[-1] = len(edges)
    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(np.arange(len(keep)) < len(keep) - 1, False)), pa.array([int(x) for x in edges], pa.int64()))
    columns = [*(c.combine_chunks() for c in rest.columns), pa.array(marks[keep].astype(np.int32)), pa.array(np.full(len(keep), piece)), lists]
    return pa.RecordBatch.from_arrays(columns, names=[*rest.column_names, "_marks", "_piece", "_edges"])


def _local_kinds(name: str, keys: list[str], known: str, most: int):
    """What sorted rows tell of their kinds, a piece of at least `most` rows of a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, piece = [], 0, TaskContext.get().partitionId() << _SHIFT
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield _kinds_of(pa.Table.from_batches(held), name, keys, known, piece)
                held, n, piece = [], 0, piece + 1
        if held:
            yield _kinds_of(pa.Table.from_batches(held), name, keys, known, piece)

    return run


def _between(edges: list[tuple[int, list[int]]], width: int) -> list[tuple]:
    """For each piece: its number, whether its first kind began earlier, whether its last kind goes on, whether its first and its last name are mixed.

    edges: in order, (piece, values): the columns of its first and of its last row, `width` each; its number of kinds;
    whether it holds one name; of its first name the kinds, those unsettled without the first, whether the first one
    is; the same of its last name, from the end. With one name, neither count of others holds the first or last kind.
    A name is mixed if it has several kinds and one that isn't settled.
    """
    before = [bool(k) and edges[k - 1][1][width : 2 * width] == x[:width] for k, (_, x) in enumerate(edges)] + [False]
    names, of = [], []  # [kinds, unsettled ones]; those of a piece's first and last name
    for k, (_, x) in enumerate(edges):
        count, same, kinds, left, begun, last_kinds, last_left, ended = x[2 * width :]
        if not k or edges[k - 1][1][width] != x[0]:
            names.append([0, 0])
        first = last = names[-1]
        first[0] += kinds - before[k]
        if count == 1:
            first[1] += begun and not before[k] and not before[k + 1]
        else:
            first[1] += left + (begun and not before[k])
            if not same:
                last = [last_kinds, last_left]
                names.append(last)
            last[1] += ended and not before[k + 1]
        of.append((first, last))
    return [(piece, before[k], before[k + 1], *(n > 1 and left > 0 for n, left in of[k])) for k, (piece, _) in enumerate(edges)]


def sorted_kinds(rows: DataFrame, name: str, keys: list[str], ties: list[str], known: str, piece: int = PIECE) -> DataFrame:
    """Rows of a kind have the same name and keys (longs without nulls). Which rows occur again, and which to look at more closely.

    found: other rows are of this row's kind, and it isn't known (a boolean column). settled: known, or not alone in
    its kind. asked: the first row of its kind, where a name has several kinds that aren't all settled. Rows that are
    neither found nor asked are left out, name and keys too. Sorted as in sorted_groups: names and kinds of any size are
    spread over tasks, and a row for each piece of a partition tells what they have to know of others.
    """
    spark, columns = rows.sparkSession, [name, *keys]
    in_order = rows.repartitionByRange(*columns, *ties).sortWithinPartitions(*columns, *ties)
    rest = [f for f in rows.schema if f.name not in columns]
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", _marks int, _piece long, _edges array<long>"
    at = stored(in_order.mapInArrow(_local_kinds(name, keys, known, piece), made))
    edges = sorted(map(tuple, at.where("_edges is not null").select("_piece", "_edges").collect()))
    between = spark.createDataFrame(_between(edges, len(columns)), "_piece long, _before boolean, _after boolean, _a boolean, _b boolean")
    mark = lambda b: F.col("_marks").bitwiseAND(1 << b) != 0
    alone, first, asked, in_first_name, in_last_name, in_first, in_last = map(mark, range(7))
    begun, goes_on = in_first & F.col("_before"), in_last & F.col("_after")
    again, is_known = ~(alone & ~begun & ~goes_on), F.col(f"`{known}`")
    first_of_kind = first & ~begun
    out = at.join(F.broadcast(between), "_piece").select(
        *[F.col(f"`{f.name}`") for f in rest if f.name != known],
        (again & ~is_known).alias("found"),
        (again | is_known).alias("settled"),
        F.when(in_first_name, first_of_kind & F.col("_a")).when(in_last_name, first_of_kind & F.col("_b")).otherwise(asked).alias("asked"),
    )
    return out.where("found or asked")
