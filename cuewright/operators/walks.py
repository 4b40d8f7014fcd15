"""Walks over the rows of a group in their order, where a row's result depends on what came before.

A walk here carries a clock: a row sets it to the row's own time where that is ahead by more than a margin, and then moves it on by
the row's length. Less the lengths so far, the clock only changes where it is set, and always upwards, so a run of rows maps the
clock before it to the clock behind it by a few steps. Rows are dealt out by ranges of group and order, so that a group may lie in
many tasks: each reduces its part of a group to such steps, the steps are followed from part to part, and then all parts are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: What a clock shows that nothing has set yet.
UNSET = -(1 << 60)
_PART = "_part"


def _opens(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Whether each row but the first is of another group than the row before; the first counts as such."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for name in group:
        a, b = batch.column(name)[:-1], batch.column(name)[1:]
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= other.to_numpy(zero_copy_only=False)
    return out


def _key(batch: pa.RecordBatch, group: list[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in group)


def followers(values: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """For rising values, the place of the first that is more than the margin ahead of each."""
    return np.searchsorted(values, values + margin, "right")


class Walk:
    """The rows of a batch, all groups at once. Values of different groups are moved apart, so that one search serves them all."""

    def __init__(self, batch: pa.RecordBatch, group: list[str], value: str, own: str, margin: str, sofar: int | None):
        """sofar: the length so far of the group of the batch before, if the first row goes on with it."""
        n = batch.num_rows
        opens = _opens(batch, group)
        self.starts = np.flatnonzero(opens)
        self.run = np.cumsum(opens) - 1
        lengths = batch.column(own).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(lengths)
        before = total - lengths
        base = before[self.starts]
        base[0] -= sofar or 0
        self.before = before - base[self.run]
        self.ends = np.append(self.starts[1:], n)
        self.after = (self.before + lengths)[self.ends - 1]
        self.margin = batch.column(margin).to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64) - self.before
        least = int(self.values.min())
        self.width = int(self.values.max()) - least + int(self.margin.max()) + 2
        self.shift = self.run * self.width - least
        apart = self.values + self.shift
        top = np.maximum.accumulate(apart)
        self.records = np.flatnonzero(np.append(True, apart[1:] > top[:-1]))
        self.apart = apart[self.records]
        self.of = self.run[self.records]
        self.next = followers(self.apart, self.margin[self.records])
        self.edge = np.searchsorted(self.of, np.arange(len(self.starts)), "right")

    def steps(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(values, clocks behind) of a run's records: a clock goes to the first value that is more than the margin ahead, and behind the
        run shows what stands beside it; a clock that none is ahead of stays."""
        first, last = int(np.searchsorted(self.of, run)), int(self.edge[run])
        to = np.where(self.next[first:last] < last, self.next[first:last], np.arange(first, last)) - first
        while not np.array_equal(further := to[to], to):
            to = further
        own = self.values[self.records[first:last]]
        return own, own[to]

    def walked(self, clocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, before, behind) for each row, from the clock before each run, all less the lengths so far: whether the row sets the clock, and what
        it shows before and behind that."""
        runs = np.arange(len(self.starts))
        entry = np.maximum(clocks + self.shift[self.starts], runs * self.width - self.margin[self.starts] - 1)
        at = np.searchsorted(self.apart, entry + self.margin[self.starts], "right")
        at = np.maximum(at, np.searchsorted(self.of, runs))
        is_set = np.zeros(len(self.values), bool)
        going = at < self.edge
        while going.any():
            at, runs = at[going], runs[going]
            is_set[self.records[at]] = True
            at = self.next[at]
            going = at < self.edge[runs]
        latest = np.maximum.accumulate(np.where(is_set, np.arange(len(is_set)), -1))
        held = latest >= self.starts[self.run]
        behind = np.where(held, self.values[latest], clocks[self.run])
        before = np.append(clocks[0], behind[:-1])
        before[self.starts] = clocks
        return is_set, before, behind


def _looked_up(values: np.ndarray, out: np.ndarray, clocks: np.ndarray, margin: int) -> np.ndarray:
    at = np.searchsorted(values, clocks + margin, "right")
    return np.where(at < len(values), np.append(out, 0)[at], clocks)


class _Part:
    """The steps of a group's rows in one task, as they come in batches."""

    def __init__(self):
        self.values = self.out = np.zeros(0, np.int64)
        self.total = 0

    def add(self, values: np.ndarray, out: np.ndarray, total: int, margin: int) -> None:
        moved = _looked_up(values, out, self.out, margin)
        more = values > (self.values[-1] if len(self.values) else np.iinfo(np.int64).min)
        x, y = np.append(self.values, values[more]), np.append(moved, out[more])
        kept = np.append(y[1:] != y[:-1], True) if len(y) else np.zeros(0, bool)
        self.values, self.out, self.total = x[kept], y[kept], total




def _pieces(batches: Iterator[pa.RecordBatch], value: str, margin: str) -> Iterator[pa.RecordBatch]:
    """Batches whose groups can be moved apart within a long."""
    for batch in batches:
        todo = [batch] if batch.num_rows else []
        while todo:
            piece = todo.pop()
            ends, n = pc.min_max(piece.column(value)).as_py(), piece.num_rows
            if n > 1 and (ends["max"] - ends["min"] + pc.max(piece.column(margin)).as_py()) * n > 1 << 60:
                todo += [piece.slice(n // 2), piece.slice(0, n // 2)]
            else:
                yield piece


def _reduced(group: list[str], value: str, own: str, margin: str):
    """The steps of the first and the last group of a task, which may go on in other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = part = row = first = None
        for batch in _pieces(batches, value, margin):
            same = key == _key(batch, group, 0)
            walk = Walk(batch, group, value, own, margin, part.total if same else None)
            for i in sorted({0, len(walk.starts) - 1}):
                if i or not same:
                    # What came before has ended; the first group that does is the task's first one.
                    first = first or (row and (row, part))
                    part, row = _Part(), batch.slice(int(walk.starts[i]), 1).select([*group, _PART, margin])
                part.add(*walk.steps(i), int(walk.after[i]), int(walk.margin[walk.starts[i]]))
            key = _key(batch, group, int(walk.starts[-1]))
        for of, found in [f for f in (first, row and (row, part)) if f]:
            arrays = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (found.values, found.out)]
            yield pa.RecordBatch.from_arrays([*of.columns, *arrays, pa.array([found.total], pa.int64())], [*of.schema.names, "_values", "_out", "_total"])

    return run


def _followed(group: list[str], margin: str, start: int):
    """The clock with which each part of a group but its first begins, from sorted parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, clock = None, start
        for batch in batches:
            parts, clocks = [], []
            for i in range(batch.num_rows):
                if (now := _key(batch, group, i)) == key:
                    parts.append(batch.column(_PART)[i].as_py())
                    clocks.append(clock)
                else:
                    key, clock = now, start
                values, out = (batch.column(c)[i].values.to_numpy() for c in ("_values", "_out"))
                clock = int(_looked_up(values, out, np.array([clock]), batch.column(margin)[i].as_py())[0]) + batch.column("_total")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(clocks, pa.int64())], ["part", "clock"])

    return run


def _walks(batches: Iterator[pa.RecordBatch], group: list[str], value: str, own: str, margin: str, start: int, entries: dict[int, int]) -> Iterator[tuple]:
    """(batch, walk, whether it goes on with the group of the batch before, is_set, before, behind) for each batch of a task."""
    key, clock, sofar = None, start, 0
    for batch in _pieces(batches, value, margin):
        same = key == _key(batch, group, 0)
        walk = Walk(batch, group, value, own, margin, sofar if same else None)
        clocks = np.full(len(walk.starts), start, np.int64)
        if same or key is None:
            clocks[0] = clock if same else entries.get(batch.column(_PART)[0].as_py(), start)
        is_set, before, behind = walk.walked(clocks)
        yield batch, walk, same, is_set, before, behind
        key, clock, sofar = _key(batch, group, int(walk.starts[-1])), int(behind[-1]), int(walk.after[-1])


def _counted(group: list[str], value: str, own: str, margin: str, start: int, entries: dict[int, int]):
    """How many rows and settings the first and the last group of a task have in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = first = None
        n = 0
        for batch, walk, same, is_set, _, _ in _walks(batches, group, value, own, margin, start, entries):
            each = np.diff(np.append(0, np.cumsum(1 + is_set)[walk.ends - 1]))
            for i in sorted({0, len(walk.starts) - 1}):
                if i or not same:
                    first = first or (row and (row, n))
                    row, n = batch.slice(int(walk.starts[i]), 1).select([*group, _PART]), 0
                n += int(each[i])
        for of, count in [f for f in (first, row and (row, n)) if f]:
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array([count], pa.int64())], [*of.schema.names, "n"])

    return run


def clocked(rows: DataFrame, group: list[str], order: list[str], value: str, own: str, margin: str, start: int = UNSET, numbered: bool = False) -> DataFrame:
    """Rows with is_set, before_us, at_us and number: whether the row's value is more than its margin ahead of its group's clock and so sets it, what
    the clock shows before and after that (it then moves on by `own`), and with `numbered` how many rows and settings of the group came before.

    value, own and margin are long columns without nulls, and margin is the same for all rows of a group. Rows are walked in the order of `order`; the
    clock of a group begins at `start`. A group may have any share of the rows: parts of it in several tasks know of each other by their steps.
    """
    names, at = rows.columns, [*group, *order]
    dealt = checkpointed(rows.repartitionByRange(*at).sortWithinPartitions(*at).withColumn(_PART, F.spark_partition_id()))
    keys = ", ".join(f"`{g}` {dealt.schema[g].dataType.simpleString()}" for g in group)
    narrow = dealt.select(*group, _PART, *dict.fromkeys([value, own, margin]))
    parts = narrow.mapInArrow(_reduced(group, value, own, margin), f"{keys}, {_PART} int, `{margin}` long, _values array<long>, _out array<long>, _total long")
    followed = parts.repartition(*group).sortWithinPartitions(*group, _PART).mapInArrow(_followed(group, margin, start), "part int, clock long")
    # What goes to the driver is a number or two for each task.
    entries, firsts = {r["part"]: r["clock"] for r in followed.collect()}, {}
    if numbered and entries:
        counts = narrow.mapInArrow(_counted(group, value, own, margin, start, entries), f"{keys}, {_PART} int, n long")
        before = F.sum("n").over(Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
        firsts = {r["part"]: r["n"] for r in counts.select(F.col(_PART).alias("part"), before.alias("n")).filter("n is not null").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch, walk, same, is_set, before, behind in _walks(batches, group, value, own, margin, start, entries):
            number = np.arange(len(is_set)) + np.cumsum(is_set) - is_set
            base = number[walk.starts]
            base[0] -= count if same else firsts.get(batch.column(_PART)[0].as_py(), 0) if count is None else 0
            number = number - base[walk.run]
            count = int(number[-1] + 1 + is_set[-1])
            columns = [pa.array(is_set), pa.array(before + walk.before), pa.array(behind + walk.before), pa.array(number)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "is_set", "before_us", "at_us", "number"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, is_set boolean, before_us long, at_us long, number long")


def most_at_once(spans: DataFrame, key: str, start: Column, end: Column, bucket: int) -> DataFrame:
    """Per key the most spans that are open at one time (those that end at a time are not open at it), as most_held.

    Changes are summed by key and bucket of time first; a key's sums run over its buckets, and rows are put in order within a bucket only.
    """
    change = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    changes = spans.select(key, F.explode(F.array(change(start, 1), change(end, -1))).alias("e")).select(key, "e.at", "e.d")
    changes = changes.groupBy(key, "at", "d").agg(F.sum("d").alias("n")).withColumn("bucket", F.floor(F.col("at") / F.lit(bucket)))
    sums = changes.groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = changes.withColumn("held", F.sum("n").over(Window.partitionBy(key, "bucket").orderBy("at", "d"))).groupBy(key, "bucket").agg(F.max("held").alias("top"))
    sums = sums.select(F.col(key).alias("of_key"), F.col("bucket").alias("of_bucket"), base.alias("base"))
    joined = tops.join(sums, F.col(key).eqNullSafe(F.col("of_key")) & F.col("bucket").eqNullSafe(F.col("of_bucket")))
    return joined.groupBy(key).agg(F.max(F.col("base") + F.col("top")).alias("most_held"))
