"""Sets of whole numbers, such as the uids of folders, as intervals.

Each task folds its rows into intervals before anything is shuffled, so a folder that was read from end to end is a few rows
however many messages it has.  Intervals are cut at multiples of ``WIDTH`` for the shuffle: a group is a set's stretch of so
many numbers, and holds half as many intervals at most, even where one folder has most of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a group.
WIDTH = 1 << 20
#: Rows that a task folds at once.
HELD = 1 << 16


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as few and sorted; neighbours are one."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, top = low[order], np.maximum.accumulate(high[order])
    first = np.append(True, low[1:] > top[:-1] + 1)
    at = np.flatnonzero(first)
    return low[at], top[np.append(at[1:], len(low)) - 1]


def _less(low: np.ndarray, high: np.ndarray, off_low: np.ndarray, off_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``low..high`` without ``off_low..off_high``, both merged: the gaps between what is taken off, within each interval."""
    if not len(low) or not len(off_low):
        return low, high
    gap_low = np.append(np.iinfo(np.int64).min, off_high + 1)
    gap_high = np.append(off_low - 1, np.iinfo(np.int64).max)
    first, last = np.searchsorted(gap_high, low), np.searchsorted(gap_low, high, side="right")
    n = np.maximum(last - first, 0)
    own = np.repeat(np.arange(len(low)), n)
    gap = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    a, b = np.maximum(low[own], gap_low[gap]), np.minimum(high[own], gap_high[gap])
    return a[a <= b], b[a <= b]


def _schema(rows: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", low long, high long"


def intervals(rows: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """``keys, low, high``: the numbers in ``column`` of each key as intervals; nulls are none."""
    return joined(folded(rows, keys, column), keys)


def folded(rows: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """Intervals as far as each task sees them, without a shuffle; those of different tasks may meet or overlap."""
    schema, names = _schema(rows, keys), [*keys, "low", "high"]
    found = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("long").alias("low"))

    def fold(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        n = 0

        def flush():
            out = []
            for key, parts in held.items():
                values = np.unique(np.concatenate(parts))
                low, high = _merged(values, values)
                out += [(*key, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        kinds = None
        for batch in batches:
            kinds = [*list(batch.schema)[:-1], pa.field("low", pa.int64()), pa.field("high", pa.int64())]
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            values = batch.column(len(keys)).to_numpy()
            at: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*columns, strict=True)):
                at.setdefault(key, []).append(i)
            for key, places in at.items():
                held.setdefault(key, []).append(values[places])
            n += batch.num_rows
            if n > HELD:
                yield flush()
                held, n = {}, 0
        if held:
            yield flush()

    return found.mapInArrow(fold, schema)


def _cut(rows: DataFrame) -> DataFrame:
    """Intervals cut at multiples of ``WIDTH``, with their group's number."""
    part = F.explode(F.sequence(F.floor(F.col("low") / WIDTH), F.floor(F.col("high") / WIDTH)))
    rows = rows.withColumn("_part", part)
    return rows.withColumns({"low": F.greatest("low", F.col("_part") * WIDTH), "high": F.least("high", F.col("_part") * WIDTH + WIDTH - 1)})


def joined(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Intervals of each key as few, those that meet at a multiple of ``WIDTH`` made one."""
    schema = _schema(rows, keys)

    def merge(table: pa.Table) -> pa.Table:
        low, high = _merged(table.column("low").to_numpy(), table.column("high").to_numpy())
        one = table.slice(0, 1).select(list(keys)).take(pa.array(np.zeros(len(low), np.int64)))
        return one.append_column("low", pa.array(low)).append_column("high", pa.array(high))

    cut = _cut(rows).groupBy(*keys, "_part").applyInArrow(merge, schema)
    inner = (F.pmod("low", F.lit(WIDTH)) != 0) & (F.pmod(F.col("high") + 1, F.lit(WIDTH)) != 0)
    # Few intervals touch a multiple: one at each end of a group, which are folded by runs of neighbours.
    edges = cut.where(~inner)
    order = Window.partitionBy(*keys).orderBy("low")
    fresh = F.coalesce((F.col("low") > F.lag("high").over(order) + 1).cast("int"), F.lit(1))
    edges = edges.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    edges = edges.groupBy(*keys, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")
    return cut.where(inner).unionByName(edges)


def difference(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The intervals of ``left`` without those of ``right``."""
    schema = _schema(left, keys)

    def less(a: pa.Table, b: pa.Table) -> pa.Table:
        low, high = _less(*_merged(*(a.column(c).to_numpy() for c in ("low", "high"))), *_merged(*(b.column(c).to_numpy() for c in ("low", "high"))))
        one = a.slice(0, 1).select(list(keys)).take(pa.array(np.zeros(len(low), np.int64)))
        return one.append_column("low", pa.array(low)).append_column("high", pa.array(high))

    groups = [_cut(x).groupBy(*keys, "_part") for x in (left, right)]
    return groups[0].cogroup(groups[1]).applyInArrow(less, schema)


def intersection(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return difference(left, difference(left, right, keys), keys)


def spread(rows: DataFrame, column: str) -> DataFrame:
    """A row for each number."""
    keys = [c for c in rows.columns if c not in ("low", "high")]
    return rows.select(*keys, F.explode(F.sequence("low", "high")).alias(column))
