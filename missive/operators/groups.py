"""Joins of many rows with a row for each key, where one key may have a third of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.scratch import scratch_path

#: Rows of a table that is sent to all executors at most.
SMALL_GROUPS = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str = "n", how: str = "left") -> DataFrame:
    """``rows`` and the columns of ``groups``, which has one row for each ``key`` and in ``size`` (dropped) how
    many of ``rows`` have it.  ``groups`` is read twice, so it should be a written table.

    Up to ``SMALL_GROUPS`` groups are sent to all executors.  Of more, those are that hold more than
    one row in ``SMALL_GROUPS``, of which there are fewer than that; no key of the others is large.  A null is no key."""
    keys = [key] if isinstance(key, str) else list(key)
    total = groups.agg(F.count("*").alias("k"), F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()
    if total["k"] <= SMALL_GROUPS:
        return rows.join(F.broadcast(groups.drop(size)), keys, how)
    least = total["n"] // SMALL_GROUPS
    hot, rest = groups.where(F.col(size) > least).drop(size), groups.where(F.col(size) <= least).drop(size)
    many = rows.join(F.broadcast(hot), keys)
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    few = rows.where(whole).join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    out = many.unionByName(few)
    if how != "left":
        return out
    # A null equals no key, and rows that have one are not sent to one place to find that out.
    none = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns if c not in (*keys, size)]
    return out.unionByName(rows.where(~whole).select("*", *none))


def written(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` as a table of its own in the shared folder."""
    path = scratch_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
