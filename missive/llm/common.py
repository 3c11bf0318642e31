"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive import scratch
from missive.scratch import bounded_batches, shared_folder  # noqa: F401  for callers of this module

#: ``A-Z`` and their lower-case forms; only these are folded, whatever the locale.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Folders made here that may still be read, by session.
_MADE: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A folder of its own that ``clean_scratch`` deletes."""
    path = scratch.scratch_path(spark, tag)
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of the lineage
    that survives lost executors, and a result that is never computed twice."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._missive_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._missive_path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete all that the operators wrote to the shared folder in this session.  For the caller,
    when their results have been read: these are DataFrames over such tables."""
    for path in sorted(_MADE.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


#: Rows of a table that ``join_groups`` sends to all executors at most.
SMALL_GROUPS = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "n", how: str = "left") -> DataFrame:
    """``rows`` and the columns of ``groups``, which has one row for each ``key`` and in ``size`` (dropped) how
    many of ``rows`` have it.  ``groups`` is read twice, so it should be a written table.

    Up to ``SMALL_GROUPS`` groups are sent to all executors.  Of more, those are that hold more than
    one row in ``SMALL_GROUPS``, of which there are fewer than that; no key of the others is large."""
    total = groups.agg(F.count("*").alias("k"), F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()
    if total["k"] <= SMALL_GROUPS:
        return rows.join(F.broadcast(groups.drop(size)), key, how)
    least = total["n"] // SMALL_GROUPS
    hot, rest = groups.where(F.col(size) > least).drop(size), groups.where(F.col(size) <= least).drop(size)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return many.unionByName(few)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from the columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a bitmap, and of the place in a word.
MAP_BITS, WORD_BITS = 26, 6


def bitmap(keys: DataFrame, key: Column, tag: str) -> DataFrame:
    """A set of keys as ``word, bits``: bit ``b`` of word ``w`` is on if some key's hash is ``64 w + b``.  However
    many keys there are, it has a million rows at most, so it can be sent to all executors."""
    at = keys.select(F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS)).alias("at"))
    bit = F.expr(f"shiftleft(1L, cast(at % {1 << WORD_BITS} as int))")
    return materialize(at.groupBy(F.shiftright("at", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits")), tag)


def with_marks(rows: DataFrame, words: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` and the boolean ``name``: false where the key is not in the set that ``bitmap`` took; true
    where it is, and for a share of the others that grows with the set."""
    word, bits, at = free_names(rows, "_mx_word", "_mx_bits", "_mx_at")
    w = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    rows = rows.withColumn(at, F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS)))
    rows = rows.join(F.broadcast(w), F.shiftright(at, WORD_BITS) == F.col(word), "left")
    on = F.getbit(bits, F.pmod(at, F.lit(1 << WORD_BITS)).cast("int")) == 1
    return rows.withColumn(name, F.coalesce(on, F.lit(False))).drop(at, word, bits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that work arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
