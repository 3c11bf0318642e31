"""K-d tree sharding: shards of near equal bytes, cut along document metadata.

A group of equal texts is one point, as heavy as all its documents; it lies where the metadata of
its smallest id are and goes to one shard.  Only a group that outweighs a shard, of which there are
fewer than shards, is cut: its documents are points of their own, in the same place.  Coordinates are
metadata, scaled to 24 bits (numbers between their extremes, text by hash, null as 0).  A node
that stands for ``k`` shards is split along its widest coordinate at the weighted quantile
``(k // 2) / k`` of the bytes, until every leaf is one shard.  Ties are ordered by the hash of the
text, and in a group that is cut by that of the row, so that a hot source can be cut anywhere.

The quantiles are found without sorting: all nodes of a level at once sum their bytes in 4,096
buckets of the key, the bucket that holds the quantile is divided again, and so on until it
is light enough, holds one row, or the key's 60 bits are used.  Only summed buckets are
shuffled, and a row for each node reaches the driver.  No row moves to be placed: a level is an
expression.  Slots are numbered in groups of bounded size, each shifted by the rows before it.

Edge cases: a null text has no bytes and weighs 16; an empty table gives an empty result;
repeated rows and ids are rows of their own, with slots of their own; more shards than rows
leave shards empty; other columns are ignored unless named in ``dims``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from missive.llm.common import discard, join_groups, materialize

COORD_BITS, TIE_BITS, STEP = 24, 36, 12
TOP = (1 << COORD_BITS) - 1
#: Beyond any key.
END = 1 << (COORD_BITS + TIE_BITS + 1)


@dataclass
class Level:
    """The boxes of one depth of the tree, from the first shard to the last.

    ``shards``: how many each stands for; ``dims`` and ``cuts``: keys of the dimension from the
    cut on go right; ``kids``: the place of the left kid in the next level.  A box of one shard
    has no cut and one kid, itself."""

    shards: list[int]
    dims: list[int]
    cuts: list[int]

    @property
    def kids(self) -> list[int]:
        sizes = [1 + (n > 1) for n in self.shards]
        return [sum(sizes[:i]) for i in range(len(sizes))]


def metadata(docs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """``doc_id, size, text_crc32, grp`` (equal for equal texts), ``row`` and a raw coordinate ``r<i>`` for each of ``dims``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    raw = []
    for i, d in enumerate(dims):
        if d == "size":
            value = F.log2(size.cast("double"))
        elif isinstance(kinds[d], T.NumericType):
            value = F.col(d).cast("double")
        else:
            value = F.when(F.col(d).isNotNull(), F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(1 << COORD_BITS))).cast("double")
        raw.append(value.alias(f"r{i}"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
        *raw,
    )
    return materialize(rows, "metadata")


def points(rows: DataFrame, shards: int, dims: int) -> DataFrame:
    """``size`` (the weight), ``tie``, ``c<i>``, and either ``grp, n`` of a group with its number of rows, or ``row`` of
    a row whose group outweighs a shard; ``grp`` is null for these."""
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("k"), "row", *(f"r{i}" for i in range(dims)))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(place).alias("at"))
    groups = materialize(groups.select("grp", "size", "n", *(F.col(f"at.r{i}").alias(f"r{i}") for i in range(dims))), "groups")
    ends = groups.agg(F.sum("size").alias("w"), *(f(f"r{i}").alias(f"{k}{i}") for i in range(dims) for k, f in (("a", F.min), ("b", F.max)))).first()
    scaled = []
    for i in range(dims):
        low, high = ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0
        unit = (F.col(f"r{i}") - F.lit(low)) / F.lit(high - low or 1.0) * TOP
        scaled.append(F.coalesce(F.nanvl(unit, F.lit(0.0)), F.lit(0.0)).cast("long").alias(f"c{i}"))
    half = TIE_BITS // 2
    tie = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << half))
    whole = F.shiftleft(tie("grp"), half)
    heavy = F.col("size") * shards > F.lit(ends["w"] or 0)
    light = groups.where(~heavy).select("size", whole.bitwiseOR(tie("grp", F.lit(1))).alias("tie"), *scaled, "grp", "n", F.lit(None).cast("long").alias("row"))
    cut = groups.where(heavy).select("grp", whole.alias("whole"), *scaled)  # fewer than shards
    single = rows.select("grp", "size", "doc_id", "row").join(F.broadcast(cut), "grp")
    single = single.select(
        "size", F.col("whole").bitwiseOR(tie("doc_id", "row")).alias("tie"), *(f"c{i}" for i in range(dims)),
        F.lit(None).cast("binary").alias("grp"), F.lit(1).cast("long").alias("n"), "row",
    )
    return light.unionByName(single)


def _of(values: list[int]) -> Column:
    """A row's entry of a list with an entry for each box."""
    return F.array(*(F.lit(v).cast("long") for v in values))[F.col("node").cast("int")]


def _key(level: Level, dims: int) -> Column:
    coords = F.array(*(F.col(f"c{i}") for i in range(dims)))
    return F.shiftleft(coords[_of(level.dims).cast("int")], TIE_BITS).bitwiseOR(F.col("tie"))


def below(rows: DataFrame, level: Level, dims: int) -> DataFrame:
    """``rows`` with ``node`` moved from the boxes of ``level`` to their kids."""
    right = (_key(level, dims) >= _of(level.cuts)).cast("long")
    return rows.withColumn("node", _of(level.kids) + right)


def _quantiles(rows: DataFrame, level: Level, weights: list[int], dims: int, tolerance: float) -> None:
    """Set the level's cuts."""
    boxes = range(len(level.shards))
    target = [weights[i] * (level.shards[i] // 2) / level.shards[i] for i in boxes]
    before, prefix = [0] * len(target), [0] * len(target)
    todo = [i for i in boxes if level.shards[i] > 1 and weights[i]]
    shift = COORD_BITS + TIE_BITS
    keyed = rows.select("node", "size", _key(level, dims).alias("key"))
    while todo and shift:
        shift -= STEP
        inside = F.shiftright("key", shift + STEP) == _of(prefix)
        part = keyed.where(_of([int(i in todo) for i in boxes]) == 1).where(inside)
        sums = part.groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bucket"))  # at most 4,096 rows a box
        sums = sums.withColumn("upto", upto + _of(before))
        goal = F.array(*(F.lit(float(t)) for t in target))[F.col("node").cast("int")]
        hits = sums.where((F.col("upto") >= goal) & (F.col("upto") - F.col("w") < goal)).collect()
        todo = []
        for r in hits:
            i = r["node"]
            low, high, t = r["upto"] - r["w"], r["upto"], target[i]
            level.cuts[i] = (r["bucket"] + (high - t < t - low)) << shift
            if r["n"] > 1 and min(t - low, high - t) > tolerance * weights[i] / level.shards[i]:
                before[i], prefix[i] = low, r["bucket"]
                todo.append(i)


def placed(rows: DataFrame, shards: int, dims: int, tolerance: float = 0.0005) -> DataFrame:
    """``rows`` with ``node``, their shard.  The boxes of each level are written with the rows'
    metadata, so that no plan holds more than one level.

    ``tolerance``: bytes by which a cut may miss, as a share of a shard's."""
    rows = materialize(rows.withColumn("node", F.lit(0).cast("long")), "points")
    now = [shards]
    while max(now) > 1:
        width = [(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"x{i}") for i in range(dims)]
        found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *width).collect()}
        widest = [max(range(dims), key=lambda i, r=found.get(n): r[f"x{i}"]) if n in found else 0 for n in range(len(now))]
        level = Level(now, widest, [END] * len(now))
        _quantiles(rows, level, [found[n]["w"] if n in found else 0 for n in range(len(now))], dims, tolerance)
        now = [k for n in now for k in ((n // 2, n - n // 2) if n > 1 else (n,))]
        before, rows = rows, materialize(below(rows, level, dims), "boxes")
        discard(before)
    return rows


def shard(
    docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "size"), slot_rows: int = 2000, tolerance: float = 0.0005
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: a row for each row of ``docs``."""
    rows = metadata(docs, dims)
    found = placed(points(rows, shards, len(dims)), shards, len(dims), tolerance)
    found = materialize(found.select("grp", "row", "n", F.col("node").cast("int").alias("shard")), "placed")
    names = ["doc_id", "size", "text_crc32", "row", "shard"]
    whole = materialize(found.where("grp IS NOT NULL").select("grp", "n", "shard"), "whole")
    single = found.where("grp IS NULL").select("row", F.col("shard").alias("own"))
    # A row's shard is its group's, or, where the group was cut, its own.
    rows = join_groups(rows, whole, "grp")
    several = rows.where("shard IS NULL").drop("shard").join(single, "row").withColumnRenamed("own", "shard")
    rows = materialize(rows.where("shard IS NOT NULL").select(*names).unionByName(several.select(*names)), "sharded")
    groups = max(1, -(-rows.count() // (shards * slot_rows)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    rows = rows.withColumn("at", inside).join(counts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
