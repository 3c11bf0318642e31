"""A stored search table with an index of pieces, kept in segments.

A segment has the normalised contents of some messages, in blocks of neighbouring ids, and a posting table: for each
piece of one to three characters and each range of ids that a task packed, one row with the ids that hold it, as
differences from the range's first in a delta-coded Parquet list, and their number, smallest and largest.  Each file's rows are
sorted by piece, so a reader opens only the row groups of the pieces that a term has.

A term of up to three characters is a piece, so postings alone decide it.  A longer one has all its three-character pieces in
a message that holds it: lists are intersected range by range, only where all of the pieces occur, and the term is
looked for in the contents of what is left, whose blocks prune the scan while it is planned.

A change is a new segment with the changed contents and the ids that it takes out of older segments, in proportion to the
change.  Segments that are not over twice as large as what comes after them are merged into it, so there are as many as the
table's size has binary digits.  Segments become visible by commits (``sources.snapshots``): a search sees one state.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators.search import TEXT_COLUMNS, has_term, matches
from missive.plans.query import INDEXED, SearchPlan
from missive.sources.snapshots import Commit, Snapshots

#: Pieces that a long term is looked up by, pairs of piece and message that a task packs at once, and removed
#: ids (of 8 bytes) that are sent to all executors.
PIECES, PAIRS, SMALL = 6, 2_000_000, 2_000_000
CONTENT = "message_id long, " + ", ".join(f"{c} string" for c in TEXT_COLUMNS) + ", block int"
POSTING = "gram string, block int, base long, n int, low long, high long, ids array<int>"
WRITE = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(4 << 20),
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("base", "n", "low", "high", "ids.list.element")},
}
CHAR = 21
TABLE = "segments"


@dataclass
class Index:
    """The index at ``path`` as of a commit; ``segments`` are its ``{"v": version, "rows": …}``, oldest first."""

    spark: SparkSession
    path: str
    version: int
    segments: list[dict]

    def _table(self, name: str, segment: dict, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}/v={segment['v']}")

    def contents_of(self, segment: dict) -> DataFrame:
        """All rows of a segment, with ``block``."""
        return self._table("contents", segment, CONTENT)

    def postings_of(self, segment: dict) -> DataFrame:
        return self._table("postings", segment, POSTING)

    def gone_after(self, segment: dict) -> DataFrame | None:
        """``gone_id``: what later segments take out of one; None for nothing."""
        later = [s for s in self.segments[self.segments.index(segment) + 1 :] if s["gone"]]
        if not later:
            return None
        rows = reduce(DataFrame.union, (self._table("gone", s, "gone_id long") for s in later))
        return F.broadcast(rows) if sum(s["gone"] for s in later) <= SMALL else rows

    def live(self, segment: dict, rows: DataFrame) -> DataFrame:
        gone = self.gone_after(segment)
        return rows if gone is None else rows.join(gone, F.col("message_id") == F.col("gone_id"), "left_anti")

    def contents(self) -> DataFrame:
        """The contents of all messages."""
        parts = [self.live(s, self.contents_of(s)).select("message_id", *TEXT_COLUMNS) for s in self.segments]
        return reduce(DataFrame.union, parts)

    def pieces(self) -> DataFrame:
        """``gram, message_id`` of all messages."""
        return reduce(DataFrame.union, (self.live(s, spread(self.postings_of(s))).select("gram", "message_id") for s in self.segments))


def codes_of(text: str) -> list[np.ndarray]:
    """The pieces of a text as numbers: three characters of ``CHAR`` bits each, counted from 1, 0 for none."""
    a = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
    one = a << 2 * CHAR
    two = one[:-1] | a[1:] << CHAR
    return [one, two, two[:-1] | a[2:]]


def texts_of(codes: np.ndarray) -> list[str]:
    mask = (1 << CHAR) - 1
    chars = np.stack([codes >> 2 * CHAR, codes >> CHAR & mask, codes & mask], axis=1)
    whole = np.maximum(chars - 1, 0).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[3 * i : 3 * i + n] for i, n in enumerate((chars > 0).sum(axis=1).tolist())]


def _pack(batches):
    """Posting rows of contents that come by block and id."""
    names = [c.split()[0] for c in POSTING.split(", ")]
    codes: list[np.ndarray] = []
    ids: list[int] = []
    block, held = -1, 0

    def flush() -> pa.RecordBatch:
        code = np.concatenate(codes)
        place = np.repeat(np.array(ids) - ids[0], [len(c) for c in codes])
        order = np.argsort(code, kind="stable")
        code, place = code[order], place[order].astype(np.int32)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(code)).astype(np.int64) if len(code) else first
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(place))
        k = len(first)
        columns = [pa.array(texts_of(code[first]), pa.string()), pa.array([block] * k, pa.int32()), pa.array([ids[0]] * k, pa.int64()), pa.array(ends - first, pa.int32()),
                   pa.array(ids[0] + place[first].astype(np.int64)), pa.array(ids[0] + place[ends - 1].astype(np.int64)), lists]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for b, message, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (b != block or held > PAIRS or not ids[-1] <= message < ids[0] + (1 << 30)):
                yield flush()
                codes, ids, held = [], [], 0
            found = [c for t in texts if t for c in codes_of(t)]
            codes.append(np.unique(np.concatenate(found)) if found else np.empty(0, np.int64))
            ids.append(message)
            block, held = b, held + len(codes[-1])
    if ids:
        yield flush()


def spread(postings: DataFrame) -> DataFrame:
    """A row for each piece and message."""
    return postings.select("gram", "block", "base", F.explode("ids").alias("at")).select("gram", "block", (F.col("base") + F.col("at")).alias("message_id"))


def add_segment(commit: Commit, contents: DataFrame, gone: DataFrame | None = None) -> None:
    """Put a segment of ``contents(message_id, …)`` into a commit, which takes the ids ``gone(gone_id)`` out of older ones."""
    spark = commit.store.spark
    entry = commit.tables.get(TABLE) or {"kind": TABLE, "schema": "", "segments": []}
    rows = contents.select(F.col("message_id").cast("long").alias("message_id"), *(F.col(c).cast("string").alias(c) for c in TEXT_COLUMNS))
    # A task's range of ids is a block; adaptive execution says how many there are, by size.  Ranges are sampled, so
    # contents that are computed are written first.
    rows = commit.staged("index-contents", rows).repartitionByRange("message_id").sortWithinPartitions("message_id").withColumn("block", F.spark_partition_id())
    path = commit.folder("contents")
    rows.write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("block").parquet(path)
    filled = [n for n in commit.store._names(f"contents/v={commit.version}") if n.startswith("block=")]
    if not filled:  # a folder with a schema, to be read as empty
        rows.withColumn("block", F.lit(0)).write.mode("overwrite").parquet(path)
    written = spark.read.schema(CONTENT).parquet(path)
    found = written.select("block", "message_id", *TEXT_COLUMNS).mapInArrow(_pack, POSTING)
    # Each task sorts what it packed: a look-up opens a stretch of each file, and nothing is packed twice or shuffled, as
    # ranges of all postings would ask for, which are larger than the text.
    found.sortWithinPartitions("gram", "block", "base").write.mode("overwrite").options(**WRITE).parquet(commit.folder("postings"))
    removed = 0
    if gone is not None:
        gone.select(F.col("gone_id").cast("long").alias("gone_id")).write.mode("overwrite").parquet(commit.folder("gone"))
        removed = spark.read.schema("gone_id long").parquet(commit.folder("gone")).count()
    segment = {"v": commit.version, "rows": written.count(), "gone": removed}
    commit.tables[TABLE] = entry | {"segments": [*entry["segments"], segment]}


def opened(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The index at ``path`` as of a commit, the newest if none is named."""
    said = Snapshots(spark, path).manifest(version)
    return Index(spark, path, said["version"], said["tables"][TABLE]["segments"])


def build(contents: DataFrame, path: str) -> Index:
    """Write the index of ``contents(message_id, …)`` to ``path``, in place of any that is there."""
    store = Snapshots(contents.sparkSession, path)
    commit = store.begin()
    commit.tables.pop(TABLE, None)
    add_segment(commit, contents)
    commit.publish()
    return opened(contents.sparkSession, path)


def updated(index: Index, changes: DataFrame) -> Index:
    """The index after ``changes``: contents to insert or replace, and with ``removed`` those to delete.  Written is a segment of
    the changed messages, with those of the latest segments that are not over twice as large."""
    store = Snapshots(index.spark, index.path)
    commit = store.begin()
    index = opened(index.spark, index.path) if index.version != commit.version - 1 else index
    changes = commit.staged("index-changes", changes)
    gone = changes.select(F.col("message_id").alias("gone_id")).distinct()
    new = changes.where("NOT removed").select("message_id", *TEXT_COLUMNS)
    kept, total = list(index.segments), changes.count()
    taken: list[dict] = []
    while kept and kept[-1]["rows"] <= 2 * total:
        taken.insert(0, kept.pop())
        total += taken[0]["rows"]
    if taken:
        old = reduce(DataFrame.union, (index.live(s, index.contents_of(s)).select("message_id", *TEXT_COLUMNS) for s in taken))
        new = old.join(gone, F.col("message_id") == F.col("gone_id"), "left_anti").unionByName(new)
        earlier = [index._table("gone", s, "gone_id long") for s in taken if s["gone"]]
        gone = reduce(DataFrame.union, earlier, gone).distinct()
    commit.tables[TABLE] = commit.tables[TABLE] | {"segments": kept}
    add_segment(commit, new, gone if kept else None)
    commit.publish()
    return opened(index.spark, index.path)


def pieces(term: str) -> list[str]:
    """What a term is looked up by: itself, or its pieces of three characters."""
    return [term] if len(term) <= INDEXED else sorted({term[i : i + INDEXED] for i in range(len(term) - INDEXED + 1)})


def _rarest(index: Index, segment: dict, term: str) -> list[str]:
    """The pieces of a term that the fewest messages hold; any of them narrow the search rightly."""
    found = pieces(term)
    if len(found) <= PIECES:
        return found
    counts = index.postings_of(segment).where(F.col("gram").isin(found)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    known = {r["gram"]: r["n"] for r in counts}
    return sorted(found, key=lambda g: (known.get(g, 0), g))[:PIECES]


def holding(index: Index, segment: dict, grams: list[str]) -> DataFrame:
    """``message_id, block`` of a segment's messages that hold all of ``grams``.  Ranges of ids in which one of them does not
    occur are skipped before any list is looked at."""
    rows = index.postings_of(segment).where(F.col("gram").isin(grams))
    if len(grams) > 1:
        same = rows.groupBy("block", "base").agg(F.collect_list("ids").alias("lists"), F.max("low").alias("low"), F.min("high").alias("high"))
        same = same.where((F.size("lists") == len(grams)) & (F.col("low") <= F.col("high")))
        rest = F.slice("lists", F.lit(2), F.size("lists") - 1)
        rows = same.select("block", "base", F.aggregate(rest, F.col("lists")[0], F.array_intersect).alias("ids"))
    return rows.select("block", "base", F.explode("ids").alias("at")).select((F.col("base") + F.col("at")).alias("message_id"), "block")


def candidates(index: Index, segment: dict, plan: SearchPlan) -> tuple[DataFrame, bool]:
    """A segment's messages that may match, and whether they do match the included terms."""
    sure = all(len(t) <= INDEXED for t in plan.include)
    by = [_rarest(index, segment, t) for t in plan.include]
    if plan.mode == "and":
        return holding(index, segment, sorted({g for grams in by for g in grams})), sure
    return reduce(DataFrame.union, (holding(index, segment, grams) for grams in by)).distinct(), sure


def found(index: Index, plan: SearchPlan, compat: bool = False) -> DataFrame:
    """``found_id``: the messages that match."""
    parts = [index.live(s, _found(index, s, plan, compat)) for s in index.segments]
    return reduce(DataFrame.union, parts).select(F.col("message_id").alias("found_id"))


def _found(index: Index, segment: dict, plan: SearchPlan, compat: bool) -> DataFrame:
    if compat:
        return index.contents_of(segment).where(matches(plan, compat)).select("message_id")
    ids, sure = candidates(index, segment, plan)
    if not sure:
        return _read(index, segment, ids).where(matches(plan)).select("message_id")
    for term in plan.exclude:  # what is excluded is looked up in the same way
        bad = holding(index, segment, _rarest(index, segment, term))
        if len(term) > INDEXED:
            bad = _read(index, segment, bad).where(has_term(term))
        ids = ids.join(bad.select("message_id"), "message_id", "left_anti")
    return ids.select("message_id")


def _read(index: Index, segment: dict, ids: DataFrame) -> DataFrame:
    """The contents of some messages, of their blocks alone."""
    wanted = ids.select(F.col("message_id").alias("wanted_id"), F.col("block").alias("wanted_block"))
    same = (F.col("block") == F.col("wanted_block")) & (F.col("message_id") == F.col("wanted_id"))
    return index.contents_of(segment).join(wanted, same, "left_semi")
