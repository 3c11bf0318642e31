"""Best-fit packing of token sequences with a bounded number of open bins.

A document's ids with the end id are one piece, or, if longer than a sequence, full pieces
after a first one that may be shorter.  Pieces are dealt at random into tasks of a set size;
a task takes them as they come (with a ``window`` over 1, the longest of so many first, which is
no longer online), and puts a piece into the open bin with the least room that holds it.  Open bins are kept in a bitset over free room (a bit is on
if some bin has exactly that room), so the best fit is the lowest bit at or above the length.
When the set number of bins is open and another is needed, the fullest closes.

Only ids, lengths and checksums of pieces are shuffled, not tokens.  ``sequences`` joins the
token ids back for the real output.

Edge cases: null and empty texts are a piece of the end id alone; rows that repeat an id are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded_batches, materialize, slices
from missive.llm.op03_tokens import list_of_ids
from missive.llm.tokens import encoder

CAPACITY = 2048


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all full but the first."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((at, capacity) for at in range(first, n, capacity))]


def pieces(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY, ids: bool = False, folder: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and ``ids`` if asked for."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        enc, end = encoder(vocabulary, folder), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            rows, packed = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = enc.encode(text.as_py()) + end
                for k, (start, length) in enumerate(cuts(len(whole) // 4, capacity)):
                    part = whole[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part)))
                    packed.append(part)
            out = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(out + [list_of_ids(packed)] * ids, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


class OpenBins:
    """At most ``most`` open bins of ``capacity``; a bin is its number and its free room."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.made, self.bits = capacity, most, 0, 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        bins = self.by_room[room]
        out = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the piece's offset in it."""
        fitting = self.bits >> length
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + length
            at = self._take(room)
        else:
            room, at = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_room[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - room


def pack(
    found: DataFrame, capacity: int = CAPACITY, open_bins: int = 4096, window: int = 1, task_pieces: int = 250_000
) -> DataFrame:
    """``found`` (with ``doc_id, piece, length``) and each piece's ``sequence_id`` and ``offset``.

    ``found`` is read twice, so it should be a written table."""
    tasks = max(1, -(-found.count() // task_pieces))
    names = found.columns
    # Rows may be equal in all columns, so they are dealt by their place in the table too.  Sorted, so
    # that a task that runs again packs the same way.
    mix = F.xxhash64("doc_id", "piece", "ids_crc32", "_mx_tag")
    dealt = found.withColumn("_mx_tag", F.monotonically_increasing_id())
    dealt = dealt.repartition(tasks, mix).sortWithinPartitions(mix, "doc_id", "piece", "start").select(*names)

    def run(batches):
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            if window > 1:
                rows = rows.take(pa.array(np.argsort(-rows.column("length").to_numpy(), kind="stable")))
            got = [bins.place(n) for n in rows.column("length").to_pylist()]
            rows = rows.append_column("sequence_id", pa.array([base + b for b, _ in got], pa.int64()))
            return rows.append_column("offset", pa.array([o for _, o in got], pa.int64())).to_batches()

        at_once = window if window > 1 else 10_000
        for batch in slices(batches, at_once):
            if held and sum(b.num_rows for b in held) + batch.num_rows > at_once:
                yield from flush()
                held = []
            held.append(batch)
        if held:
            yield from flush()

    schema = found.select(*names).schema.simpleString()[7:-1].replace(":", " ")
    return dealt.mapInArrow(run, schema.replace(",", ", ") + ", sequence_id long, offset long")


def packed(docs: DataFrame, **more) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(materialize(pieces(docs), "pieces"), **more)


def sequences(docs: DataFrame, capacity: int = CAPACITY, **more) -> DataFrame:
    """The real output: ``sequence_id, ids, doc_ids``, a row of at most ``capacity`` ids each."""
    found = materialize(pieces(docs, capacity=capacity, ids=True), "pieces")
    placed = pack(found.drop("ids"), capacity, **more)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Rows that repeat an id and text have pieces with equal ids: any of them fills the place.
    one = found.dropDuplicates(keys).select(*(F.col(k).alias(f"o_{k}") for k in keys), "ids")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys))
    placed = placed.join(one, same).select("sequence_id", F.struct("offset", "ids", "doc_id").alias("item"))
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return whole.select("sequence_id", F.flatten("items.ids").alias("ids"), F.col("items.doc_id").alias("doc_ids"))
