"""Token ids as Parquet list columns.

Documents are range-partitioned by id, encoded and written in ascending order, so part files
follow each other.  In a file, ``ids`` is dictionary encoded (a vocabulary fits a dictionary
page, which packs an id into as many bits as it needs) and the number columns are delta
encoded; row groups and pages have set sizes, and the writer leaves page indexes.  Reading
metadata alone touches no token page, and a range of ids reads the pages that hold it.

A part file's rows carry their start within the part; the starts in the whole corpus are those
plus the token totals of the parts before, of which there is one number a part.

Edge cases: a null text is empty and has the end id alone; rows that repeat an id stand next
to each other, ordered by their text's hash; null ids come first; an empty table writes no
rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.common import bounded_batches, scratch_path, slices
from missive.llm.tokens import encoder

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
WRITE = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(4 << 20),
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "part_start", "n_tokens")},
}


def list_of_ids(packed: list[bytes]) -> pa.Array:
    """Arrow lists of ints over the packed ids, without a Python number for each."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    values = np.frombuffer(b"".join(packed), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """The rows of ``SCHEMA`` in the order of ``docs`` within each partition."""

    def run(batches):
        enc, part, at = encoder(vocabulary, folder), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches):
            packed = [enc.encode(x.as_py()) + end for x in batch.column(1)]
            n = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            out = [batch.column(0), pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n), list_of_ids(packed)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    return docs.mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    row_group_bytes: int = 64 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 1000,
    folder: str | None = None,
) -> None:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "tag"]  # the tag parts rows that repeat id and text
    rows = rows.withColumn("tag", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tag")
    sizes = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows}
    encode(rows, vocabulary, end_id, folder).write.options(**WRITE, **{k: str(v) for k, v in sizes.items()}).parquet(path)


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tokens: bool = True
) -> DataFrame:
    """``doc_id, start, n_tokens`` and, if asked for, ``ids`` of the documents in a range of ids."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = stored
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    rows = rows.join(F.broadcast(parts), "part")
    out = rows.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")
    return out if tokens else out.drop("ids")


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` returns; counts are taken
    from the ids."""

    def run(batches):
        for batch in slices(batches):
            ids = batch.column(2)
            flat = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(), dtype="<i4")).cast("B")
            ends = np.cumsum([0, *ids.value_lengths().to_pylist()]) * 4
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            out = [batch.column(0), batch.column(1), pa.array(np.diff(ends) // 4, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write, read back and digest."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return digests(read_tokens(spark, path))
