"""Importance resampling of a corpus towards a target, over hashed runs of words.

A feature is a run of up to ``longest`` words; its bucket is the CRC of its bytes.  Each partition of
texts is read into a trie whose edges are words: a node is a feature, and holds its count and the
state of its CRC, which the nodes below carry on, so no feature is ever put together as a
string.  A full trie hands its counts to the partition's bucket totals and starts anew.  Spark
merges the totals of corpus and target, a row a bucket, and takes the gain of each bucket
from them.  Texts are then read again along tries whose nodes have their bucket's gain attached.
A document's weight is the floored mean of its gains, and noise from its id makes the draw
one without replacement, in proportion to the weights.

The draw needs no sort of all: counts by score (an integer in a range that gains and noise
bound, about 100,000 values at most) give the lowest score that is drawn, and only rows from
there on are sorted, by range partitions; a rank is a row's place in its partition after the rows of those before.

Edge cases: null texts count as empty and have no features; documents without features have weight 0; those with fewer
than ``least_words`` words are scored but never drawn; a null id is the text ``null`` in its noise and comes last among equal
scores; rows that repeat id and score have ranks of their own in any order; without documents the result is empty, and an empty
target leaves all its counts 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import bounded_batches, materialize, slices

BUCKETS = 10_000
#: Nodes that a trie holds before it starts anew.
NODES = 200_000
#: Every byte to itself: letters and digits stay, A-Z folded, and so do bytes of other characters; all else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PLACE_BITS = 33


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Trie:
    """Words as edges from node 0; a node's value is a count or a gain."""

    def __init__(self, longest: int, gains: list[int] | None = None):
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.below: list[dict[bytes, int]] = [{}]
        self.crc, self.value = [0], [0]

    def grow(self, node: int, word: bytes) -> int:
        crc = zlib.crc32(b" " + word if node else word, self.crc[node])
        at = self.below[node][word] = len(self.crc)
        self.below.append({})
        self.crc.append(crc)
        self.value.append(0 if self.gains is None else self.gains[crc % len(self.gains)])
        return at

    def walk(self, words: list[bytes]):
        """The node of each feature with how often it comes there."""
        if self.longest == 1:
            first = self.below[0]
            for word, times in Counter(words).items():
                at = first.get(word)
                yield (self.grow(0, word) if at is None else at), times
            return
        for start in range(len(words)):
            node = 0
            for word in words[start : start + self.longest]:
                at = self.below[node].get(word)
                node = self.grow(node, word) if at is None else at
                yield node, 1

    def count(self, words: list[bytes]) -> None:
        value = self.value
        for node, times in self.walk(words):
            value[node] += times

    def gain(self, words: list[bytes]) -> int:
        value = self.value
        return sum(value[node] * times for node, times in self.walk(words))

    def add_to(self, totals: np.ndarray) -> None:
        np.add.at(totals, np.array(self.crc[1:], np.int64) % len(totals), np.array(self.value[1:], np.int64))


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, n``: how many features of ``texts`` fall into each bucket; no row for none."""

    def run(batches):
        trie, totals = Trie(longest), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in batch.column(0):
                trie.count(words_of(text.as_py()))
                if len(trie.crc) > NODES:
                    trie.add_to(totals)
                    trie.clear()
        trie.add_to(totals)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: the floored thousandfold logarithm of its share in the target over its
    share in the corpus, both with one more feature in every bucket."""
    spark = docs.sparkSession
    found = materialize(bucket_totals(docs, longest, buckets).withColumn("of", F.lit("s")).unionByName(bucket_totals(target, longest, buckets).withColumn("of", F.lit("t"))), "buckets")
    side = [F.coalesce(F.sum(F.when(F.col("of") == k, F.col("n"))), F.lit(0)).cast("double") for k in "st"]
    total = found.agg(side[0].alias("s"), side[1].alias("t")).first()
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    each = every.join(found.groupBy("bucket").agg(side[0].alias("s"), side[1].alias("t")), "bucket", "left")
    s, t = F.coalesce("s", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    ratio = (t + 1) * F.lit(total["s"] + buckets) / ((s + 1) * F.lit(total["t"] + buckets))
    rows = each.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()  # a row a bucket
    return [g for _, g in sorted((r["bucket"], r["gain"]) for r in rows)]


def scored(docs: DataFrame, gain: list[int], longest: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``: a row for each row of ``docs``."""

    def run(batches):
        trie = Trie(longest, gain)
        for batch in slices(batches):
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                n = sum(max(0, len(words) - k) for k in range(longest))
                n_words.append(len(words))
                n_features.append(n)
                weight.append(trie.gain(words) // n if n else 0)
                if len(trie.crc) > NODES:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` and each row's place, from 1, in the whole order."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_mx_place", F.monotonically_increasing_id())
    rows = materialize(rows.select("*", F.shiftright("_mx_place", PLACE_BITS).alias("_mx_part")), "ordered")
    parts = rows.groupBy("_mx_part").agg(F.count("*").alias("_mx_n"))
    before = Window.orderBy("_mx_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("_mx_part", F.coalesce(F.sum("_mx_n").over(before), F.lit(0)).alias("_mx_before"))
    place = F.col("_mx_place").bitwiseAND((1 << PLACE_BITS) - 1) + F.col("_mx_before") + 1
    return rows.join(F.broadcast(parts), "_mx_part").withColumn(name, place).drop("_mx_part", "_mx_place", "_mx_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: a row for each row of ``docs``; ``rank`` is null for those not drawn."""
    bounded_batches(docs.sparkSession)
    found = scored(docs, gains(docs, target, longest, buckets), longest, seed)
    found = materialize(found.withColumn("tag", F.monotonically_increasing_id()), "scored")
    able = found.where(F.col("n_words") >= least_words)
    counts = sorted(((r["score"], r["count"]) for r in able.groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    lowest, reached = None, 0
    for score, n in counts:
        if reached >= draw:
            break
        lowest, reached = score, reached + n
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if lowest is None:
        return found.select(*columns, none)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= lowest)
    top = ranked(found.where(high), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tag")], "rank")
    top = top.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return top.unionByName(found.where(~high).select(*columns, none))


#: The CRC's table is made from its polynomial, and a word's CRC is folded over its bytes.
SQL = r"""
WITH RECURSIVE shifts AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM shifts WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM shifts WHERE k = 8),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
),
doc_counts AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM doc_words) GROUP BY r, w),
every AS (SELECT w FROM doc_counts UNION SELECT w FROM target_words),
bytes AS (
  SELECT w, list_transform(range(0, length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT) AS b FROM every
),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, crc_table
),
s AS (SELECT bucket, sum(n) AS n FROM doc_counts JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket,
         floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
           / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
),
weights AS (
  SELECT r, sum(n * gain)::BIGINT AS total FROM doc_counts JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r
),
scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features,
         CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM doc_words LEFT JOIN weights USING (r)
),
scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scores
),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         (10 * count(*) FILTER (n_features >= 20) OVER ()) // 100 AS draw
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draw THEN place END AS rank
FROM drawn
"""
