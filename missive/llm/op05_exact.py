"""Exact duplicates by progressive refinement.

1. Rows are grouped by the byte length of the normalised text; a length held once is done.
2. Of the others, groups by length and the hash of the first characters; a pair held once is done.
3. Only rows of surviving groups have their whole text hashed (SHA-256), and equal length and
   hash make a group of copies.

Stages 1 and 2 move a length, a hash and a count for each row, summed before the shuffle.  The
groups that survive them become a bitmap of fixed size that all executors get, so that the
last pass knows which texts to hash; no text is shuffled for it.  Texts are equal when identical after lower-casing A-Z.

Edge cases: null counts as empty, and empty texts are copies of each other; of copies the
largest id stays; of rows that repeat id and text, the one with the largest tag (given to each
row when it is read) stays; null ids lose against any other; an empty table gives an empty
result; other columns are ignored here and kept by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import ascii_lower, bitmap, discard, free_names, join_groups, materialize, with_marks

#: Characters of a text that stage 2 hashes.
PREFIX = 256
#: Tables of up to this many rows (40 bytes each) are sent to all executors.
SMALL = 200_000


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.sha2(ascii_lower(_text()).cast("binary"), 256)


def _length() -> Column:
    """The bytes of the normalised text: folding A-Z keeps their number."""
    return F.octet_length(_text())


def _head() -> Column:
    """A hash of the first characters of the normalised text."""
    return F.xxhash64(ascii_lower(F.substring(_text(), 1, PREFIX)))


def surviving(docs: DataFrame) -> DataFrame:
    """``_len, _head`` of the groups that hold several rows after stages 1 and 2."""
    keys = docs.select(_length().alias("_len"), _head().alias("_head")).groupBy("_len", "_head").agg(F.count("*").alias("n"))
    keys = materialize(keys, "keys")
    lengths = keys.groupBy("_len").agg(F.sum("n").alias("rows")).where("rows > 1").select("_len")
    return keys.where("n > 1").join(lengths, "_len", "left_semi").select("_len", "_head")


def survivors(docs: DataFrame) -> DataFrame:
    """The surviving groups as a bitmap."""
    return bitmap(surviving(docs), F.struct("_len", "_head"), "survivors")


def with_hit(docs: DataFrame, words: DataFrame, name: str = "_mx_hit") -> DataFrame:
    """``docs`` and the boolean ``name``: whether the row's group may have survived.  A row beside a group that
    did is hashed for nothing, and no row of one is missed."""
    return with_marks(docs, words, F.struct(_length().alias("_len"), _head().alias("_head")), name)


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest``: a row for each row of ``docs``.

    ``digest`` is the text's SHA-256 for the rows that stage 3 read, and for all rows if
    ``digest_all``; grouping uses the former alone."""
    return _groups(docs, survivors(docs), digest_all)


def _groups(docs: DataFrame, words: DataFrame, digest_all: bool = False) -> DataFrame:
    rows = with_hit(docs.select("doc_id", "text"), words).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("tag"),
        F.col("_mx_hit").alias("hit"),
        (_digest() if digest_all else F.when(F.col("_mx_hit"), _digest())).alias("digest"),
    )
    rows = materialize(rows, "digests")
    group = rows.where("hit").groupBy("digest").agg(F.max(F.struct("doc_id", "tag")).alias("stays"), F.count("*").alias("n"))
    group = materialize(group.where("n > 1").withColumn("group_size", F.col("n")), "groups")
    several = join_groups(rows.where("hit"), group, "digest")
    alone = F.col("stays").isNull()
    several = several.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("tag") == F.col("stays.tag"))).alias("kept"),
        "digest",
    )
    single = rows.where("not hit").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return several.unionByName(single)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies that ``exact_groups`` drops, with its columns as they were.  Texts
    of groups that did not survive are not hashed here either."""
    words = survivors(docs)
    groups = materialize(_groups(docs, words), "kept")
    columns = docs.columns
    doc, digest, hit = free_names(docs, "_mx_id", "_mx_digest", "_mx_hit")
    dropped = groups.where("not kept").select(F.col("doc_id").alias(doc), F.col("digest").alias(digest)).distinct()
    kept = groups.where("kept and group_size > 1").select(F.col("doc_id").alias(doc), F.col("digest").alias(digest))
    # A row that repeats id and text is dropped once and kept once.
    twice = materialize(dropped.join(kept, [doc, digest], "left_semi"), "twice")
    gone = materialize(dropped.join(twice, [doc, digest], "left_anti"), "gone")
    discard(groups)
    gone, twice = (F.broadcast(x) if x.count() <= SMALL else x for x in (gone, twice))
    rows = with_hit(docs, words, hit).withColumns({doc: F.col("doc_id").cast("long"), digest: F.when(F.col(hit), _digest())})
    match = rows[doc].eqNullSafe(gone[doc]) & (rows[digest] == gone[digest])
    rows = rows.join(gone, match, "left_anti")
    if not twice.isEmpty():
        here = rows[doc].eqNullSafe(twice[doc]) & (rows[digest] == twice[digest])
        again = rows.join(twice, here, "left_semi").dropDuplicates([doc, digest])
        rows = rows.join(twice, here, "left_anti").unionByName(again)
    return rows.select(*(f"`{c}`" for c in columns))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``exact_groups`` with every row's digest."""
    found = exact_groups(docs, digest_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY s) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY doc_id DESC) = 1 AS kept,
       sha256(s) AS text_sha256
FROM t
"""
