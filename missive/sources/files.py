"""Message files: read, verified, stored once by content, and listed like a mailbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.mail import message_lines
from missive.operators.groups import join_groups, written

#: Messages that are fetched together.
CHUNK = 500


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, size_bytes`` of all message files below ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content", F.col("length").alias("size_bytes"))


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """Sizes and times alone: without its content column the reader opens no file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), "modificationTime")


def relative_to(path: Column, root: str) -> Column:
    """A file's path below ``root``, whatever form of it the reader gives: schemes and doubled slashes aside."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "/+", "/")
    base = F.concat(F.regexp_replace(plain(F.lit(root)), "/$", ""), F.lit("/"))
    return F.when(F.startswith(plain(path), base), F.substr(plain(path), F.length(base) + 1))


def confined(relative_path: Column) -> Column:
    """Whether a path stays below the root that it is joined to."""
    return F.coalesce(~relative_path.rlike(r"(^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|^$|\x00)"), F.lit(False))


def verified(files: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """``wanted(relative_path, file_hash)`` with content and ``state``: ok, missing, mismatch, or outside
    for a path that leaves ``root``.  ``files`` are those below it."""
    named = files.select(relative_to(F.col("path"), root).alias("below"), "content")
    inside = confined(F.col("relative_path"))
    rows = wanted.join(named, F.when(inside, F.regexp_replace("relative_path", "/+", "/")) == F.col("below"), "left")
    ok = F.sha2("content", 256) == F.lower("file_hash")
    state = F.when(~inside, "outside").when(F.col("content").isNull(), "missing").when(ok, "ok").otherwise("mismatch")
    return rows.select("relative_path", "file_hash", F.when(state == "ok", F.col("content")).alias("content"), state.alias("state"))


def reusable(files: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """``relative_path, file_hash, size_bytes`` of those of ``wanted(relative_path, file_hash)`` whose file is there already and has
    that content, so that it need not be fetched; a hash that is none, or a path that leaves ``root``, reuses nothing."""
    asked = wanted.where(F.col("file_hash").rlike("^[0-9a-fA-F]{64}$"))
    rows = verified(files, asked, root).where("state = 'ok'")
    return rows.select("relative_path", F.lower("file_hash").alias("file_hash"), F.length("content").cast("long").alias("size_bytes"))


def stored_once(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming(account_id, sha256, …)`` with ``deduplicated``: whether the account has that content
    already, in the store or earlier (by ``seq``) in the batch."""
    keys = ["account_id", "sha256"]
    known = stored.select("account_id", F.col("file_hash").alias("sha256"), F.lit(True).alias("known")).distinct()
    first = incoming.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    # A content that a third of all messages share is one row of the groups, which many rows then look up.
    rows = join_groups(incoming, written(first.join(known, keys, "left"), "contents"), keys)
    again = F.coalesce("known", F.lit(False)) | (F.col("seq") > F.col("first_seq"))
    return rows.withColumn("deduplicated", again).drop("known", "first_seq")


def mailbox(spark: SparkSession, root: str, low: int = 1, high: int | None = None, content: bool = True) -> DataFrame:
    """``raw_name, uid, size_bytes`` of the files ``<folder>/<uid>.eml`` below ``root`` with uids from ``low`` to ``high``, and
    their ``content`` if asked for.

    Spark lists the files; uids are columns of their paths, so a range opens no file outside it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    uid = F.try_to_number(F.regexp_extract(F.element_at(parts, -1), r"^(\d{1,18})\.eml$", 1), F.lit("9" * 18)).cast("long")
    rows = files.withColumn("uid", uid).where(F.col("uid") >= low)
    if high is not None:
        rows = rows.where(F.col("uid") <= high)
    folder = F.url_decode(F.replace(F.element_at(parts, -2), F.lit("+"), F.lit("%2B")))
    return rows.select(folder.alias("raw_name"), "uid", F.col("length").alias("size_bytes"), *(["content"] if content else []))


def headers(messages: DataFrame) -> DataFrame:
    """``raw_name, uid, size_bytes, message_id, head``: messages without their bodies."""
    text = F.decode("content", "ISO-8859-1")
    end = F.regexp_instr(text, F.lit(r"\r?\n\r?\n"))
    head = F.when(end > 0, F.substr(text, F.lit(1), end - 1)).otherwise(text)
    mid = F.regexp_extract(head, r"(?im)^message-id:\s*(\S+)", 1)
    return messages.select("raw_name", "uid", "size_bytes", F.nullif(mid, F.lit("")).alias("message_id"), F.encode(head, "ISO-8859-1").alias("head"))


def in_chunks(uids: DataFrame, size: int = CHUNK) -> DataFrame:
    """``raw_name, chunk, uids``: each folder's uids, newest first, in the groups in which they are fetched.

    Groups are ranges of uids that begin at multiples of ``size``, so no folder is sorted in one place."""
    chunk = F.floor(F.col("uid") / size)
    return uids.groupBy("raw_name", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("uid"), asc=False).alias("uids"))


def listed(lines: DataFrame) -> DataFrame:
    """``uid, size_bytes, modseq, internal_date, flags, message_id`` from ``lines(line)`` of a server's responses."""
    return lines.select(message_lines("line").alias("m")).select("m.*").where("uid IS NOT NULL")
