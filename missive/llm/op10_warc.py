"""WARC archives and their merged capture index.

Pages become WARC/1.0 records.  Of captures with equal payloads of at least ``least`` bytes the one
with the largest id holds the payload and the others are revisit records that name it; a
revisit's own headers tell the length and digest of the payload, so it can be read alone.

An archive is a file of gzip members, one for each record, so a record can be read from its place in
the file.  Records are compressed in tasks and written by Spark's text writer, so archives go to
any store that Spark writes; the writer's line separator is an empty gzip member.  A task begins a new
archive when the next record would take the last one over ``archive_bytes``.

Archives are read back a record at a time.  Each archive's captures, sorted by URL key and time, are
a run.  Runs are dealt out by ranges of (URL key, time, page); the task of a range merges its
share of all runs with a loser tree, so the partitions in order are the captures of the whole
collection in order, and those of a URL are its history.

Edge cases: a null page is an empty payload; a null URL has no target header and the empty
key; a null id sorts first and dates from the epoch, and equal payloads whose ids are all null are
responses; of rows that repeat the largest id of a payload one is the response and the others
revisit that id; line breaks in URLs are escaped; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.functions.display import utc_seconds
from missive.llm.common import bounded_batches, join_groups, materialize, scratch_path

LEAST = 1000
#: Bytes from which a new archive begins; a longer record is an archive alone.
ARCHIVE = 32 << 20
#: Fixed value: a gzip member without content.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
BREAK = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Seconds since 1970 at page 0: pages have no capture time, so one a second is assumed.
EPOCH = 1_704_067_200
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", re.S)

CAPTURE = (
    "page_id long, url_key string, stamp string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, archive string, place long"
)


def url_key(url: str | None) -> str:
    """Host names from the last to the first, then path and query."""
    found = _URL.match(url or "")
    if not found:
        return url or ""
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2] or "/")


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` as ``page_id, url, payload, digest, revisit, refers_to``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    digest = F.sha1(F.col("payload").cast("binary"))
    large = F.octet_length("payload") >= least
    # How often each id has a payload tells whether the largest is one row.
    ids = rows.where(large).groupBy(digest.alias("digest"), "page_id").agg(F.count("*").alias("times"))
    groups = ids.groupBy("digest").agg(F.max(F.struct("page_id", "times")).alias("top"), F.sum("times").alias("n"))
    groups = groups.where("n > 1 and top.page_id is not null").select("digest", F.col("top.page_id").alias("holder"), (F.col("top.times") > 1).alias("twins"), "n")
    groups = materialize(groups, "payload_groups")
    rows = join_groups(rows.withColumn("digest", digest), groups, "digest")
    held = F.col("page_id").eqNullSafe(F.col("holder"))
    rows = rows.withColumn("revisit", F.col("holder").isNotNull() & ~held)
    if not groups.where("twins").isEmpty():
        # Rows that repeat the id of a payload's holder: which is the response is decided on a written
        # table, where a row keeps its tag.
        twins = materialize(rows.where(held & F.col("twins")).withColumn("tag", F.monotonically_increasing_id()), "twins")
        first = twins.groupBy("digest").agg(F.min("tag").alias("first"), F.count("*").alias("n"))
        twins = join_groups(twins, materialize(first, "first_twins"), "digest").withColumn("revisit", F.col("tag") != F.col("first"))
        rows = rows.where(~(held & F.coalesce("twins", F.lit(False)))).unionByName(twins.drop("tag", "first"))
    return rows.select("page_id", "url", "payload", "digest", "revisit", F.when(F.col("revisit"), F.col("holder")).alias("refers_to"))


def _id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit(""))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _stamp(page: Column) -> Column:
    return utc_seconds(F.coalesce(page, F.lit(0)) + EPOCH)


def records(rows: DataFrame) -> DataFrame:
    """The text of each record."""
    revisit = F.col("revisit")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(BREAK * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))

    none = F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.0{BREAK}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", _stamp(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), none),
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: {PROFILE}{BREAK}"),
                line("WARC-Refers-To", _id(F.col("refers_to"))),
                line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            ),
        ).otherwise(none),
        F.lit(f"Content-Type: application/http; msgtype=response{BREAK}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
    )
    return rows.select(F.concat(head, block, F.lit(BREAK * 2)).cast("binary").alias("record"))


def packed(found: DataFrame, archive_bytes: int) -> DataFrame:
    """``archive`` (a task's, from 0) and ``value``, the gzip member of each record."""

    def run(batches):
        archive = size = 0
        for batch in batches:
            members, numbers = [], []
            for record in batch.column(0):
                coder = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = coder.compress(record.as_py()) + coder.flush()
                if size and size + len(member) > archive_bytes:
                    archive, size = archive + 1, 0
                size += len(member) + len(EMPTY)
                members.append(member)
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(members, pa.binary())], names=["archive", "value"])

    return found.mapInArrow(run, "archive int, value binary")


def write_archives(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE) -> None:
    """A record for each row of ``pages``, in archives of about ``archive_bytes``."""
    bounded_batches(pages.sparkSession, 200)
    found = packed(records(roles(pages, least)), archive_bytes)
    # The writer writes a string's bytes as they are, and those of the separator in this character set.
    text = found.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive")
    text.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def members(content: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member that has any, from ``at`` on."""
    view = memoryview(content)
    while at < len(view):
        coder, parts, start = zlib.decompressobj(31), [], at
        while not coder.eof:
            if at >= len(view):
                raise ValueError(f"a record at {start} is cut off")
            piece = view[at : at + (1 << 16)]
            parts.append(coder.decompress(piece))
            at += len(piece) - len(coder.unused_data)
        if whole := b"".join(parts):
            yield start, whole


def parse(content: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], int, str]]:
    """Place, header, and the payload's length and SHA-1 of each record of an archive."""
    for place, record in members(content, at):
        head, found, block = record.partition(b"\r\n\r\n")
        first, *rows = head.split(b"\r\n")
        if not found or not first.startswith(b"WARC/"):
            raise ValueError(f"no record at {place}: {first[:40]!r}")
        header = {}
        for row in rows:
            name, _, value = row.decode().partition(":")
            header[name.lower()] = value.strip()
        length = int(header["content-length"])
        if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise ValueError(f"the record at {place} has another length")
        http, _, payload = block[:length].partition(b"\r\n\r\n")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if header["warc-type"] == "revisit":
            size, digest = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1]), header["warc-payload-digest"].removeprefix("sha1:")
        elif header["warc-payload-digest"] != "sha1:" + digest:
            raise ValueError(f"the record at {place} has another digest")
        yield place, header, size, digest


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """``CAPTURE`` rows of all archives, each archive's sorted by URL key and time: the runs.

    Lengths and digests are of the payloads read; for revisits, which have none, those that their
    own headers tell."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                for at, head, size, digest in parse(content.as_buffer()):
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    out.append((page and int(page), url_key(head.get("warc-target-uri")), head["warc-date"], head["warc-type"], size, digest, to and int(to), name.as_py(), at))
                out.sort(key=lambda r: (r[1].encode(), r[2], -1 if r[0] is None else r[0]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [c.split()[0] for c in CAPTURE.split(", ")]
                columns = zip(*out, strict=True) if out else [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return materialize(files.select("path", "content").mapInArrow(run, CAPTURE), "captures")


class LoserTree:
    """The k-way merge of sorted runs: each inner node keeps the loser of its two sides, so
    the next item costs one comparison a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, at: int) -> int:
        if at >= self.k:
            return at - self.k
        a, b = self._build(2 * at), self._build(2 * at + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[at] = lose
        return win

    def __iter__(self) -> Iterator:
        while (out := self.heads[self.winner]) is not None:
            yield out
            now = self.winner
            self.heads[now] = next(self.runs[now], None)
            at = (now + self.k) // 2
            while at >= 1:
                if self._less(self.losers[at], now):
                    self.losers[at], now = now, self.losers[at]
                at //= 2
            self.winner = now


def merged(captures: DataFrame, task_rows: int = 100_000) -> DataFrame:
    """``captures`` (a written table) and ``history_rank``, each one's place in the order of all by URL
    key, time and page, from 0."""
    order = ["url_key", "stamp", "page_id"]
    tasks = max(1, -(-captures.count() // task_rows))
    dealt = captures.repartitionByRange(tasks, *order, "archive", "place").sortWithinPartitions("archive", *order, "place")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema) + ", part int, at long"
    names = captures.columns
    keys = [names.index(c) for c in ("url_key", "stamp", "page_id", "archive", "place")]

    def run(batches):
        rows = pa.Table.from_batches(list(batches))
        if not rows.num_rows:
            return
        columns = [rows.column(i).to_pylist() for i in keys]
        items = [(u.encode(), s, -1 if p is None else p, a, x, i) for i, (u, s, p, a, x) in enumerate(zip(*columns, strict=True))]
        starts = [i for i in range(len(items)) if not i or items[i][3] != items[i - 1][3]]
        runs = [iter(items[a:b]) for a, b in zip(starts, [*starts[1:], len(items)], strict=True)]
        rows = rows.take(pa.array([x[-1] for x in LoserTree(runs)], pa.int64()))
        part = TaskContext.get().partitionId()
        rows = rows.append_column("part", pa.array([part] * rows.num_rows, pa.int32()))
        yield from rows.append_column("at", pa.array(range(rows.num_rows), pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    out = materialize(dealt.mapInArrow(run, schema), "index")
    parts = out.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = out.join(F.broadcast(parts), "part")
    return out.select(*names, (F.col("before") + F.col("at")).alias("history_rank"))


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages``, read them back and merge the index."""
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    return merged(read_captures(spark, path))


SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), k AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS d,
         max(page_id) OVER (PARTITION BY html) AS holder,
         row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS nth,
         CASE WHEN url IS NULL THEN ''
              WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
                array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.')), ',') || ')' ||
                coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), ''), '/')
              ELSE url END AS url_key
  FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND nth > 1 AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND nth > 1 THEN holder END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS history_rank
FROM k
"""
