"""Mail ingest as a stream of message files.

The stream carries paths and sizes alone; new files arrive in micro-batches of at most ``BATCH``, which are cut into
commits of at most ``COMMIT_BYTES``.  A commit is one of the commit log (``sources.snapshots``): the contents that the account does
not have yet, their hashes, the event log and the message rows become visible together, with the epoch and part that they are
of, so one that runs again after a crash adds nothing and readers never see half of one.  Files over the size limit are
never opened.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.display import attachment_names, message_path, utc_text
from missive.functions.mail import parsed
from missive.functions.normalise import normalised
from missive.operators.store import latest
from missive.sources import log
from missive.sources.files import stored_once
from missive.sources.snapshots import Snapshots

#: Messages in a batch, bytes of a commit, and the size from which only a message's place is kept.
BATCH, COMMIT_BYTES, MOST_BYTES = 100, 50 << 20, 50 << 20
FILES = "path string, modificationTime timestamp, length long, content binary"


def outcomes(files: DataFrame, account_id: str, now: datetime, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each file ``…/<folder>/<uid>.eml``: keys, parsed fields, outcome and contents.

    A message with a defect keeps its headers and has no contents, as has an oversize one."""
    parts = F.split("path", "/")
    rows = files.select(
        "path", F.lit(account_id).alias("account_id"), F.element_at(parts, -2).alias("folder_raw_name"),
        F.regexp_extract(F.element_at(parts, -1), r"^(\d+)\.eml$", 1).cast("long").alias("uid"), F.col("length").alias("size_bytes"),
        utc_text(F.col("modificationTime")).alias("internal_date"), (F.col("length") > most_bytes).alias("oversize"), "content",
        F.sha2("content", 256).alias("file_hash"),
    )
    rows = rows.withColumn("m", parsed(F.when(~F.col("oversize"), F.col("content")), F.col("internal_date"), now))
    outcome = F.when(F.col("oversize"), "oversize").when(F.col("m.parse_error").isNotNull(), "parse").otherwise("stored")
    good = outcome == "stored"
    return rows.select(
        "path", "account_id", "folder_raw_name", "uid", "size_bytes", "internal_date", "file_hash", "content", outcome.alias("outcome"),
        message_path(F.col("account_id"), F.col("internal_date"), F.col("file_hash")).alias("relative_path"),
        *(F.col(f"m.{c}").alias(c) for c in ("subject", "sender", "recipient", "date_sent", "message_id", "thread_key", "content_key", "has_attachment")),
        F.when(good, normalised(F.col("m.subject"))).alias("subject_norm"), F.when(good, normalised(F.col("m.sender"))).alias("sender_norm"),
        F.when(good, normalised(F.col("m.body_text"))).alias("body_text"), F.when(good, normalised(attachment_names(F.col("m.attachments")))).alias("attachment_names"),
    )


def commits(sizes: list[tuple[str, int]], most: int = COMMIT_BYTES) -> list[list[str]]:
    """Paths in the order given, cut before the one that would take a commit over ``most`` bytes."""
    out, held = [], 0
    for path, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


#: Buckets of the message table, and the uids of a folder that share one.
BUCKETS, TOGETHER = 64, 1000
KEY = ("account_id", "folder_raw_name", "uid")


def known_contents(store: Snapshots, hashes: list[str]) -> DataFrame:
    """``account_id, file_hash`` of those of ``hashes`` that are stored.  The runs' Bloom filters and ranges say which parts
    of them are read, and there are few runs however many commits there were."""
    if "hashes" not in store.manifest()["tables"]:
        return store.spark.createDataFrame([], "account_id string, file_hash string")
    return store.read("hashes").where(F.col("file_hash").isin(hashes))


def write_batch(out: str, account_id: str, now: datetime, most_bytes: int = MOST_BYTES, commit_bytes: int = COMMIT_BYTES) -> Callable[[DataFrame, int], None]:
    stamp = now.strftime("%Y-%m-%dT%H:%M:%SZ")

    def commit(store: Snapshots, files: DataFrame, epoch: int, part: int) -> None:
        now_at = store.begin()
        files = now_at.staged("files", files.withColumn("sha256", F.sha2("content", 256)))
        hashes = [r[0] for r in files.where("content IS NOT NULL").select("sha256").distinct().collect()]  # at most BATCH
        hashed = files.select("path", "length", "sha256", "content", F.lit(account_id).alias("account_id"), F.col("path").alias("seq"))
        whole = stored_once(hashed.where("content IS NOT NULL"), known_contents(store, hashes))
        rows = outcomes(files, account_id, now, most_bytes)
        at = {"epoch": F.lit(epoch), "part": F.lit(part)}
        fresh = whole.where("NOT deduplicated").select("account_id", F.col("sha256").alias("file_hash"), "content")
        now_at.append("store", fresh.withColumns(at))
        now_at.add_run("hashes", fresh.select("account_id", "file_hash"), "file_hash")
        small = F.col("outcome") != "oversize"
        again = whole.select(F.col("path").alias("again_path"), "deduplicated")
        events = rows.join(again, F.col("path") == F.col("again_path"), "left").select(
            "account_id", F.when(small, "fetch").otherwise("fetch_skipped").alias("event"), "folder_raw_name", "uid", F.when(small, F.col("file_hash")).alias("file_hash"),
            F.when(small, F.col("relative_path")).alias("relative_path"), "size_bytes", F.when(~small, "oversize").alias("reason"), "deduplicated", F.lit(stamp).alias("timestamp"),
        )
        now_at.append("log", events.select(log.line({c: F.col(c) for c in events.columns}).alias("value")), "text")
        table = rows.drop("content", "path").withColumns(at)
        if "messages" in now_at.tables:
            now_at.merge("messages", table.withColumn("seq", F.lit(0)), KEY)
        else:
            now_at.create("messages", latest(table.withColumn("seq", F.lit(0)), KEY).drop("seq").select(*table.columns), ("account_id", "folder_raw_name", f"uid div {TOGETHER}"), BUCKETS)
        now_at.note("ingested", [epoch, part])
        now_at.publish()

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        listed = sorted((r["path"], r["length"], r["modificationTime"]) for r in batch.select("path", "length", "modificationTime").collect())  # at most BATCH
        store = Snapshots(spark, out)
        done = store.manifest()["notes"].get("ingested", [-1, -1])
        for part, paths in enumerate(commits([(p, n if n <= most_bytes else 0) for p, n, _ in listed], commit_bytes)):
            if [epoch, part] <= done:  # a batch that runs again after a stop is cut in the same way
                continue
            mine = [x for x in listed if x[0] in set(paths)]
            files = spark.createDataFrame([(p, t, n, None) for p, n, t in mine if n > most_bytes], FILES)
            if small := [p for p, n, _ in mine if n <= most_bytes]:
                files = files.unionByName(spark.read.format("binaryFile").load(small).select("path", "modificationTime", "length", "content"))
            commit(store, files, epoch, part)

    return run


def ingest(spark: SparkSession, source: str, out: str, account_id: str, now: datetime, batch: int = BATCH, **limits: int):
    """Start a query that takes in all files below ``source`` that it has not seen."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True)
    stream = files.option("maxFilesPerTrigger", batch).load(source).select("path", "modificationTime", "length")
    write = stream.writeStream.foreachBatch(write_batch(out, account_id, now, **limits)).option("checkpointLocation", f"{out}/checkpoint")
    return write.trigger(availableNow=True).start()


def messages(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The stored messages, a row for each folder and uid, as of the newest commit or another."""
    return Snapshots(spark, out).read("messages", version)


def events(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The events of all commits up to one."""
    return log.read_committed(Snapshots(spark, out).read("log", version))
