"""The event log: a JSON object and its checksum on each line, a file a month and account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.display import utc_text, zoned

#: The events, and what two of them need.
EVENTS = ("fetch", "fetch_skipped", "moved", "delete_detected", "remote_state_unknown", "parse_failed")
NEEDED = ("account_id", "folder_id", "folder_raw_name", "uid", "uidvalidity", "source_item_key")
#: Fields in the order in which they are written, which is that of their names.
SCHEMA = (
    "account_id string, content_key string, deduplicated boolean, event string, file_hash string, folder_id bigint, folder_raw_name string, "
    "message_id string, moved_to_folder_id bigint, reason string, relative_path string, size_bytes bigint, source_item_key string, "
    "timestamp string, uid bigint, uidvalidity bigint"
)
FIELDS = tuple(f.split()[0] for f in SCHEMA.split(", "))
MARK = "|CRC32:"


def checksum(text: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.crc32(text.cast("binary"))), 8, "0"))


def line(columns: dict[str, Column]) -> Column:
    """An event's line: fields by name, all of them that are given, nulls written as such."""
    fields = F.struct(*(c.alias(k) for k, c in sorted(columns.items())))
    text = F.to_json(fields, {"ignoreNullFields": "false"})
    return F.concat(text, F.lit(MARK), checksum(text))


def valid() -> Column:
    """Whether an event's fields are what its name asks for."""
    has = lambda *names: F.array_compact(F.array(*(F.col(n).cast("string") for n in names)))
    base = F.col("event").isin(*EVENTS) & F.col("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(F.col("timestamp")).isNotNull()
    stored = F.size(has(*NEEDED, "relative_path", "file_hash", "size_bytes")) == len(NEEDED) + 3
    skipped = (F.size(has(*NEEDED, "reason")) == len(NEEDED) + 1) & F.col("relative_path").isNull() & F.col("file_hash").isNull()
    kind = F.when(F.col("event") == "fetch", stored).when(F.col("event") == "fetch_skipped", skipped).otherwise(True)
    return F.coalesce(base & kind, F.lit(False))


def write(events: DataFrame, path: str) -> None:
    """Append ``events`` (any of ``FIELDS``) to the files of their accounts and months."""
    columns = {c: F.col(c) for c in events.columns if c in FIELDS}
    month = F.replace(F.substring(utc_text(zoned(F.col("timestamp"))), 1, 7), F.lit("-"), F.lit(""))
    rows = events.select(line(columns).alias("value"), F.col("account_id").alias("account"), month.alias("month"))
    rows.write.mode("append").partitionBy("account", "month").text(path)


def read_lines(lines: DataFrame) -> DataFrame:
    """``lines(file, place, value)`` as events with ``file``, ``place``, ``intact`` and ``last``."""
    text = F.regexp_extract("value", r"^(.*)\|CRC32:([0-9a-f]{8})$", 1)
    told = F.regexp_extract("value", r"^(.*)\|CRC32:([0-9a-f]{8})$", 2)
    event = F.from_json(text, SCHEMA)
    intact = F.coalesce((checksum(text) == told) & event.isNotNull() & event["event"].isNotNull(), F.lit(False))
    ends = lines.groupBy("file").agg(F.max("place").alias("end")).withColumnRenamed("file", "end_file")
    rows = lines.withColumn("intact", intact)
    # A row a file; each is one month of an account, so one file may hold many of the rows and is no key to shuffle them by.
    ends = F.broadcast(ends) if few(ends) else ends
    rows = rows.join(ends, F.col("file") == F.col("end_file"), "left")
    last = F.col("place") == F.col("end")
    rows = rows.select("file", "place", F.octet_length("value").alias("bytes"), "intact", last.alias("last"), event.alias("e"))
    return rows.select("file", "place", "bytes", "intact", "last", "e.*")


def few(rows: DataFrame, most: int = 200_000) -> bool:
    """Whether there are so few rows that they can be sent to all executors."""
    return rows.limit(most + 1).count() <= most


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files; ``place`` orders a file's: where its split starts, then the row."""
    rows = spark.read.text(path, recursiveFileLookup=True)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").where("value <> ''")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events.  A broken line is dropped if it is its file's last, which a crash leaves, and
    is an error anywhere else; a first pass looks for such, as Spark may drop a row before an
    expression on it can fail."""
    rows = read_lines(lines_of(spark, path))
    broken = rows.where("NOT intact AND NOT last").select("file").limit(1).collect()
    if broken:
        raise ValueError(f"a broken event within {broken[0]['file']}")
    return rows.where("intact").drop("bytes", "intact", "last")


def read_committed(lines: DataFrame) -> DataFrame:
    """The events of ``lines(value)`` that a commit made visible, where no line is torn: a broken one is an error."""
    rows = read_lines(lines.select(F.lit("").alias("file"), F.lit(0).alias("place"), "value"))
    if not rows.where("NOT intact").isEmpty():
        raise ValueError("a broken event within a commit")
    return rows.drop("file", "place", "bytes", "intact", "last")


def bytes_cut(lines: DataFrame) -> DataFrame:
    """``file, bytes``: what a repair of the ends removes."""
    return read_lines(lines).where("last AND NOT intact").select("file", "bytes")


def replay(events: DataFrame) -> DataFrame:
    """The last known state of each message, folded from its events in the order of the instants that their
    timestamps name, of equal ones in the order of file and place where ``events`` has these."""
    key = ["account_id", "folder_id", "uidvalidity", "uid"]
    state = F.when(F.col("event") == "moved", "moved").when(F.col("event") == "delete_detected", "deleted")
    state = state.when(F.col("event") == "remote_state_unknown", "unknown").otherwise("present")
    order = F.struct(F.try_to_timestamp("timestamp"), *(F.col(c) for c in ("file", "place") if c in events.columns))
    rows = events.withColumn("state", state).withColumn("order", order)
    of = lambda event: F.when(F.col("event") == event, F.col("order"))
    return rows.groupBy(*key).agg(
        F.max_by("state", "order").alias("remote_state"),
        F.max_by("relative_path", of("fetch")).alias("relative_path"),
        F.max_by("moved_to_folder_id", of("moved")).alias("moved_to_folder_id"),
        F.count("*").alias("n_events"),
    )


STATE_KEY = ("account_id", "folder_id", "uidvalidity", "uid")


def fold_new(store, events: str, state: str, buckets: int = 64) -> int:
    """Fold the events that commits added since the last fold into the table ``state``, in a commit of its own that also says
    up to which commit that was.  Only new events are read, and only the buckets of the messages that they name.

    Of two events of a message the one with the later instant counts, whichever was folded first; of equal instants the one of
    the later commit.  The state's rows are those of ``replay``; the number of the folded commit is returned."""
    commit = store.begin()
    done, newest = commit.notes.get(f"folded {events}", -1), commit.version - 1
    new = store.read(events).where(F.col("v") > done)  # a partition column: other commits' files are not opened
    instant = F.unix_micros(F.coalesce(zoned(F.col("timestamp")), F.to_timestamp(F.lit("1970-01-01T00:00:00Z"))))
    rank = F.struct(instant.alias("at"), F.col("v").alias("v"))
    kind = F.when(F.col("event") == "moved", "moved").when(F.col("event") == "delete_detected", "deleted").when(F.col("event") == "remote_state_unknown", "unknown").otherwise("present")
    of = lambda event: F.when(F.col("event") == event, rank)
    rows = new.groupBy(*STATE_KEY).agg(
        F.max_by(kind, rank).alias("remote_state"), F.max(rank).alias("state_at"), F.max_by("relative_path", of("fetch")).alias("relative_path"), F.max(of("fetch")).alias("path_at"),
        F.max_by("moved_to_folder_id", of("moved")).alias("moved_to_folder_id"), F.max(of("moved")).alias("moved_at"), F.count("*").alias("n_events"),
    )
    if state not in commit.tables:
        commit.create(state, rows, ("account_id", "folder_id", "uidvalidity", "uid div 1000"), buckets)
    else:
        rows = commit.staged("folded", rows)
        touched = [r[0] for r in rows.select(commit.bucket_of(state)).distinct().collect()]  # a row a bucket at most
        old = commit.current(state, touched)
        parts = old.unionByName(rows)
        whole = parts.groupBy(*STATE_KEY).agg(
            *(x for value, at in (("remote_state", "state_at"), ("relative_path", "path_at"), ("moved_to_folder_id", "moved_at")) for x in (F.max_by(value, at).alias(value), F.max(at).alias(at))),
            F.sum("n_events").alias("n_events"),
        )
        commit.merge(state, whole.select(*old.columns).join(rows.select(*STATE_KEY), list(STATE_KEY), "left_semi").withColumn("seq", F.lit(0)), STATE_KEY)
    commit.note(f"folded {events}", newest)
    commit.publish()
    return newest


def repaired(lines: DataFrame) -> DataFrame:
    """``file, place, value`` without the broken line at a file's end, which a crash leaves: what a repair
    writes anew.  Lines in the middle stay, broken or not."""
    cut = read_lines(lines).where("last AND NOT intact").select(F.col("file").alias("cut_file"), F.col("place").alias("cut_place"))
    return lines.join(cut, (F.col("file") == F.col("cut_file")) & (F.col("place") == F.col("cut_place")), "left_anti")
