"""The message model over the driver's tables, for queries and tests.

The same views in Spark and as common table expressions for DuckDB; every column is a
deterministic expression that both evaluate alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.functions.display import utc_seconds
from missive.functions.normalise import stored_form
from missive.operators.index import Index, build
from missive.operators.pages import Directory, directory
from missive.operators.search import keyed
from missive.scratch import scratch_path

#: 2026-07-01T00:00:00Z.
EPOCH = 1_782_864_000


@dataclass
class Views:
    accounts: DataFrame
    folders: DataFrame
    messages: DataFrame
    contents: DataFrame
    failures: DataFrame
    index: Index | None = None
    directory: Directory | None = None


def views(spark: SparkSession, sf_dir: str) -> Views:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    folder_id = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    account = F.concat(F.lit("account-"), F.substring(F.lit("abc"), (F.pmod(folder_id, F.lit(3)) + 1).cast("int"), F.lit(1)))
    folders = docs.select("source").distinct().select(
        folder_id.alias("id"), account.alias("account_id"), F.col("source").alias("raw_name"), F.upper("source").alias("display_name"),
        F.lit(1).cast("long").alias("uidvalidity"), (folder_id % 4 != 0).alias("is_sync_target"),
    )
    accounts = folders.select(F.col("account_id").alias("id")).distinct()
    accounts = accounts.select("id", F.lit("imap").alias("provider_type"), (F.col("id") != "account-c").alias("is_enabled"))
    doc = F.col("doc_id")
    state = F.element_at(F.array(*map(F.lit, ("present", "moved", "deleted", "unknown"))), (doc % 4 + 1).cast("int"))
    flags = F.element_at(F.array(*map(F.lit, ("", "\\Seen", "\\Flagged", "\\Seen \\Flagged"))), (doc % 5 % 4 + 1).cast("int"))
    toxic = labels.select(F.col("doc_id").alias("label_id"), "toxic", "quality")
    rows = docs.join(toxic, doc == F.col("label_id"), "left")
    hash_ = F.sha2(F.col("text").cast("binary"), 256)
    messages = rows.select(
        doc.alias("id"), account.alias("account_id"), folder_id.alias("folder_id"), F.concat(F.lit("<m"), doc.cast("string"), F.lit("@example.org>")).alias("message_id"),
        F.substring(hash_, 1, 32).alias("content_key"), F.when(doc % 13 != 0, doc).alias("uid"), F.when(doc % 29 == 0, 2).otherwise(1).cast("long").alias("uidvalidity"),
        state.alias("remote_state"), F.when(doc % 4 == 1, (folder_id + 1) % 20).alias("moved_to_folder_id"),
        F.when(F.col("toxic") == 1, "trashed").otherwise("active").alias("local_state"), hash_.alias("file_hash"),
        F.substring("text", 1, 60).alias("subject"), F.concat("source", F.lit("@example.org")).alias("sender"), F.concat("lang", F.lit("@example.org")).alias("recipient"),
        F.when(doc % 2 == 0, F.concat("lang", F.lit("-cc@example.org"))).alias("cc"), F.when(doc % 5 == 1, F.concat(F.lit("<m"), (doc - 1).cast("string"), F.lit("@example.org>"))).alias("in_reply_to"),
        F.when(doc % 5 == 1, F.concat(F.lit("<m0@example.org> <m"), (doc - 1).cast("string"), F.lit("@example.org>"))).alias("references_ids"),
        F.when(doc % 7 != 0, utc_seconds(F.lit(EPOCH) + doc * 60)).alias("date_sent"), F.when(doc % 11 != 0, utc_seconds(F.lit(EPOCH + 30) + doc * 60)).alias("internal_date"),
        F.col("n_chars").alias("size_bytes"), (F.col("n_chars") > 2000).alias("has_attachment"), flags.alias("imap_flags"),
        F.when(doc % 3 != 0, utc_seconds(F.lit(EPOCH) + doc * 3600)).alias("flags_seen_at"), (doc % 50).cast("string").alias("thread_key"),
        F.concat_ws("/", F.lit("eml"), account, F.concat(F.substring(hash_, 1, 32), F.lit(".eml"))).alias("relative_path"),
    )
    contents = docs.where("text IS NOT NULL").select(
        doc.alias("message_id"), stored_form(F.substring("text", 1, 60)).alias("subject_norm"), stored_form(F.concat("source", F.lit("@example.org"))).alias("sender_norm"),
        stored_form(F.col("text")).alias("body_text"), F.when(F.col("n_chars") > 2000, F.concat(F.lit("report-"), doc.cast("string"), F.lit(".xlsx"))).alias("attachment_names"),
    )
    kind = F.element_at(F.array(*map(F.lit, ("transient", "oversize", "parse"))), (F.col("label_id") % 3 + 1).cast("int"))
    failures = rows.where(F.col("quality") == 0).select(
        account.alias("account_id"), folder_id.alias("folder_id"), F.lit(1).cast("long").alias("uidvalidity"), doc.alias("uid"), kind.alias("error_class"),
        (doc % 12 + 1).alias("attempt_count"), utc_seconds(F.lit(EPOCH) + doc * 10).alias("first_failed_at"),
    )
    return Views(accounts, folders, messages, contents, failures)


_STORED: dict[tuple, Views] = {}


def stored(spark: SparkSession, sf_dir: str) -> Views:
    """The model written once for a session, with its search index: contents are normalised when they are
    stored, messages lie in the order of pages, and searches read these tables."""
    key = spark.sparkContext.applicationId, sf_dir, _age(spark, sf_dir)
    if key not in _STORED:
        v, path = views(spark, sf_dir), scratch_path(spark, "store")
        order = [F.desc("sort_key"), F.desc("id")]
        keyed(v.messages).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/messages")
        for name in ("accounts", "folders"):  # a row a source
            getattr(v, name).coalesce(1).write.parquet(f"{path}/{name}")
        v.failures.write.parquet(f"{path}/failures")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        directory(read("messages")).write.parquet(f"{path}/directory")
        index = build(v.contents, f"{path}/index")
        _STORED[key] = Views(read("accounts"), read("folders"), read("messages"), index.contents(), read("failures"), index, Directory(read("messages"), read("directory")))
    return _STORED[key]


def _age(spark: SparkSession, sf_dir: str) -> tuple:
    """Times and lengths of the two tables' files, so that a changed table is stored anew."""
    out = []
    for table in ("documents", "labels"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(at))
    return tuple(out)


def _fold(text: str) -> str:
    return rf"trim(regexp_replace(replace(lower({text}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def _stamp(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


_FOLDER = r"CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT)"
_ACCOUNT = f"'account-' || substr('abc', CAST({_FOLDER} % 3 + 1 AS INT), 1)"
CTES = {
    "folders": f"SELECT DISTINCT {_FOLDER} AS id, {_ACCOUNT} AS account_id, source AS raw_name, upper(source) AS display_name, CAST(1 AS BIGINT) AS uidvalidity, {_FOLDER} % 4 <> 0 AS is_sync_target FROM documents",
    "accounts": "SELECT DISTINCT account_id AS id, 'imap' AS provider_type, account_id <> 'account-c' AS is_enabled FROM folders",
    "messages": f"""SELECT d.doc_id AS id, {_ACCOUNT} AS account_id, {_FOLDER} AS folder_id, '<m' || d.doc_id || '@example.org>' AS message_id,
      substr(sha256(text), 1, 32) AS content_key, CASE WHEN d.doc_id % 13 <> 0 THEN d.doc_id END AS uid, CAST(CASE WHEN d.doc_id % 29 = 0 THEN 2 ELSE 1 END AS BIGINT) AS uidvalidity,
      CASE d.doc_id % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'moved' WHEN 2 THEN 'deleted' ELSE 'unknown' END AS remote_state,
      CASE WHEN d.doc_id % 4 = 1 THEN ({_FOLDER} + 1) % 20 END AS moved_to_folder_id,
      CASE WHEN l.toxic = 1 THEN 'trashed' ELSE 'active' END AS local_state, sha256(text) AS file_hash, substr(text, 1, 60) AS subject, source || '@example.org' AS sender, lang || '@example.org' AS recipient,
      CASE WHEN d.doc_id % 2 = 0 THEN lang || '-cc@example.org' END AS cc, CASE WHEN d.doc_id % 5 = 1 THEN '<m' || (d.doc_id - 1) || '@example.org>' END AS in_reply_to,
      CASE WHEN d.doc_id % 5 = 1 THEN '<m0@example.org> <m' || (d.doc_id - 1) || '@example.org>' END AS references_ids,
      CASE WHEN d.doc_id % 7 <> 0 THEN {_stamp(f"{EPOCH} + d.doc_id * 60")} END AS date_sent, CASE WHEN d.doc_id % 11 <> 0 THEN {_stamp(f"{EPOCH} + 30 + d.doc_id * 60")} END AS internal_date,
      n_chars AS size_bytes, n_chars > 2000 AS has_attachment, CASE d.doc_id % 5 % 4 WHEN 0 THEN '' WHEN 1 THEN '\\Seen' WHEN 2 THEN '\\Flagged' ELSE '\\Seen \\Flagged' END AS imap_flags,
      CASE WHEN d.doc_id % 3 <> 0 THEN {_stamp(f"{EPOCH} + d.doc_id * 3600")} END AS flags_seen_at, CAST(d.doc_id % 50 AS VARCHAR) AS thread_key,
      'eml/' || {_ACCOUNT} || '/' || substr(sha256(text), 1, 32) || '.eml' AS relative_path
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "contents": f"SELECT doc_id AS message_id, {_fold('substr(text, 1, 60)')} AS subject_norm, {_fold('source')} || '@example.org' AS sender_norm, {_fold('text')} AS body_text, CASE WHEN n_chars > 2000 THEN 'report-' || doc_id || '.xlsx' END AS attachment_names FROM documents WHERE text IS NOT NULL",
    "failures": f"SELECT {_ACCOUNT} AS account_id, {_FOLDER} AS folder_id, CAST(1 AS BIGINT) AS uidvalidity, d.doc_id AS uid, CASE l.doc_id % 3 WHEN 0 THEN 'transient' WHEN 1 THEN 'oversize' ELSE 'parse' END AS error_class, d.doc_id % 12 + 1 AS attempt_count, {_stamp(f'{EPOCH} + d.doc_id * 10')} AS first_failed_at FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0",
}


def sql(body: str) -> str:
    """``body`` after the common table expressions that it names."""
    used = [k for k in CTES if k in body or (k == "folders" and "accounts" in body)]
    return "WITH " + ",\n".join(f"{k} AS ({CTES[k]})" for k in used) + "\n" + body if used else body
