"""Rows as lines, attachments with free names, inline parts, and tables of older versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.mail import rendered, safe_names
from missive.operators.store import canonical_time
from missive.sources.files import verified

#: Fields of a row as JSON.
LINE = (
    "id", "account_id", "folder_id", "folder_name", "subject", "sender", "date_sent", "internal_date", "size_bytes", "has_attachment",
    "imap_flags", "local_state", "remote_state", "thread_key",
)


def json_lines(summaries: DataFrame, fields: tuple[str, ...] = LINE) -> DataFrame:
    """A JSON object for each summary, nulls written."""
    return summaries.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def tab_lines(summaries: DataFrame) -> DataFrame:
    shown = [F.coalesce(F.translate(F.col(c).cast("string"), "\t\r\n", "   "), F.lit("")) for c in ("id", "sort_key", "sender", "subject")]
    return summaries.select(F.concat_ws("\t", *shown).alias("line"))


def message_file(messages: DataFrame) -> DataFrame:
    """``file_name, content`` of stored messages as they are exported: by their subject, safe for any file system, and id."""
    name = F.concat(F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit("message")), F.lit(" "), F.col("id").cast("string"), F.lit(".eml"))
    return messages.select("id", safe_names(name)["name"].alias("file_name"), "content")


def verified_files(messages: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``id, file_name, content, state`` of ``messages(id, subject, relative_path, file_hash)``: only a message whose file below ``root``
    still has its hash has a name and content to export; the others say why not (missing, mismatch, outside)."""
    found = verified(files, messages.select("relative_path", "file_hash").distinct(), root)
    rows = messages.select("id", "subject", "relative_path", "file_hash").join(found, ["relative_path", "file_hash"])
    named = message_file(rows.where("state = 'ok'").select("id", "subject", "content"))
    bad = rows.where("state <> 'ok'").select("id", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("binary").alias("content"), "state")
    return named.select("id", "file_name", "content", F.lit("ok").alias("state")).unionByName(bad)


def attachments(messages: DataFrame) -> DataFrame:
    """``id, part_index, file_name, content_type, is_executable, warnings, payload`` of
    ``messages(id, content)``; names are safe, and free within a message: a repeated one gets `` (n)``."""
    parts = messages.select("id", F.posexplode(rendered(F.col("content"))["parts"]).alias("part_index", "part"))
    rows = parts.where("NOT part.is_inline").withColumn("safe", safe_names(F.coalesce("part.filename", F.lit("attachment"))))
    again = F.row_number().over(Window.partitionBy("id", F.lower("safe.name")).orderBy("part_index")) - 1
    stem, ending = F.regexp_extract("safe.name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("safe.name", r"^(.*?)(\.[^.]*)?$", 2)
    rows = rows.withColumn("again", again)
    name = F.when(F.col("again") == 0, F.col("safe.name")).otherwise(F.concat(stem, F.lit(" ("), F.col("again").cast("string"), F.lit(")"), ending))
    return rows.select("id", "part_index", name.alias("file_name"), "part.content_type", "safe.is_executable", "safe.warnings", "part.payload")


def inline_part(parts: Column, content_id: Column) -> Column:
    """The first part with a content id; null without one."""
    return F.get(F.filter(parts, lambda p: p["content_id"] == content_id), 0)


VERSION = 4


def _cursors(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    folders = tables["folders"].withColumns({"backfill_next_uid": F.lit(None).cast("long"), "initial_sync_completed": F.lit(False)})
    return tables | {"folders": folders, "sync_failures": tables["sync_failures"].withColumn("uidvalidity", F.lit(0).cast("long"))}


def _times(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    def fixed(rows: DataFrame) -> DataFrame:
        times = [c for c, kind in rows.dtypes if kind == "string" and c.endswith(("_at", "_date", "date_sent"))]
        return rows.withColumns({c: canonical_time(F.col(c)) for c in times})

    return {k: fixed(v) for k, v in tables.items()}


def _flags(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return tables | {
        "folders": tables["folders"].withColumn("highest_modseq", F.lit(None).cast("long")),
        "messages": tables["messages"].withColumn("flags_seen_at", F.lit(None).cast("string")),
    }


STEPS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {2: _cursors, 3: _times, 4: _flags}


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """The tables of an older version as those of ``VERSION``; of a newer one, an error."""
    if version > VERSION:
        raise ValueError(f"version {version} is newer than {VERSION}")
    for step in sorted(STEPS):
        if step > version:
            tables = STEPS[step](tables)
    return tables
