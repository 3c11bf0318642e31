"""Contents computed again from the stored files, and rows chosen for it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.functions.display import attachment_names
from missive.functions.mail import parsed
from missive.functions.normalise import normalised
from missive.sources.files import verified


def reparse(targets: DataFrame, files: DataFrame, root: str, now: datetime) -> DataFrame:
    """``message_id``, the four contents and ``state`` (ok, parse, missing, mismatch, outside) of
    stored messages, whose files are below ``root``.  Only rows that are ok have contents; headers are left as they are."""
    wanted = targets.select("relative_path", "file_hash").distinct()
    found = verified(files, wanted, root)
    rows = targets.select("id", "relative_path", "file_hash", "internal_date").join(found, ["relative_path", "file_hash"])
    rows = rows.withColumn("m", parsed(F.col("content"), F.col("internal_date"), now))
    state = F.when((F.col("state") == "ok") & F.col("m.parse_error").isNotNull(), "parse").otherwise(F.col("state"))
    ok = state == "ok"
    return rows.select(
        F.col("id").alias("message_id"), F.when(ok, normalised(F.col("m.subject"))).alias("subject_norm"), F.when(ok, normalised(F.col("m.sender"))).alias("sender_norm"),
        F.when(ok, normalised(F.col("m.body_text"))).alias("body_text"), F.when(ok, normalised(attachment_names(F.col("m.attachments")))).alias("attachment_names"), state.alias("state"),
    )


def counters(results: DataFrame) -> DataFrame:
    """One row: what was read, renewed, and why the rest was skipped."""
    is_ = lambda *states: F.coalesce(F.sum(F.col("state").isin(*states).cast("long")), F.lit(0))
    return results.agg(
        F.count("*").alias("processed"), is_("ok").alias("updated"), is_("missing", "mismatch", "outside", "parse").alias("skipped"),
        is_("missing").alias("missing"), is_("mismatch").alias("mismatched"), is_("parse").alias("parse_failed"),
    )


def renewed(contents: DataFrame, results: DataFrame) -> DataFrame:
    """``contents`` with those of ``results`` that are ok in place of the old ones."""
    new = results.where("state = 'ok'").select(*contents.columns)
    return contents.join(new.select("message_id"), "message_id", "left_anti").select(*contents.columns).unionByName(new)


def folder_ids(folders: DataFrame, account_ids: tuple[str, ...] | None, raw_names: tuple[str, ...] | None) -> tuple[int, ...] | None:
    """The ids of folders by name within the accounts; unknown names match nothing, and no names
    do not filter.  At most as many rows as names and accounts reach the driver."""
    if raw_names is None:
        return None
    rows = folders.where(F.col("raw_name").isin(list(raw_names)))
    if account_ids is not None:
        rows = rows.where(F.col("account_id").isin(list(account_ids)) if account_ids else F.lit(False))
    return tuple(sorted(r[0] for r in rows.select("id").collect()))


def folders_named(folders: DataFrame, raw_names: DataFrame, account_ids: DataFrame | None = None) -> DataFrame:
    """``id`` of the folders whose name ``raw_names(raw_name)`` has, of the accounts ``account_ids(account_id)`` or of all."""
    rows = folders.join(raw_names.select("raw_name"), "raw_name", "left_semi")
    if account_ids is not None:
        rows = rows.join(account_ids.select("account_id"), "account_id", "left_semi")
    return rows.select("id")


def enabled_accounts(accounts: DataFrame) -> DataFrame:
    """All but those that are off, as a boolean, a number or a text; one that says nothing is on."""
    return accounts.where(~F.coalesce(F.lower(F.col("is_enabled").cast("string")).isin("0", "false"), F.lit(False)))


def total_results(results: DataFrame) -> DataFrame:
    """The sum of runs over accounts; cancelled if any was."""
    sums = [F.sum(c).alias(c) for c in ("fetched", "transferred_bytes", "skipped", "failed")]
    return results.agg(*sums, F.bool_or("cancelled").alias("cancelled"))
