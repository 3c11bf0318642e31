"""One synchronisation as joins: what to fetch, what moved or went, which flags changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.display import zoned
from missive.operators.groups import join_groups, written

PLACE = ("account_id", "folder_id", "uidvalidity", "uid")
FLAG_TTL_S, FLAG_WINDOW_DAYS = 3600, 30
MAX_MODSEQ = 2**63 - 1


def to_fetch(remote: DataFrame, local: DataFrame, folder_cursors: DataFrame) -> DataFrame:
    """Remote messages of the current generation that are not stored, and whether they are new
    (above the last seen uid) or old (to be filled in, newest first)."""
    at = folder_cursors.select("folder_id", "uidvalidity", "last_seen_uid", "backfill_next_uid")
    rows = remote.join(at, ["folder_id", "uidvalidity"])
    part = F.when(F.col("uid") > F.col("last_seen_uid"), "forward").when(F.col("uid") <= F.col("backfill_next_uid"), "backfill")
    rows = rows.withColumn("part", part).where("part IS NOT NULL")
    return rows.join(local.select(*PLACE), list(PLACE), "left_anti")


def admitted(rows: DataFrame, most_bytes: int) -> DataFrame:
    """``rows`` and how each is stored: whole, or its headers alone if it is larger than allowed."""
    return rows.withColumn("oversize", F.coalesce(F.col("size_bytes") > most_bytes, F.lit(False)))


def missing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Stored messages of the targets' generations that the mailbox no longer lists."""
    return local.join(remote.select(*PLACE), list(PLACE), "left_anti").where("uid IS NOT NULL")


def moves(gone: DataFrame, messages: DataFrame) -> DataFrame:
    """``id, remote_state, moved_to_folder_id`` for messages that are gone: moved if exactly one
    other folder of the account has the same content, deleted if none has and the content is
    known, else unknown.

    Contents are grouped before the join: the smallest two folders that hold one tell whether
    there is exactly one other, so a content that a third of all messages share adds no pairs."""
    key = ["account_id", "content_key", "file_hash"]
    here = messages.where("remote_state = 'present'").groupBy(*key, "folder_id").agg(F.count("*").alias("n"))
    held = here.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("folder_id").alias("low"), F.max("folder_id").alias("high"), F.count("*").alias("folders")
    )
    own = here.select(*key, "folder_id", F.col("n").alias("own_n"))
    g = gone.select("id", *key, "folder_id")
    # What many messages share is many rows of ``gone`` too: groups are joined with groups, then looked up.
    sizes = g.groupBy(*key, "folder_id").agg(F.count("*").alias("rows"))
    groups = sizes.join(held, key, "left").join(own, [*key, "folder_id"], "left")
    rows = join_groups(g, written(groups, "contents"), [*key, "folder_id"], "rows")
    others = F.coalesce("n", F.lit(0)) - F.coalesce("own_n", F.lit(0))
    other = F.when(F.col("low") == F.col("folder_id"), F.col("high")).otherwise(F.col("low"))
    state = F.when(others == 1, "moved").when((others == 0) & F.col("file_hash").isNotNull(), "deleted").otherwise("unknown")
    return rows.select("id", others.alias("candidates"), state.alias("remote_state"), F.when(others == 1, other).alias("moved_to_folder_id"))


def expired(seen_at: Column, now: str) -> Column:
    """Whether flags were seen longer ago than the limit; unreadable times are."""
    seconds = F.unix_seconds(zoned(F.lit(now))) - F.unix_seconds(zoned(seen_at))
    return F.coalesce(seconds >= FLAG_TTL_S, F.lit(True))


def flag_window(messages: DataFrame, since: str) -> DataFrame:
    return messages.where(F.col("uid").isNotNull() & (F.col("internal_date") >= since))


def refreshed_flags(window: DataFrame, remote: DataFrame, now: str, path: str = "ttl", modseq: int = 0) -> DataFrame:
    """``id, imap_flags, flags_seen_at, changed`` of the messages whose flags are settled now.

    ``baseline``: all of the window that the mailbox lists.  ``delta``: those changed since
    ``modseq``, and the expired others as they are.  ``ttl``: the expired ones that the mailbox
    lists; those it does not list stay untouched."""
    new = remote.select(*PLACE, F.col("flags").alias("new_flags"), "modseq")
    old = window.withColumn("old", expired(F.col("flags_seen_at"), now))
    rows = old.join(new, list(PLACE), "left")
    listed, differs = F.col("modseq").isNotNull(), ~F.col("imap_flags").eqNullSafe(F.col("new_flags"))
    if path == "delta":
        hit = listed & (F.col("modseq") > modseq)
        keep, changed = hit | F.col("old"), hit & differs
    else:
        keep = listed if path == "baseline" else listed & F.col("old")
        changed = differs
    flags = F.when(changed, F.col("new_flags")).otherwise(F.col("imap_flags"))
    return rows.where(keep).select("id", flags.alias("imap_flags"), F.lit(now).alias("flags_seen_at"), changed.alias("changed"))


def valid_modseq(value: Column) -> Column:
    n = F.try_to_number(value.cast("string"), F.lit("9" * 19)).cast("decimal(20,0)")
    return F.when((n > 0) & (n <= MAX_MODSEQ), n.cast("long"))


def folder_changes(remote: DataFrame, local: DataFrame) -> DataFrame:
    """``raw_name, change``: folders that appeared or went."""
    new = remote.join(local, "raw_name", "left_anti").select("raw_name", F.lit("new").alias("change"))
    return new.unionByName(local.join(remote, "raw_name", "left_anti").select("raw_name", F.lit("removed").alias("change")))


def reparse_targets(messages: DataFrame, failed: DataFrame, only_failed: bool) -> DataFrame:
    """Stored messages to parse again; those whose parsing failed if asked for."""
    rows = messages.where("relative_path IS NOT NULL AND file_hash IS NOT NULL")
    if not only_failed:
        return rows
    bad = failed.where("error_class = 'parse'").select(*PLACE)
    return rows.join(bad, list(PLACE), "left_semi")


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """One row of counts over ``outcome, size_bytes, oversize``: an oversize message counts as
    fetched, as skipped and as failed."""
    is_ = lambda *kinds: F.col("outcome").isin(*kinds).cast("long")
    return outcomes.agg(
        F.sum(is_("stored", "oversize")).alias("fetched"), F.coalesce(F.sum(F.when(F.col("outcome") == "stored", F.col("size_bytes"))), F.lit(0)).alias("transferred_bytes"),
        F.sum(is_("oversize", "known")).alias("skipped"), F.sum(is_("oversize", "transient", "permanent", "parse")).alias("failed"),
    )
