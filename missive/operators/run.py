"""One synchronisation of all folders: from a listing, cursors and what is stored to new rows, events, failures
and cursors, as joins.

A run has two halves.  ``work`` says which listed messages are fetched, and why: failures that are tried again,
new ones (``forward``) and, newest first, old ones (``backfill``).  ``settle`` takes the outcomes of fetching them.
A run that is stopped says at which uid of each folder (``stops``); what was done is kept, and the
cursor stands below it.  Mail that arrives meanwhile is the forward part of the next listing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.groups import join_groups, written
from missive.operators.store import ATTEMPTS, FAILURE_KEY, cursors
from missive.operators.sync import PLACE, expired, valid_modseq

#: Fixed value: bytes from which a message is not fetched whole.
MOST_BYTES = 50 << 20
GENERATION = ["folder_id", "uidvalidity"]


def started(listing: DataFrame, known: DataFrame) -> DataFrame:
    """The cursors with which a run begins: ``listing(folder_id, uidvalidity, max_uid)`` has a row for each folder, empty
    ones too.  A generation without a cursor gets a fresh one; one without a backfill cursor gets the
    largest uid for it.  Cursors of older generations are left behind, rows of these stay."""
    names = ["folder_id", "uidvalidity", "last_seen_uid", "backfill_next_uid", "initial_sync_completed", "highest_modseq"]
    fresh = cursors(listing.join(known.select(*GENERATION), GENERATION, "left_anti"))
    old = known.join(listing.select(*GENERATION, "max_uid"), GENERATION)
    old = old.withColumn("backfill_next_uid", F.coalesce("backfill_next_uid", "max_uid", F.lit(0)))
    return old.select(*names).unionByName(fresh.select(*names))


def work(remote: DataFrame, now: DataFrame, failed: DataFrame, broken: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``remote`` that are fetched and ``part``.  A failure is tried again wherever its uid is, up to
    ``ATTEMPTS`` times; one for its size only if the message is small enough now, and is passed over else.

    ``broken(account_id, folder_id, kind)``: of a folder that could not be read nothing is fetched, and of an account
    whose sign-in failed (``kind`` is ``auth``) nothing at all."""
    at = now.select(*GENERATION, "last_seen_uid", "backfill_next_uid", "initial_sync_completed")
    rows = remote.join(at, GENERATION)
    if broken is not None:
        rows = rows.join(broken.where("kind = 'auth'").select("account_id").distinct(), "account_id", "left_anti")
        rows = rows.join(broken.where("kind <> 'auth'").select("account_id", "folder_id").distinct(), ["account_id", "folder_id"], "left_anti")
    bad = failed.select(*FAILURE_KEY, F.col("error_class").alias("_class"), F.col("attempt_count").alias("_tries"))
    rows = rows.join(bad, list(FAILURE_KEY), "left")
    waits = (F.col("_class") == "oversize") & (F.col("size_bytes") > most_bytes)
    tried = F.col("_tries") < ATTEMPTS
    part = (
        F.when(tried & F.coalesce(waits, F.lit(False)), F.lit(None))
        .when(tried, "retry")
        .when(F.col("uid") > F.col("last_seen_uid"), "forward")
        .when(~F.col("initial_sync_completed") & (F.col("uid") <= F.col("backfill_next_uid")), "backfill")
    )
    return rows.withColumn("part", part).where("part IS NOT NULL").select(*remote.columns, "part")


def reached(todo: DataFrame, stops: DataFrame | None) -> DataFrame:
    """What a run that is stopped has done: of a folder with a ``stop_uid`` the backfill from there on, and
    what comes before the backfill."""
    if stops is None:
        return todo
    rows = todo.join(stops.select(*GENERATION, "stop_uid"), GENERATION, "left")
    return rows.where((F.col("part") != "backfill") | F.col("stop_uid").isNull() | (F.col("uid") >= F.col("stop_uid"))).drop("stop_uid")


def item_key(uidvalidity: Column, uid: Column) -> Column:
    return F.concat_ws(":", uidvalidity.cast("string"), uid.cast("string"))


def flag_text(flags: Column) -> Column:
    return F.array_join(flags, " ")


def flags_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda f: f != "")


@dataclass
class Settled:
    """``messages`` to upsert, ``events`` to append, ``attempts`` that failed, ``cleared`` failures, and the new ``cursors``."""

    messages: DataFrame
    events: DataFrame
    attempts: DataFrame
    cleared: DataFrame
    cursors: DataFrame


def settle(done: DataFrame, outcomes: DataFrame, now: DataFrame, listing: DataFrame, stored: DataFrame, at: str, stops: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> Settled:
    """``done`` is ``work`` as far as it was ``reached``; ``outcomes`` has its keys, ``outcome`` (ok, parse, transient or permanent;
    what is larger than ``most_bytes`` is oversize whatever it says), ``message_id, content_key, file_hash, relative_path``.

    Contents that the account has, in ``stored`` or in an earlier message of the run, are marked as duplicates.
    The forward cursor goes past messages that failed."""
    keys = list(PLACE)
    large = F.coalesce(F.col("size_bytes") > most_bytes, F.lit(False))
    rows = done.join(outcomes.select(*keys, *(c for c in outcomes.columns if c not in done.columns)), keys)
    rows = rows.withColumn("outcome", F.when(large, "oversize").otherwise(F.col("outcome"))).withColumn("source_item_key", item_key(F.col("uidvalidity"), F.col("uid")))
    whole = F.col("outcome").isin("ok", "parse")
    kept = lambda c: F.when(whole, F.col(c)).alias(c)
    known = stored.where("file_hash IS NOT NULL").select("account_id", "file_hash").distinct().withColumn("_known", F.lit(True))
    first = F.min(F.when(whole, F.struct("folder_id", "uidvalidity", "uid"))).alias("_first")
    groups = rows.groupBy("account_id", "file_hash").agg(first, F.count("*").alias("n")).join(known, ["account_id", "file_hash"], "left")
    rows = join_groups(rows, written(groups, "contents"), ["account_id", "file_hash"])
    again = F.coalesce("_known", F.lit(False)) | (F.struct("folder_id", "uidvalidity", "uid") > F.col("_first"))
    messages = rows.where(F.col("outcome").isin("ok", "parse", "oversize")).select(
        *keys, "source_item_key", F.lit("present").alias("remote_state"), F.lit("active").alias("local_state"), "size_bytes",
        "message_id", F.coalesce(kept("content_key"), F.concat(F.lit("uid:"), "source_item_key")).alias("content_key"), kept("file_hash"), kept("relative_path"),
    )
    events = rows.where(F.col("outcome").isin("ok", "parse", "oversize")).select(
        F.when(whole, "fetch").otherwise("fetch_skipped").alias("event"), *keys, "folder_raw_name", "source_item_key", F.when(whole, F.col("message_id")).alias("message_id"),
        kept("relative_path"), kept("file_hash"), "size_bytes", F.when(~whole, "oversize").alias("reason"), F.when(whole, again).alias("deduplicated"), F.lit(at).alias("timestamp"),
    )
    attempts = rows.where("outcome <> 'ok'").select(*FAILURE_KEY, F.col("outcome").alias("error_class"), F.lit(at).alias("at"))
    cleared = rows.where("outcome = 'ok'").select(*FAILURE_KEY)
    return Settled(messages, events, attempts, cleared, _advanced(now, listing, stops))


def _advanced(now: DataFrame, listing: DataFrame, stops: DataFrame | None) -> DataFrame:
    rows = now.join(listing.select(*GENERATION, "max_uid"), GENERATION, "left")
    rows = rows.join(stops.select(*GENERATION, "stop_uid"), GENERATION, "left") if stops is not None else rows.withColumn("stop_uid", F.lit(None).cast("long"))
    open_ = ~F.col("initial_sync_completed") & (F.col("stop_uid") > 1) & (F.col("stop_uid") <= F.col("backfill_next_uid") + 1)
    left = F.when(open_, F.col("stop_uid") - 1).otherwise(F.lit(0).cast("long"))
    return rows.select(
        *GENERATION, F.greatest("last_seen_uid", F.coalesce("max_uid", F.lit(0))).alias("last_seen_uid"),
        F.when(F.col("initial_sync_completed"), F.col("backfill_next_uid")).otherwise(left).alias("backfill_next_uid"),
        (F.col("initial_sync_completed") | (left == 0)).alias("initial_sync_completed"), "highest_modseq",
    )


def state_events(changes: DataFrame, messages: DataFrame, at: str) -> DataFrame:
    """Events of messages that moved, went or may have, from ``sync.moves``."""
    name = F.when(F.col("remote_state") == "moved", "moved").when(F.col("remote_state") == "deleted", "delete_detected").otherwise("remote_state_unknown")
    rows = messages.drop("remote_state", "moved_to_folder_id").join(changes.select("id", "remote_state", "moved_to_folder_id"), "id")
    return rows.select(name.alias("event"), *PLACE, "content_key", "file_hash", "moved_to_folder_id", F.lit(at).alias("timestamp"))


def flag_paths(folders: DataFrame, window: DataFrame, now: str) -> DataFrame:
    """``folder_id, path, highest_modseq``: how each folder's flags are refreshed, and its MODSEQ afterwards.

    ``folders(folder_id, uidvalidity, initial_sync_completed, highest_modseq, server_modseq, condstore)``.  Before the
    backfill is complete, or with no message in ``window`` whose flags are old, nothing is asked (``none``); then a
    saved MODSEQ that is invalid, ahead of the server's or not supported is cleared."""
    old = window.where(expired(F.col("flags_seen_at"), now)).groupBy(*GENERATION).agg(F.count("*").alias("_old"))
    rows = folders.join(old, GENERATION, "left")
    saved, current = valid_modseq(F.col("highest_modseq")), valid_modseq(F.col("server_modseq"))
    usable = F.col("condstore") & current.isNotNull()
    stale = saved.isNull() | F.coalesce(saved > current, F.lit(False))
    path = (
        F.when(~F.col("initial_sync_completed"), "wait").when(F.col("_old").isNull(), "none")
        .when(usable & stale, "baseline").when(usable, "delta").otherwise("ttl")
    )
    reset = F.col("highest_modseq").isNotNull() & (~usable | stale)
    after = F.when(path.isin("baseline", "delta"), current).when((path == "wait") | ((path == "none") & ~reset), saved)
    return rows.select("folder_id", path.alias("path"), after.alias("highest_modseq"))
