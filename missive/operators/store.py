"""Changes to the stored tables as joins and latest-wins folds.

There is no update in place: a change is a DataFrame of new rows with a ``seq``, and the result
is the table after it.  All are keyed by the natural keys of the model and idempotent, so a
batch that is applied twice changes nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions.display import utc_seconds

FAILURE_KEY = ("account_id", "folder_id", "uidvalidity", "uid")
#: A failed message is tried this often.
ATTEMPTS = 10


def latest(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """The row with the largest ``seq`` for each key, as one partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def same_keys(a: str, b: str, keys: tuple[str, ...]) -> Column:
    return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))


def upsert(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], supplied: tuple[str, ...] | None = None, defaults: dict | None = None) -> DataFrame:
    """``table`` after ``changes`` (with ``seq``).  Existing rows take the ``supplied`` columns, all
    if not said, and new rows those that the changes have, with ``defaults`` where these are null or absent."""
    defaults = defaults or {}
    new = latest(changes, keys).drop("seq")
    given = [c for c in (supplied if supplied is not None else new.columns) if c in new.columns and c not in keys]
    old = table.withColumn("_old", F.lit(True)).alias("o")
    new = new.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys)), "full")
    out = []
    for c in table.columns:
        o = F.col(f"o.{c}")
        if c in keys:
            out.append(F.when(F.col("_old"), o).otherwise(F.col(f"n.{c}")).alias(c))
            continue
        value = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in defaults:
            value = F.when(F.col("_old").isNull(), F.coalesce(value, F.lit(defaults[c]))).otherwise(value)
        take = F.col("_old").isNull() | F.col("_new") if c in given else F.col("_old").isNull()
        out.append(F.when(take, value).otherwise(o).cast(table.schema[c].dataType).alias(c))
    return both.select(*out)


#: What a new account and a new folder have where nothing is said.
NEW_ACCOUNT = {"port": 993, "is_enabled": True}
NEW_FOLDER = {"is_sync_target": True, "initial_sync_completed": False}


def upsert_accounts(table: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(table, changes, ("id",), defaults={k: v for k, v in NEW_ACCOUNT.items() if k in table.columns})


def upsert_folders(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Folders by account and name.  Known ones take the display name, generation and time of what a change
    supplies (not null), never whether they are synchronised; new ones get the next ids."""
    keys = ("account_id", "raw_name")
    new = latest(changes, keys).drop("seq", "id")
    known = [c for c in ("display_name", "uidvalidity", "last_synced_at") if c in new.columns and c in table.columns]
    held = table.select(*keys, *(F.col(c).alias(f"_was_{c}") for c in known), F.lit(True).alias("_held"))
    both = new.alias("n").join(held.alias("h"), same_keys("n", "h", keys), "left")
    full = both.select(*(F.col(f"n.{k}") for k in keys), *((F.when(F.col("_held"), F.coalesce(f"n.{c}", f"_was_{c}")).otherwise(F.col(f"n.{c}")) if c in known else F.col(f"n.{c}")).alias(c) for c in new.columns if c not in keys))
    out = upsert(table, full.withColumn("seq", F.lit(0)), keys, supplied=tuple(known), defaults={k: v for k, v in NEW_FOLDER.items() if k in table.columns})
    return numbered(out, keys)


def upsert_messages(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Messages by (account, folder, generation, uid), or without a uid by the source's key.

    Known messages keep their id; the others get the next ones in key order."""
    mailbox, archive = ("account_id", "folder_id", "uidvalidity", "uid"), ("account_id", "folder_id", "source_item_key")
    changes = changes.drop("id")
    live = upsert(table.where("uid IS NOT NULL"), changes.where("uid IS NOT NULL"), mailbox)
    kept = upsert(table.where("uid IS NULL"), changes.where("uid IS NULL"), archive)
    return numbered(live.unionByName(kept), ("account_id", "folder_id", "uidvalidity", "uid", "source_item_key"))


def numbered(rows: DataFrame, order: tuple[str, ...], last: int | None = None) -> DataFrame:
    """Ids for the rows without one, on from ``last``, or from the largest in ``rows``.  Rows are numbered within 64 hash
    buckets, each shifted by the new rows of those before."""
    new = rows.where("id IS NULL").withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(64)))
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_b", before.alias("_before"))
    if last is None:
        sizes = sizes.join(F.broadcast(rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))))  # 64 rows and 1
    else:
        sizes = sizes.withColumn("_last", F.lit(last))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    new = new.withColumn("_at", at).join(F.broadcast(sizes), "_b").withColumn("id", F.col("_last") + F.col("_before") + F.col("_at"))
    return rows.where("id IS NOT NULL").unionByName(new.select(*rows.columns))


def set_columns(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], nulls: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with the values of ``changes`` for the rows that it names: those that are not null, and of the
    columns ``nulls`` all.  Of changes that repeat a key the one with the largest ``seq`` counts, or any without ``seq``."""
    changes = latest(changes if "seq" in changes.columns else changes.withColumn("seq", F.lit(0)), keys).drop("seq")
    new = changes.withColumn("_changed", F.lit(True)).alias("n")
    both = table.alias("t").join(new, reduce(and_, (F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys)), "left")
    own = [c for c in changes.columns if c not in keys]

    def value(c: str) -> Column:
        if c not in own:
            return F.col(f"t.{c}")
        return (F.when(F.col("_changed"), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")) if c in nulls else F.coalesce(f"n.{c}", f"t.{c}")).alias(c)

    return both.select(*map(value, table.columns))


def set_remote_state(messages: DataFrame, states: DataFrame) -> DataFrame:
    """``messages`` with ``states(id, remote_state, moved_to_folder_id)``; a state without a folder clears it."""
    return set_columns(messages, states, ("id",), nulls=("moved_to_folder_id",))


def set_sync_target(folders: DataFrame, account_id: str, raw_name: str, enabled: bool) -> DataFrame:
    """``folders`` with one of them switched on or off; an error if there is none of that name."""
    named = (F.col("account_id") == account_id) & (F.col("raw_name") == raw_name)
    if folders.where(named).isEmpty():
        raise LookupError(f"account {account_id} has no folder {raw_name!r}")
    return folders.withColumn("is_sync_target", F.when(named, F.lit(enabled)).otherwise(F.col("is_sync_target")))


def normalised_contents(contents: DataFrame) -> DataFrame:
    """Contents as they are stored: each text normalised, and where ``subject_norm`` or ``sender_norm`` is absent or
    null, of ``subject`` or ``sender``."""
    from missive.functions.normalise import normalised

    def given(norm: str, plain: str | None = None) -> Column:
        found = [F.col(c) for c in (norm, plain) if c in contents.columns]
        return normalised(F.coalesce(*found).cast("string")) if found else F.lit(None).cast("string")

    return contents.select(
        "message_id", given("subject_norm", "subject").alias("subject_norm"), given("sender_norm", "sender").alias("sender_norm"),
        given("body_text").alias("body_text"), given("attachment_names").alias("attachment_names"),
    )


def by_key(messages: DataFrame, account_id: str, folder_id: int, uidvalidity: int, uid: int) -> DataFrame:
    """The message with a natural key."""
    here = (F.col("account_id") == account_id) & (F.col("folder_id") == folder_id)
    return messages.where(here & (F.col("uidvalidity") == uidvalidity) & (F.col("uid") == uid))


def known_uids(messages: DataFrame, account_id: str, folder_id: int, uidvalidity: int) -> DataFrame:
    """``uid`` of what is stored of a folder's generation."""
    here = (F.col("account_id") == account_id) & (F.col("folder_id") == folder_id) & (F.col("uidvalidity") == uidvalidity)
    return messages.where(here & F.col("uid").isNotNull()).select("uid")


def exists(messages: DataFrame, account_id: str, message_id: str) -> DataFrame:
    """One row: whether an account has a message of that Message-ID."""
    rows = messages.where((F.col("account_id") == account_id) & (F.col("message_id") == message_id))
    return rows.agg((F.count("*") > 0).alias("found"))


def cursors(max_uids: DataFrame) -> DataFrame:
    """Fresh cursors of a generation from ``folder_id, uidvalidity, max_uid``."""
    top = F.coalesce("max_uid", F.lit(0))
    return max_uids.select(
        "folder_id", "uidvalidity", top.alias("last_seen_uid"), top.alias("backfill_next_uid"), (top == 0).alias("initial_sync_completed"),
        F.lit(None).cast("long").alias("highest_modseq"),
    )


def failures(attempts: DataFrame) -> DataFrame:
    """The failure table from a log of attempts (``FAILURE_KEY``, error_class, at, seq)."""
    return attempts.groupBy(*FAILURE_KEY).agg(
        F.max_by("error_class", "seq").alias("error_class"), F.count("*").alias("attempt_count"),
        F.min("at").alias("first_failed_at"), F.max("at").alias("last_failed_at"),
    )


def without(table: DataFrame, cleared: DataFrame, keys: tuple[str, ...] = FAILURE_KEY) -> DataFrame:
    """``table`` without the rows whose keys ``cleared`` names."""
    return table.join(cleared.select(*keys), list(keys), "left_anti")


def pending(failed: DataFrame) -> DataFrame:
    return failed.where(F.col("attempt_count") < ATTEMPTS)


def first_stored(messages: DataFrame) -> DataFrame:
    """For each account and content hash the path stored first."""
    rows = messages.where("relative_path IS NOT NULL")
    return rows.groupBy("account_id", "file_hash").agg(F.min_by("relative_path", "id").alias("relative_path"), F.min("id").alias("id"))


def canonical_time(text: Column) -> Column:
    """A date with or without a time, a fraction and a zone (UTC without one), parted by a blank, as
    ``YYYY-MM-DDTHH:MM:SSZ``, the fraction cut off; values with a ``T`` and those that are no time stay."""
    form = r"^\s*(\d{4}-\d\d-\d\d)(?: (\d\d:\d\d)(:\d\d)?(?:\.\d+)?)?\s*(Z|[+-]\d\d:\d\d)?\s*$"
    # One pass of the pattern puts a bar before the zone, which no text of the form has.
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def whole(x: Column) -> Column:
        clock, zone = F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)
        return F.concat(clock, F.substr(F.lit("0000-00-00T00:00:00"), F.length(clock) + 1), F.when(zone == "", "Z").otherwise(zone))

    parted = once(F.regexp_replace(text, form, "$1T$2$3|$4"), lambda x: F.when(x != text, whole(x)))
    new = once(F.unix_seconds(F.try_to_timestamp(parted)), utc_seconds)
    return F.when(F.instr(text, "T") == 0, F.coalesce(new, text)).otherwise(text)
