"""Flags of messages as a stream's state, with timers for their age.

The stream's rows are observations of flags.  State is held for blocks of a thousand uids, so a folder of any size is many keys and a
key's state is bounded (``waits`` is since when a touch waits, or 0).  What comes out:

``update``  flags that are new or differ from the last ones;
``touch``   flags that were seen again as they were.  A touch only moves a time, so touches wait in the state until ``flush`` of them are
            there, the block has a change to write anyway, or the oldest has waited ``wait`` seconds: a block is rewritten seldom;
``due``     flags that were seen ``ttl`` seconds ago, once the watermark has passed that.  The mailbox is asked for these; one that it does
            not list stays due and untouched, and is not told of again.

Only messages of the last ``window`` days count; older ones leave the state.  An observation that is not later than the state's is
ignored; of several in a batch the latest counts, of equal times the largest flags.  Rows without a place, a time or an internal date are
ignored; null flags are a value.  Which folders are refreshed at all, and by which path, is ``run.flag_paths``'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from missive.functions.display import zoned
from missive.operators.sync import FLAG_TTL_S, FLAG_WINDOW_DAYS, PLACE
from missive.sources.snapshots import Snapshots

#: Uids of a key's state, and touches that wait in it.
BLOCK, FLUSH = 1000, 500
STATE = "uid array<long>, flags array<string>, seen array<long>, sent array<long>, due array<boolean>, waits array<long>, timer long"
TABLE = "account_id string, folder_id long, uidvalidity long, uid long, imap_flags string, flags_seen_at string"
OUT = "account_id string, folder_id long, uidvalidity long, uid long, kind string, imap_flags string, flags_seen_at string"


class Flags(StatefulProcessor):
    def __init__(self, ttl: int, window: int, flush: int, wait: int):
        self.ttl, self.window, self.flush, self.wait = ttl, window, flush, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", STATE)

    def _load(self) -> tuple[pd.DataFrame, int]:
        old = self.block.get() if self.block.exists() else ([], [], [], [], [], [], 0)
        names = ("uid", "flags", "seen", "sent", "due", "waits")
        rows = pd.DataFrame({n: pd.Series(list(v), dtype=object if n == "flags" else bool if n == "due" else np.int64) for n, v in zip(names, old, strict=False)})
        return rows, old[6]

    def _save(self, rows: pd.DataFrame, timer: int) -> None:
        """Keep the rows, with a timer for what happens next to any of them."""
        after = 0
        if len(rows):
            times = [rows["sent"] + self.window + 1, rows.loc[~rows["due"], "seen"] + self.ttl, rows.loc[rows["waits"] > 0, "waits"] + self.wait]
            after = int(min(t.min() for t in times if len(t)))
        if timer and timer != after:
            self.handle.deleteTimer(timer * 1000)
        if after and timer != after:
            self.handle.registerTimer(after * 1000)
        if len(rows):
            self.block.update((*(rows[c].tolist() for c in ("uid", "flags", "seen", "sent", "due", "waits")), after))
        else:
            self.block.clear()

    @staticmethod
    def _out(key: tuple, rows: pd.DataFrame, kind) -> pd.DataFrame:
        n = len(rows)
        seen = np.char.add(np.datetime_as_string(rows["seen"].to_numpy().astype("datetime64[s]"), unit="s"), "Z")
        return pd.DataFrame({
            "account_id": [key[0]] * n, "folder_id": [key[1]] * n, "uidvalidity": [key[2]] * n, "uid": rows["uid"].to_numpy(),
            "kind": kind, "imap_flags": rows["flags"].to_numpy(dtype=object), "flags_seen_at": seen.astype(object),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.DataFrame({"uid": [], "flags": [], "at_s": [], "sent": []})
        for part in rows:  # of any number of observations only the block's last ones are kept
            new = pd.concat([new, part[["uid", "flags", "at_s", "sent"]]]) if len(new) else part[["uid", "flags", "at_s", "sent"]]
            new = new.assign(order=new["flags"].fillna("")).sort_values(["uid", "at_s", "order"]).drop_duplicates("uid", keep="last").drop(columns="order")
        old, timer = self._load()
        both = new.astype({"uid": np.int64}).merge(old, "left", "uid", suffixes=("", "_old"))
        later = both["seen"].isna() | (both["at_s"] > both["seen"])
        both = both[later]
        same = both["seen"].notna() & ((both["flags"] == both["flags_old"]) | (both["flags"].isna() & both["flags_old"].isna()))
        fresh = pd.DataFrame({
            "uid": both["uid"], "flags": both["flags"].astype(object).where(both["flags"].notna(), None), "seen": both["at_s"].astype(np.int64),
            "sent": both["sent"].astype(np.int64), "due": False, "waits": np.where(same, np.where(both["waits"] > 0, both["waits"], both["at_s"]), 0).astype(np.int64),
        })
        kept = old[~old["uid"].isin(fresh["uid"])]
        state = pd.concat([kept, fresh], ignore_index=True) if len(kept) else fresh.reset_index(drop=True)
        changes = fresh[fresh["waits"] == 0]
        if len(changes):
            yield self._out(key, changes, "update")
        if len(changes) or int((state["waits"] > 0).sum()) >= self.flush:
            state = yield from self._flushed(key, state)
        self._save(state, timer)

    def _flushed(self, key, state: pd.DataFrame) -> Iterator[pd.DataFrame]:
        touched = state[state["waits"] > 0]
        if len(touched):
            yield self._out(key, touched, "touch")
        return state.assign(waits=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        state, _ = self._load()
        leaving = state["sent"] + self.window < now
        if ((state["waits"] > 0) & (leaving | (state["waits"] + self.wait <= now))).any():
            state = yield from self._flushed(key, state)
        state = state[~leaving].reset_index(drop=True)
        old = ~state["due"] & (state["seen"] + self.ttl <= now)
        if old.any():
            yield self._out(key, state[old], "due")
        self._save(state.assign(due=state["due"] | old), 0)

    def close(self) -> None:
        pass


def refreshed(
    seen: DataFrame, late: str = "10 minutes", ttl: int = FLAG_TTL_S, window_days: int = FLAG_WINDOW_DAYS, flush: int = FLUSH, wait: int = 600
) -> DataFrame:
    """``OUT`` of a stream of ``seen(account_id, folder_id, uidvalidity, uid, flags, internal_date, at)``, ``at`` being a timestamp and
    ``internal_date`` a text.  Observations may be ``late``.  The session's state store is RocksDB's (``cursors.PROVIDER``)."""
    window = window_days * 86_400
    at, sent = F.unix_seconds("at"), F.unix_seconds(zoned(F.col("internal_date")))
    # The watermark comes first: observations of messages outside the window tell the time too.
    rows = seen.withWatermark("at", late).select(*PLACE, "flags", "at", at.alias("at_s"), sent.alias("sent"), F.expr(f"uid div {BLOCK}").alias("block"))
    rows = rows.where((F.col("sent") >= F.col("at_s") - window) & F.expr(" AND ".join(f"{c} IS NOT NULL" for c in PLACE)))
    keyed = rows.groupBy("account_id", "folder_id", "uidvalidity", "block")
    return keyed.transformWithStateInPandas(Flags(ttl, window, flush, wait), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def written_to(path: str, table: str = "flags"):
    """For ``foreachBatch``: each batch's updates and touches as one commit of the keyed table ``table(account_id, folder_id, uidvalidity,
    uid, imap_flags, flags_seen_at)`` at ``path``, which rewrites only the buckets that they are in.  A batch that runs again after
    its commit was published changes nothing."""

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        store = Snapshots(spark, path)
        if store.manifest()["notes"].get(f"{table}_epoch", -1) >= epoch:
            rows.write.format("noop").mode("overwrite").save()  # the state's version of this batch is still wanted
            return
        commit = store.begin()
        if table not in commit.tables:
            commit.create(table, spark.createDataFrame([], TABLE), ("account_id", "folder_id", f"uid div {BLOCK}"))
            commit.publish()
            commit = store.begin()
        # A uid can have an update and a touch in a batch: the later one, of equal times the update, counts.
        seq = F.struct("flags_seen_at", "kind").alias("seq")
        commit.merge(table, rows.where("kind <> 'due'").select(*PLACE, "imap_flags", "flags_seen_at", seq), PLACE)
        commit.note(f"{table}_epoch", epoch)
        commit.publish()

    return write
