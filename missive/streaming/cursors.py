"""Synchronisation cursors as a stream's state.

The stream's rows are listings of folders.  Each micro-batch takes in whole listings, folds uids to intervals before they are
shuffled, and gives for each folder and generation what is fetched now: new uids (``forward``), and of old ones at most
``most``, newest first (``backfill``).  The cursors are state of the stream: how far forward it has come, and below which uid the
backfill goes on.  A stream that stops goes on from its checkpoint, where a batch that was not committed runs again with
the state that it had, so what is fetched and the cursors are those of a stream that never stopped.  A new generation is a new
key and begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from missive.operators.intervals import _less, _merged, folded

KEYS = ("account_id", "folder_id", "uidvalidity")
STATE = "last_seen_uid long, backfill_next_uid long"
WORK = "account_id string, folder_id long, uidvalidity long, part string, low long, high long, last_seen_uid long, backfill_next_uid long, initial_sync_completed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest(low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``most`` largest numbers of merged intervals, and the largest below them (0 for none)."""
    before = np.cumsum((high - low + 1)[::-1])[::-1] - (high - low + 1)  # numbers above each interval
    take = before < most
    left = most - before[take]
    cut = np.maximum(low[take], high[take] - left + 1)
    rest_low, rest_high = _less(low, high, cut, high[take])
    return cut, high[take], int(rest_high[-1]) if len(rest_high) else 0


class Cursors(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low, high = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in rows:
            low, high = _merged(np.append(low, part["low"].to_numpy(np.int64)), np.append(high, part["high"].to_numpy(np.int64)))
        low, high = _less(low, high, np.array([np.iinfo(np.int64).min + 2]), np.array([0]))
        top = int(high[-1]) if len(high) else 0
        if self.cursor.exists():
            seen, back = self.cursor.get()
        else:
            seen = back = top
        new = _less(low, high, np.array([np.iinfo(np.int64).min + 2]), np.array([seen]))
        old = _less(low, high, np.array([back + 1]), np.array([np.iinfo(np.int64).max - 2]))
        cut_low, cut_high, rest = newest(*old, self.most)
        seen, back = max(seen, top), rest
        self.cursor.update((seen, back))
        parts = [("forward", a, b) for a, b in zip(*new, strict=True)] + [("backfill", a, b) for a, b in zip(cut_low, cut_high, strict=True)]
        parts = parts or [(None, None, None)]  # the cursors are told of folders with nothing to fetch too
        names, lows, highs = zip(*parts, strict=True)
        n = len(parts)
        yield pd.DataFrame({
            "account_id": [key[0]] * n, "folder_id": [key[1]] * n, "uidvalidity": [key[2]] * n, "part": names, "low": pd.array(lows, "Int64"), "high": pd.array(highs, "Int64"),
            "last_seen_uid": [seen] * n, "backfill_next_uid": [back] * n, "initial_sync_completed": [back == 0] * n,
        })

    def close(self) -> None:
        pass


def fetched(listings: DataFrame, most: int = 500) -> DataFrame:
    """``WORK`` of a stream of ``listings(account_id, folder_id, uidvalidity, uid)``: intervals of uids to fetch, or a row
    without one, with the folder's cursors after the batch.  The session's state store is RocksDB's (``PROVIDER``)."""
    rows = folded(listings, KEYS, "uid")
    return rows.groupBy(*KEYS).transformWithStateInPandas(Cursors(most), outputStructType=WORK, outputMode="append", timeMode="none")
