"""Sets as intervals against plain sets, and replay in steps against replay at once."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.operators import intervals
from missive.sources import log
from missive.sources.snapshots import Snapshots

KEYS = ("account_id", "folder_id")


def sets(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault((r.account_id, r.folder_id), []).append((r.low, r.high))
    return {k: sorted(v) for k, v in out.items()}


def runs(values) -> list:
    out: list = []
    for x in sorted(values):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


@pytest.mark.parametrize(("width", "held"), [(1 << 20, 1 << 16), (16, 20), (7, 1)])
def test_sets_as_intervals(spark, monkeypatch, width, held):
    monkeypatch.setattr(intervals, "WIDTH", width)
    monkeypatch.setattr(intervals, "HELD", held)
    rng = random.Random(width)
    make = lambda: {k: {rng.randint(0, 120) for _ in range(rng.randint(0, 150))} for k in (("a", 1), ("a", 2), ("b", None), (None, 1))}
    left, right = make() | {("only", 1): {5, 6, 7}}, make() | {("right", 1): {1}}
    frame = lambda s: spark.createDataFrame([(*k, x) for k, v in s.items() for x in [*v, *list(v)[:3], None]], "account_id string, folder_id long, uid long").repartition(3)
    a, b = (intervals.intervals(frame(x), KEYS, "uid") for x in (left, right))
    assert sets(a.collect()) == {k: runs(v) for k, v in left.items() if v}
    less = intervals.difference(a, b, KEYS)
    want = {k: v - right.get(k, set()) for k, v in left.items()}
    assert {tuple(r) for r in intervals.spread(less, "uid").collect()} == {(*k, x) for k, v in want.items() for x in v}
    both = {tuple(r) for r in intervals.spread(intervals.intersection(a, b, KEYS), "uid").collect()}
    assert both == {(*k, x) for k, v in left.items() for x in v & right.get(k, set())}


def test_what_is_taken_off_an_interval():
    as_ = lambda *p: tuple(np.array(x, np.int64) for x in zip(*p, strict=True)) if p else (np.empty(0, np.int64),) * 2
    less = lambda a, b: list(zip(*map(np.ndarray.tolist, intervals._less(*as_(*a), *as_(*b))), strict=True))
    assert less([(1, 10)], [(3, 4), (7, 7)]) == [(1, 2), (5, 6), (8, 10)]
    assert less([(1, 10)], [(0, 99)]) == [] and less([(1, 3), (7, 9)], [(3, 7)]) == [(1, 2), (8, 9)] and less([(1, 2)], []) == [(1, 2)]
    assert less([(5, 9)], [(1, 2), (20, 30)]) == [(5, 9)]


def test_a_folder_read_from_end_to_end_is_one_row(spark):
    rows = spark.range(1, 50_001).select(F.lit("a").alias("account_id"), F.lit(1).alias("folder_id"), F.col("id").alias("uid"))
    found = intervals.intervals(rows, KEYS, "uid")
    assert [tuple(r) for r in found.collect()] == [("a", 1, 1, 50_000)]
    assert intervals.intervals(rows.limit(0), KEYS, "uid").collect() == []


EVENT = "account_id string, folder_id long, uidvalidity long, uid long, event string, timestamp string, relative_path string, moved_to_folder_id long"


def test_replay_in_steps_reads_only_what_is_new(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["fetch", "moved", "delete_detected", "remote_state_unknown", "fetch_skipped"]
    rows = []
    for i in range(300):
        kind = rng.choice(kinds)
        minute = rng.randint(0, 500) * 600 + i  # no two instants are equal
        rows.append(("a", rng.randint(1, 2), 1, rng.randint(1, 40), kind, f"2026-07-{1 + minute // 86400:02d}T{minute // 3600 % 24:02d}:{minute // 60 % 60:02d}:{minute % 60:02d}Z", f"p{i}" if kind == "fetch" else None, i if kind == "moved" else None))
    at = Snapshots(spark, str(tmp_path / "log"))
    whole = lambda upto: sorted(map(tuple, log.replay(spark.createDataFrame(rows[:upto], EVENT)).select("account_id", "folder_id", "uidvalidity", "uid", "remote_state", "relative_path", "moved_to_folder_id", "n_events").collect()))
    done = 0
    for upto in (250, 253, 300):
        commit = at.begin()
        commit.append("events", spark.createDataFrame(rows[done:upto], EVENT))
        commit.publish()
        before = at.manifest()["tables"].get("state", {"at": []})["at"]
        log.fold_new(at, "events", "state")
        got = at.read("state").select("account_id", "folder_id", "uidvalidity", "uid", "remote_state", "relative_path", "moved_to_folder_id", "n_events")
        assert sorted(map(tuple, got.collect())) == whole(upto)
        after = at.manifest()["tables"]["state"]["at"]
        if done:
            assert sum(x != y for x, y in zip(before, after, strict=True)) <= 2  # two folders of 40 messages
        done = upto
    # Nothing new changes nothing, and the files of earlier commits are not opened: they may be gone.
    for v in ("0", "2"):
        for f in (tmp_path / "log" / "events" / f"v={v}").glob("*.parquet"):
            f.write_bytes(b"")
    commit = at.begin()
    commit.append("events", spark.createDataFrame([("a", 1, 1, 999, "fetch", "2026-08-01T00:00:00Z", "new", None)], EVENT))
    commit.publish()
    log.fold_new(at, "events", "state")
    assert at.read("state").where("uid = 999").first()["relative_path"] == "new" and at.read("state").count() == len(whole(300)) + 1
