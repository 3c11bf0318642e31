"""Whole synchronisation runs on small mailboxes with known answers."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from missive.operators import requests, run, store, sync

REMOTE = "account_id string, folder_id long, folder_raw_name string, uidvalidity long, uid long, size_bytes long"
CURSORS = "folder_id long, uidvalidity long, last_seen_uid long, backfill_next_uid long, initial_sync_completed boolean, highest_modseq long"
FAILED = "account_id string, folder_id long, uidvalidity long, uid long, error_class string, attempt_count long"
OUTCOMES = "account_id string, folder_id long, uidvalidity long, uid long, outcome string, message_id string, content_key string, file_hash string, relative_path string"
STORED = "account_id string, file_hash string"
AT, BIG = "2026-08-01T00:00:00Z", run.MOST_BYTES + 1


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "folder_id long, uidvalidity long, max_uid long")


def box(spark, uids, folder=1, generation=5, size=10):
    return spark.createDataFrame([("a", folder, f"F{folder}", generation, u, size) for u in uids], REMOTE)


def parts(rows) -> dict:
    return {(r.folder_id, r.uid): r.part for r in rows.collect()}


def outcome(spark, *rows):
    return spark.createDataFrame([("a", f, g, u, o, f"<{u}@x>", f"k{u}", h, f"p/{h}") for f, g, u, o, h in rows], OUTCOMES)


def none(spark, kind):
    return spark.createDataFrame([], kind)


def test_a_first_run_then_a_stop_then_the_rest(spark):
    where = listing(spark, (1, 5, 9), (2, 7, 0))
    now = run.started(where, none(spark, CURSORS))
    assert {(r.folder_id, r.last_seen_uid, r.backfill_next_uid, r.initial_sync_completed) for r in now.collect()} == {(1, 9, 9, False), (2, 0, 0, True)}
    remote = box(spark, [2, 4, 8, 9])
    todo = run.work(remote, now, none(spark, FAILED))
    assert parts(todo) == {(1, u): "backfill" for u in (2, 4, 8, 9)}
    stops = spark.createDataFrame([(1, 5, 8)], "folder_id long, uidvalidity long, stop_uid long")
    done = run.reached(todo, stops)
    assert sorted(r.uid for r in done.collect()) == [8, 9]
    got = run.settle(done, outcome(spark, (1, 5, 9, "ok", "h9"), (1, 5, 8, "transient", None)), now, where, none(spark, STORED), AT, stops)
    after = {r.folder_id: (r.last_seen_uid, r.backfill_next_uid, r.initial_sync_completed) for r in got.cursors.collect()}
    assert after == {1: (9, 7, False), 2: (0, 0, True)}
    # Meanwhile 10 and 11 arrive: they are new, the rest is still to be filled in, and 8 is tried again.
    failed = store.failures(got.attempts.withColumn("seq", F.lit(1)))
    where = listing(spark, (1, 5, 11), (2, 7, 0))
    now = run.started(where, got.cursors)
    todo = run.work(box(spark, [2, 4, 8, 9, 10, 11]), now, failed)
    assert parts(todo) == {(1, 2): "backfill", (1, 4): "backfill", (1, 8): "retry", (1, 10): "forward", (1, 11): "forward"}
    all_ok = outcome(spark, *((1, 5, u, "ok", f"h{u}") for u in (2, 4, 8, 10)), (1, 5, 11, "permanent", None))
    got = run.settle(todo, all_ok, now, where, none(spark, STORED), AT)
    assert {r.uid for r in got.messages.collect()} == {2, 4, 8, 10} and {r.uid for r in got.cleared.collect()} == {2, 4, 8, 10}
    assert [(r.uid, r.error_class) for r in got.attempts.collect()] == [(11, "permanent")]
    after = {r.folder_id: (r.last_seen_uid, r.backfill_next_uid, r.initial_sync_completed) for r in got.cursors.collect()}
    assert after == {1: (11, 0, True), 2: (0, 0, True)}  # past the one that failed


def test_a_new_generation_begins_anew(spark):
    known = spark.createDataFrame([(1, 5, 9, 0, True, 77), (3, 5, 4, None, False, None)], CURSORS)
    now = run.started(listing(spark, (1, 6, 3), (3, 5, 6)), known)
    assert {tuple(r) for r in now.collect()} == {(1, 6, 3, 3, False, None), (3, 5, 4, 6, False, None)}
    assert parts(run.work(box(spark, [1, 3], generation=6), now, none(spark, FAILED))) == {(1, 1): "backfill", (1, 3): "backfill"}


def test_failures_that_are_tried_again(spark):
    now = spark.createDataFrame([(1, 5, 9, 0, True, None)], CURSORS)
    remote = box(spark, [1, 2, 3, 9]).union(box(spark, [4], size=BIG)).union(box(spark, [12], size=BIG))
    failed = spark.createDataFrame([("a", 1, 5, 1, "transient", 9), ("a", 1, 5, 2, "parse", 10), ("a", 1, 5, 3, "oversize", 1), ("a", 1, 5, 4, "oversize", 1), ("a", 1, 4, 9, "parse", 1)], FAILED)
    assert parts(run.work(remote, now, failed)) == {(1, 1): "retry", (1, 3): "retry", (1, 12): "forward"}


def test_broken_folders_and_accounts(spark):
    now = spark.createDataFrame([(f, 5, 0, 0, True, None) for f in (1, 2, 3)], CURSORS)
    remote = box(spark, [1], 1).union(box(spark, [1], 2)).union(box(spark, [1], 3).withColumn("account_id", F.lit("b")))
    broken = spark.createDataFrame([("a", 2, "fetch"), ("b", None, "auth")], "account_id string, folder_id long, kind string")
    assert parts(run.work(remote, now, none(spark, FAILED), broken)) == {(1, 1): "forward"}


def test_rows_events_and_duplicates(spark):
    where = listing(spark, (1, 5, 5))
    now = spark.createDataFrame([(1, 5, 0, 0, True, None)], CURSORS)
    todo = run.work(box(spark, [1, 2, 3, 4]).union(box(spark, [5], size=BIG)), now, none(spark, FAILED))
    got = run.settle(todo, outcome(spark, (1, 5, 1, "ok", "h"), (1, 5, 2, "ok", "h"), (1, 5, 3, "ok", "old"), (1, 5, 4, "parse", "bad"), (1, 5, 5, "ok", "big")), now, where, spark.createDataFrame([("a", "old"), ("b", "h")], STORED), AT)
    events = {r.uid: (r.event, r.deduplicated, r.reason, r.file_hash) for r in got.events.collect()}
    assert events == {1: ("fetch", False, None, "h"), 2: ("fetch", True, None, "h"), 3: ("fetch", True, None, "old"), 4: ("fetch", False, None, "bad"), 5: ("fetch_skipped", None, "oversize", None)}
    rows = {r.uid: (r.source_item_key, r.content_key, r.relative_path) for r in got.messages.collect()}
    assert rows[1] == ("5:1", "k1", "p/h") and rows[5] == ("5:5", "uid:5:5", None) and len(rows) == 5
    assert {(r.uid, r.error_class) for r in got.attempts.collect()} == {(4, "parse"), (5, "oversize")}


def test_events_of_moved_and_deleted_messages(spark):
    kind = "id long, account_id string, folder_id long, uidvalidity long, uid long, content_key string, file_hash string, remote_state string"
    messages = spark.createDataFrame([(1, "a", 1, 5, 1, "k", "h", "present"), (2, "a", 2, 5, 9, "k", "h", "present"), (3, "a", 1, 5, 2, "q", "g", "present"), (4, "a", 1, 5, 3, "n", None, "present")], kind)
    gone = sync.missing(messages, messages.where("id = 2"))
    got = {r.uid: (r.event, r.moved_to_folder_id) for r in run.state_events(sync.moves(gone, messages), messages, AT).collect()}
    assert got == {1: ("moved", 2), 2: ("delete_detected", None), 3: ("remote_state_unknown", None)}


def test_how_flags_are_refreshed(spark):
    kind = "folder_id long, uidvalidity long, initial_sync_completed boolean, highest_modseq string, server_modseq long, condstore boolean"
    rows = [(1, 1, False, "5", 9, True), (2, 1, True, None, 9, True), (3, 1, True, "5", 9, True), (4, 1, True, "50", 9, True), (5, 1, True, "5", None, True), (6, 1, True, "5", 9, False), (7, 1, True, "5", 9, True), (8, 1, True, "50", 9, True), (9, 1, True, "bad", 9, True), (10, 1, True, None, None, False)]
    window = spark.createDataFrame([(f, 1, None) for f in range(1, 7)] + [(7, 1, "2026-07-31T23:59:00Z")], "folder_id long, uidvalidity long, flags_seen_at string")
    got = {r.folder_id: (r.path, r.highest_modseq) for r in run.flag_paths(spark.createDataFrame(rows, kind), window, AT).collect()}
    assert got == {1: ("wait", 5), 2: ("baseline", 9), 3: ("delta", 9), 4: ("baseline", 9), 5: ("ttl", None), 6: ("ttl", None), 7: ("none", 5), 8: ("none", None), 9: ("none", None), 10: ("none", None)}


def test_retries_end():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise requests.Transient
        return "done"

    assert requests.with_retry(work, base=0.001) == "done" and len(calls) == 3
    calls.clear()
    with pytest.raises(requests.Transient):
        requests.with_retry(work, retries=1, base=0.001)
    with pytest.raises(ZeroDivisionError):
        requests.with_retry(lambda: 1 / 0)
    stopped = threading.Event()
    stopped.set()
    with pytest.raises(InterruptedError):
        requests.with_retry(work, stopped=stopped)


def test_flag_texts(spark):
    rows = spark.createDataFrame([(["\\Seen", "x"],), ([],)], "f array<string>").withColumn("t", run.flag_text("f"))
    assert [(r.t, r.back) for r in rows.withColumn("back", run.flags_of(F.col("t"))).collect()] == [("\\Seen x", ["\\Seen", "x"]), ("", [])]
