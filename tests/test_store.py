"""Upserts, synchronisation, the event log, files and the stream, with known answers."""

from __future__ import annotations

import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from missive.operators import store, sync
from missive.sources import files, log
from missive.streaming import ingest

MESSAGES = "id long, account_id string, folder_id long, uidvalidity long, uid long, source_item_key string, subject string"


def test_upsert_keeps_ids_and_generations(spark):
    table = spark.createDataFrame([(5, "a", 1, 11, 7, "11:7", "old")], MESSAGES)
    rows = [("a", 1, 11, 7, "11:7", "new", 1), ("a", 1, 12, 7, "12:7", "x", 1), ("a", 1, 11, 7, "11:7", "newer", 2), ("a", 1, 11, None, "arc", "kept", 1)]
    changes = spark.createDataFrame(rows, "account_id string, folder_id long, uidvalidity long, uid long, source_item_key string, subject string, seq long")
    got = store.upsert_messages(table, changes)
    by_key = {r.source_item_key: (r.id, r.subject) for r in got.collect()}
    assert by_key["11:7"] == (5, "newer") and {v[0] for v in by_key.values()} == {5, 6, 7}
    again = {r.source_item_key: (r.id, r.subject) for r in store.upsert_messages(got, changes).collect()}
    assert again == by_key


def test_folder_upsert_touches_only_what_is_supplied(spark):
    folders = spark.createDataFrame([("a", "INBOX", "In", True)], "account_id string, raw_name string, display_name string, is_sync_target boolean")
    changes = spark.createDataFrame([("a", "INBOX", "Eingang", False, 1), ("a", "New", "Neu", False, 1)], "account_id string, raw_name string, display_name string, is_sync_target boolean, seq int")
    got = {r.raw_name: (r.display_name, r.is_sync_target) for r in store.upsert(folders, changes, ("account_id", "raw_name"), ("display_name",)).collect()}
    assert got == {"INBOX": ("Eingang", True), "New": ("Neu", False)}


def test_failures_cursors_and_partial_updates(spark):
    log_ = spark.createDataFrame([("a", 1, 11, 7, "transient", "T0", 0), ("a", 1, 11, 7, "permanent", "T1", 1), ("a", 1, 12, 7, "transient", "T2", 2)], "account_id string, folder_id long, uidvalidity long, uid long, error_class string, at string, seq long")
    got = {r.uidvalidity: tuple(r)[4:] for r in store.failures(log_).collect()}
    assert got == {11: ("permanent", 2, "T0", "T1"), 12: ("transient", 1, "T2", "T2")}
    top = spark.createDataFrame([(1, 1, 9), (2, 1, None)], "folder_id long, uidvalidity long, max_uid long")
    assert {r.folder_id: (r.last_seen_uid, r.initial_sync_completed) for r in store.cursors(top).collect()} == {1: (9, False), 2: (0, True)}
    at = spark.createDataFrame([(1, 5, 5)], "folder_id long, last_seen_uid long, backfill_next_uid long")
    new = spark.createDataFrame([(1, 8, None)], "folder_id long, last_seen_uid long, backfill_next_uid long")
    assert tuple(store.set_columns(at, new, ("folder_id",)).first()) == (1, 8, 5)


def test_times_become_canonical(spark):
    rows = spark.createDataFrame([("2026-07-31 12:00:00",), ("2026-07-31T12:04:00Z",), ("odd",), (None,)], "t string")
    assert [r[0] for r in rows.select(store.canonical_time(F.col("t"))).collect()] == ["2026-07-31T12:00:00Z", "2026-07-31T12:04:00Z", "odd", None]


PLACE = "account_id string, folder_id long, uidvalidity long, uid long"


def test_moves_by_number_of_candidates(spark):
    fields = f"id long, {PLACE}, content_key string, file_hash string, remote_state string"
    rows = [(1, "a", 1, 1, 1, "k1", "h1", "present"), (2, "a", 2, 1, 9, "k1", "h1", "present"), (3, "a", 1, 1, 2, "k2", "h2", "present"), (4, "a", 1, 1, 3, "k3", None, "present"),
            (5, "a", 1, 1, 4, "k4", "h4", "present"), (6, "a", 2, 1, 8, "k4", "h4", "present"), (7, "a", 3, 1, 8, "k4", "h4", "present"), (8, "b", 2, 1, 8, "k2", "h2", "present"), (9, "a", 2, 1, 7, "k2", "h2", "deleted")]
    messages = spark.createDataFrame(rows, fields)
    remote = messages.where("folder_id <> 1").select("account_id", "folder_id", "uidvalidity", "uid")
    got = {r.id: (r.candidates, r.remote_state, r.moved_to_folder_id) for r in sync.moves(sync.missing(messages, remote), messages).collect()}
    assert got == {1: (1, "moved", 2), 3: (0, "deleted", None), 4: (0, "unknown", None), 5: (2, "unknown", None)}


def test_flags_by_path(spark):
    window = spark.createDataFrame([(1, "a", 1, 1, 1, "", "2026-07-31T00:00:00Z"), (2, "a", 1, 1, 2, "", "2026-07-31T11:59:00Z"), (3, "a", 1, 1, 3, "", None)], f"id long, {PLACE}, imap_flags string, flags_seen_at string")
    remote = spark.createDataFrame([("a", 1, 1, 1, "\\Seen", 5), ("a", 1, 1, 2, "\\Seen", 50)], f"{PLACE}, flags string, modseq long")
    now = "2026-07-31T12:00:00Z"
    run = lambda *a: {r.id: (r.imap_flags, r.changed) for r in sync.refreshed_flags(window, remote, now, *a).collect()}
    assert run("baseline") == {1: ("\\Seen", True), 2: ("\\Seen", True)}
    assert run("ttl") == {1: ("\\Seen", True)}  # 3 is not listed, 2 was seen lately
    assert run("delta", 10) == {1: ("", False), 2: ("\\Seen", True), 3: ("", False)}
    values = spark.createDataFrame([("5",), ("0",), ("-1",), ("9223372036854775807",), ("9223372036854775808",), ("x",), (None,)], "v string")
    assert [r[0] for r in values.select(sync.valid_modseq(F.col("v"))).collect()] == [5, None, None, 2**63 - 1, None, None, None]


def event(**more) -> dict:
    base = {"event": "moved", "account_id": "a", "folder_id": 1, "uid": 1, "uidvalidity": 1, "timestamp": "2026-07-31T12:00:00Z"}
    return base | more


def test_log_round_trip_and_checksums(spark, tmp_path):
    rows = spark.createDataFrame([event(uid=1), event(uid=2, timestamp="2026-08-01T00:00:00Z"), event(uid=3, account_id="b")])
    log.write(rows, f"{tmp_path}/log")
    assert {p.name for p in tmp_path.glob("log/*/*")} == {"month=202607", "month=202608"}
    line = next(x for p in tmp_path.glob("log/**/part*.txt") for x in p.read_text().splitlines() if '"uid":3' in x)
    text, _, crc = line.rpartition("|CRC32:")
    assert crc == f"{zlib.crc32(text.encode()):08x}" and text.startswith('{"account_id":"b","event":"moved","folder_id":1,')
    got = log.read(spark, f"{tmp_path}/log")
    assert {(r.account_id, r.uid) for r in got.collect()} == {("a", 1), ("a", 2), ("b", 3)}


def test_a_torn_tail_is_dropped_and_a_broken_middle_is_an_error(spark, tmp_path):
    good = spark.createDataFrame([event()]).select(log.line({c: F.col(c) for c in event()})).first()[0]
    (tmp_path / "a.jsonl").write_text(f"{good}\n{good[:40]}")
    assert log.read(spark, f"{tmp_path}/a.jsonl").count() == 1
    assert log.bytes_cut(log.lines_of(spark, f"{tmp_path}/a.jsonl")).first().bytes == 40
    (tmp_path / "b.jsonl").write_text(f"{good}\n{good[:40]}\n{good}\n")
    with pytest.raises(Exception, match="a broken event within"):
        log.read(spark, f"{tmp_path}/b.jsonl").collect()


def test_event_rules(spark):
    full = event(event="fetch", folder_raw_name="I", source_item_key="1:1", relative_path="p", file_hash="h", size_bytes=1, reason="r")
    skipped = full | {"event": "fetch_skipped", "relative_path": None, "file_hash": None}
    rows = [full, skipped, full | {"file_hash": None}, skipped | {"file_hash": "h"}, full | {"event": "x"}, full | {"timestamp": "2026-07-31T12:00:00"}, full | {"timestamp": "soon Z"}]
    types = "event string, account_id string, folder_id long, uid long, uidvalidity long, timestamp string, folder_raw_name string, source_item_key string, relative_path string, file_hash string, size_bytes long, reason string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in types.split(", ")) for r in rows], types)
    assert [r[0] for r in df.select(log.valid()).collect()] == [True, True, False, False, False, False, False]


def test_replay_goes_by_instants_and_then_by_place(spark):
    rows = [event(event="fetch", uid=1, timestamp="2026-01-01T00:00:00+09:00"), event(event="delete_detected", uid=1, timestamp="2025-12-31T20:00:00Z"),
            event(event="moved", uid=2, timestamp="2026-01-01T00:00:00Z") | {"moved_to_folder_id": 4}, event(event="fetch", uid=2, timestamp="2026-01-01T09:00:00+09:00")]
    frame = spark.createDataFrame([(r["account_id"], 1, 1, r["uid"], r["event"], r["timestamp"], None, r.get("moved_to_folder_id"), "f", i) for i, r in enumerate(rows)],
                                  "account_id string, folder_id long, uidvalidity long, uid long, event string, timestamp string, relative_path string, moved_to_folder_id long, file string, place long")
    assert {r.uid: (r.remote_state, r.moved_to_folder_id) for r in log.replay(frame).collect()} == {1: ("deleted", None), 2: ("present", 4)}


def test_a_torn_tail_is_repaired(spark):
    lines = spark.createDataFrame([("a", 1, "broken"), ("a", 2, "torn"), ("b", 1, "torn")], "file string, place long, value string")
    assert {(r.file, r.place) for r in log.repaired(lines).collect()} == {("a", 1)}


def test_folders_and_accounts_have_defaults(spark):
    kind = "id long, account_id string, raw_name string, display_name string, uidvalidity long, is_sync_target boolean, initial_sync_completed boolean, last_synced_at string"
    table = spark.createDataFrame([(7, "a", "Old", "Alt", 3, False, True, "t0")], kind)
    rows = [("a", "Old", None, 4, None, 1), ("a", "New", "Neu", None, None, 1), ("b", "Old", None, 9, "t1", 1)]
    got = store.upsert_folders(table, spark.createDataFrame(rows, "account_id string, raw_name string, display_name string, uidvalidity long, last_synced_at string, seq long"))
    found = {(r.account_id, r.raw_name): tuple(r)[3:] for r in got.collect()}
    assert found == {("a", "Old"): ("Alt", 4, False, True, "t0"), ("a", "New"): ("Neu", None, True, False, None), ("b", "Old"): (None, 9, True, False, "t1")}
    assert sorted(r.id for r in got.collect()) == [7, 8, 9]
    accounts = spark.createDataFrame([("a", 1, False)], "id string, port int, is_enabled boolean")
    got = store.upsert_accounts(accounts, spark.createDataFrame([("a", 2, 1), ("b", None, 1)], "id string, port int, seq long"))
    assert {tuple(r) for r in got.collect()} == {("a", 2, False), ("b", 993, True)}


def test_states_can_be_cleared_and_missing_folders_are_errors(spark):
    messages = spark.createDataFrame([(1, "moved", 4), (2, "moved", 4)], "id long, remote_state string, moved_to_folder_id long")
    states = spark.createDataFrame([(1, "deleted", None)], "id long, remote_state string, moved_to_folder_id long")
    assert {tuple(r) for r in store.set_remote_state(messages, states).collect()} == {(1, "deleted", None), (2, "moved", 4)}
    folders = spark.createDataFrame([("a", "I", True), ("a", "J", True)], "account_id string, raw_name string, is_sync_target boolean")
    assert {tuple(r) for r in store.set_sync_target(folders, "a", "I", False).collect()} == {("a", "I", False), ("a", "J", True)}
    with pytest.raises(LookupError):
        store.set_sync_target(folders, "b", "I", True)


def test_contents_fall_back_to_headers(spark):
    rows = [(1, None, "Ｓｕｂ", "SENDER", "Body\n\nText"), (2, "", "Sub", None, None)]
    got = store.normalised_contents(spark.createDataFrame(rows, "message_id long, subject_norm string, subject string, sender string, body_text string"))
    assert [tuple(r) for r in got.orderBy("message_id").collect()] == [(1, "sub", "sender", "body text", None), (2, "", None, None, None)]


def test_times_are_made_canonical(spark):
    rows = {"2024-02-29 01:02:03": "2024-02-29T01:02:03Z", "2024-02-29 01:02:03.9": "2024-02-29T01:02:03Z", "2024-02-29 01:02": "2024-02-29T01:02:00Z", "2024-02-29": "2024-02-29T00:00:00Z",
            "2024-02-29 01:02:03+09:00": "2024-02-28T16:02:03Z", "2024-02-29 23:30:00 -01:00": "2024-03-01T00:30:00Z", "2024-02-29 01:02:03Z": "2024-02-29T01:02:03Z",
            "2024-02-30 01:02:03": "2024-02-30 01:02:03", "2024-02-29T01:02:03.5+09:00": "2024-02-29T01:02:03.5+09:00", "soon": "soon", "": "", None: None}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select(store.canonical_time(F.col("t"))).collect()
    assert [r[0] for r in got] == list(rows.values())


@pytest.fixture
def mailbox(tmp_path):
    for folder, uids in (("INBOX", (1, 2, 3)), ("Old", (7,))):
        (tmp_path / "mail" / folder).mkdir(parents=True)
        for u in uids:
            (tmp_path / "mail" / folder / f"{u}.eml").write_bytes(f"Message-ID: <{u}@x>\r\nSubject: Ｓｕｂｊｅｃｔ {u}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nBody {u}".encode())
    return tmp_path / "mail"


def test_mailbox_ranges(spark, mailbox):
    (mailbox / "INBOX" / "notes.eml").write_bytes(b"x")
    rows = files.mailbox(spark, str(mailbox), low=2)
    assert {(r.raw_name, r.uid, r.size_bytes == len(r.content)) for r in rows.collect()} == {("INBOX", 2, True), ("INBOX", 3, True), ("Old", 7, True)}
    assert "content" not in files.mailbox(spark, str(mailbox), content=False).columns
    head = files.headers(files.mailbox(spark, str(mailbox), high=1)).first()
    assert b"Body" not in head.head and head.message_id == "<1@x>" and head.size_bytes > len(head.head)
    chunks = files.in_chunks(spark.createDataFrame([("I", i) for i in range(1, 8)], "raw_name string, uid long"), 3)
    assert {r.chunk: r.uids for r in chunks.collect()} == {0: [2, 1], 1: [5, 4, 3], 2: [7, 6]}
    lines = spark.createDataFrame([("* 1 FETCH (UID 5 FLAGS (\\Seen))",), ("* OK",)], "line string")
    assert [(r.uid, r.flags) for r in files.listed(lines).collect()] == [(5, ["\\Seen"])]


def test_files_are_verified_and_stored_once(spark, mailbox):
    stored = files.read_messages(spark, str(mailbox))
    one = stored.where("path LIKE '%/INBOX/1.eml'").select(F.sha2("content", 256)).first()[0]
    wanted = spark.createDataFrame([("INBOX/1.eml", one.upper()), ("INBOX/2.eml", one), ("INBOX/9.eml", one), ("../INBOX/1.eml", one)], "relative_path string, file_hash string")
    assert {r.relative_path: r.state for r in files.verified(stored, wanted, str(mailbox)).collect()} == {"INBOX/1.eml": "ok", "INBOX/2.eml": "mismatch", "INBOX/9.eml": "missing", "../INBOX/1.eml": "outside"}
    incoming = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)], "account_id string, sha256 string, seq long")
    known = spark.createDataFrame([("a", "y")], "account_id string, file_hash string")
    assert {r.seq: r.deduplicated for r in files.stored_once(incoming, known).collect()} == {1: False, 2: True, 3: True, 4: False}
    assert files.read_headers(spark, str(mailbox)).count() == 4
    # A path that ends like the one wanted is another file.
    (mailbox / "b" / "INBOX").mkdir(parents=True)
    (mailbox / "b" / "INBOX" / "1.eml").write_bytes(b"other")
    again = files.verified(files.read_messages(spark, str(mailbox)), wanted.where("relative_path = 'INBOX/1.eml'"), f"file:{mailbox}/").collect()
    assert [r.state for r in again] == ["ok"]
    paths = ["a/b", "a/..b", "/a", "a/../b", "..", "C:x", "a\\..\\b", "", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(files.confined(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, True] + [False] * 7


def test_stream_takes_each_file_once(spark, mailbox, tmp_path):
    now = datetime(2026, 7, 31, tzinfo=UTC)
    (mailbox / "INBOX" / "4.eml").write_bytes(b"Subject: broken\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\nnone")
    out = str(tmp_path / "out")
    ingest.ingest(spark, str(mailbox), out, "a", now, batch=2).awaitTermination()
    got = {(r.folder_raw_name, r.uid): r for r in ingest.messages(spark, out).collect()}
    assert len(got) == 5 and got["INBOX", 2].subject_norm == "subject 2" and got["Old", 7].body_text == "body 7"
    assert got["INBOX", 4].outcome == "parse" and got["INBOX", 4].subject == "broken" and got["INBOX", 4].body_text is None
    (mailbox / "Old" / "8.eml").write_bytes(b"Subject: late\r\n\r\nx")
    ingest.ingest(spark, str(mailbox), out, "a", now, batch=2).awaitTermination()
    assert ingest.messages(spark, out).count() == 6
    events = log.read(spark, f"{out}/log")
    assert events.count() == 6 and events.where("event = 'fetch'").count() == 6


def test_contents_are_stored_once_and_large_files_are_not_opened(spark, mailbox, tmp_path):
    now, out = datetime(2026, 7, 31, tzinfo=UTC), str(tmp_path / "out")
    same = (mailbox / "INBOX" / "1.eml").read_bytes()
    (mailbox / "Old" / "1.eml").write_bytes(same)
    (mailbox / "Old" / "9.eml").write_bytes(b"x" * 5000)
    ingest.ingest(spark, str(mailbox), out, "a", now, batch=10, most_bytes=4000, commit_bytes=2 * len(same)).awaitTermination()
    (mailbox / "Old" / "2.eml").write_bytes(same)
    ingest.ingest(spark, str(mailbox), out, "a", now, batch=10, most_bytes=4000, commit_bytes=2 * len(same)).awaitTermination()
    store_of = spark.read.option("basePath", f"{out}/store").parquet(f"{out}/store")
    assert store_of.count() == store_of.select("file_hash").distinct().count() == 4 and store_of.select("epoch", "part").distinct().count() > 1
    events = {r.folder_raw_name + str(r.uid): (r.event, r.deduplicated, r.file_hash is None) for r in log.read(spark, f"{out}/log").collect()}
    assert events["Old1"] == events["Old2"] == ("fetch", True, False) and events["INBOX1"] == ("fetch", False, False) and events["Old9"] == ("fetch_skipped", None, True)
    assert {r.uid: r.outcome for r in ingest.messages(spark, out).collect() if r.folder_raw_name == "Old"} == {1: "stored", 2: "stored", 7: "stored", 9: "oversize"}
    assert ingest.commits([("a", 3), ("b", 3), ("c", 9), ("d", 1), ("e", 5)], 6) == [["a", "b"], ["c"], ["d", "e"]]


def test_oversize_messages_have_no_contents(spark, mailbox):
    rows = ingest.outcomes(spark.read.format("binaryFile").load(f"{mailbox}/INBOX/*.eml"), "a", datetime(2026, 7, 31, tzinfo=UTC), most_bytes=10)
    assert {(r.outcome, r.body_text) for r in rows.collect()} == {("oversize", None)}


def test_run_statistics(spark):
    rows = spark.createDataFrame([("stored", 5), ("oversize", 100), ("known", 7), ("transient", 1), ("parse", 1)], "outcome string, size_bytes long")
    assert tuple(sync.run_statistics(rows).first()) == (2, 5, 2, 3)
