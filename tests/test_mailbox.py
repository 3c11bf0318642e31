"""The mailbox source: round trips, what is listed and opened for a range, streams that stop."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from missive.sources import mailbox

MESSAGES = [("INBOX", u, f"m{u}".encode()) for u in (1, 2, 999, 1000, 1001, 2500, 70_000)] + [
    ("Sent/ü &x", 5, b""), ("..", 6, b"\x00\xff"), ("_a", 7, b"x" * 5000), ("%2E.", 8, b"y"),
]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mail") / "box")
    mailbox.write(spark.createDataFrame(MESSAGES, "raw_name string, uid int, content binary"), path)
    return path


def test_round_trip(spark, root):
    rows = mailbox.read(spark, root).collect()
    assert sorted((r.raw_name, r.uid, bytes(r.content)) for r in rows) == sorted(MESSAGES)
    assert all(r.size_bytes == len(r.content) and r.modified is not None for r in rows)
    assert sorted((r.raw_name, r.uid, r.size_bytes) for r in mailbox.read(spark, f"file://{root}", content=False).collect()) == sorted((n, u, len(c)) for n, u, c in MESSAGES)


def test_ranges_give_what_filters_give(spark, root):
    for asked in (
        {"low": 1000}, {"low": 1000, "high": 2499}, {"names": ["INBOX"], "high": 1000}, {"uids": [2, 6, 70_000, 8]}, {"names": ["..", "_a"]}, {"low": 6, "high": 4},
        {"uids": []}, {"names": []}, {"names": ["none"]}, {"low": -5}, {"uids": [1, 2, 999], "low": 2, "names": ["INBOX"]}, {"high": 0}, {"uids": [0, -1, 2**62]},
    ):
        got = sorted((r.raw_name, r.uid) for r in mailbox.read(spark, root, **asked).collect())
        fits = lambda n, u: asked.get("low", 1) <= u <= asked.get("high", u) and u in asked.get("uids", [u]) and n in asked.get("names", [n])  # noqa: B023, E731
        assert got == sorted((n, u) for n, u, _ in MESSAGES if fits(n, u)), asked


def test_scans_of_one_frame_do_not_mix(spark, root):
    rows = mailbox.read(spark, root)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        both = rows.where("uid > 999").unionByName(rows.where("uid <= 999 AND raw_name = 'INBOX'")).unionByName(rows.where("uid <= 999 AND raw_name <> 'INBOX'"))
        assert sorted((r.raw_name, r.uid) for r in both.collect()) == sorted((n, u) for n, u, _ in MESSAGES)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_range_lists_its_blocks_alone(root):
    reader = mailbox.MailboxReader(mailbox._Files(root, True, 16), mailbox.Wanted(1000, 2400, None, frozenset(["INBOX"])))
    assert [(p.folder, p.blocks) for p in reader.partitions()] == [("INBOX", [2, 1])]
    few = mailbox.MailboxReader(mailbox._Files(root, True, 1), mailbox.Wanted(uids=frozenset([5, 70_000]), names=frozenset(["INBOX"])))
    assert [p.blocks for p in few.partitions()] == [[70], [0]]
    uids = [b.column(1).to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert uids == [[1001, 1000]]  # newest first


def test_what_is_no_message_is_ignored(spark, tmp_path):
    root = tmp_path / "box"
    root.mkdir()
    assert mailbox.read(spark, str(root)).count() == 0
    for at in ("a/0/x.eml", "a/0/.5-f", "a/0/5.txt", "a/0/1500.eml", "a/x/6.eml", "a/7.eml", "_b/0/8.eml", "9.eml", "a/0/12345678901234567890.eml"):
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_bytes(b"?")
    assert mailbox.read(spark, str(root)).count() == 0
    (root / "a/0/9.eml").write_bytes(b"!")
    assert [tuple(r)[:3] for r in mailbox.read(spark, str(root)).collect()] == [("a", 9, 1)]
    with pytest.raises(Exception, match="no mailbox"):
        mailbox.read(spark, str(root / "none")).count()


def test_rows_without_a_place_are_refused(spark, tmp_path):
    for row in (("a", None), (None, 1), ("a", 0), ("", 1)):
        with pytest.raises(Exception, match="a folder"):
            mailbox.write(spark.createDataFrame([(*row, b"x")], "raw_name string, uid long, content binary"), str(tmp_path / "box"))
    mailbox.write(spark.createDataFrame([("a", 1, None)], "raw_name string, uid long, content binary"), str(tmp_path / "box"))
    assert (tmp_path / "box/a/0/1.eml").read_bytes() == b""


def test_batches_are_bounded(tmp_path, monkeypatch):
    at = tmp_path / "a/0"
    at.mkdir(parents=True)
    for uid in range(1, 8):
        (at / f"{uid}.eml").write_bytes(b"x" * 40)
    monkeypatch.setattr(mailbox, "BYTES", 100)
    files = mailbox._Files(str(tmp_path), True, 16)
    (part,) = files.plan({"a": mailbox.Wanted()})
    assert [b.num_rows for b in files.rows(part)] == [2, 2, 2, 1]
    monkeypatch.setattr(mailbox, "ROWS", 3)
    files.content = False
    assert [b.num_rows for b in files.rows(part)] == [3, 3, 1]


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    root, out = str(tmp_path / "box"), str(tmp_path / "out")
    Path(root).mkdir()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 0").selectExpr("source AS raw_name", "doc_id * 20 AS uid", "text AS content")
    last = docs.agg(F.max("uid")).first()[0]
    seen = []
    for low, high in ((0, last // 3), (last // 3, last // 3), (last // 3, last // 2), (last // 2, last)):  # the second time nothing is new
        mailbox.write(docs.where((F.col("uid") > low) & (F.col("uid") <= high)), root)
        query = mailbox.follow(spark, root).writeStream.format("parquet").option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert query.exception() is None
        seen.append(spark.read.schema(mailbox.SCHEMA).parquet(out).count())
    found = spark.read.schema(f"{mailbox.SCHEMA}, content binary").parquet(out).selectExpr("raw_name", "uid", "CAST(content AS string)").collect()
    want = docs.selectExpr("raw_name", "uid", "coalesce(content, '')").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and seen[0] == seen[1] < seen[2] < seen[3]
