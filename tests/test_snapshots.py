"""The commit log: all of a commit or nothing, only touched buckets, few runs."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from missive.operators import store
from missive.sources import snapshots
from missive.sources.snapshots import Conflict, Snapshots
from missive.streaming import ingest

FIELDS = "id long, account_id string, folder_id long, uid long, flags string, size long"
KEY = ("account_id", "folder_id", "uid")
BY = ("account_id", "folder_id", "uid div 10")


@pytest.fixture
def box(spark, tmp_path):
    rows = spark.range(1, 401).select("id", F.lit("a").alias("account_id"), (F.col("id") % 2).alias("folder_id"), "id", F.lit("old").alias("flags"), (F.col("id") * 3).alias("size")).toDF(*[c.split()[0] for c in FIELDS.split(", ")])
    at = Snapshots(spark, str(tmp_path / "box"))
    commit = at.begin()
    commit.create("messages", rows, BY, 32)
    commit.append("log", rows.select(F.lit("first").alias("line")))
    commit.publish()
    return at


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_commit_is_seen_whole_or_not_at_all(box, spark):
    before, log = content(box.read("messages")), box.read("log").count()
    changes = spark.createDataFrame([("a", 1, 7, "new", 1), ("a", 1, 9999, "fresh", 1)], "account_id string, folder_id long, uid long, flags string, seq long")
    half = box.begin()
    half.append("log", spark.createDataFrame([("second",)], "line string"))
    assert box.read("log").count() == log and content(box.read("messages")) == before
    half.merge("messages", changes, KEY, ids=("id", KEY))
    assert box.read("log").count() == log and content(box.read("messages")) == before
    # The writer stops here; the next one begins anew and its commit has none of what was left.
    again = box.begin()
    again.merge("messages", changes.where("flags = 'new'"), KEY)
    assert again.publish() == 1
    assert box.read("log").count() == log and box.read("messages").where("flags <> 'old'").count() == 1
    assert content(box.read("messages", version=0)) == before


def test_only_touched_buckets_are_read_and_written(box, spark):
    changes = spark.range(101, 105).select(F.lit("a").alias("account_id"), (F.col("id") % 2).alias("folder_id"), F.col("id").alias("uid"), F.lit("seen").alias("flags"), F.lit(1).alias("seq"))
    commit = box.begin()
    before = commit.tables["messages"]["at"]
    touched = commit.merge("messages", changes, KEY, supplied=("flags",), insert=False)
    commit.publish()
    after = box.manifest()["tables"]["messages"]["at"]
    assert 1 <= len(touched) <= 2 and [b for b in range(32) if after[b] != before[b]] == touched
    assert {n for n in box._names("messages/v=1") if n.startswith("bucket")} == {f"bucket={b}" for b in touched}
    got = {r.uid: r.flags for r in box.read("messages").collect()}
    assert len(got) == 400 and all((got[u] == "seen") == (101 <= u < 105) for u in got)
    assert sorted(r.uid for r in box.read("messages", buckets=touched).collect()) != sorted(got)


@pytest.mark.parametrize("most", [200_000, 3])
def test_merges_equal_a_join_of_the_whole_table(box, spark, monkeypatch, most):
    monkeypatch.setattr(snapshots, "SMALL", most)  # few: by a shuffle
    table = box.read("messages")
    rows = [("a", 1, 7, "x", None, 1), ("a", 1, 7, "y", 5, 2), ("a", 0, 8, None, 6, 1), ("b", 0, 8, "z", None, 1), ("a", None, None, "n", 1, 1)]
    changes = spark.createDataFrame(rows, "account_id string, folder_id long, uid long, flags string, size long, seq long")
    commit = box.begin()
    commit.merge("messages", changes, KEY, defaults={"size": 77}, ids=("id", KEY))
    commit.publish()
    want = store.numbered(store.upsert(table, changes, KEY, defaults={"size": 77}), KEY)
    assert content(box.read("messages")) == content(want)
    # Values that are not null, and of one column all.
    commit = box.begin()
    commit.merge("messages", changes.where("account_id = 'a' AND uid = 8"), KEY, insert=False, nulls=("size",))
    commit.publish()
    got = box.read("messages").where("account_id = 'a' AND uid = 8").first()
    assert (got["flags"], got["size"]) == (None, 6)
    # Ids go on from the largest ever given, even when its row is gone.
    last = box.read("messages").agg(F.max("id")).first()[0]
    commit = box.begin()
    commit.remove("messages", box.read("messages").where(F.col("id") == last), KEY)
    commit.publish()
    commit = box.begin()
    commit.merge("messages", spark.createDataFrame([("c", 1, 1, "f", 1, 1)], changes.schema), KEY, ids=("id", KEY))
    commit.publish()
    assert box.read("messages").where("account_id = 'c'").first()["id"] == last + 1 and box.read("messages").where(F.col("id") == last).isEmpty()


def test_of_two_writers_one_fails(box, spark):
    one, two = box.begin(), box.begin()
    one.note("by", "one")
    one.publish()
    with pytest.raises(Conflict):
        two.publish()
    assert box.manifest()["notes"] == {"by": "one"}
    with pytest.raises(LookupError):
        box.read("messages", version=9)


def test_changes_of_nothing_and_of_an_empty_table(spark, tmp_path):
    at = Snapshots(spark, str(tmp_path / "none"))
    empty = spark.createDataFrame([], FIELDS)
    commit = at.begin()
    commit.create("messages", empty, BY, 4)
    commit.publish()
    assert at.read("messages").count() == 0
    commit = at.begin()
    assert commit.merge("messages", empty.drop("id").withColumn("seq", F.lit(1)), KEY) == []
    commit.publish()
    commit = at.begin()
    commit.merge("messages", spark.createDataFrame([("a", 1, 1, "f", 1, 1)], "account_id string, folder_id long, uid long, flags string, size long, seq long"), KEY, ids=("id", KEY))
    with pytest.raises(ValueError):
        commit.remove("messages", at.read("messages"), KEY) or commit.merge("messages", spark.createDataFrame([("a", 1, 1, "f", 1, 1)], "account_id string, folder_id long, uid long, flags string, size long, seq long"), KEY)
    commit.publish()
    assert [r.id for r in at.read("messages").collect()] == [1]


def test_runs_stay_few_and_hold_all(spark, tmp_path):
    at = Snapshots(spark, str(tmp_path / "runs"))
    for i in range(12):
        commit = at.begin()
        commit.add_run("hashes", spark.range(i * 10, i * 10 + 10).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h")), "h")
        commit.publish()
    runs = at.manifest()["tables"]["hashes"]["runs"]
    assert len(runs) <= 4 and sum(n for _, n in runs) == 120 and at.read("hashes").distinct().count() == 120


def test_vacuum_keeps_what_recent_commits_show(box, spark):
    for i in range(4):
        commit = box.begin()
        commit.merge("messages", spark.createDataFrame([("a", 1, 1, f"f{i}", 1)], "account_id string, folder_id long, uid long, flags string, seq long"), KEY)
        commit.publish()
    now = content(box.read("messages"))
    assert snapshots.vacuum(box, keep=2) == 3 and content(box.read("messages")) == now and box.versions() == [3, 4]
    assert box.read("messages", version=3).where("flags = 'f2'").count() == 1


def test_a_stream_that_stops_between_any_two_writes(spark, tmp_path, monkeypatch):
    """Wherever a commit stops, readers see the state before it, and the stream that starts again ends
    as one that never stopped."""
    now = datetime(2026, 7, 31, tzinfo=UTC)
    mail = tmp_path / "mail" / "INBOX"
    mail.mkdir(parents=True)
    for u in range(1, 4):
        (mail / f"{u}.eml").write_bytes(f"Subject: s{u}\r\n\r\nbody {u % 2}".encode())
    start = lambda out: ingest.ingest(spark, str(tmp_path / "mail"), str(tmp_path / out), "a", now, batch=2).awaitTermination()
    start("whole")
    real, left = snapshots.Commit.__dict__.copy(), []

    def stopping(name):
        def call(self, *a, **k):
            if left and left[0] == name:
                raise RuntimeError(f"stop before {name}")
            return real[name](self, *a, **k)

        return call

    for name in ("append", "add_run", "create", "merge", "publish"):
        monkeypatch.setattr(snapshots.Commit, name, stopping(name))
    for step in ("append", "add_run", "create", "publish", "merge"):
        left[:] = [step]
        with pytest.raises(Exception, match="stop before"):
            start("cut")
        at = Snapshots(spark, str(tmp_path / "cut"))
        seen = at.manifest()
        assert seen["version"] == (-1 if step != "merge" else 0)
        if step == "merge":
            assert ingest.messages(spark, at.path).count() == ingest.events(spark, at.path).count() == 2
        left[:] = []
        if step == "publish":
            left[:] = ["merge"]  # the first batch goes through, the second stops
    start("cut")
    for of in (ingest.messages, ingest.events):
        assert content(of(spark, str(tmp_path / "cut"))) == content(of(spark, str(tmp_path / "whole")))
