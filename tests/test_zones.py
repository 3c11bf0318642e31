"""Texts of times in UTC are the same whatever the session's time zone is, gaps of summer time included."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from missive import views
from missive.functions import display
from missive.operators import store, sync
from missive.sources import log
from missive.streaming import ingest


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


#: An instant that no clock of New York shows as such, one that it shows twice, and a few others.
TIMES = ["2024-03-10T02:30:00Z", "2024-11-03T01:30:00Z", "2024-02-29T01:02:03Z", "1969-12-31T23:59:59Z", "2026-01-01T00:00:00Z"]


def test_stamps(spark, zone):
    seconds = [int(datetime.fromisoformat(t).timestamp()) for t in TIMES]
    rows = spark.createDataFrame(list(zip(seconds, TIMES, strict=True)), "s long, t string")
    got = rows.select("t", display.utc_seconds(F.col("s")), display.utc_text(F.timestamp_seconds("s")), display.utc_text(display.zoned(F.col("t")))).collect()
    assert all(len(set(r)) == 1 for r in got)
    local = rows.select(display.local_text(F.col("t"), "Asia/Tokyo")).collect()
    assert [r[0] for r in local] == ["2024-03-10 11:30", "2024-11-03 10:30", "2024-02-29 10:02", "1970-01-01 08:59", "2026-01-01 09:00"]


def test_canonical_times_and_paths(spark, zone):
    rows = spark.createDataFrame([(t.replace("T", " ").replace("Z", ""), t) for t in TIMES], "t string, want string")
    got = rows.select("want", store.canonical_time(F.col("t")), display.message_path(F.lit("a"), F.col("t"), F.lit("h" * 64))).collect()
    assert all(r[0] == r[1] and r[2] == f"eml/a/{r[0][:4]}/{r[0][5:7]}/{'h' * 32}.eml" for r in got)


def test_ages_of_flags(spark, zone):
    rows = spark.createDataFrame([("2026-07-01T23:00:00Z", True), ("2026-07-01T23:00:01Z", False), ("2026-07-01 23:00:01", False), ("2026-07-02T08:00:01+09:00", False), (None, True), ("x", True)], "t string, want boolean")
    assert all(r[0] == r[1] for r in rows.select("want", sync.expired(F.col("t"), "2026-07-02T00:00:00Z")).collect())


def test_months_of_the_log(spark, zone, tmp_path):
    rows = [("a", "fetch", 1, "2026-07-31T23:30:00Z"), ("a", "fetch", 2, "2026-08-01T01:00:00+09:00"), ("a", "fetch", 3, "2026-08-01T00:30:00Z")]
    log.write(spark.createDataFrame(rows, "account_id string, event string, uid long, timestamp string"), str(tmp_path / "log"))
    files = {p.parent.name: p.read_text().count("\n") for p in (tmp_path / "log").glob("account=a/*/*.txt")}
    assert {k: v for k, v in files.items()}.keys() == {"month=202607", "month=202608"}


def test_views_and_ingest(spark, zone, tmp_path):
    v = views.views(spark, "/root/testdata/sf0.001")
    got = v.messages.where("id = 1").select("date_sent", "flags_seen_at").first()
    assert tuple(got) == ("2026-07-01T00:01:00Z", "2026-07-01T01:00:00Z")
    (tmp_path / "I").mkdir()
    (tmp_path / "I" / "1.eml").write_bytes(b"Subject: s\r\n\r\nx")
    import os

    os.utime(tmp_path / "I" / "1.eml", (1_709_168_523, 1_709_168_523))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert ingest.outcomes(files, "a", datetime(2026, 8, 1, tzinfo=UTC)).first()["internal_date"] == "2024-02-29T01:02:03Z"
