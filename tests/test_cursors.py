"""Cursors as a stream's state: a stream that stops twice ends as one that never stopped."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from missive.operators.intervals import spread
from missive.streaming import cursors


def test_the_newest_of_intervals():
    as_ = lambda *p: tuple(np.array(x, np.int64) for x in zip(*p, strict=True))
    newest = lambda p, n: (list(zip(*(x.tolist() for x in cursors.newest(*as_(*p), n)[:2]), strict=True)), cursors.newest(*as_(*p), n)[2])
    assert newest([(1, 3), (7, 9)], 2) == ([(8, 9)], 7) and newest([(1, 3), (7, 9)], 4) == ([(3, 3), (7, 9)], 2)
    assert newest([(1, 3), (7, 9)], 3) == ([(7, 9)], 3) and newest([(1, 3)], 9) == ([(1, 3)], 0)


def test_a_stream_that_stops_and_goes_on(spark, tmp_path):
    """Listings of documents of given tables; after each the expected work by plain sets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 0")
    rows = docs.select(F.lit("a").alias("account_id"), (F.col("doc_id") % 3).alias("folder_id"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).cast("long").alias("uidvalidity"), F.col("doc_id").alias("uid"))
    last = rows.agg(F.max("uid")).first()[0]
    limits = [last // 3, last // 2, last // 2, last, last]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cursors.PROVIDER)

    def stream(name, upto, at_once):
        out = str(tmp_path / name)
        listings = spark.readStream.schema("account_id string, folder_id long, uidvalidity long, uid long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in"))
        work = cursors.fetched(listings, most=10)
        query = work.writeStream.format("parquet").option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start(out)
        query.awaitTermination()
        assert query.exception() is None

    def listing(name, i, limit):
        rows.where(F.col("uid") <= limit).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))

    for i, limit in enumerate(limits):  # stopped after each listing
        listing("cut", i, limit)
        if i in (0, 2, 4):
            stream("cut", i, False)
    for i, limit in enumerate(limits):
        listing("whole", i, limit)
    stream("whole", 5, True)

    state: dict = {}
    want = set()
    all_rows = [tuple(r) for r in rows.collect()]
    for limit in limits:
        for key in sorted({r[:3] for r in all_rows if r[3] <= limit}):
            uids = sorted(r[3] for r in all_rows if r[:3] == key and r[3] <= limit)
            seen, back = state.get(key, (uids[-1], uids[-1]))
            old = [u for u in uids if u <= back]
            want |= {(*key, "forward", u) for u in uids if u > seen} | {(*key, "backfill", u) for u in old[-10:]}
            state[key] = (max(seen, uids[-1]), old[-11] if len(old) > 10 else 0)
    for name in ("cut", "whole"):
        found = spark.read.schema(cursors.WORK).parquet(str(tmp_path / name))
        got = [tuple(r) for r in spread(found.where("part IS NOT NULL").select(*cursors.KEYS, "part", "low", "high"), "uid").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        ends = found.groupBy(*cursors.KEYS).agg(F.max("last_seen_uid"), F.min("backfill_next_uid")).collect()
        assert {tuple(r)[:3]: tuple(r)[3:] for r in ends} == state
