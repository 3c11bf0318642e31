"""Flags as a stream's state: timers for their age, touches that wait, against a plain simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from missive.functions.display import utc_seconds
from missive.operators.sync import PLACE
from missive.sources.snapshots import Snapshots
from missive.streaming import cursors, flags

START, STEP, DAY = 1_790_000_000, 1800, 86_400
SEEN = "account_id string, folder_id long, uidvalidity long, uid long, flags string, internal_date string, at timestamp"


def simulated(rounds, ttl, window, flush, wait):
    """What comes out of each batch; a round is a list of (place, flags, sent, at).  A block is a folder's thousand uids."""
    state: dict = {}
    out: list[set] = []
    watermark = 0

    def timers(now):
        found = set()
        for block in {k[:3] + (k[3] // 1000,) for k in state}:
            mine = {k: v for k, v in state.items() if k[:3] + (k[3] // 1000,) == block}
            if any(v["waits"] and (v["sent"] + window < now or v["waits"] + wait <= now) for v in mine.values()):
                found |= flushed(mine)
            for k, v in mine.items():
                if v["sent"] + window < now:
                    del state[k]
                elif not v["due"] and v["seen"] + ttl <= now:
                    v["due"] = True
                    found.add((*k, "due", v["flags"], v["seen"]))
        return found

    def flushed(mine):
        found = {(*k, "touch", v["flags"], v["seen"]) for k, v in mine.items() if v["waits"]}
        for v in mine.values():
            v["waits"] = 0
        return found

    for rows in rounds:
        found, changed = set(), set()
        latest: dict = {}
        for k, f, sent, at in rows:
            if sent is not None and sent >= at - window and (k not in latest or (at, f or "") > (latest[k][2], latest[k][0] or "")):
                latest[k] = (f, sent, at)
        for k, (f, sent, at) in latest.items():
            old = state.get(k)
            if old and at <= old["seen"]:
                continue
            same = bool(old) and old["flags"] == f
            state[k] = {"flags": f, "seen": at, "sent": sent, "due": False, "waits": ((old["waits"] or at) if same else 0)}
            if not same:
                found.add((*k, "update", f, at))
                changed.add(k[:3] + (k[3] // 1000,))
        for block in {k[:3] + (k[3] // 1000,) for k in latest}:
            mine = {k: v for k, v in state.items() if k[:3] + (k[3] // 1000,) == block}
            if block in changed or sum(v["waits"] > 0 for v in mine.values()) >= flush:
                found |= flushed(mine)
        found |= timers(watermark)
        out.append(found)
        watermark = max([watermark, *(at for *_, at in rows)])
    return out


def test_flags_with_timers(spark, tmp_path):
    """Seven rounds over documents of a given table, stopped after the third; the table that its commits make."""
    docs = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").where("doc_id IS NOT NULL").collect()]
    rounds: list[list] = []
    for i in range(7):
        at = START + i * STEP + (5 * STEP if i == 6 else 0)
        rows = []
        for d in docs:
            if (d + i) % 3 == 0 or (d % 7 == 0 and i):
                continue
            sent = None if d % 11 == 5 else START - 30 * DAY + (d % 20) * 600  # some leave the window meanwhile
            f = None if d % 13 == 0 else ["", "\\Seen"][(d % 5 == 0 and i > 2) or d % 2]
            rows.append((("a", d % 3, 1, d * 37), f, sent, at))
            if d % 17 == 0:  # repeated, and seen otherwise at the same time
                rows += [rows[-1], (("a", d % 3, 1, d * 37), "\\Zz", sent, at)]
        rounds.append(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cursors.PROVIDER)
    source, out, table = (str(tmp_path / n) for n in ("in", "out", "table"))

    def put(rows):
        frame = spark.createDataFrame([(*k, f, sent, at) for k, f, sent, at in rows], "account_id string, folder_id long, uidvalidity long, uid long, flags string, sent long, at_s long")
        frame.select(*PLACE, "flags", utc_seconds(F.col("sent")).alias("internal_date"), F.timestamp_seconds("at_s").alias("at")).coalesce(1).write.mode("append").parquet(source)

    def go():
        write = flags.written_to(table)

        def both(rows, epoch):
            kept = rows.persist()
            kept.write.mode("append").parquet(out)
            write(kept, epoch)
            kept.unpersist()

        seen = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(source)
        query = flags.refreshed(seen, late="0 seconds", flush=20, wait=3000).writeStream.foreachBatch(both)
        query = query.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None

    for i, rows in enumerate(rounds):
        put(rows)
        if i in (2, 6):
            go()
    got = [tuple(r) for r in spark.read.parquet(out).selectExpr(*PLACE, "kind", "imap_flags", "unix_seconds(to_timestamp(flags_seen_at))").collect()]
    # Where the stream stops, timers have a batch without rows.
    want = simulated([*rounds[:3], [], *rounds[3:], []], 3600, 30 * DAY, 20, 3000)
    assert len(got) == len(set(got)) and {r[4] for r in got} == {"update", "touch", "due"}
    assert set(got) == set().union(*want)

    last: dict = {}
    for batch in want:
        for r in sorted((r for r in batch if r[4] != "due"), key=lambda r: (r[6], r[4])):
            last[r[:4]] = r[5:]
    rows = Snapshots(spark, table).read("flags").selectExpr(*PLACE, "imap_flags", "unix_seconds(to_timestamp(flags_seen_at))").collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in rows} == last and len(rows) == len(last)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, 5, "update", "x", "2026-01-01T00:00:00Z")], flags.OUT)
    write = flags.written_to(str(tmp_path / "t"))
    write(rows, 0)
    store = Snapshots(spark, str(tmp_path / "t"))
    before = store.versions()
    write(rows.withColumn("imap_flags", F.lit("y")), 0)
    assert store.versions() == before and store.read("flags").first()["imap_flags"] == "x"
    write(rows.limit(0), 1)
    assert store.manifest()["notes"]["flags_epoch"] == 1 and store.read("flags").count() == 1
