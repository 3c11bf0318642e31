"""Joins with hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from missive.operators import groups, sync
from missive.sources import files


@pytest.mark.parametrize("most", [200_000, 5])
def test_joins_with_groups(spark, monkeypatch, most):
    monkeypatch.setattr(groups, "SMALL_GROUPS", most)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None, i % 2, i) for i in range(400)]
    table = spark.createDataFrame(rows, "k string, g long, i long").repartition(5)
    each = groups.written(table.groupBy("k", "g").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("k <> 'k3'"), "g")
    got = {(r.k, r.g, r.i, r.first) for r in groups.join_groups(table, each, ["k", "g"]).collect()}
    least: dict = {}
    for k, g, i in rows:
        least[k, g] = min(i, least.get((k, g), i))
    assert got == {(k, g, i, None if k in (None, "k3") else least[k, g]) for k, g, i in rows}
    assert groups.join_groups(table, each, ["k", "g"], how="inner").count() == sum(k not in (None, "k3") for k, _, _ in rows)


@pytest.mark.parametrize("most", [200_000, 2])
def test_a_content_that_most_messages_share(spark, monkeypatch, most):
    monkeypatch.setattr(groups, "SMALL_GROUPS", most)
    rows = [("a", "same" if i % 3 else f"h{i}", i) for i in range(90)] + [("a", None, 90), ("b", "same", 91)]
    incoming = spark.createDataFrame(rows, "account_id string, sha256 string, seq long").repartition(4)
    stored = spark.createDataFrame([("a", "h6"), ("b", "x")], "account_id string, file_hash string")
    got = {r.seq: r.deduplicated for r in files.stored_once(incoming, stored).collect()}
    seen: set = {("a", "h6"), ("b", "x")}
    for a, h, i in rows:
        assert bool(got[i]) == ((a, h) in seen and h is not None), i
        seen.add((a, h))
    kind = "id long, account_id string, folder_id long, uidvalidity long, uid long, content_key string, file_hash string, remote_state string"
    messages = spark.createDataFrame([(i, "a", i % 2 if i < 60 else 5 + i, 1, i, "k" if i < 60 else f"k{i}", "h" if i % 9 else None, "present") for i in range(80)], kind)
    moved = {r.id: (r.candidates, r.remote_state, r.moved_to_folder_id) for r in sync.moves(messages, messages).collect()}
    assert len(moved) == 80
    whole = messages.collect()
    for r in whole:
        others = [o for o in whole if (o.account_id, o.content_key, o.file_hash) == (r.account_id, r.content_key, r.file_hash) and r.file_hash and o.folder_id != r.folder_id]
        assert moved[r.id][0] == len(others) and moved[r.id][1] == ("moved" if len(others) == 1 else "unknown" if others or not r.file_hash else "deleted")
