"""Reparsing, small look-ups, requests and the registered queries."""

from __future__ import annotations

import ast
import threading
import time
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from missive.operators import reparse
from missive.operators.requests import Channels
from missive.sources.files import read_messages

ROOT = Path(__file__).resolve().parents[1]


def test_reparse_renews_what_is_verified(spark, tmp_path):
    for name, body in (("a", b"Subject: New\r\n\r\nText"), ("b", b"Subject: x\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n-"), ("c", b"Subject: c\r\n\r\nc")):
        (tmp_path / f"{name}.eml").write_bytes(body)
    files = read_messages(spark, str(tmp_path))
    hashes = {r[0].rpartition("/")[2]: r[1] for r in files.select("path", F.sha2("content", 256)).collect()}
    rows = [(1, "a.eml", hashes["a.eml"].upper(), None), (2, "b.eml", hashes["b.eml"], None), (3, "c.eml", "0" * 64, None), (4, "d.eml", "0" * 64, None)]
    targets = spark.createDataFrame(rows, "id long, relative_path string, file_hash string, internal_date string")
    got = reparse.reparse(targets, files, str(tmp_path), datetime(2026, 7, 31, tzinfo=UTC))
    assert {r.message_id: r.state for r in got.collect()} == {1: "ok", 2: "parse", 3: "mismatch", 4: "missing"}
    assert tuple(reparse.counters(got).first()) == (4, 1, 3, 1, 1, 1)
    old = spark.createDataFrame([(1, "old", "", "old", None), (2, "kept", "", "kept", None)], "message_id long, subject_norm string, sender_norm string, body_text string, attachment_names string")
    assert {r.message_id: (r.subject_norm, r.body_text) for r in reparse.renewed(old, got).collect()} == {1: ("new", "text"), 2: ("kept", "kept")}


def test_look_ups_and_totals(spark):
    folders = spark.createDataFrame([(1, "a", "INBOX"), (2, "b", "INBOX"), (3, "a", "Old")], "id long, account_id string, raw_name string")
    assert reparse.folder_ids(folders, None, None) is None and reparse.folder_ids(folders, None, ("INBOX",)) == (1, 2)
    assert reparse.folder_ids(folders, ("a",), ("INBOX", "None")) == (1,) and reparse.folder_ids(folders, None, ("None",)) == ()
    accounts = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, is_enabled boolean")
    assert {r.id for r in reparse.enabled_accounts(accounts).collect()} == {"a", "c"}
    runs = spark.createDataFrame([(1, 10, 0, 0, False), (2, 20, 1, 1, True)], "fetched long, transferred_bytes long, skipped long, failed long, cancelled boolean")
    assert tuple(reparse.total_results(runs).first()) == (3, 30, 1, 1, True)


def test_a_later_request_stops_the_earlier(spark):
    channels, out = Channels(spark), {}
    slow = spark.range(8).repartition(4).select(F.expr("java_method('java.lang.Thread', 'sleep', 3000L)"))
    first = threading.Thread(target=lambda: out.update(first=channels.run("list", slow.collect)))
    first.start()
    time.sleep(1.5)
    assert channels.run("list", lambda: spark.range(3).count()) == 3
    first.join(30)
    assert out["first"] is None


def test_queries_are_registered_with_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_only_the_entry_module_knows_the_optional_part():
    for path in [*ROOT.glob("missive/*.py"), *ROOT.glob("missive/[!l]*/*.py")]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("missive.llm", "corpus_pipeline")) for n in names), path


def test_core_results_equal_duckdb(spark, tmp_path):
    """A few queries on tables made here, against their SQL."""
    import duckdb

    from missive import queries

    rng = [("the tion of @ report ß", "src7"), ("THE  nothing", "src1"), ("estion the", "src2"), ("ing the tion", "src7")]
    docs = [(i, rng[i % 4][0] + " x" * (i * 37 % 1500), ["en", "de"][i % 2], rng[i % 4][1]) for i in range(1, 240)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = df.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("x_search_match_exclude_two", "o2_first_page", "i16_moves", "i12_flags_delta", "k3_upsert_messages", "s11_reparse_targets"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = duck.sql(queries.SQL[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        left = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
        assert left == sorted(map(repr, want.select(*columns).fetchall())), name


def test_a_repeated_query_name_is_an_error():
    from missive import queries, registry  # noqa: F401  registers them

    with pytest.raises(ValueError, match="already"):
        registry.register("s1_accounts", lambda spark, sf_dir: None, None)


def test_no_query_has_constant_rows_as_its_only_input(spark, monkeypatch, tmp_path):
    """Every query of the core reads a given table: with the tables gone, each fails."""
    from missive import queries, registry  # noqa: F401  registers them

    missing = []
    for name, query in registry.QUERIES.items():
        try:
            query(spark, str(tmp_path / "nothing"))
            missing.append(name)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
    assert missing == []
