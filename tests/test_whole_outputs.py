"""Queries that show all of their work: the forms that are written and read, and not only that they agree."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from missive.queries import QUERIES, SQL


def rows_of(spark, folder, query: str, table: str, columns: str) -> list:
    got = sorted(map(tuple, QUERIES[query](spark, folder).select(*columns.split(", ")).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT {columns} FROM ({SQL[query]})").fetchall())
    return got


def test_mailbox_names_are_compared_as_they_are_written(spark, tmp_path):
    texts = ["Größe", "A & B", "日本", "x😀y\n", "", "&-", "a\u007f/,é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(spark, str(tmp_path), "n21_mailbox_names", "documents", "doc_id, coded, back, plain")
    assert [r[1] for r in got[:3]] == ["Gr&APYA3w-e", "A &- B", "&ZeVnLA-"] and [r[2] for r in got] == texts


def test_canonical_times_take_every_form(spark, tmp_path):
    days = spark.range(100).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.lit(1_709_164_800) + F.col("id") * 86_400).cast("timestamp_ntz").alias("o_orderdate"))
    days.write.parquet(f"{tmp_path}/orders.parquet")
    got = rows_of(spark, str(tmp_path), "k23_canonical_times", "orders", "o_orderkey, t, other")
    assert got[1][1:] == ("2024-03-01T00:00:00Z", "2024-02-29T15:00:01Z") and got[3][2] == "2024-02-30 00:00:03" and got[2][2] == "2024-03-02T00:00:00Z"
