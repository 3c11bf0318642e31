"""Queries on tables as they are at a larger size: dealt over many files, in any order, with keys far beyond the small ones."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from missive.queries import QUERIES, SQL


def same_as_sql(spark, folder, query: str, table: str) -> list:
    got = sorted(map(tuple, QUERIES[query](spark, folder).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in QUERIES[query](spark, folder).columns)
    assert got == sorted(db.execute(f"SELECT {columns} FROM ({SQL[query]})").fetchall())
    return got


def test_replay_does_not_depend_on_where_events_lie(spark, tmp_path):
    kind = F.element_at(F.array(*map(F.lit, ("click", "view", "purchase", "error"))), (F.col("event_id") % 4 + 1).cast("int"))
    events = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") % 61).alias("user_id"), kind.alias("event_type"))
    events.orderBy(F.rand(5)).repartition(12).sortWithinPartitions(F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = same_as_sql(spark, str(tmp_path), "i22_replay", "events")
    assert len(got) == 61


def test_times_of_large_keys_have_years_of_five_digits(spark, tmp_path):
    keys = spark.range(2_900_000, 9_000_000, 99_991).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.col("id") * 300).cast("timestamp_ntz").alias("o_orderdate"))
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    got = same_as_sql(spark, str(tmp_path), "n3_utc_text", "orders")
    assert {len(at) for _, at, _ in got} == {20, 21}
