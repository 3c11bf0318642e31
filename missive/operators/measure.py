"""The folder tree, and the sums, percentiles and extrapolations of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.search import TEXT_COLUMNS


def folder_counts(accounts: DataFrame, folders: DataFrame, messages: DataFrame) -> DataFrame:
    """``account_id, folder_id, display_name, n``: each account's folders and how many messages these hold."""
    counts = messages.groupBy("folder_id").agg(F.count("*").alias("n"))
    rows = accounts.select(F.col("id").alias("account_id")).join(folders.select(F.col("id").alias("folder_id"), "account_id", "display_name"), "account_id")
    return rows.join(counts, "folder_id", "left").select("account_id", "folder_id", "display_name", F.coalesce("n", F.lit(0)).alias("n"))


def folder_tree(accounts: DataFrame, folders: DataFrame) -> DataFrame:
    """``key, parent, kind, display_name, account_id, folder_id``: a root with an entry for all accounts, one for each account, and
    the folders of these.  Folders without an account are left out; blank names fall back to ids."""
    spark = accounts.sparkSession
    named = lambda name, none: F.coalesce(F.nullif(F.trim(name), F.lit("")), none)
    kind = "key string, parent string, kind string, display_name string, account_id string, folder_id long"
    top = spark.createDataFrame([("mail-accounts", None, "root", "Accounts", None, None), ("all-accounts", "mail-accounts", "all_accounts", "All accounts", None, None)], kind)
    shown = F.col("display_name") if "display_name" in accounts.columns else F.lit(None).cast("string")
    some = accounts.select(
        F.concat(F.lit("account:"), "id").alias("key"), F.lit("mail-accounts").alias("parent"), F.lit("account").alias("kind"),
        named(shown, F.col("id")).alias("display_name"), F.col("id").alias("account_id"), F.lit(None).cast("long").alias("folder_id"),
    )
    known = folders.join(accounts.select(F.col("id").alias("known_id")), F.col("account_id") == F.col("known_id"), "left_semi")
    below = known.select(
        F.concat(F.lit("folder:"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("account:"), "account_id").alias("parent"), F.lit("folder").alias("kind"),
        named(F.col("display_name"), F.concat(F.lit("folder-"), F.col("id").cast("string"))).alias("display_name"), "account_id", F.col("id").alias("folder_id"),
    )
    return top.unionByName(some).unionByName(below)


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles of ``value`` as ``p50, p95, …``."""
    found = (F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("long").alias(f"p{round(100 * p)}") for p in shares)
    return rows.groupBy(by).agg(*found)


def payload_bytes(contents: DataFrame) -> DataFrame:
    """One row: the bytes of all searched text columns, and the rows."""
    size: Column = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in TEXT_COLUMNS), F.lit(0))
    return contents.agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))


def extrapolated(rows: DataFrame, by: str, x: str, y: str, at: float) -> DataFrame:
    """The least-squares line of ``y`` over ``x`` at a point, not below zero."""
    line = F.regr_slope(y, x) * at + F.regr_intercept(y, x)
    return rows.groupBy(by).agg(F.round(F.greatest(F.lit(0.0), line), 2).alias(f"at_{at:g}"))
