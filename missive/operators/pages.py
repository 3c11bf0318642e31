"""Pages of a stored message table by a directory of its files.

Messages are stored in the order of pages, so each file holds a stretch of it.  The directory says of each file where its
stretch begins and ends and how many rows it has in each state: a row a file, read when a page is asked for.  A page opens
the files from its cursor on, one and then twice as many at a time, until it is full; a page at an offset goes
straight to the file that holds it where the filter is one of states alone.  What is read depends on the page, not on the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.plans.filters import SORT_KEY, Condition, read_cursor


def directory(messages: DataFrame) -> DataFrame:
    """``path, first, last, states`` of each file of a stored table in the order of pages: keys and ids of the first and last row, and
    rows by ``local_state``."""
    key = F.struct(SORT_KEY, "id")
    rows = messages.select(F.col("_metadata.file_path").alias("path"), key.alias("key"), F.coalesce("local_state", F.lit("")).alias("state"))
    each = rows.groupBy("path", "state").agg(F.max("key").alias("first"), F.min("key").alias("last"), F.count("*").alias("n"))
    states = F.map_from_entries(F.collect_list(F.struct("state", "n")))
    return each.groupBy("path").agg(F.max("first").alias("first"), F.min("last").alias("last"), states.alias("states"))


class Directory:
    """A directory in the driver: a row for each file, first file first."""

    def __init__(self, messages: DataFrame, rows: DataFrame):
        self.messages, self.spark = messages, messages.sparkSession
        self.files = sorted(rows.collect(), key=lambda r: tuple(r["first"]), reverse=True)

    def open(self, files: list) -> DataFrame:
        return self.spark.read.schema(self.messages.schema).parquet(*(r["path"] for r in files))

    def top(self, rows_of, cursor: str | None, limit: int) -> DataFrame:
        """The first ``limit`` rows that ``rows_of`` lets through of the messages of as few files as hold them."""
        files = self.files
        if cursor:
            at = read_cursor(cursor)
            files = [r for r in files if tuple(r["last"]) < at]
        take = 1
        while True:
            part = files[:take]
            rows = rows_of(self.open(part) if part else self.messages.limit(0))
            top = rows.orderBy(F.desc(SORT_KEY), F.desc("id")).limit(limit)
            if take >= len(files) or top.select("id").count() == limit:
                return top
            take *= 2

    def at(self, states: tuple[str, ...], offset: int, limit: int) -> tuple[DataFrame, int]:
        """The messages of the files that hold the rows from ``offset`` on, of those in some states, and how many of these
        come before the first of them."""
        before, part, held = 0, [], 0
        for r in self.files:
            n = sum(r["states"].get(s, 0) for s in states)
            if not part and before + n <= offset:
                before += n
                continue
            part.append(r)
            held += n
            if before + held >= offset + limit:
                break
        return (self.open(part) if part else self.messages.limit(0)), before


def states_of(filters: tuple[Condition, ...]) -> tuple[str, ...] | None:
    """The states that a filter asks for if it asks for nothing else."""
    if len(filters) == 1 and filters[0].column == "local_state" and filters[0].test == "in":
        return tuple(filters[0].value)
    return None
