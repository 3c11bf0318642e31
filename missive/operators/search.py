"""Search, listing, threads, counts and details over the message model.

Everything is a DataFrame expression: terms are looked up in a trigram index or, without one, are
``contains`` on stored normalised columns; filters sit under the joins; a page is the top ``limit + 1``
rows by (sort key, id), kept in one ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators.pages import states_of
from missive.plans.filters import SORT_KEY, Condition, Page, read_cursor, wanted, write_cursor
from missive.plans.query import SearchPlan, parse_query

TEXT_COLUMNS = ("subject_norm", "sender_norm", "body_text", "attachment_names")
PAGE = 200
#: Folders and failures are dimensions; folders are sent to all executors up to this many.
SMALL_FOLDERS = 100_000
SUMMARY = (
    "id", "account_id", "folder_id", "folder_raw_name", "folder_name", "subject", "sender", "date_sent", "internal_date", "size_bytes", "has_attachment",
    "imap_flags", "flags_seen_at", "local_state", "remote_state", "moved_to_folder_id", "moved_to_folder_name", "thread_key", "failure_class", "uid",
)
DETAIL = (*SUMMARY, "recipient", "cc", "message_id", "in_reply_to", "references_ids", "relative_path", "file_hash")


def sort_key() -> Column:
    return F.coalesce("date_sent", "internal_date", F.lit(""))


def has_term(term: str) -> Column:
    """Whether one of the text columns holds ``term``; bare columns, so that readers can use it."""
    return reduce(or_, (F.contains(F.col(c), F.lit(term)) for c in TEXT_COLUMNS))


def lacks_term(term: str) -> Column:
    return reduce(and_, (F.col(c).isNull() | ~F.contains(F.col(c), F.lit(term)) for c in TEXT_COLUMNS))


def matches(plan: SearchPlan, compat: bool = False) -> Column:
    """Positive terms joined by the plan's mode, less every excluded one.

    ``compat``: as a chain of set operations without brackets reads it, where every exclusion
    after the first adds its rows."""
    found = reduce(or_ if plan.mode == "or" else and_, map(has_term, plan.include))
    if not compat:
        return reduce(and_, map(lacks_term, plan.exclude), found)
    for i, term in enumerate(plan.exclude):
        found = found | has_term(term) if i else found & lacks_term(term)
    return found


def conditions(filters: tuple[Condition, ...]) -> Column:
    """The filter as one condition.  Undated rows fail ``since`` and pass ``until``, whose days end with
    their last second."""
    return reduce(and_, (c.holds() for c in filters), F.lit(True))


def keyed(messages: DataFrame) -> DataFrame:
    """``messages`` with their sort key, which a stored table has, so that its reader is given conditions on it."""
    return messages if SORT_KEY in messages.columns else messages.withColumn(SORT_KEY, sort_key())


def after(cursor: str) -> Column:
    """Rows behind the cursor, in a form that the reader can be given."""
    key, message_id = read_cursor(cursor)
    here = F.col(SORT_KEY)
    return (here < key) | ((here == key) & (F.col("id") < message_id))


def selected(v, filters: tuple[Condition, ...], plan: SearchPlan | None = None, compat: bool = False) -> DataFrame:
    """The messages that pass the filter and, with a plan, whose stored text matches it, by the index if there is one."""
    rows = keyed(v.messages).where(conditions(filters))
    if plan is None:
        return rows
    if v.index is not None:
        from missive.operators.index import found

        ids = found(v.index, plan, compat)
    else:
        ids = v.contents.where(matches(plan, compat)).select(F.col("message_id").alias("found_id"))
    return rows.join(ids, F.col("id") == F.col("found_id"), "left_semi")


def with_names(rows: DataFrame, folders: DataFrame, failures: DataFrame) -> DataFrame:
    """Folder names (messages without a folder go), names of folders moved to, and failures of
    the same account, folder, generation and uid."""
    here = folders.select(F.col("id").alias("f_id"), F.col("raw_name").alias("folder_raw_name"), F.col("display_name").alias("folder_name"))
    there = folders.select(F.col("id").alias("t_id"), F.col("display_name").alias("moved_to_folder_name"))
    bad = failures.select(*(F.col(c).alias(f"x_{c}") for c in ("account_id", "folder_id", "uidvalidity", "uid")), F.col("error_class").alias("failure_class"))
    same = reduce(and_, (F.col(c) == F.col(f"x_{c}") for c in ("account_id", "folder_id", "uidvalidity", "uid")))
    rows = rows.join(here, F.col("folder_id") == F.col("f_id")).join(there, F.col("moved_to_folder_id") == F.col("t_id"), "left")
    return rows.join(bad, same, "left")


def summaries(rows: DataFrame, columns: tuple[str, ...] = SUMMARY) -> DataFrame:
    shown = {"subject": F.coalesce("subject", F.lit("")), "sender": F.coalesce("sender", F.lit(""))}
    return rows.select(*(shown.get(c, F.col(c)).alias(c) for c in columns), sort_key().alias(SORT_KEY))


def page_rows(v, filters: tuple[Condition, ...], plan: SearchPlan | None = None, cursor: str | None = None, limit: int = PAGE, compat: bool = False) -> DataFrame:
    """One page as a DataFrame of at most ``limit`` rows.

    The top rows are taken before the joins where these cannot drop any; folders can only drop
    messages that have none, so the semi join with their ids goes below the limit.  Where messages are stored with a
    directory of their files, a page without terms opens only those that it needs."""
    if limit <= 0:
        raise ValueError("a page has at least one row")
    known = v.folders.select(F.col("id").alias("known_id"))

    def shown(rows: DataFrame) -> DataFrame:
        rows = rows.where(after(cursor)) if cursor else rows
        return rows.join(known, F.col("folder_id") == F.col("known_id"), "left_semi")

    if plan is None and v.directory is not None:
        top = v.directory.top(lambda rows: shown(rows.where(conditions(filters))), cursor, limit)
    else:
        top = shown(selected(v, filters, plan, compat)).orderBy(F.desc(SORT_KEY), F.desc("id")).limit(limit)
    return summaries(with_names(top, v.folders, v.failures))


def deep_page(v, filters: tuple[Condition, ...], offset: int, limit: int = PAGE) -> DataFrame:
    """``id`` and sort key of the page at an offset, or the last full one of fewer rows."""
    states = states_of(filters) if v.directory is not None else None
    if states is None:
        rows = selected(v, filters)
        skip = max(0, min(offset, rows.count() - limit))
    else:
        total = sum(r["states"].get(x, 0) for r in v.directory.files for x in states)
        offset = max(0, min(offset, total - limit))
        rows, before = v.directory.at(states, offset, limit)
        rows, skip = rows.where(conditions(filters)), offset - before
    return rows.select("id", sort_key().alias(SORT_KEY)).orderBy(F.desc(SORT_KEY), F.desc("id")).offset(skip).limit(limit)


def search(v, query: str | None, filters: tuple[Condition, ...] | None = None, cursor: str | None = None, limit: int = PAGE, mode: str = "and", on_plan=None) -> Page:
    """A page of results, or of all messages without a query; ``on_plan`` sees the plan first."""
    plan = parse_query(query, mode) if query is not None else None
    if on_plan and plan:
        on_plan(plan)
    rows = page_rows(v, wanted() if filters is None else filters, plan, cursor, limit + 1)
    got = rows.orderBy(F.desc(SORT_KEY), F.desc("id")).collect()
    last = write_cursor(got[limit - 1][SORT_KEY], got[limit - 1]["id"]) if len(got) > limit else None
    return Page(got[:limit], last, bool(plan and plan.has_slow_path))


def count(v, filters: tuple[Condition, ...] | None = None, plan: SearchPlan | None = None) -> DataFrame:
    """The number of messages; folders are not looked at."""
    return selected(v, wanted() if filters is None else filters, plan).agg(F.count("*").alias("n"))


def thread(v, thread_key: str, filters: tuple[Condition, ...] | None = None) -> DataFrame:
    """All messages of a thread that pass the filter."""
    rows = selected(v, (wanted() if filters is None else filters) + (Condition("thread_key", "is", thread_key),))
    return summaries(with_names(rows, v.folders, v.failures))


def detail(v, message_id: int) -> DataFrame:
    """One message whatever its states."""
    return summaries(with_names(v.messages.where(F.col("id") == message_id), v.folders, v.failures), DETAIL)
