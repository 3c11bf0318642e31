"""Conditions on messages and page cursors, as values that plans are made of."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime, timedelta
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column that pages are ordered by, beside the id.
SORT_KEY = "sort_key"


class Condition(NamedTuple):
    """``column`` is ``value``, is ``in`` it, or is no less (``from``) or no more (``to``) than it."""

    column: str
    test: str
    value: Any

    def holds(self, columns: dict[str, Column] | None = None) -> Column:
        c = (columns or {}).get(self.column, F.col(self.column))
        if self.test == "in":
            return c.isin(list(self.value)) if self.value else F.lit(False)
        return {"is": c.__eq__, "from": c.__ge__, "to": c.__le__}[self.test](self.value)


#: Names under which ``wanted`` takes values, with the column and the test that each stands for.
CONDITIONS = {
    "accounts": ("account_id", "in"), "folders": ("folder_id", "in"), "local": ("local_state", "in"), "remote": ("remote_state", "in"),
    "since": (SORT_KEY, "from"), "until": (SORT_KEY, "to"), "attachment": ("has_attachment", "is"), "thread": ("thread_key", "is"),
}


def wanted(**given: Any) -> tuple[Condition, ...]:
    """Conditions by the names of ``CONDITIONS``.  ``None`` does not filter, an empty list matches nothing, and
    only active messages are wanted unless ``local`` says otherwise."""
    unknown = given.keys() - CONDITIONS.keys()
    if unknown:
        raise TypeError(f"no condition is called {', '.join(sorted(unknown))}")
    values = {"local": ("active",)} | given
    text = lambda v: utc_text(v) if isinstance(v, datetime) else v
    return tuple(Condition(*CONDITIONS[k], text(v)) for k, v in values.items() if v is not None)


#: A cursor is JSON with these fields of these types: the place of a page's last row.
CURSOR = {"sort_key": str, "message_id": int}


def write_cursor(*place: Any) -> str:
    return json.dumps(dict(zip(CURSOR, place, strict=True)), separators=(",", ":"))


def read_cursor(text: str) -> tuple[str, int]:
    found = json.loads(text)  # what is not JSON is a ValueError too
    if not isinstance(found, dict) or {k: type(v) for k, v in found.items()} != CURSOR:
        raise ValueError(f"a cursor has {' and '.join(CURSOR)} alone, not {text[:80]!r}")
    return tuple(found[k] for k in CURSOR)


def cursor_text(key: Column, message_id: Column) -> Column:
    """The cursor after each row, as ``write_cursor`` writes it."""
    return F.to_json(F.struct(key.cast("string").alias("sort_key"), message_id.cast("long").alias("message_id")))


def cursor_place(text: Column) -> Column:
    """``struct<sort_key, message_id>`` of a cursor; null for what is none."""
    found = F.from_json(text, "sort_key string, message_id bigint", {"mode": "PERMISSIVE"})
    return F.when(found["sort_key"].isNotNull() & found["message_id"].isNotNull(), found)


class Page(NamedTuple):
    """Rows, the cursor of the next page (null after the last), and whether a term was not indexed."""

    items: list
    next_cursor: str | None
    slow: bool

    @property
    def exhausted(self) -> bool:
        return self.next_cursor is None


def day_bounds(since: str | None, until: str | None) -> tuple[datetime | None, datetime | None]:
    """The first and last instant of days written as ``YYYY-MM-DD``, in UTC."""
    first, last = (day and datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC) for day in (since or None, until or None))
    if first and last and first > last:
        raise ValueError("the first day is after the last")
    return first, last and last + timedelta(days=1, microseconds=-1)


def utc_text(value: datetime) -> str:
    """``YYYY-MM-DDTHH:MM:SSZ`` in UTC; a time without a zone is UTC."""
    value = value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)
    return value.strftime("%Y-%m-%dT%H:%M:%SZ")
