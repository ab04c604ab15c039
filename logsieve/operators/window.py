"""Which events a list asks for: scope, search and keyset paging."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.display import ZONE, shown_time

SEARCHED = ("event_name", "event_source", "identity_arn", "source_ip")
LARGEST_PAGE = 1000
_UNITS = {10: ("%Y-%m-%d", timedelta(days=1)), 16: ("%Y-%m-%d %H:%M", timedelta(minutes=1)), 19: ("%Y-%m-%d %H:%M:%S", timedelta(seconds=1))}


@dataclass(frozen=True)
class Cursor:
    """The last row of a page; ``time_micros`` is None for an event without a time."""

    event_id: int
    time_micros: int | None


@dataclass(frozen=True)
class Window:
    """``start`` and ``stop`` are bounds in the display zone by day, minute or second, both inclusive."""

    after: Cursor | None = None
    limit: int = 200
    search: str = ""
    newest_first: bool = True
    log_type: str | None = None
    start: str | None = None
    stop: str | None = None

    @property
    def size(self) -> int:
        return max(1, min(self.limit, LARGEST_PAGE))

    def next(self, cursor: Cursor) -> Window:
        return replace(self, after=cursor)


def bound(text: str, end: bool = False) -> datetime:
    """The instant a bound stands for, in the display zone; an end is the instant after its unit."""
    text = text.strip()
    form, unit = _UNITS.get(len(text), (None, None))
    try:
        at = datetime.strptime(text, form or "")
        if form is None or at.strftime(form) != text:
            raise ValueError
    except ValueError:
        raise ValueError(f"{text!r} is no date, minute or second") from None
    return at + unit if end else at


def scope(window: Window, columns: list[str]) -> list[Column]:
    """Conditions of log type and time; an event without a time is outside any time bound.

    The bounds are shifted, not the column, so Parquet can prune by them.
    """
    out = []
    if window.log_type is not None:
        out.append(F.col("log_type") == window.log_type if "log_type" in columns else F.lit(window.log_type == "unknown"))
    instant = lambda at: F.lit(str(at)).cast("timestamp_ntz") - F.expr(ZONE)
    if window.start is not None:
        out.append(F.col("event_time") >= instant(bound(window.start)))
    if window.stop is not None:
        out.append(F.col("event_time") < instant(bound(window.stop, end=True)))
    return out


def searches_time(needle: str) -> bool:
    """Whether a needle reads as part of a date or a clock; testing the time text costs a format per row."""
    return bool(re.fullmatch(r"[0-9:. -]+", needle)) and (bool(re.search("[-:]", needle)) or needle.isdigit())


def search(needle: str) -> Column | None:
    """Case-insensitive substring of the searched columns, and of the shown time if it reads as one."""
    if not needle:
        return None
    pattern = F.lit("%" + re.sub(r"([%_\\])", r"\\\1", needle) + "%")
    found = F.lit(False)
    for c in SEARCHED:
        found = found | F.coalesce(F.ilike(F.col(c), pattern, F.lit("\\")), F.lit(False))
    if searches_time(needle):
        found = found | F.coalesce(F.contains(shown_time(F.col("event_time")), F.lit(needle)), F.lit(False))
    return found


def after(window: Window) -> Column | None:
    """Rows behind the cursor in list order, where events without a time come last either way."""
    if window.after is None:
        return None
    step = (lambda a, b: a < b) if window.newest_first else (lambda a, b: a > b)
    later = step(F.col("event_id"), F.lit(window.after.event_id))
    if window.after.time_micros is None:
        return F.col("event_time").isNull() & later
    at = F.timestamp_micros(F.lit(window.after.time_micros)).cast("timestamp_ntz")
    return F.col("event_time").isNull() | step(F.col("event_time"), at) | ((F.col("event_time") == at) & later)


def order(window: Window) -> list[Column]:
    if window.newest_first:
        return [F.col("event_time").desc_nulls_last(), F.col("event_id").desc()]
    return [F.col("event_time").asc_nulls_last(), F.col("event_id").asc()]


def within(events: DataFrame, window: Window, searched: bool = True) -> DataFrame:
    """The events of a window before paging."""
    for c in scope(window, events.columns):
        events = events.where(c)
    found = search(window.search) if searched else None
    return events if found is None else events.where(found)


def page_rows(events: DataFrame, window: Window) -> DataFrame:
    """One page in list order: a top-k, so nothing is sorted as a whole."""
    rows = within(events, window)
    behind = after(window)
    rows = rows if behind is None else rows.where(behind)
    return rows.orderBy(*order(window)).limit(window.size)
