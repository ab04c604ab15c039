"""Pages of a large case from few of its files: bounds of time and id by file, opened in order until the page is sure.

A case's events lie in many Parquet files. ``zones`` has a row for each with the bounds of its times and ids and the
number of events without a time. A page in list order opens the files whose bounds come first, twice as many each
time, and stops when the last row of the page comes before everything that an unopened file could hold. Events
without a time come last in either order, so they are looked at only when all others are on pages before.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.display import canonical
from logsieve.operators import results
from logsieve.operators.window import Window, bound, page_rows

ZONES = "file string, log_type string, rows long, untimed long, first_time timestamp_ntz, last_time timestamp_ntz, first_id long, last_id long"
NARROW = ("event_id", "event_time", "log_type", "event_name", "event_source", "identity_arn", "source_ip")
#: Files that are opened first; and the bounds that are fetched at a time.
FIRST_FILES, FETCHED = 8, 4096


def zones(events: DataFrame) -> DataFrame:
    """The bounds of every file that ``events`` is read from. Two narrow columns are read."""
    names = dict(f.split(" ") for f in ZONES.split(", "))
    found = events.select(F.col("_metadata.file_path").alias("file"), "log_type", "event_id", "event_time").groupBy("file", "log_type").agg(
        F.count("*").alias("rows"), F.count_if(F.col("event_time").isNull()).alias("untimed"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
        F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
    )
    return found.select(*[F.col(c).cast(k).alias(c) for c, k in names.items()])


def _wanted(table: DataFrame, window: Window) -> DataFrame:
    """Files that may hold rows of the page which have a time."""
    nine = F.expr("INTERVAL 9 HOURS")
    rows = table.where("rows > untimed")
    if window.log_type is not None:
        rows = rows.where(F.col("log_type") == window.log_type)
    if window.start is not None:
        rows = rows.where(F.col("last_time") >= F.lit(str(bound(window.start))).cast("timestamp_ntz") - nine)
    if window.stop is not None:
        rows = rows.where(F.col("first_time") < F.lit(str(bound(window.stop, end=True))).cast("timestamp_ntz") - nine)
    if window.after is not None and window.after.time_micros is not None:
        at = F.timestamp_micros(F.lit(window.after.time_micros)).cast("timestamp_ntz")
        rows = rows.where(F.col("first_time") <= at if window.newest_first else F.col("last_time") >= at)
    return rows


def _key(row, newest: bool) -> tuple:
    return (row.event_time, row.event_id) if newest else (-_micros(row.event_time), -row.event_id)


def _micros(at: datetime) -> int:
    return round((at - datetime(1970, 1, 1)).total_seconds() * 1e6)


def page(spark: SparkSession, folder: str, table: DataFrame, schema, window: Window) -> tuple[list[int], list[str]]:
    """(ids of the page's rows in order, files that were opened) of the events in ``folder`` with these zones."""
    newest, size = window.newest_first, window.size
    read = lambda files: canonical(spark.read.schema(schema).option("basePath", folder).parquet(*files)).select(*NARROW)
    outer = "last_time" if newest else "first_time"
    opened, held = [], []
    by = [F.col(outer).desc() if newest else F.col(outer).asc(), F.col("file")]
    untimed_only = window.after is not None and window.after.time_micros is None
    waiting = [] if untimed_only else _wanted(table, window).orderBy(*by).limit(FETCHED).collect()
    more = len(waiting) == FETCHED
    wave = FIRST_FILES
    while waiting:
        now, waiting = waiting[:wave], waiting[wave:]
        wave *= 2
        files = [z.file for z in now]
        opened += files
        rows = page_rows(read(files).where("event_time is not null"), window).select("event_id", "event_time").collect()
        held = sorted(held + rows, key=lambda r: _key(r, newest), reverse=True)[:size]
        if not waiting and more:
            last = now[-1]
            edge = F.lit(getattr(last, outer))
            behind = (F.col(outer) < edge if newest else F.col(outer) > edge) | ((F.col(outer) == edge) & (F.col("file") > last.file))
            waiting = _wanted(table, window).where(behind).orderBy(*by).limit(FETCHED).collect()
            more = len(waiting) == FETCHED
        if len(held) == size and waiting:
            next_time = getattr(waiting[0], outer)
            if held[-1].event_time > next_time if newest else held[-1].event_time < next_time:
                break
    if len(held) < size and window.start is None and window.stop is None:
        rows = table.where("untimed > 0")
        rows = rows if window.log_type is None else rows.where(F.col("log_type") == window.log_type)
        files = [z.file for z in rows.select("file").collect()]
        if files:
            opened += files
            rest = replace(window, after=window.after if untimed_only else None, limit=size - len(held))
            held += page_rows(read(files).where("event_time is null"), rest).select("event_id", "event_time").collect()
    return [r.event_id for r in held], list(dict.fromkeys(opened))


def list_events(spark: SparkSession, folder: str, table: DataFrame, schema, window: Window) -> DataFrame:
    """One page as ``results.list_events`` gives it; wide columns are read from the files that were opened only."""
    ids, files = page(spark, folder, table, schema, window)
    events = spark.read.schema(schema).option("basePath", folder).parquet(*files) if files else spark.read.schema(schema).parquet(folder).limit(0)
    wanted = events.where(F.col("event_id").between(min(ids), max(ids)) & F.col("event_id").isin(ids)) if ids else events.limit(0)
    return results.summarize(wanted).orderBy(*results._shown_order(window)).limit(max(1, len(ids)))
