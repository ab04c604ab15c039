"""Export of a list as JSON lines."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.display import canonical
from logsieve.functions.fields import time_text
from logsieve.functions.schema import FLAG_COLUMNS, JSON_COLUMNS, TEXT_COLUMNS
from logsieve.operators.window import Window, order, within


def export_lines(events: DataFrame, window: Window, matches: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(line) of every row of a list in list order: all fields, bodies as JSON, nulls kept.

    With ``matches`` (of one rule) lines begin with the rule and what matched, and only matched events
    come out; else the window's search applies. With ``files`` events whose file isn't there stay out.
    """
    rows = within(canonical(events), window, searched=matches is None)
    if files is not None:
        rows = rows.join(files.select("file_id"), "file_id", "left_semi")
    head = []
    if matches is not None:
        # Matches hold one row an event, and are the smaller side by far.
        rows = rows.join(matches.select("event_id", "rule_id", F.try_parse_json("matched_fields").alias("matched_fields")), "event_id")
        head = ["rule_id", "matched_fields"]
    bodies = [F.coalesce(F.try_parse_json(c), F.when(F.col(c).isNotNull(), F.to_variant_object(F.struct(F.col(c).alias("text"))))).alias(c) for c in JSON_COLUMNS]
    line = F.to_json(F.struct(*head, "event_id", "log_type", time_text(F.col("event_time")).alias("event_time"), *TEXT_COLUMNS, *FLAG_COLUMNS, *bodies), {"ignoreNullFields": "false"})
    return rows.orderBy(*order(window)).select(line.alias("line"))


def export_file(events: DataFrame, window: Window, path: str, matches: DataFrame | None = None, progress: Callable[[int], bool] | None = None, parallel: bool | None = None) -> int:
    """Write the lines to one file, which appears only when it is complete; returns their number.

    ``parallel`` (default: where tasks reach ``path``, as in a local session or under ``spark.checkpoint.dir``) has
    tasks write ordered parts beside the file and copy each to its place in it; the driver sees names and sizes.
    Else rows come to the driver partition by partition in order. ``progress`` is told the number of lines now and
    then, and stops the export by returning False, which leaves nothing behind.
    """
    spark = events.sparkSession
    if parallel is None:
        shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
        parallel = spark.sparkContext.master.startswith("local") or bool(shared) and os.path.abspath(path).startswith(os.path.abspath(shared) + os.sep)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".export-")
    try:
        if parallel:
            os.close(handle)
            n = _in_place(export_lines(events, window, matches), part, progress)
        else:
            n = _streamed(export_lines(events, window, matches), handle, progress)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return n


def _streamed(lines: DataFrame, handle: int, progress: Callable[[int], bool] | None) -> int:
    n = 0
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        for row in lines.toLocalIterator(prefetchPartitions=True):
            out.write(row.line + "\n")
            n += 1
            if progress and n % 10_000 == 0 and not progress(n):
                raise InterruptedError("the export was stopped")
    return n


def _in_place(lines: DataFrame, target: str, progress: Callable[[int], bool] | None) -> int:
    """Sorted parts, written by tasks, are copied by tasks to their places in ``target``, some parts to a job."""
    spark, staged, n = lines.sparkSession, f"{target}.parts", 0
    try:
        lines.write.text(f"file://{staged}")
        parts = sorted((f for f in os.listdir(staged) if f.startswith("part-")), key=lambda f: int(f.split("-")[1]))  # in order of the sort's ranges
        sizes = [os.path.getsize(f"{staged}/{f}") for f in parts]
        places = [sum(sizes[:k]) for k in range(len(sizes))]
        os.truncate(target, sum(sizes))
        wave = max(1, spark.sparkContext.defaultParallelism) * 4
        for k in range(0, len(parts), wave):
            told = [(f"{staged}/{f}", at) for f, at in zip(parts[k : k + wave], places[k : k + wave], strict=True)]
            rows = spark.createDataFrame(told, "part string, place long").repartition(len(told), "part")
            n += rows.mapInPandas(_copier(target), "lines long").agg(F.sum("lines").alias("n")).first().n or 0
            if progress and not progress(n):
                raise InterruptedError("the export was stopped")
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return n


def _copier(target: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = []
            for part, place in zip(batch.part, batch.place, strict=True):
                lines = 0
                with open(part, "rb") as source, open(target, "r+b") as out:
                    out.seek(place)  # a task that is run again writes the same bytes to the same place
                    while data := source.read(1 << 20):
                        out.write(data)
                        lines += data.count(b"\n")
                counts.append(lines)
            yield pd.DataFrame({"lines": counts})

    return run


def export_folder(events: DataFrame, window: Window, path: str, matches: DataFrame | None = None) -> None:
    """The same lines as a folder of ordered parts, written by the executors: for lists of any size."""
    export_lines(events, window, matches).write.mode("errorifexists").text(path)
