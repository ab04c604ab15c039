"""Normalizing log lines that are already rows: from text files, tables or streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.schema import EVENTS
from logsieve.sources.ingest import _KINDS, columns_of
from logsieve.sources.mapping import FieldMap
from logsieve.sources.normalize import alb_event, audit_event, json_event

_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in EVENTS.split(", "))])


def normalize_lines(lines: DataFrame, log_type: str, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """Canonical events of (file_id, record_index, line) rows; malformed and null lines give none.

    A line of an audit trail is one record. One narrow pass in Arrow batches, so it runs on a stream as well;
    only a table of fewer splits than the cluster has cores is dealt out first.
    """
    mapping, cores = FieldMap(overrides), lines.sparkSession.sparkContext.defaultParallelism
    lines = lines.select("file_id", "record_index", "line")
    if not lines.isStreaming and lines.rdd.getNumPartitions() < cores:
        lines = lines.repartition(cores)

    def one(line: str):
        if log_type == "alb_access":
            return alb_event(line)
        if log_type != "cloudtrail":
            return json_event(line, log_type)
        try:
            return audit_event(json.loads(line), mapping)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, index, line in zip(*(batch.column(c).to_pylist() for c in ("file_id", "record_index", "line")), strict=True):
                event = one(line) if line else None
                if event is not None:
                    rows.append(event | {"event_id": file_id << 32 | index, "file_id": file_id, "record_index": index, "log_type": log_type})
            yield columns_of(rows, _SCHEMA)

    wanted = lines.select(F.col("file_id").cast("long"), F.col("record_index").cast("long"), F.col("line").cast("string"))
    return wanted.mapInArrow(run, EVENTS)
