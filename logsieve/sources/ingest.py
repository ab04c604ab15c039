"""From log files to canonical events.

Small files are one task's work each; a large one is read in parts (``splits``), whose record numbers are put
together from the counts of the parts before. A gzip stream is decompressed piece by piece, records are numbered
in stream order, normalized, and given on in batches, so memory doesn't grow with the number of records. Damage
ends a file, not the run: what was read before it stays, and the file's outcome says so, whatever went wrong.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.schema import EVENTS, JSON_COLUMNS, LINE_TYPES
from logsieve.sources.detect import detected, opened, read_files
from logsieve.sources.discovery import Candidate, scan_folder
from logsieve.sources.json_stream import documents
from logsieve.sources.mapping import FieldMap
from logsieve.sources.normalize import alb_event, audit_event, json_event
from logsieve.sources.remote import in_tasks
from logsieve.sources.splits import BATCH_ROWS, Footers, Part, line_blocks, parquet_blocks, text_pieces

COLUMNS = [f.split(" ")[0] for f in EVENTS.split(", ")]
#: Columns that are always built: what names an event, and what outcomes are told by.
KEYS = ("event_id", "file_id", "record_index", "log_type")
OUTCOME = "file_status string, file_note string, malformed long"
#: Compressed bytes of a part of a large file.
SPLIT_BYTES = 16 << 20
#: Parts whose offsets are sent to every task; beyond that they are joined by a shuffle.
BROADCAST_PARTS = 200_000

_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "array<string>": pa.list_(pa.string())}


def arrow_schema(columns: str) -> pa.Schema:
    """Of a DDL string of the kinds that are used here."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in columns.split(", "))])


_SCHEMA = arrow_schema(f"{EVENTS}, {OUTCOME}")


def columns_of(rows: list[dict[str, Any]], schema: pa.Schema = _SCHEMA) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


@dataclass
class Outcome:
    """How a file ended: parsed, skipped or failed; ``records`` counts what was stored."""

    status: str = "parsed"
    note: str | None = None
    records: int = 0
    malformed: int = 0

    def row(self, file_id: int, log_type: str) -> dict[str, Any]:
        return {"file_id": file_id, "record_index": self.records, "log_type": log_type, "file_status": self.status, "file_note": self.note, "malformed": self.malformed}


def is_parquet(path: str) -> bool:
    return path.lower().endswith(".parquet")


def by_line(log_type: str) -> bool:
    return log_type == "alb_access" or log_type in LINE_TYPES


def built(columns: list[str] | None) -> str:
    """The canonical columns as DDL: those asked for, and the keys; all if None."""
    if unknown := set(columns or ()) - set(COLUMNS):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    return ", ".join(f for f in EVENTS.split(", ") if columns is None or (name := f.split(" ")[0]) in columns or name in KEYS)


def line_event(line: str | dict[str, Any], log_type: str, wanted: frozenset[str] | None = None) -> dict[str, Any] | None:
    """The event of a line, or None if it is malformed."""
    return alb_event(line, wanted) if log_type == "alb_access" else json_event(line, log_type, wanted)


def read_events(path: str, log_type: str, file: BinaryIO, mapping: FieldMap, outcome: Outcome, part: Part | None = None, wanted: frozenset[str] | None = None, footers: Footers | None = None) -> Iterator[dict[str, Any]]:
    """Events of a file, or of one part of it, in stream order; ``outcome`` is filled in as it goes.

    Only ``wanted`` columns are built. Files that aren't read by line have their first part only.
    """
    part, parquet, lines = part or Part(0, path, 0), is_parquet(path), by_line(log_type)
    if log_type in ("cloudtrail_digest", "config_snapshot") or (parquet and log_type not in LINE_TYPES):
        outcome.status, outcome.note = "skipped", "no supported log records"
        return
    try:
        if lines:
            # Every non-empty line takes a number, malformed ones too.
            i = 0
            for block in parquet_blocks(file, part, footers, parsed=True) if parquet else line_blocks(file, part):
                for line in block:
                    event = line_event(line, log_type, wanted)
                    if event is None:
                        outcome.malformed += 1
                    else:
                        outcome.records += 1
                        event["record_index"] = i
                        yield event
                    i += 1
        elif not part.start:
            for i, record in enumerate(documents(text_pieces(file))):
                outcome.records += 1
                yield audit_event(record, mapping, wanted) | {"record_index": i}
    except (zlib.error, EOFError, ValueError, OSError, RecursionError, pa.ArrowException) as error:
        outcome.note = "damaged: nested too deeply" if isinstance(error, RecursionError) else f"damaged: {error}"
        outcome.status = "failed" if lines or not outcome.records else "parsed"
        return
    if not outcome.records:
        outcome.status, outcome.note = "skipped", "no supported log records"
    elif outcome.malformed:
        outcome.note = f"{outcome.malformed} malformed records"


def file_rows(part: Part, content: bytes | None, mapping: FieldMap, opener: str | None = None, wanted: frozenset[str] | None = None, log_type: str | None = None, footers: Footers | None = None) -> Iterator[dict[str, Any]]:
    """Events of a part, then a row with its outcome. Never fails: a file that can't be opened has an outcome that says so."""
    outcome, file_id = Outcome(), part.file_id
    log_type = log_type or detected(part.path, content, opener).log_type
    shown = "cloudtrail" if log_type == "unknown" else log_type
    try:
        with opened(part.path, content, opener) as file:
            for event in read_events(part.path, log_type, file, mapping, outcome, part, wanted, footers):
                event["event_id"], event["file_id"], event["log_type"] = file_id << 32 | event["record_index"], file_id, shown
                yield event
    except Exception as error:  # such as a file that is gone
        outcome.status, outcome.note = "failed", f"unreadable: {type(error).__name__}"
    yield outcome.row(file_id, log_type)


def batches_of(rows: Iterator[dict[str, Any]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield columns_of(held, schema)
            held = []
    if held:
        yield columns_of(held, schema)


def read_contents(files: DataFrame, overrides: dict[str, list[str]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Events of (file_id, path, content) rows, and a row with ``file_status`` for each file.

    Events have ``event_id = file_id << 32 | record_index`` and null outcome columns. A null content is
    opened by its path in the task. Of the canonical ``columns`` only those asked for (and ``KEYS``) are built.
    """
    mapping, shape = FieldMap(overrides), f"{built(columns)}, {OUTCOME}"
    wanted = None if columns is None else frozenset(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "content")), strict=True):
                yield from batches_of(file_rows(Part(file_id, path, 0), content, mapping, wanted=wanted), arrow_schema(shape))

    return files.select("file_id", "path", "content").mapInArrow(run, shape)


def _source(spark: SparkSession, what: str, files: list[tuple[int, str, int]], split_bytes: int, overrides: dict[str, list[str]] | None, opener: str | None, columns: list[str] | None = None):
    from logsieve.sources.source import reader

    found = reader(spark, opener=opener, overrides=json.dumps(overrides or {}), what=what, outcomes="true", splitBytes=str(split_bytes), files=json.dumps(files))
    return (found if columns is None else found.schema(f"{built(columns)}, {OUTCOME}, part int")).load()


def _in_parts(spark: SparkSession, files: list[tuple[int, str, int]], split_bytes: int, overrides: dict[str, list[str]] | None, opener: str | None, columns: list[str] | None) -> DataFrame:
    """Events and outcomes of large files: their parts are counted first, which costs a decompression.

    Counts give each part its first record number. A file whose parts don't fit together (it is damaged, has one
    member only, or isn't read by line) stays in one piece, but its lines are parsed by all cores: one task reads
    it and hands on blocks of lines.
    """
    from logsieve.sources.source import offsets

    told = _source(spark, "extents", files, split_bytes, None, opener).toArrow().to_pylist()  # a row a part, as many as the planner holds
    starts, whole = offsets(files, told, split_bytes)
    out: list[DataFrame] = []
    if starts:
        numbers = spark.createDataFrame(starts, "file_id long, part int, first long")
        numbers = F.broadcast(numbers) if len(starts) <= BROADCAST_PARTS else numbers
        split = [f for f in files if f[0] not in whole]
        rows = _source(spark, "events", split, split_bytes, overrides, opener, columns).join(numbers, ["file_id", "part"])
        event = F.col("file_status").isNull()
        moved = {c: F.when(event, F.col(c) + F.col("first")).otherwise(F.col(c)) for c in ("record_index", "event_id")}
        out.append(rows.withColumns(moved).select(*[f.split(" ")[0] for f in built(columns).split(", ")], "file_status", "file_note", "malformed"))
    if whole:
        out.append(_by_blocks(spark, [f for f in files if f[0] in whole], overrides, opener, columns))
    return reduce(DataFrame.unionByName, out)


def file_outcomes(rows: DataFrame) -> DataFrame:
    """(file_id, log_type, status, records, malformed, note) of each file, from the outcomes of its parts among ``rows``.

    A file that is damaged has failed, but for an audit trail with records before the damage.
    """
    found = rows.where("file_status is not null").groupBy("file_id").agg(
        F.min("log_type").alias("log_type"), F.sum("record_index").alias("records"), F.sum("malformed").alias("malformed"), F.count("*").alias("parts"),
        F.max(F.col("file_status") == "failed").alias("failed"), F.min(F.when(F.col("file_status") == "failed", F.col("file_note"))).alias("failure"), F.min("file_note").alias("own"),
    )
    kept = F.col("log_type").isin("cloudtrail", "unknown") & (F.col("records") > 0)
    status = F.when(F.col("failed") & ~kept, "failed").when(F.col("records") == 0, "skipped").otherwise("parsed")
    counted = F.when(F.col("records") == 0, "no supported log records").when(F.col("malformed") > 0, F.concat(F.col("malformed"), F.lit(" malformed records")))
    note = F.when(F.col("failed"), F.col("failure")).when(F.col("parts") == 1, F.col("own")).otherwise(counted)
    return found.select("file_id", "log_type", status.alias("status"), "records", "malformed", note.alias("note"))


def _by_blocks(spark: SparkSession, files: list[tuple[int, str, int]], overrides: dict[str, list[str]] | None, opener: str | None, columns: list[str] | None) -> DataFrame:
    """Events and outcomes of files that one task each has to read: lines go to all cores in blocks."""
    blocks = _source(spark, "blocks", files, 0, None, opener)
    cores = spark.sparkContext.defaultParallelism
    mapping, shape = FieldMap(overrides), f"{built(columns)}, {OUTCOME}"
    wanted = None if columns is None else frozenset(columns)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(shape)
        for batch in batches:
            for row in batch.to_pylist():
                if row["file_status"] is not None:  # how the reading ended; the block tells of its lines itself
                    yield columns_of([Outcome(row["file_status"], row["file_note"]).row(row["file_id"], row["log_type"])], schema)
                    continue
                found, bad = [], 0
                for i, line in enumerate(row["lines"]):
                    event = line_event(line, row["log_type"], wanted) if by_line(row["log_type"]) else audit_event(json.loads(line), mapping, wanted)
                    if event is None:
                        bad += 1
                        continue
                    index = row["first"] + i
                    found.append(event | {"record_index": index, "event_id": row["file_id"] << 32 | index, "file_id": row["file_id"], "log_type": "cloudtrail" if row["log_type"] == "unknown" else row["log_type"]})
                if found:
                    yield columns_of(found, schema)
                yield columns_of([Outcome("read", None, len(found), bad).row(row["file_id"], row["log_type"])], schema)

    return blocks.repartition(4 * cores).mapInArrow(parse, shape)


def ingest(spark: SparkSession, candidates: list[Candidate], overrides: dict[str, list[str]] | None = None, split_bytes: int = SPLIT_BYTES, opener: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Events of the candidates, and rows with ``file_status``: one a file as :func:`read_contents` gives it, of files
    larger than ``split_bytes`` one a part. :func:`file_outcomes` puts them together. Of the canonical ``columns`` only
    those asked for (and ``KEYS``) are built."""
    near = [(c.file_id, c.path, c.size) for c in candidates if in_tasks(c.path, opener)]
    far = [(c.file_id, c.path) for c in candidates if not in_tasks(c.path, opener)]
    small, large = [f for f in near if f[2] <= split_bytes], [f for f in near if f[2] > split_bytes]
    out = []
    if small or not (large or far):
        out.append(_source(spark, "events", small, 0, overrides, opener, columns).drop("part"))
    if large:
        out.append(_in_parts(spark, large, split_bytes, overrides, opener, columns))
    if far:
        out.append(read_contents(read_files(spark, far), overrides, columns))
    return reduce(DataFrame.unionByName, out)


def with_companions(events: DataFrame) -> DataFrame:
    """VARIANT companions of the JSON columns, so that rules parse no body again."""
    return events.withColumns({f"{c}_v": F.try_parse_json(c) for c in JSON_COLUMNS})


def ingest_folder(spark: SparkSession, root: str, selected: set[str] | None = None, overrides: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[Candidate]]:
    """All candidates of a folder, or those ``selected`` by path; ids count the whole folder."""
    candidates = [c for c in scan_folder(root).candidates if selected is None or c.path in selected]
    return ingest(spark, candidates, overrides), candidates
