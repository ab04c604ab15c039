"""Log files as a Spark data source, for batches and for streams.

    spark.dataSource.register(LogSource)
    spark.read.format("cloud_logs").load("/data/logs")
    spark.readStream.format("cloud_logs").load("/data/logs")

Rows are canonical events. A schema of fewer columns builds fewer: ``.schema("event_id long, event_name string")``
never makes a JSON body. With ``pushdown`` (for which ``spark.sql.python.filterPushdown.enabled`` must be true) equality
filters on ``file_id`` and ``log_type`` reach the source: other files aren't opened, or only as far as their type.

A file's id is its place in order of path in a batch, and of arrival (time of change, then path) in a stream, whose
offset is the last file taken, with its number. Options: ``outcomes`` adds a row for each file; ``files`` lists them as
JSON of [id, path, size]; ``splitBytes`` reads large files in parts, whose records are numbered from 0 in each ``part``;
``what`` is events, extents (of parts) or blocks (of lines); ``overrides`` is a field mapping as JSON; ``opener``
opens paths of other file systems.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from logsieve.functions.schema import EVENTS
from logsieve.sources import splits
from logsieve.sources.detect import detected, opened
from logsieve.sources.discovery import is_candidate, is_litter, scan_folder
from logsieve.sources.ingest import OUTCOME, arrow_schema, batches_of, by_line, file_rows, is_parquet
from logsieve.sources.json_stream import documents
from logsieve.sources.mapping import FieldMap
from logsieve.sources.remote import ARROW_SCHEMES, list_arrow, scheme_of
from logsieve.sources.splits import Extent, Part

NAME = "cloud_logs"
EXTENTS = "file_id long, part int, log_type string, begin long, end long, records long, failed boolean"
BLOCKS = "file_id long, log_type string, first long, lines array<string>, file_status string, file_note string"
#: Bytes of the files that one task reads, and of the lines of a block.
TASK_BYTES = 32 << 20
_KINDS = {"bigint": "long", "int": "int", "string": "string", "boolean": "boolean", "timestamp_ntz": "timestamp_ntz", "array<string>": "array<string>"}


def reader(spark: SparkSession, **options: str | None):
    """``spark.read`` of this source with options that aren't None."""
    spark.dataSource.register(LogSource)
    return spark.read.format(NAME).options(**{k: v for k, v in options.items() if v is not None})


def offsets(files: list[tuple[int, str, int]], told: list[dict], split_bytes: int) -> tuple[list[tuple[int, int, int]], set[int]]:
    """((file_id, part, number of its first record) of every part, ids of the files that can't be read in parts)."""
    found = {(t["file_id"], t["part"]): t for t in told}
    starts, whole = [], set()
    for file_id, path, size in files:
        parts = splits.parts_of(file_id, path, size, split_bytes)
        rows = [found.get((file_id, p.number)) for p in parts]
        begun = sum(r is not None and r["begin"] >= 0 for r in rows)
        fits = all(r is not None and not r["failed"] and by_line(r["log_type"]) for r in rows) and begun > 1
        if not fits or not (is_parquet(path) or splits.verified([(p, Extent(r["begin"], r["end"])) for p, r in zip(parts, rows, strict=True)])):
            whole.add(file_id)
            continue
        first = 0
        for p, r in zip(parts, rows, strict=True):
            starts.append((file_id, p.number, first))
            first += r["records"]
    return starts, whole


@dataclass
class LogPartition(InputPartition):
    parts: list[Part]

    def __init__(self, parts: list[Part]):
        super().__init__(None)
        self.parts = parts


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        what = self.options.get("what", "events")
        if what == "extents":
            return EXTENTS
        if what == "blocks":
            return BLOCKS
        return f"{EVENTS}, {OUTCOME}, part int" if self._told() else EVENTS

    def _told(self) -> bool:
        return self.options.get("outcomes", "false").lower() == "true"

    def reader(self, schema: StructType) -> LogReader:
        kind = FilteredReader if self.options.get("pushdown", "false").lower() == "true" else LogReader
        return kind(dict(self.options), schema, self._told())

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(dict(self.options), schema, self._told())


class _Reading:
    """What batches and streams have in common: from parts of files to Arrow batches of the columns asked for."""

    def __init__(self, options: dict[str, str], schema: StructType, told: bool):
        self.options, self.told = {k.lower(): v for k, v in options.items()}, told
        options = self.options
        self.columns = ", ".join(f"{f.name} {_KINDS[f.dataType.simpleString()]}" for f in schema.fields)
        self.wanted = frozenset(f.name for f in schema.fields)
        self.opener, self.overrides = options.get("opener"), json.loads(options.get("overrides") or "{}")
        self.split_bytes = int(options.get("splitbytes", "0"))
        #: By column, the values that a pushed filter leaves.
        self.only: dict[str, set] = {}

    def _planned(self, files: list[tuple[int, str, int]]) -> Sequence[LogPartition]:
        ids = self.only.get("file_id")
        parts = [p for f in files if ids is None or f[0] in ids for p in splits.parts_of(*f, self.split_bytes)]
        most = min(TASK_BYTES, max(1 << 20, sum(min(p.stop, p.size) - p.start for p in parts) // max(1, 3 * (os.cpu_count() or 1))))
        return [LogPartition(ps) for ps in splits.packed(parts, most, open_bytes=256 << 10)] or [LogPartition([])]

    def read(self, partition: LogPartition) -> Iterator[pa.RecordBatch]:
        run = {"events": self._events, "extents": self._extents, "blocks": self._blocks}[self.options.get("what", "events")]
        footers = splits.Footers()
        rows = (row for path, parts in groupby(partition.parts, key=lambda p: p.path) for kind in [detected(path, None, self.opener).log_type] for part in parts for row in run(part, kind, footers))
        yield from batches_of(rows, arrow_schema(self.columns))

    def _events(self, part: Part, kind: str, footers: splits.Footers) -> Iterator[dict]:
        types = self.only.get("log_type")
        if types is not None and ("cloudtrail" if kind == "unknown" else kind) not in types and not self.told:
            return
        for row in file_rows(part, None, FieldMap(self.overrides), self.opener, self.wanted, kind, footers):
            if "file_status" not in row or self.told:
                row["part"] = part.number
                yield row

    def _extents(self, part: Part, kind: str, footers: splits.Footers) -> Iterator[dict]:
        found, failed = Extent(), False
        if by_line(kind):
            try:
                with opened(part.path, None, self.opener) as file:
                    found = splits.extent_of(file, part, is_parquet(part.path), footers)
            except Exception:  # the part is read again with its file, which then tells what is wrong
                failed = True
        yield {"file_id": part.file_id, "part": part.number, "log_type": kind, "begin": found.begin, "end": found.end, "records": found.records, "failed": failed}

    def _blocks(self, part: Part, kind: str, footers: splits.Footers) -> Iterator[dict]:
        """Blocks of lines; records of an audit trail are lines of JSON. The last row tells how the file ended."""
        row, first, end = {"file_id": part.file_id, "log_type": kind}, 0, {"file_status": "read", "file_note": None}
        if kind in ("cloudtrail_digest", "config_snapshot") or (is_parquet(part.path) and not by_line(kind)):
            end = {"file_status": "skipped", "file_note": "no supported log records"}
        else:
            try:
                with opened(part.path, None, self.opener) as file:
                    blocks = _record_blocks(file) if not by_line(kind) else splits.parquet_blocks(file, part, footers) if is_parquet(part.path) else splits.line_blocks(file, part)
                    for block in blocks:
                        yield row | {"first": first, "lines": block}
                        first += len(block)
            except Exception as error:
                end = {"file_status": "failed", "file_note": "damaged: nested too deeply" if isinstance(error, RecursionError) else f"damaged: {error}"}
        yield row | end


def _record_blocks(file) -> Iterator[list[str]]:
    """Records of an audit trail as lines of JSON; those before damage come out before the error."""
    held: list[str] = []
    size = 0
    try:
        for record in documents(splits.text_pieces(file)):
            held.append(json.dumps(record))
            size += len(held[-1])
            if size >= splits.BLOCK_BYTES:
                yield held
                held, size = [], 0
    except Exception:
        if held:
            yield held
        raise
    if held:
        yield held


def local(root: str) -> str:
    return root.removeprefix("file://").removeprefix("file:")


def candidates(root: str) -> list[tuple[int, str, int]]:
    """(id, path, size) of a folder's candidates, on the local disks or where Arrow can list."""
    if scheme_of(root) in ARROW_SCHEMES:
        found = [(p, n) for p, n in list_arrow(root) if n and is_candidate(name := p.rpartition("/")[2]) and not is_litter(name)]
        return [(i, p, n) for i, (p, n) in enumerate(found)]
    return [(c.file_id, c.path, c.size) for c in scan_folder(local(root)).candidates]


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[LogPartition]:
        if "files" in self.options:
            return self._planned([tuple(f) for f in json.loads(self.options["files"])])
        return self._planned(candidates(self.options["path"]))


class FilteredReader(LogReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("file_id", "log_type"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only[name] & values if name in self.only else values
            yield f  # Spark filters the rows once more


class LogStreamReader(_Reading, DataSourceStreamReader):
    """Takes files as they arrive. A file must be complete when it appears, isn't looked at again, and has to stay as
    long as the stream may be restarted: numbers count the files that arrived before."""

    def _arrived(self, after: dict) -> list[tuple[int, str, int]]:
        """(time of change, path, size) of files after an offset, in order of arrival."""
        found = []
        for c in scan_folder(local(self.options["path"])).candidates:
            if (time := os.stat(c.path).st_mtime_ns, c.path) > (after["time"], after["path"]):
                found.append((time, c.path, c.size))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": "", "count": 0}

    def latestOffset(self) -> dict:
        start = self.initialOffset()
        new = self._arrived(start)
        return {"time": new[-1][0], "path": new[-1][1], "count": len(new)} if new else start

    def partitions(self, start: dict, end: dict) -> Sequence[LogPartition]:
        new = [f for f in self._arrived(start) if f[:2] <= (end["time"], end["path"])]
        if len(new) != max(0, end["count"] - start["count"]):
            raise RuntimeError(f"{end['count'] - start['count']} files arrived and {len(new)} are there: files of a stream have to stay")
        return self._planned([(start["count"] + k, path, size) for k, (_, path, size) in enumerate(new)])
