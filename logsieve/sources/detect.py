"""What a log file is, judged by the first part of its content."""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any, BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.sources.json_stream import documents
from logsieve.sources.mapping import rfc3339
from logsieve.sources.normalize import PROTOCOLS, endpoint_host, json_producer
from logsieve.sources.remote import in_tasks, open_ranged

HEAD_BYTES = 256 << 10
MEMBER_SCAN_BYTES = 1 << 20
NOTHING = "no recognized log signature"


@dataclass
class Detection:
    path: str
    log_type: str = "unknown"
    confidence: str = "none"
    records: int | None = None
    estimated: bool = False
    note: str | None = None
    sample_time: str | None = None
    sample_source: str | None = None
    sample_name: str | None = None
    sample_ip: str | None = None


DETECTION = "path string, log_type string, confidence string, records long, estimated boolean, note string, sample_time string, sample_source string, sample_name string, sample_ip string"


def gunzip(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Decompressed pieces of all members of a stream; raises zlib.error or EOFError where it is damaged."""
    unzip, started = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            if unzip.eof:
                if not chunk.strip(b"\0"):
                    break
                unzip, started = zlib.decompressobj(31), False
            data = unzip.decompress(chunk, 1 << 20)
            started = True
            chunk = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if data:
                yield data
    if started and not unzip.eof:
        raise EOFError("the compressed stream ends too early")


def pieces(file: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    file.seek(0)
    while chunk := file.read(size):
        yield chunk


def head_of(file: BinaryIO) -> tuple[bytes, bool, bool]:
    """(first decompressed bytes, whether more follow, whether the stream is damaged)."""
    out = b""
    try:
        for data in gunzip(pieces(file, 64 << 10)):
            out += data
            if len(out) >= HEAD_BYTES:
                return out[:HEAD_BYTES], True, False
    except (zlib.error, EOFError):
        return out, False, True
    return out, False, False


def _alb_sample(line: str) -> tuple[str, str] | None:
    parts = line.split(None, 4)
    if len(parts) < 4 or parts[0] not in PROTOCOLS or rfc3339(parts[1]) is None or not parts[2].startswith("app/"):
        return None
    host = endpoint_host(parts[3])
    return None if host is None else (parts[1], host)


def _sample(d: Detection, record: Any) -> Detection:
    if isinstance(record, dict):
        text = lambda k: record[k] if isinstance(record.get(k), str) else None
        d.sample_time, d.sample_source, d.sample_name, d.sample_ip = text("eventTime"), text("eventSource"), text("eventName"), text("sourceIPAddress")
    return d


def _document(path: str, value: Any) -> Detection:
    if not isinstance(value, dict):
        return Detection(path, note=NOTHING)
    if "digestPublicKeyFingerprint" in value and "logFiles" in value:
        return Detection(path, "cloudtrail_digest", "high")
    if isinstance(items := value.get("configurationItems"), list):
        return Detection(path, "config_snapshot", "high", len(items))
    if isinstance(records := value.get("Records"), list):
        found = Detection(path, "cloudtrail", "high", len(records))
        if not records:
            return found
        first = records[0] if isinstance(records[0], dict) else {}
        if all(k in first for k in ("eventVersion", "eventSource", "eventTime")):
            return _sample(found, first)
        found.confidence = "low"
        return found
    return Detection(path, note=NOTHING)


def classify(path: str, head: bytes, cut: bool) -> Detection:
    """In this order: a load balancer's line anywhere, a JSON record on the first line, a JSON document, part of one."""
    text = head.decode("utf-8", "replace")
    lines = text.splitlines()
    balancer = [s for line in lines if (s := _alb_sample(line))]
    if balancer:
        return Detection(path, "alb_access", "high", len(balancer), cut, sample_time=balancer[0][0], sample_source="elasticloadbalancing.amazonaws.com", sample_ip=balancer[0][1])
    try:
        producer = json_producer(json.loads(lines[0])) if lines else None
    except (ValueError, RecursionError):
        producer = None
    if producer:
        return Detection(path, producer, "high", sum(line.startswith("{") for line in lines), cut)
    decoder = json.JSONDecoder()
    try:
        return _document(path, decoder.raw_decode(text.lstrip())[0])
    except RecursionError:
        return Detection(path, note="nested too deeply")
    except ValueError:
        pass
    try:  # the document is cut: its first record may still be whole
        record = next(documents(iter([text])), None)
    except (ValueError, RecursionError):
        record = None
    if isinstance(record, dict) and "eventVersion" in record:
        return _sample(Detection(path, "cloudtrail", "high", text.count('"eventVersion"'), cut), record)
    return Detection(path, note=NOTHING)


def detect_parquet(path: str, file: BinaryIO) -> Detection:
    """By the footer and the first row."""
    import pyarrow.parquet as pq

    try:
        table = pq.ParquetFile(file, buffer_size=64 << 10)  # pages are fetched as they are needed, not whole row groups
        first = next(table.iter_batches(1)).to_pylist() if table.metadata.num_rows else []
    except Exception as error:  # a damaged file is a finding, not a failure
        return Detection(path, note=f"unreadable Parquet: {type(error).__name__}")
    producer = json_producer(first[0]) if first else None
    return Detection(path, producer, "high", table.metadata.num_rows) if producer else Detection(path, note=NOTHING)


def detect(path: str, file: BinaryIO) -> Detection:
    """Never fails: damage and foreign content come out as ``unknown`` with a note. Reads the file's ends only."""
    length = file.seek(0, io.SEEK_END)
    file.seek(0)
    start = file.read(4)
    if path.lower().endswith(".parquet"):
        return detect_parquet(path, file) if start == b"PAR1" else Detection(path, note="not a Parquet file")
    if start[:2] != b"\x1f\x8b" or length < 18:
        return Detection(path, note="not gzip" if length >= 2 else "too short")
    head, cut, damaged = head_of(file)
    if not head:
        return Detection(path, note="damaged gzip")
    found = classify(path, head, cut)
    if cut and found.records:
        file.seek(0)
        members = file.read(MEMBER_SCAN_BYTES).count(b"\x1f\x8b\x08")
        file.seek(-4, io.SEEK_END)
        size = int.from_bytes(file.read(4), "little")  # of the last member, modulo 2^32
        if members <= 1 and size > len(head) and size / length < 1000:
            found.records, found.estimated = max(found.records, round(size * found.records / len(head))), True
    if damaged:
        found.note, found.estimated = "; ".join(filter(None, [found.note, "damaged gzip"])), True
    return found


#: Tasks that files are dealt over at most.
MOST_TASKS = 10_000


def detected(path: str, content: bytes | None, opener: str | None = None) -> Detection:
    """A detection for any file, whatever is wrong with it: one that can't be opened or read is unknown with a note."""
    try:
        with opened(path, content, opener) as file:
            return detect(path, file)
    except Exception as error:  # one file's trouble is never the run's
        return Detection(path, note=f"unreadable: {type(error).__name__}")


def detect_contents(files: DataFrame, opener: str | None = None) -> DataFrame:
    """A detection for each row of (path, content): contents are opened in the tasks where they are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [asdict(detected(path, content, opener)) for path, content in zip(part.path, part.content, strict=True)]
            yield pd.DataFrame(found, columns=list(Detection.__dataclass_fields__)).astype({"records": "Int64"})

    return files.select("path", "content").mapInPandas(run, DETECTION)


def detect_all(spark: SparkSession, paths: list[str], opener: str | None = None) -> DataFrame:
    """A detection for each path, judged on the executors; contents never reach the driver.

    Where tasks can open the files, a part of the head (and a Parquet file's footer) is all that is fetched.
    """
    return detect_contents(read_files(spark, list(enumerate(paths)), opener), opener).orderBy("path")


def opened(path: str, content: bytes | None, opener: str | None = None) -> BinaryIO:
    return open_ranged(path, opener) if content is None else io.BytesIO(content)


def read_files(spark: SparkSession, files: list[tuple[int, str]], opener: str | None = None) -> DataFrame:
    """(file_id, path, content) of the (id, path) pairs.

    Files that tasks can open (``remote.in_tasks``) are read there by ranges, so their content is null here
    and they may have any size. Others are read whole by Spark's reader (2 GiB at most each); their names,
    which the driver lists anyway, are joined to number them.
    """
    names = spark.createDataFrame([(i, p, not in_tasks(p, opener)) for i, p in files], "file_id long, path string, whole boolean")
    remote = [p for _, p in files if not in_tasks(p, opener)]
    near = names.where("not whole").drop("whole").repartition(max(1, min(MOST_TASKS, len(files) - len(remote)))).withColumn("content", F.lit(None).cast("binary"))
    if not remote:
        return near
    far = spark.read.format("binaryFile").load(remote).select("path", "content").join(names, "path").select("file_id", "path", "content")
    return near.unionByName(far) if len(remote) < len(files) else far
