import gzip
import io
import json
import os
import random
import time
import zlib
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import StructType

from logsieve.sources import splits as S
from logsieve.sources.detect import detect_all, detected
from logsieve.sources.discovery import Candidate, scan_folder
from logsieve.sources.ingest import file_outcomes, ingest, ingest_folder, read_contents
from logsieve.sources.source import LogSource, offsets, reader
from tests import fixtures as X

ROWS = ["event_id", "file_id", "record_index", "log_type", "event_time", "event_name", "source_ip", "request", "raw"]


def lines_of(data, part=None):
    return [x for block in S.line_blocks(io.BytesIO(data), part or S.Part(0, "x.gz", len(data))) for x in block]


def members(texts, level=6):
    return b"".join(gzip.compress(t, level, mtime=0) for t in texts)


def in_parts(data, size):
    """(lines, whether the parts fit together), read part by part."""
    out, extents = [], []
    for p in S.parts_of(0, "x.gz", len(data), size):
        found = S.Extent()
        try:
            got = [x for block in S.line_blocks(io.BytesIO(data), p, found) for x in block]
        except (zlib.error, EOFError):
            return out, False
        found.records = len(got)
        assert S.extent_of(io.BytesIO(data), p, False) == found
        out += got
        extents.append((p, found))
    return out, S.verified(extents)


@pytest.mark.parametrize("seed", range(12))
def test_parts_hold_each_line_once(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice([b"", b"\r", b"a" * rng.randint(0, 50), bytes(rng.randrange(33, 256) for _ in range(rng.randint(0, 400))), "é😀".encode() * rng.randint(0, 9)]) + rng.choice([b"\n", b"\r\n"])
    text = b"".join(line() for _ in range(300)) + rng.choice([b"", b"open end"])
    cuts = sorted(rng.sample(range(len(text)), rng.choice([0, 1, 30])))  # members end within lines, too
    data = members([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])], rng.choice([0, 1, 9])) + rng.choice([b"", b"\0" * 700])
    whole = lines_of(data)
    assert whole == [x for y in text.decode("utf-8", "replace").split("\n") if (x := y.rstrip("\r"))]
    for size in (1, 7, 100, 1000, len(data) - 1, len(data)):
        got, fits = in_parts(data, size)
        assert fits <= (got == whole)
        if not data.endswith(b"\0\0"):
            assert fits and got == whole


def test_a_line_over_many_members_and_parts():
    data = members([b"x" * 5000, b"y" * 5000, b"z\nlast"])
    assert in_parts(data, 10) == (["x" * 5000 + "y" * 5000 + "z", "last"], True)


def test_what_looks_like_a_member_is_not_believed():
    noise = bytes(random.Random(1).randbytes(2000))
    data = members([b"a\n" + b"\x1f\x8b\x08\x00" + noise + b"\nb\n", b"c\n"], 0)  # stored, so the bytes are there as they are
    assert in_parts(data, 20)[1] and in_parts(data, 20)[0] == lines_of(data)
    within = members([b"a\n" + gzip.compress(b"inner\n", mtime=0) + b"\nb\n", b"c\n"], 0)
    found = [in_parts(within, size) for size in range(5, 60)]
    assert all(got == lines_of(within) for got, fits in found if fits) and not all(fits for _, fits in found)  # a whole member within another


def test_damage_is_never_split():
    rng = random.Random(5)
    data = bytearray(members(["".join(f"{rng.random()}\n" for _ in range(300)).encode() for _ in range(20)]))
    data[len(data) // 2] ^= 255
    for bad in (bytes(data), bytes(data[: len(data) // 3])):
        assert not in_parts(bad, 1000)[1]


def test_what_was_read_before_damage_comes_out():
    data = members([b"one\ntwo\nthr"])[:-9] + b"junkjunkj"
    got = []
    with pytest.raises((zlib.error, EOFError)):
        for block in S.line_blocks(io.BytesIO(data), S.Part(0, "x", len(data))):
            got += block
    assert got == ["one", "two"]


def test_one_long_line_takes_time_in_proportion():
    took = []
    for mb in (25, 100):
        data = gzip.compress(b"x" * (mb << 20), 1)
        began = time.perf_counter()
        assert [len(x) for x in lines_of(data)] == [mb << 20]
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


# Whole files ------------------------------------------------------------------------------------------


def alb_file(path, records, a_member):
    lines = ["junk" if i % 50 == 7 else X.alb(i, status=str(200 + i % 300)) for i in range(records)]
    with open(path, "wb") as out:
        for at in range(0, records, a_member):
            out.write(gzip.compress(("\n".join(lines[at : at + a_member]) + "\n").encode(), 6))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("parts")
    alb_file(f"{root}/a_many_members.gz", 3000, 100)
    alb_file(f"{root}/b_one_member.gz", 3000, 3000)
    with gzip.open(f"{root}/c_audit.json.gz", "wt") as out:
        json.dump({"Records": [X.audit(i) for i in range(1500)]}, out)
    rows = [{"requestedtimeutc": "2026-01-01 00:00:00", "httpmethod": "GET", "apipath": f"/p{i}", "memberid": i % 3, "sourceip": "192.0.2.1"} for i in range(4000)]
    pq.write_table(pa.Table.from_pylist(rows), f"{root}/d_rows.parquet", row_group_size=250)
    with open(f"{root}/e_cut.gz", "wb") as out:
        out.write(open(f"{root}/a_many_members.gz", "rb").read()[:-500])
    with gzip.open(f"{root}/f_small.gz", "wt") as out:
        out.write("\n".join(json.dumps(X.waf(i)) for i in range(5)))
    return str(root)


def kept(df):
    return sorted((tuple(r) for r in df.where("file_status is null").select(ROWS).collect()), key=str), sorted((tuple(r) for r in file_outcomes(df).select("file_id", "records", "log_type", "status", "note", "malformed").collect()), key=str)


def test_split_files_give_what_unsplit_ones_give(spark, folder):
    found = scan_folder(folder).candidates
    whole, split = kept(ingest(spark, found)), kept(ingest(spark, found, split_bytes=4000))
    assert len(whole[0]) > 11_000 and split[0] == whole[0]
    note = lambda rows: [r[:4] + (r[4].split(":")[0] if r[4] else None, r[5]) for r in rows]
    assert note(split[1]) == note(whole[1])
    assert {r[0]: r[3] for r in whole[1]} == {0: "parsed", 1: "parsed", 2: "parsed", 3: "parsed", 4: "failed", 5: "parsed"}


def test_only_columns_asked_for_are_built(spark, folder):
    found = scan_folder(folder).candidates
    names = ["event_id", "file_id", "record_index", "log_type", "event_name", "request"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*names, "file_status", "malformed").collect()), key=str)
    for some in (found, found[1:2]):
        few = ingest(spark, some, split_bytes=4000, columns=["event_name", "request"])
        assert few.columns == [*names, "file_status", "file_note", "malformed"] and rows(few) == rows(ingest(spark, some, split_bytes=4000))
    contents = spark.createDataFrame([(c.file_id, c.path, bytearray(open(c.path, "rb").read())) for c in found[2:4]], "file_id long, path string, content binary")
    assert rows(read_contents(contents, columns=["event_name", "request"])) == rows(read_contents(contents))
    with pytest.raises(ValueError):
        ingest(spark, found, columns=["nothing"])


def test_records_of_parquet_give_what_their_json_gives(tmp_path):
    from logsieve.sources.normalize import json_event

    plain = [{"requestedtimeutc": f"2026-01-01 00:00:0{i}", "httpmethod": "GET", "apipath": x, "memberid": i or None, "sourceip": None if i % 2 else "192.0.2.1", "more": i % 2 == 0} for i, x in enumerate(["/p", 'é"😀\\\n', "", None])]
    others = [r | {"number": x, "list": ["a"], "at": datetime(2026, 1, 1, 0, 0, i)} for i, (r, x) in enumerate(zip(plain, [1.5, float("nan"), None, float("inf")], strict=True))]
    for rows, kind in ((plain, dict), (others, str)):
        pq.write_table(pa.Table.from_pylist(rows), path := str(tmp_path / "rows.parquet"))
        part = S.Part(0, path, os.path.getsize(path))
        texts, records = ([x for block in S.parquet_blocks(open(path, "rb"), part, parsed=p) for x in block] for p in (False, True))
        assert len(texts) == len(rows) and {type(r) for r in records} == {kind}
        assert texts == [json.dumps(r, default=str, separators=(",", ":"), ensure_ascii=False) for r in rows]
        for wanted in (None, frozenset({"raw"}), frozenset({"request"})):
            got = [json_event(r, "gateway_request", wanted) for r in records]
            want = [json_event(t, "gateway_request", wanted) for t in texts]
            if wanted == {"request"}:  # a line is there anyway
                got, want = ([e and {k: v for k, v in e.items() if k != "raw"} for e in x] for x in (got, want))
            assert got == want and sum(e is None for e in got) == 2 * (kind is str)


def test_large_files_use_many_tasks(spark, folder):
    found = {os.path.basename(c.path): c for c in scan_folder(folder).candidates}
    files = [(c.file_id, c.path, c.size) for c in found.values() if c.size > 4000]
    told = [r.asDict() for r in reader(spark, files=json.dumps(files), what="extents", splitBytes="4000").load().collect()]
    starts, whole = offsets(files, told, 4000)
    assert whole == {found[n].file_id for n in ("b_one_member.gz", "c_audit.json.gz", "e_cut.gz")}
    many = [x for x in starts if x[0] == found["a_many_members.gz"].file_id]
    assert len(many) > 10 and [f for *_, f in many] == sorted(f for *_, f in many) and many[0][2] == 0
    one = ingest(spark, [found["b_one_member.gz"]], split_bytes=4000)
    assert one.where("file_status is null").rdd.getNumPartitions() >= 4


def test_a_source_gives_what_ingest_gives(spark, folder):
    spark.dataSource.register(LogSource)
    whole = sorted((tuple(r) for r in ingest_folder(spark, folder)[0].where("file_status is null").select(ROWS).collect()), key=str)
    df = spark.read.format("cloud_logs").load(folder)
    assert sorted((tuple(r) for r in df.select(ROWS).collect()), key=str) == whole
    few = spark.read.format("cloud_logs").schema("event_id long, event_name string").load(folder)
    assert sorted(few.collect()) == sorted((r[0], r[5]) for r in whole)


def test_bodies_that_no_one_asks_for_are_not_built(monkeypatch):
    from logsieve.sources import normalize as N

    def never(*_, **__):
        raise AssertionError("a body was built")

    monkeypatch.setattr(N, "_flat", never)
    monkeypatch.setattr(N, "compact", never)
    wanted = frozenset({"event_id", "event_name", "source_ip"})
    assert N.alb_event(X.alb(1), wanted)["event_name"] == "GET"
    for kind, record in (("waf_acl", X.waf()), ("apigw_access", X.apigw()), ("nginx_access", X.nginx())):
        assert N.json_event(json.dumps(record), kind, wanted)["event_name"]
    assert N.audit_event(X.audit(), N.FieldMap(), wanted) == {"event_name": "ConsoleLogin", "source_ip": "192.0.2.0"}


def test_pushed_filters_leave_other_files_closed(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = reader(spark, opener="tests.test_splits:only_small", pushdown="true", path=folder).load()
        assert df.where("file_id = 5").count() == 5 and df.where("file_id in (5, 9) and event_name = 'BLOCK'").count() == 5
        assert reader(spark, pushdown="true", path=folder).load().where("log_type = 'waf_acl'").count() == 5
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def only_small(path):
    if "f_small" not in path:
        os._exit(1)  # a task that opens another file dies
    return open(path, "rb")


def test_a_stream_gives_what_a_batch_gives(spark, folder, tmp_path):
    spark.dataSource.register(LogSource)
    source, names = tmp_path / "in", sorted(os.listdir(folder))
    source.mkdir()

    def add(some):
        for name in some:
            data = open(f"{folder}/{name}", "rb").read()
            with open(source / f".{name}", "wb") as out:
                out.write(data)
            os.rename(source / f".{name}", source / name)
            time.sleep(0.01)

    def drain():
        query = spark.readStream.format("cloud_logs").load(str(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    add(names[:3])
    drain()
    add(names[3:])
    drain()
    drain()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(ROWS).collect()), key=str)
    assert got == sorted((tuple(r) for r in spark.read.format("cloud_logs").load(folder).select(ROWS).collect()), key=str)


# Ranges and damage --------------------------------------------------------------------------------------


class Counted(io.FileIO):
    def read(self, n=-1):
        data = super().read(n)
        with open(os.environ.get("COUNTED", "/dev/null"), "a") as out:
            out.write(f"{len(data)}\n")
        return data

    def readinto(self, buffer):
        n = super().readinto(buffer)
        with open(os.environ.get("COUNTED", "/dev/null"), "a") as out:
            out.write(f"{n}\n")
        return n


def counted(path):
    return Counted(path)


def test_detection_fetches_the_ends_of_a_file_only(tmp_path, monkeypatch):
    rng = random.Random(2)
    with open(tmp_path / "big.gz", "wb") as out:
        head = gzip.compress(("\n".join(X.alb(i) for i in range(2000)) + "\n").encode())
        out.write(head)
        for _ in range(30):
            out.write(gzip.compress(rng.randbytes(1 << 20), 0))
    rows = pa.table({"requestedtimeutc": ["2026-01-01 00:00:00"] * 300_000, "httpmethod": ["GET"] * 300_000, "apipath": [f"/{rng.random()}" for _ in range(300_000)]})
    pq.write_table(rows, tmp_path / "big.parquet", compression="none")
    for name, kind in (("big.gz", "alb_access"), ("big.parquet", "gateway_request")):
        monkeypatch.setenv("COUNTED", str(tmp_path / f"{name}.log"))
        found = detected(str(tmp_path / name), None, "tests.test_splits:counted")
        read = sum(map(int, open(tmp_path / f"{name}.log")))
        assert found.log_type == kind and read < 3 << 19 < os.path.getsize(tmp_path / name), read
    assert found.records == 300_000


def test_a_task_reads_a_file_s_footer_once(spark, tmp_path, monkeypatch):
    rows = [{"requestedtimeutc": "2026-01-01 00:00:00", "httpmethod": "GET", "apipath": f"/p{i}", "memberid": i % 3, "sourceip": "192.0.2.1"} for i in range(4000)]
    pq.write_table(pa.Table.from_pylist(rows), path := str(tmp_path / "rows.parquet"), row_group_size=20, compression="none")
    size = os.path.getsize(path)
    for what, most in (("extents", 2), ("events", 4)):
        source = LogSource({"files": json.dumps([[0, path, size]]), "what": what, "splitBytes": "500", "opener": "tests.test_splits:counted"})
        read = source.reader(StructType.fromDDL(source.schema()))
        tasks = read.partitions()
        assert len(tasks) == 1 and len(tasks[0].parts) > 400
        monkeypatch.setenv("COUNTED", str(tmp_path / what))
        table = pa.Table.from_batches(list(read.read(tasks[0])))
        assert (sum(table["records"].to_pylist()) if what == "extents" else table.num_rows) == len(rows)
        assert sum(map(int, open(tmp_path / what))) < most * size


def test_a_preview_of_a_remote_file_fetches_its_head(spark, folder):
    from logsieve.sources.storage import Storage

    file = Storage(spark).open(f"file://{folder}/a_many_members.gz")
    data = open(f"{folder}/a_many_members.gz", "rb").read()
    assert file.read(10) == data[:10] and file.seek(-7, 2) == len(data) - 7 and file.read() == data[-7:] and file.fetched == 17
    file.seek(3)
    buffer = bytearray(5)
    assert file.readinto(buffer) == 5 and bytes(buffer) == data[3:8] and file.read(0) == b"" and file.tell() == 8


DAMAGED = {
    "deep_list.gz": gzip.compress(b"[" * 200_000),
    "deep_object.gz": gzip.compress(b'{"a":' * 100_000),
    "deep_record.gz": gzip.compress(b'{"Records":[{"eventVersion":"1","eventSource":"s","eventTime":"2024-01-01T00:00:00Z"},' + b"[" * 200_000),
    "deep_line.gz": gzip.compress((json.dumps(X.waf()) + "\n" + '{"webaclId":' + "[" * 200_000 + "\n" + json.dumps(X.waf(1))).encode()),
    "number.gz": gzip.compress((json.dumps(X.apigw()) + "\n" + json.dumps(X.apigw(status="7" * 5000)) + "\n" + json.dumps(X.apigw()).replace('"502"', "7" * 5000)).encode()),
    "alb_number.gz": gzip.compress((X.alb() + "\n" + X.alb(status="9" * 5000)).encode()),
    "empty_text.gz": gzip.compress(b""),
    "junk.parquet": b"PAR1junk",
}


def test_no_file_stops_a_run(spark, tmp_path):
    for name, data in DAMAGED.items():
        (tmp_path / name).write_bytes(data)
    found = scan_folder(str(tmp_path)).candidates
    found.append(Candidate(len(found), str(tmp_path / "gone.gz"), 100))
    rows = ingest(spark, found).collect()
    names = {c.file_id: os.path.basename(c.path) for c in found}
    told = {names[r.file_id]: (r.file_status, r.record_index, r.malformed) for r in rows if r.file_status}
    assert told == {
        "deep_list.gz": ("skipped", 0, 0), "deep_object.gz": ("failed", 0, 0), "deep_record.gz": ("parsed", 1, 0), "deep_line.gz": ("parsed", 2, 1), "number.gz": ("parsed", 2, 1), "alb_number.gz": ("parsed", 2, 0),
        "empty_text.gz": ("skipped", 0, 0), "junk.parquet": ("skipped", 0, 0), "gone.gz": ("failed", 0, 0)}
    kinds = {os.path.basename(r.path): (r.log_type, r.note) for r in detect_all(spark, [c.path for c in found]).collect()}
    assert kinds["gone.gz"] == ("unknown", "unreadable: FileNotFoundError") and kinds["deep_list.gz"][0] == "unknown" and kinds["number.gz"][0] == "apigw_access" and len(kinds) == len(found)
    contents = spark.createDataFrame([(i, n, bytearray(d)) for i, (n, d) in enumerate(DAMAGED.items())], "file_id long, path string, content binary")
    assert read_contents(contents).where("file_status is not null").count() == len(DAMAGED)


def test_folders_of_other_file_systems_are_listed_by_arrow(folder, monkeypatch):
    from pyarrow import fs

    from logsieve.sources import remote, source

    want = [(c.path, c.size) for c in scan_folder(folder).candidates]
    assert remote.list_arrow(f"s3://bucket{folder}", fs.LocalFileSystem(), folder) == [(f"s3://bucket{p}", n) for p, n in want]
    monkeypatch.setattr(source, "list_arrow", lambda root: [("s3://b/a.gz", 5), ("s3://b/empty.gz", 0), ("s3://b/x.txt", 5), ("s3://b/.DS_Store.gz", 1)])
    assert source.candidates("s3://b") == [(0, "s3://b/a.gz", 5), (1, "s3://b/.DS_Store.gz", 1)]
    with pytest.raises(OSError):
        remote.open_ranged("viewfs://x/y.gz")
    assert not remote.in_tasks("viewfs://x/y.gz") and remote.in_tasks("s3a://x/y.gz") and remote.in_tasks("/x")
