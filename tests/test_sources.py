import gzip
import io
import json
import os
from datetime import datetime

import pytest

from logsieve.functions.display import canonical
from logsieve.operators import results
from logsieve.sources import normalize as N
from logsieve.sources.detect import classify, detect, detect_all
from logsieve.sources.discovery import list_folder, scan_folder
from logsieve.sources.discovery import scan as scan_any
from logsieve.sources.ingest import ingest_folder, with_companions
from logsieve.sources.json_stream import documents
from logsieve.sources.mapping import FieldMap, clf, loose_utc, rfc3339
from logsieve.sources.preview import preview
from tests import fixtures as X


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return X.write_folder(str(tmp_path_factory.mktemp("logs")))


@pytest.fixture(scope="module")
def events(spark, folder):
    return ingest_folder(spark, folder)[0].cache()


def test_scan(spark, folder, tmp_path):
    scan = scan_folder(folder)
    names = [os.path.relpath(c.path, folder) for c in scan.candidates]
    assert names == sorted(names) and "b/alb.log.GZ" in names and len(names) == 10
    assert [c.file_id for c in scan.candidates] == list(range(10))
    assert {(os.path.basename(s.path), s.reason) for s in scan.skipped} == {("notes.txt", "extension"), ("empty.gz", "empty")}
    assert list_folder(spark, folder).where("reason is null").count() == 10 and {s.reason for s in scan_any(spark, f"file://{folder}").skipped} == {s.reason for s in scan.skipped}
    with pytest.raises(NotADirectoryError):
        scan_folder(f"{folder}/nothing")
    os.symlink(folder, tmp_path / "link")
    assert scan_folder(str(tmp_path)).candidates == []


def test_detect(spark, folder):
    found = {os.path.basename(r.path): r for r in detect_all(spark, [c.path for c in scan_folder(folder).candidates]).collect()}
    assert {k: r.log_type for k, r in found.items()} == {
        "a_audit.json.gz": "cloudtrail", "alb.log.GZ": "alb_access", "waf.gz": "waf_acl", "apigw.gz": "apigw_access", "nginx.gz": "nginx_access", "gateway.parquet": "gateway_request",
        "digest.gz": "cloudtrail_digest", "unknown.gz": "unknown", "fake.gz": "unknown", "truncated.gz": "alb_access"}
    assert found["a_audit.json.gz"].confidence == "high" and found["a_audit.json.gz"].records == 5 and found["a_audit.json.gz"].sample_name == "ConsoleLogin"
    assert found["fake.gz"].note == "not gzip" and found["gateway.parquet"].records == 2


def test_classify_parts():
    low = classify("p", json.dumps({"Records": [{"a": 1}]}).encode(), False)
    assert (low.log_type, low.confidence) == ("cloudtrail", "low")
    assert classify("p", b'{"Records":[]}', False).records == 0
    assert classify("p", json.dumps({"configurationItems": [1, 2]}).encode(), False).log_type == "config_snapshot"
    cut = json.dumps({"Records": [X.audit(i) for i in range(9)]}).encode()[:3000]
    assert classify("p", cut, True).log_type == "cloudtrail" and classify("p", cut, True).estimated
    big = gzip.compress("".join(X.alb(i) + "\n" for i in range(20_000)).encode())
    assert abs(detect("x.gz", io.BytesIO(big)).records - 20_000) < 500
    assert detect("x.gz", io.BytesIO(b"\x1f")).log_type == "unknown" and detect("x.parquet", io.BytesIO(b"PAR1junk")).note.startswith("unreadable")


def test_alb_tokens():
    assert N.alb_tokens('a "b c" "d\\"e" - ') == ["a", "b c", 'd\\"e', "-"]
    assert N.alb_tokens('a "open') is None and N.alb_tokens('"glued"x') is None and N.alb_tokens("") == []
    assert N.endpoint_host("[2001:db8::1]:80") == "2001:db8::1" and N.endpoint_host("1.2.3.4:5") == "1.2.3.4" and N.endpoint_host("x") is None


@pytest.mark.parametrize("bad", ["ftp " + X.alb()[6:], X.alb(time="yesterday"), X.alb().replace("app/", "net/"), " ".join(X.alb().split()[:10]), ""])
def test_malformed_alb(bad):
    assert N.alb_event(bad) is None


@pytest.mark.parametrize("status,code", [("404", "HTTP 404"), ("399", None), ("600", "HTTP 600"), ("-", None), ("99999", None)])
def test_alb_status(status, code):
    event = N.alb_event(X.alb(status=status))
    assert event["error_code"] == code and event["aws_region"] == "eu-west-1" and event["account_id"] == "000000000000"
    assert json.loads(event["response"])["response_processing_time"] == -1.0 and event["error_message"] == "error reason"
    assert list(json.loads(event["request"])) == ["method", "url", "protocol", "trace_id", "domain_name", "request_creation_time", "actions_executed", "redirect_url"]


def test_times():
    assert rfc3339("2024-01-02T03:04:05.1234567+09:00") == datetime(2024, 1, 1, 18, 4, 5, 123456)
    assert rfc3339("2024-01-02 03:04:05Z") is None and rfc3339("2024-13-02T03:04:05Z") is None and rfc3339(5) is None
    assert loose_utc("2024-01-02 03:04:05.5") == loose_utc("2024-01-02T05:04:05.5+02") == datetime(2024, 1, 2, 3, 4, 5, 500000)
    assert clf("31/Aug/2026:00:00:05 +0900") == datetime(2026, 8, 30, 15, 0, 5) and clf("31/Foo/2026:00:00:05 +0900") is None


def test_mapping():
    record = X.audit(userIdentity={"type": "AssumedRole", "arn": 5, "sessionContext": {"sessionIssuer": {"userName": "u"}}})
    event = N.audit_event(record, FieldMap())
    assert event["identity_arn"] is None and event["identity_name"] == "u" and event["mfa_authenticated"] is True and event["management_event"] is True
    assert event["request"] == '{"a":{"b":[1,2]},"z":1}' and event["resources"] == '[{"ARN":"arn:x"}]'
    assert N.audit_event(record, FieldMap({"event_name": ["resources.0.ARN"]}))["event_name"] == "arn:x"
    assert N.audit_event("text", FieldMap())["event_name"] is None
    with pytest.raises(ValueError):
        FieldMap({"nope": ["x"]})


def test_documents_in_any_pieces():
    text = json.dumps({"x": {"y": 1}, "Records": [{"a": "]}"}, {"b": [1, {"c": 2}]}, 7]}) + '\n{"Records":[]}' + json.dumps({"Records": [{"d": 4}]})
    want = [{"a": "]}"}, {"b": [1, {"c": 2}]}, 7, {"d": 4}]
    for n in (1, 2, 7, 1000):
        assert list(documents(text[i : i + n] for i in range(0, len(text), n))) == want
    nested = '{"meta":{"Records":[1,2]},"text":"\\"Records\\":[3","n":-1.5e3,"Records":[{"a":1}],"after":{"Records":[4]}} {"x":[[],{}],"Records":[5]}'
    for n in (1, 3, 1000):
        assert list(documents(nested[i : i + n] for i in range(0, len(nested), n))) == [{"a": 1}, 5]
    for bad in ('{"Records":null,"other":[7,8]}', '{} [1]', '{"a":1', '{"a":"x', '{"Records":[1 2x]}', '{"a" 1}'):
        with pytest.raises(ValueError):
            assert [x for x in documents(iter(bad)) if x != 1 and x != 2] == []
    assert list(documents(iter(["nothing"]))) == list(documents(iter([]))) == []
    got = []
    with pytest.raises(ValueError):
        for x in documents(iter(['{"Records":[{"a":1},{"b":'])):
            got.append(x)
    assert got == [{"a": 1}]


def test_ingest(events, folder):
    rows = events.collect()
    files = {os.path.basename(c.path): c.file_id for c in scan_folder(folder).candidates}
    outcome = {r.file_id: r for r in rows if r.file_status}
    assert outcome.keys() == set(files.values())
    assert {k: (outcome[i].file_status, outcome[i].record_index, outcome[i].malformed) for k, i in files.items() if k != "truncated.gz"} == {
        "a_audit.json.gz": ("parsed", 6, 0), "alb.log.GZ": ("parsed", 4, 1), "waf.gz": ("parsed", 2, 1), "apigw.gz": ("parsed", 2, 0), "nginx.gz": ("parsed", 2, 0), "gateway.parquet": ("parsed", 2, 0),
        "digest.gz": ("skipped", 0, 0), "unknown.gz": ("skipped", 0, 0), "fake.gz": ("failed", 0, 0)}
    damaged = outcome[files["truncated.gz"]]
    assert damaged.file_status == "failed" and "damaged" in damaged.file_note and damaged.record_index > 0
    events = [r for r in rows if not r.file_status]
    assert all(r.event_id == r.file_id << 32 | r.record_index for r in events) and len({r.event_id for r in events}) == len(events)
    alb = sorted(r.record_index for r in events if r.file_id == files["alb.log.GZ"])
    assert alb == [0, 2, 3, 4]  # the empty line takes no number, the broken one does
    gate = {r.identity_name: r for r in events if r.log_type == "gateway_request"}
    assert gate[None].identity_type == "anonymous" and gate["42"].source_ip == "203.0.113.9" and gate["42"].user_agent == "app" and gate["42"].event_time == datetime(2026, 8, 31, 0, 0, 5, 500000)
    waf = next(r for r in events if r.event_name == "BLOCK")
    assert (waf.error_code, waf.aws_region, waf.user_agent, waf.event_time) == ("SQLiRule", "us-east-1", "bot", datetime(2024, 3, 1, 0, 0, 0, 123000))
    assert json.loads(waf.request)["url"] == "/a?x=1" and json.loads(waf.resources)["host"] == "h.example"
    web = next(r for r in events if r.log_type == "nginx_access" and r.error_code)
    assert web.error_code == "HTTP 503" and json.loads(web.request)["url"] == "w.example/u?x" and "referer" not in json.loads(web.request)


def test_selection_keeps_ids(spark, folder):
    all_files = {c.path: c.file_id for c in scan_folder(folder).candidates}
    chosen = {p for p in all_files if p.endswith(("waf.gz", "nginx.gz"))}
    rows = ingest_folder(spark, folder, chosen)[0].collect()
    assert {r.file_id for r in rows} == {all_files[p] for p in chosen}


def test_summary_and_payload_keys(events):
    stored = with_companions(events.where("file_status is null").drop("file_status", "file_note", "malformed"))
    rows = {r.event_id: r for r in results.summarize(stored).collect()}
    audit = rows[min(i for i, r in rows.items() if r.log_type == "cloudtrail")]
    assert audit.resource == "arn:x" and audit.time == "2024-03-01 10:02:03.000"
    block = next(r for r in rows.values() if r.event_name == "BLOCK")
    assert (block.country, block.rule, block.method, block.target) == ("NL", "SQLiRule", "POST", "h.example")
    keys = {(r.log_type, r.path): r.events for r in results.payload_keys(stored).collect()}
    assert keys["cloudtrail", "request.a.b.1"] == 6 and keys["cloudtrail", "resources.0.ARN"] == 6 and ("waf_acl", "response.response_code_sent") not in keys
    assert canonical(stored).columns == stored.columns


def test_preview(folder):
    read = lambda p: open(f"{folder}/{p}", "rb")
    one = preview("a.gz", read("a_audit.json.gz"))
    assert one.log_type == "cloudtrail" and len(one.records) == 6 and one.mapped == 6 and one.names == [("ConsoleLogin", 5), ("GetObject", 1)]
    piece = {x.path: x.column for x in one.records[0]}
    assert piece["userIdentity.sessionContext.attributes.mfaAuthenticated"] == "mfa_authenticated" and piece["additionalEventData.MFAUsed"] is None and piece["requestParameters.a.b.0"] == "request"
    assert preview("b.gz", read("b/alb.log.GZ")).records[0][3].column == "source_ip"
    assert preview("c.gz", read("b/waf.gz")).names == [("ALLOW", 1), ("BLOCK", 1)]
    assert preview("d.gz", read("unknown.gz")).records == []


def test_damage_within_the_head():
    whole = gzip.compress("".join(X.alb(i) + "\n" for i in range(200)).encode())
    found = detect("x.gz", io.BytesIO(whole[: len(whole) // 2]))
    assert found.log_type == "alb_access" and "damaged" in found.note


def _odd_lines(n=400):
    import random

    rnd = random.Random(8)
    out = ["", " ", '"', X.alb(), "\t" + X.alb() + "  ", X.alb().replace(" ", "\t"), X.alb(extra=False), X.alb(target="[2001:db8::1]:80"), X.alb().replace("198.51.100.0:2817", "[2001:db8::2]:9"), X.alb().replace("198.51.100.0:2817", "noport"),
        X.alb(time="2024-03-01T00:00:00.123456789+05:30"), X.alb(time="2024-02-30T00:00:00Z"), X.alb(time="2024-03-01 00:00:00Z"), X.alb(time="2024-03-01T00:00:00"), X.alb(status="99999999999999999999999"), X.alb(status="+404"), X.alb(method="")]
    base = X.alb()
    for _ in range(n):
        chars = list(base)
        for _ in range(rnd.randrange(1, 4)):
            i = rnd.randrange(len(chars))
            chars[i] = rnd.choice(['"', " ", "\\", "-", "é", "x", "", "9", ":"])
        out.append("".join(chars))
    return out


def test_quick_tokens_equal_the_slow_ones(monkeypatch):
    lines = _odd_lines()
    quick = [N.alb_tokens(x) for x in lines]
    monkeypatch.setattr(N, "_SPACES", frozenset())
    assert [N.alb_tokens(x) for x in lines] == quick and any(t is None for t in quick)


def test_lines_of_a_table_equal_the_reader(spark):
    from logsieve.sources.lines import normalize_lines

    lines = _odd_lines()
    want = {i: e for i, x in enumerate(lines) if (e := N.alb_event(x)) is not None}
    rows = normalize_lines(spark.createDataFrame([(2, i, x) for i, x in enumerate(lines)] + [(2, 9999, None)], "file_id int, record_index int, line string"), "alb_access").collect()
    assert 100 < len(want) < len(lines) and {r.record_index for r in rows} == want.keys()
    for r in rows:
        assert r.event_id == 2 << 32 | r.record_index and r.log_type == "alb_access"
        assert {k: r[k] for k in want[r.record_index]} == want[r.record_index]
        assert json.loads(r.raw)["line"] == lines[r.record_index]
