import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logsieve.functions.display import PROJECTIONS, family
from logsieve.functions.redact import log_safe
from logsieve.operators import case as C
from logsieve.operators import results
from logsieve.operators.export import export_file, export_folder
from logsieve.operators.rulesets import RuleSet, shipped
from logsieve.operators.window import Cursor, Window, bound, page_rows, searches_time, within
from logsieve.plans.parser import parse_condition, parse_rules
from logsieve.streaming.rules import alerts_per_window, event_stream, matches, write_matches
from tests import fixtures as X

T = datetime(2024, 6, 6, 3, 0, 0)
ROWS = [
    (1, "cloudtrail", T.replace(microsecond=5), "A", "1.1.1.1", '{"k":"a","l":[{"m":1}]}'), (2, "cloudtrail", T.replace(microsecond=5), "B%", "43.201.1.1", '{"k":"a"}'), (3, "alb_access", None, "C_x", None, None),
    (4, "cloudtrail", T.replace(hour=14, minute=59, second=59), None, "9.9.9.9", '{"k":"b"}'), (5, "alb_access", T.replace(hour=15), "D", None, '{"k":null}'), (6, "cloudtrail", None, "E", "1.1.1.1", "bad"), (7, "cloudtrail", T, "aB", "1.1.1.1", '{"k":"a"}'),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "event_id long, log_type string, event_time timestamp_ntz, event_name string, source_ip string, request string").cache()


def ids(df):
    return [r.event_id for r in df.collect()]


@pytest.mark.parametrize("newest", [True, False])
def test_walk_all_pages(events, newest):
    timed = sorted((r for r in ROWS if r[2]), key=lambda r: (r[2], r[0]), reverse=newest)
    want = [r[0] for r in timed] + sorted((r[0] for r in ROWS if not r[2]), reverse=newest)
    for limit in (1, 3):
        seen, window = [], Window(limit=limit, newest_first=newest)
        while page := results.list_events(events, window).collect():
            seen += [r.event_id for r in page]
            window = window.next(Cursor(page[-1].event_id, page[-1].time_micros))
        assert seen == want
    assert Window(limit=0).size == 1 and Window(limit=10**6).size == 1000


def test_bounds(events):
    assert bound("2024-06-06") == datetime(2024, 6, 6) and bound(" 2024-06-06 ", True) == datetime(2024, 6, 7) and bound("2024-06-06 11:00", True) == datetime(2024, 6, 6, 11, 1) and bound("2024-06-06 11:00:59", True) == datetime(2024, 6, 6, 11, 1)
    for bad in ("2024-6-6", "2024-06-31", "06/06/2024", "2024-06-06 25:00", "", "2024-06-06T11:00"):
        with pytest.raises(ValueError):
            bound(bad)
    # The sixth of June ends at 15:00 UTC; events without a time are outside any bound.
    assert set(ids(within(events, Window(start="2024-06-06", stop="2024-06-06")))) == {1, 2, 4, 7}
    assert set(ids(within(events, Window(start="2024-06-07")))) == {5}
    assert set(ids(within(events, Window(log_type="alb_access")))) == {3, 5}


@pytest.mark.parametrize("needle,want", [("", {1, 2, 3, 4, 5, 6, 7}), ("%", {2}), ("_", {3}), ("b", {2, 7}), ("43.201", {2}), ("\\", set()), ("06-06 23:59", {4}), ("12:00:00.000", {1, 2, 7}), ("9", {4})])
def test_search(events, needle, want):
    assert set(ids(within(results.canonical(events), Window(search=needle)))) >= want
    if needle != "9":
        assert set(ids(within(results.canonical(events), Window(search=needle)))) == want


def test_what_reads_as_time():
    assert [searches_time(x) for x in ("43.201", "2024", "06-06", "11:00", "a1", "", "1 2", ".")] == [False, True, True, True, False, False, False, False]


def test_stats(events):
    got = [(r.value, r.n, r.total, r.distinct_values) for r in results.field_stats(events, "request.k", Window()).collect()]
    assert got == [("a", 3, 7, 3), (None, 3, 7, 3), ("b", 1, 7, 3)]
    assert [(r.value, r.n) for r in results.field_stats(events, "request.l.0.m", Window(log_type="cloudtrail"), top=1).collect()] == [(None, 4)]
    assert [(r.value, r.n) for r in results.field_stats(events, "day", Window()).collect()] == [("2024-06-06", 4), (None, 2), ("2024-06-07", 1)]
    for bad in ("raw.x", "event_id", "request", "request.", "request.a'b", "request.a b", "nothing"):
        with pytest.raises(ValueError):
            results.field_stats(events, bad, Window())


def test_details(events):
    assert results.event_detail(events, 99) == [] and results.raw_record(events, 99) is None
    detail = dict(results.event_detail(events, 1))
    assert detail["event_time"] == "2024-06-06 12:00:00.000" and detail["event_name"] == "A" and len(detail) == 18
    assert family("waf_acl") == "waf" and family("nginx_access") == "http" and family(None) == "audit" and all(PROJECTIONS.values())
    assert log_safe('read file {"secret":1}') == "read file " and log_safe("ä" * 100) == "ä" * 40


def test_condition_within_rule(events):
    rule = parse_rules('rule r { meta: log_type = "cloudtrail" fields: $a = request.k == "a" condition: $a }')[0]
    query = parse_condition('source_ip startswith "1." or request.k == "b"')
    assert set(ids(results.evaluate(events, results.condition_rule(query)))) == {1, 4, 6, 7}
    both = results.evaluate(events, results.condition_rule(query, rule))
    assert set(ids(both)) == {1, 7} and json.loads(both.where("event_id = 1").first().matched_fields) == {"$a": "a", "search:source_ip": "1.1.1.1"}


def test_export(events, tmp_path):
    path = str(tmp_path / "out.jsonl")
    assert export_file(events, Window(newest_first=False), path) == 7
    lines = [json.loads(x) for x in open(path, encoding="utf-8")]
    assert [x["event_id"] for x in lines] == [7, 1, 2, 4, 5, 3, 6]
    assert lines[1]["request"] == {"k": "a", "l": [{"m": 1}]} and lines[1]["error_code"] is None and lines[1]["event_time"] == "2024-06-06T03:00:00.000005Z" and lines[6]["request"] == {"text": "bad"}
    rule = parse_rules('rule r { condition: source_ip == "1.1.1.1" }')[0]
    assert export_file(events, Window(search="ignored"), path, results.evaluate(events, rule)) == 3
    first = json.loads(open(path, encoding="utf-8").readline())
    assert first["rule_id"] == "r" and first["matched_fields"] == {"source_ip": "1.1.1.1"}
    export_folder(events, Window(), str(tmp_path / "parts"))
    assert sorted(os.listdir(tmp_path)) == ["out.jsonl", "parts"]


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    folder = X.write_folder(str(root / "logs"))
    made = C.Case.create(spark, str(root), "one", folder)
    made.register(shipped())
    return made


def test_case_tables(case):
    assert case.meta["status"] == "done" and case.files.count() == 10 and {r.status for r in case.files.collect()} == {"parsed", "skipped", "failed"}
    assert "request_v" in case.events.columns and case.payload_keys.where("path = 'response.status'").count() == 2
    assert {r.log_type: r.events for r in results.log_type_counts(case.events, case.files).collect()}["cloudtrail"] == 6
    assert results.file_spans(case.files.drop("records"), case.events).where("n = 0").count() == 3


def test_case_in_another_file_system(spark, case, tmp_path):
    """By a mount that only Spark's readers know."""
    os.makedirs(tmp_path / "far")
    X.write_folder(str(tmp_path / "far" / "logs"))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.caselog.link./in", f"file://{tmp_path}/far")
    one = C.Case.create(spark, "viewfs://caselog/in", "far", "viewfs://caselog/in/logs")
    assert one.events.count() == case.events.count() and one.files.count() == 10
    one.register(shipped())
    one.evaluate(next(r for r in shipped().rules if r.id == "root_sensitive_action"))
    assert one.matches("root_sensitive_action").count() == 5 and one.rules["root_sensitive_action"]["evaluated"]
    assert [c["case_id"] for c in C.list_cases(spark, "viewfs://caselog/in")] == ["far"]


def test_lazy_evaluation(case, monkeypatch):
    rules = {r.id: r for r in shipped().rules}
    assert not case.rules["root_sensitive_action"]["evaluated"] and case.matches().count() == 0
    case.evaluate(rules["root_sensitive_action"])
    case.evaluate(rules["client_denied"])
    assert case.rules["root_sensitive_action"]["evaluated"]
    page = results.list_matches(case.matches("root_sensitive_action"), Window(limit=2, newest_first=False)).collect()
    assert len(page) == 2 and page[0].time == "2024-03-01 10:02:03.000" and page[0].resource == "arn:x" and json.loads(page[0].matched_fields)["identity_type"] == "Root"
    groups = {r.rule_id: r.matches for r in case.groups().collect()}
    assert groups["root_sensitive_action"] == 5 and groups["client_denied"] == 1 and groups["calls_throttled"] == 0 and len(groups) == 24
    assert case.groups().first().rule_id == "root_sensitive_action"
    with monkeypatch.context() as m:
        m.setattr(results, "evaluate", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            case.evaluate(rules["root_sensitive_action"])
    assert not case.rules["root_sensitive_action"]["evaluated"] and case.matches("root_sensitive_action").count() == 0
    assert not [x for x in os.listdir(case.path) if x.startswith("staged")]


def test_search_is_no_rule(case):
    assert case.search("plain words") is None
    assert case.search('event_name == "GetObject" or error_code == "HTTP 503"') == "#search"
    assert case.matches("#search").count() == 2
    case.search('error_code == "HTTP 503"')
    assert case.matches("#search").count() == 1
    one = results.matched_unmatched(case.events, case.matches(), Window()).first()
    hits = case.matches().where("rule_id <> '#search'").select("event_id").distinct().count()
    assert one.matched == hits and one.matched + one.unmatched == one.total == case.events.count()
    assert "#search" not in {r.rule_id for r in case.groups().collect()}


def test_case_folders(spark, case, tmp_path):
    root = os.path.dirname(case.path)
    assert [c["case_id"] for c in C.list_cases(spark, root)] == ["one"] and C.list_cases(spark, str(tmp_path / "no")) == []
    for bad in ("../x", "", "a/b", ".hidden", "a..b", "x" * 200):
        with pytest.raises(ValueError):
            C.safe_id(bad)
    with pytest.raises(FileNotFoundError):
        C.delete_case(spark, root, "two")
    os.makedirs(tmp_path / "empty")
    empty = C.Case.create(spark, f"file://{tmp_path}", "none", f"file://{tmp_path}/empty")
    with pytest.raises(FileExistsError):
        C.Case.create(spark, str(tmp_path), "none", str(tmp_path / "empty"))
    assert empty.events.count() == 0 and empty.files.count() == 0
    empty.register(RuleSet())
    C.delete_case(spark, str(tmp_path), "none")
    with pytest.raises(NotADirectoryError):
        C.Case.create(spark, str(tmp_path), "bad", str(tmp_path / "nowhere"))
    assert C.list_cases(spark, str(tmp_path))[0]["status"] == "failed"


def test_stream(spark, events, tmp_path):
    source = str(tmp_path / "in")
    whole = results.canonical(events)
    whole.where("event_id < 4").write.parquet(source)
    rules = parse_rules('rule a { condition: request.k == "a" } rule b { meta: log_type = "alb_access" condition: event_name exists }')
    stream = event_stream(spark, source, whole.schema)
    write_matches(matches(stream, rules), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    whole.where("event_id >= 4").write.mode("append").parquet(source)
    write_matches(matches(event_stream(spark, source, whole.schema), rules), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.rule_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.rule_id, r.event_id) for r in results.evaluate_all(events, rules).collect()} == {("a", 1), ("a", 2), ("a", 7), ("b", 3), ("b", 5)}
    counted = alerts_per_window(event_stream(spark, source, whole.schema), rules).writeStream.format("memory").queryName("alerts").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert {(r.rule_id, r.matches) for r in spark.table("alerts").where("start is not null").collect()} >= {("a", 3), ("b", 1)}


def test_page_plan_is_top_k(events):
    plan = page_rows(events, Window(limit=5))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_commonest_paths_are_ranked_in_shares(spark):
    counts = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') as log_type", "concat('p', lpad(id, 5, '0')) as path", "id % 7 as events").unionByName(spark.sql("select cast(null as string) log_type, 'x' path, 1L events"))
    plain = {}
    for r in counts.collect():
        plain.setdefault(r.log_type, []).append((-r.events, r.path))
    want = {(t, p, -n) for t, rows in plain.items() for n, p in sorted(rows)[:100]}
    got = results.commonest(counts, 100, shares=8)
    assert {tuple(r) for r in got.select("log_type", "path", "events").collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().count("Window ") >= 2


def test_a_parallel_export_has_the_bytes_of_a_streamed_one(spark, tmp_path):
    many = spark.range(3000).selectExpr("id as event_id", "'cloudtrail' as log_type", "timestamp_micros(cast(pmod(id * 7919, 977) as bigint) * 1000000) as t", "concat('n', id, if(id % 9 = 0, '\u00e9', '')) as event_name")
    many = many.withColumn("event_time", F.when(F.col("event_id") % 11 != 0, F.col("t").cast("timestamp_ntz"))).drop("t").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for newest in (True, False):
            told = []
            assert export_file(many, Window(newest_first=newest), str(tmp_path / "a"), parallel=False) == 3000
            assert export_file(many, Window(newest_first=newest), str(tmp_path / "b"), progress=lambda n: told.append(n) or True) == 3000
            assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes() and told[-1] == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    with pytest.raises(InterruptedError):
        export_file(many, Window(), str(tmp_path / "c"), progress=lambda n: False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    assert export_file(many.limit(0), Window(), str(tmp_path / "none")) == 0 and (tmp_path / "none").read_bytes() == b""
