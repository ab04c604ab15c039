import pytest

from logsieve.api import Engine, as_rows, with_clause
from logsieve.operators.window import Window
from logsieve.plans.model import RuleError
from logsieve.plans.parser import parse_condition
from tests import fixtures as X


@pytest.mark.parametrize("text,want", [
    ("", 'c == "1"'), ('a == "x"', 'a == "x" and c == "1"'), ('a == "x or y"', 'a == "x or y" and c == "1"'), ('a == "x" or b exists', '(a == "x" or b exists) and c == "1"'),
    ("(a exists or b exists)", '(a exists or b exists) and c == "1"'), ("a matches / or /", 'a matches / or / and c == "1"')])
def test_clauses(text, want):
    assert with_clause(text, 'c == "1"') == want and parse_condition(want) is not None


def test_a_session(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "work"))
    folder = X.write_folder(str(tmp_path / "logs"))
    assert len(as_rows(engine.scan_directory(folder))) == 12 and engine.detect_logs(folder).count() == 10
    assert engine.default_mapping()["event_name"] == ("eventName",) and engine.preview_mapping(X.audit())["identity_name"] == "issuer"
    assert engine.preview_head(f"{folder}/a_audit.json.gz").log_type == "cloudtrail"

    engine.save_rule('rule mine { meta: severity = "high" condition: error_code == "HTTP 503" }')
    with engine.cancellable("parse"):
        engine.start_parse("c1", folder)
    assert engine.cancel("parse") == []
    assert engine.list_cases()[0]["case_id"] == "c1" and len(engine.list_rule_sources()) == 25
    assert engine.explain_rule("rule a { condition: x exists }") == ["In any event, x is present."]
    assert engine.count_rule_matches("c1", 'rule a { condition: error_code == "HTTP 503" } rule b { condition: error_code startswith "HTTP 503" }')[0] == 1

    engine.evaluate_rule("c1", "mine")
    engine.evaluate_rule("c1", "mine")
    page = engine.query_rule_matches("c1", "mine")
    assert page.total == 1 and page.next is None and page.rows[0]["status"] == "503"
    side = engine.query_results("c1")
    assert {r["rule_id"]: r["matches"] for r in side["rules"]}["mine"] == 1 and side["totals"]["matched"] == 1 and side["log_types"]["waf_acl"] == 2 and side["days"]["last_day"] == "2026-08-31"

    events = engine.query_events("c1", Window(limit=5))
    assert len(events.rows) == 5 and events.total > 5 and engine.query_events("c1", Window(limit=5, after=events.next)).total is None
    assert engine.search("c1", 'event_name == "BLOCK"').total == 1 and engine.search("c1", "getobj").total == 1 and engine.search("c1", "").total == events.total
    assert engine.field_stats("c1", "event_name", rule_id="mine").first().value == "PUT"
    assert engine.list_payload_keys("c1").count() > 20
    some = page.rows[0]["event_id"]
    assert dict(engine.get_event("c1", some))["event_source"] == "nginx" and "birdview" in engine.get_raw_record("c1", some)
    assert engine.export_results("c1", str(tmp_path / "x.jsonl"), rule_id="mine") == 1
    engine.delete_rule("mine")
    with pytest.raises(RuleError):
        engine.delete_rule("..")
    engine.delete_case("c1")
    assert engine.list_cases() == []
