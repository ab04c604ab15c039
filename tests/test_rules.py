import itertools
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsieve.functions.display import canonical
from logsieve.functions.fields import time_text
from logsieve.operators import results
from logsieve.operators.rulesets import RuleSet, delete_rule, layered, save_rule, shipped
from logsieve.plans.compile import prepare
from logsieve.plans.explain import explain
from logsieve.plans.model import And, AtLeast, DuplicateRule, Not, Or, RuleError, UnknownOperator, Variable
from logsieve.plans.parser import parse_condition, parse_rules, rule_sources
from logsieve.plans.regex import to_java
from tests import rows as R

SCHEMA = "event_id long, log_type string, event_name string, source_ip string, error_code string, mfa_authenticated boolean, request string, response string, raw string"
BODIES = [
    '{"n":5,"s":"5","t":"true","b":true,"f":false,"z":null,"a":[1,2],"o":{"k":"v","j":1},"d":1.5,"u":"Äx","neg":-3}', '{"n":6,"s":"abc","b":"true","o":{"j":{"i":"deep"}},"a":"[1,2]","d":"1.5"}',
    '{"n":"6","s":"","big":1e3,"a":[],"o":{},"0":"zero"}', "[1,2,3]", "not json", None, '{"s":" 5 ","n":"5d","x":"NaN","i":"inf","h":"0x10","p":"+5"}',
]
EVENTS = [
    dict(event_id=i, log_type=["cloudtrail", "waf_acl"][i % 2], event_name=n, source_ip=ip, error_code=e, mfa_authenticated=m, request=b, response=BODIES[(i + 3) % 7], raw=BODIES[(i + 1) % 7])
    for i, (n, ip, e, m, b) in enumerate(itertools.product(["Login", "LOGOUT", None], ["192.0.2.1", None], ["HTTP 403"], [True, False, None], BODIES))
]

LEAVES = [
    'event_name == "Login"', 'event_name != "Login"', 'event_name icontains "log"', 'event_name istartswith "LOGI"', 'event_name iendswith "OUT"', 'event_name contains "ogi"', 'event_name startswith "Lo"', 'event_name endswith "in"',
    'event_name contains ""', 'event_name in ("Login", "x")', "event_name matches /^Log(in|x)$/", "event_name exists", "event_name missing", 'source_ip startswith "192."', "source_ip missing", 'error_code == "HTTP 403"',
    "mfa_authenticated == true", "mfa_authenticated == false", "mfa_authenticated != true", 'mfa_authenticated == "true"', 'mfa_authenticated in ("true")', "mfa_authenticated > 0", "event_name > 3", "event_name == 5",
    "request.n > 5", "request.n >= 5", "request.n < 6", "request.n <= 5", "request.n == 5", "request.n == 6", 'request.n == "5"', "request.n != 5", 'request.n == "6"', 'request.s == "5"', "request.s > 4", 'request.s == ""',
    "request.b == true", "request.b == false", 'request.b == "true"', "request.t == true", 'request.t == "true"', "request.f == false", "request.b exists", "request.z exists", "request.z missing", 'request.a == "[1,2]"', 'request.a matches /^\\[1,2\\]$/',
    'request.a in ("[1,2]")', 'request.o contains "\\"k\\""', 'request.o.j == "1"', "request.o.j == 1", 'request.o.j.i == "deep"', "request.o.k.x missing", "request.0 exists", "request.a.0 missing", "request.d == 1.5", "request.d > 1", 'request.u icontains "äX"',
    'request.u icontains "ÄX"', "request.x > 1", "request.i > 1", "request.h > 1", "request.p > 1", "request.big > 999", "request.neg < -2", "request.neg == -3", "request exists", 'request contains "not"', 'raw.s == "5"', "raw.n > 5", 'raw.o == "{\\"j\\":1,\\"k\\":\\"v\\"}"',
    "response.n > 5", "nothing exists", "nothing missing", "nothing.at.all missing", 'event_name.x == "y"', "mfa_authenticated contains true", "event_name startswith 5",
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([tuple(e[c.split(" ")[0]] for c in SCHEMA.split(", ")) for e in EVENTS], SCHEMA).repartition(3).cache()


def check(events, rules):
    """All rules in one pass: matches, the weaker condition, and evidence, against the row evaluator."""
    prepared, compiled = prepare(canonical(events), rules)
    weak = [F.lit(True) if c.pruning is None else F.coalesce(c.pruning, F.lit(False)) for c in compiled]
    got = prepared.select("event_id", F.array(*[c.matches for c in compiled]).alias("m"), F.array(*weak).alias("w"), F.array(*[c.evidence for c in compiled]).alias("e")).collect()
    by = {e["event_id"]: e for e in EVENTS}
    for r in got:
        event = by[r.event_id]
        for rule, m, w, e in zip(rules, r.m, r.w, r.e):
            want = R.condition(event, rule, rule.condition) and rule.applies_to(event["log_type"])
            assert m is not None and m == want, (explain(rule), event)
            assert w or not m, (explain(rule), event)
            assert json.loads(e) == R.evidence(event, rule), (explain(rule), event)


def test_every_operator_on_every_event(events):
    check(events, [parse_condition(t) for t in LEAVES])


@pytest.mark.parametrize("shape", ["not ({0})", "{0} and {1}", "{0} or {1}", "not ({0} or {1}) and {2}", "({0} and {1}) or ({2} and {3})", "2 of ({0}, {1}, {2})", "3 of ({0}, {1}, {2})", "0 of ({0}) or 4 of ({1}, {2})"])
def test_shapes(events, shape):
    step = [LEAVES[i::5] + LEAVES[:i:5] for i in range(4)]
    rules = [parse_condition(shape.format(*four)) for four in zip(*step)]
    assert all(rules)
    check(events, rules[:16])


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_random_conditions(events, data):
    def some(depth):
        if depth == 0 or data.draw(st.booleans()):
            return data.draw(st.sampled_from(LEAVES))
        kind = data.draw(st.sampled_from(["and", "or", "not", "of"]))
        if kind == "not":
            return f"not ({some(depth - 1)})"
        if kind == "of":
            return f"{data.draw(st.integers(0, 3))} of ({data.draw(st.sampled_from(LEAVES))}, {data.draw(st.sampled_from(LEAVES))})"
        return f"({some(depth - 1)}) {kind} ({some(depth - 1)})"

    check(events, [parse_condition(some(3)) for _ in range(4)])


def test_bindings_and_log_type(events):
    check(events, parse_rules("""
      rule a { meta: log_type = "waf_acl" fields: $x = event_name == "Login" $x = request.n > 5 $y = request.s exists $z = source_ip missing condition: $x and 1 of ($y, $y, $z) }
      rule b { fields: $x = event_name exists $x = error_code exists $x = request.n exists condition: 2 of ($x, $x) }"""))  # fmt: skip


def test_parser():
    text = '// first\nrule one { meta: name = "N" severity = "high"\n fields: $a = event_name == "a\\"b\\n" $b = request.k >= -1.5\n condition: $a or not $b and ($a) }\n/* x */ rule two { condition: 2 of (event_name exists, event_name missing, $c) fields: $c = x in ("1", "2") }'
    one, two = parse_rules(text)
    assert (one.name, one.severity, one.description, one.log_type) == ("N", "high", "", None) and (two.name, two.severity) == ("two", "unknown")
    assert one.tests[0].value == 'a"b\n' and one.tests[1].value == -1.5
    assert one.condition == Or((Variable("$a"), And((Not(Variable("$b")), Variable("$a")))))
    assert two.condition == AtLeast(2, ("event_name", "event_name#2", "$c")) and two.columns == {"event_name", "x"}
    assert [s.split("{")[0].strip() for _, s in rule_sources(text)] == ["rule one", "rule two"]
    assert explain(one) == 'In any event, event_name is "a"b\n" or not (request.k is at least -1.5) and event_name is "a"b\n".'


@pytest.mark.parametrize("text,line,kind", [
    ("rule a {\n condition: $x }", 2, RuleError), ("rule a {\n\n condition: f like \"x\" }", 3, UnknownOperator), ("rule a { }", 1, RuleError), ("rule a { condition: f == }", 1, RuleError), ("rule a {\n condition: f matches /(/ }", 2, RuleError),
    ("rule a { condition: f matches /(?=x)/ }", 1, RuleError), ("rule a { condition: f matches /(a)\\1/ }", 1, RuleError), ('rule a { condition: f == "open }', 1, RuleError), ("rule a { condition: f > 1.2.3 }", 1, RuleError),
    ("rule a { condition: f exists } rule a { condition: f exists }", None, DuplicateRule), ("rule a { other: x }", 1, RuleError), ("rule a { condition: f in () }", 1, RuleError), ("x", 1, RuleError)])
def test_faults(text, line, kind):
    with pytest.raises(kind) as e:
        parse_rules(text)
    assert e.value.line == line


@pytest.mark.parametrize("text", ["hello", "43.201", "", "event_name", 'event_name == "x" }', 'event_name == "x" } rule b { condition: y exists', "$a", "fields: $a = x exists condition: $a", "ConsoleLogin and x"])
def test_what_is_no_condition(text):
    assert parse_condition(text) is None


def test_regex(spark):
    cases = [("a$", ["a", "a\n"], [True, False]), ("a.b", ["a\rb", "a\nb"], [True, False]), ("(?i)ä", ["Ä"], [True]), ("\\d", ["٣", "x"], [True, False]), ("[$]x", ["$x", "x"], [True, False]), ("(?P<n>x)[]a]", ["x]", "xb"], [True, False])]
    for pattern, texts, want in cases:
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.col("t").rlike(to_java(pattern)).alias("m")).collect()
        assert [r.m for r in rows] == want, pattern


def test_time_text(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' a union all select timestamp_ntz'2024-01-02 03:04:05.120' union all select timestamp_ntz'2024-01-02 03:04:50'").select(time_text(F.col("a")).alias("t")).collect()
    assert [r.t for r in rows] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.12Z", "2024-01-02T03:04:50Z"]


def test_pushdown_and_pruning(spark, tmp_path):
    spark.range(10).selectExpr("id as event_id", "if(id < 5, 'waf_acl', 'cloudtrail') as log_type", "'x' as event_name", "'{}' as request").write.partitionBy("log_type").parquet(str(tmp_path / "e"))
    rule = parse_rules('rule a { meta: log_type = "waf_acl" condition: (event_name == "x" and request.k > 1) or (event_name in ("y", "z") and request.j exists) }')[0]
    events, (c,) = prepare(spark.read.parquet(str(tmp_path / "e")), [rule])
    plan = events.where(c.condition).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*log_type#\d+ = waf_acl", plan) and "Or(EqualTo(event_name,x),In(event_name, [y,z]))" in plan
    assert "Python" not in plan and "parseJson" not in plan


def test_rule_sets(tmp_path):
    pack = shipped()
    assert len(pack.rules) == 24 and not pack.errors and all(r.severity in ("high", "medium", "low") and r.description and r.log_type for r in pack.rules)
    folder = str(tmp_path)
    (tmp_path / "bad.rules").write_text("rule x {")
    (tmp_path / "note.txt").write_text("x")
    save_rule(folder, 'rule calls_throttled { condition: event_name == "mine" }')
    save_rule(folder, 'rule own { condition: event_name == "own" }')
    both = layered(folder)
    assert len(both.rules) == 25 and both.rules[-1].id == "own" and len(both.errors) == 1
    assert [r.id for r in both.rules].index("calls_throttled") == [r.id for r in pack.rules].index("calls_throttled") and both.origin["calls_throttled"] == "user"
    for text in ("rule own { condition: x exists }", "", "rule a { condition: x exists } rule b { condition: x exists }", "rule a.b { condition: x exists }"):
        with pytest.raises(RuleError):
            save_rule(folder, text)
    assert save_rule(folder, "rule renamed { condition: x exists }", replaces="own").id == "renamed"
    assert {r.id for r in RuleSet.load(folder).rules} == {"calls_throttled", "renamed"}
    delete_rule(folder, "renamed")
    with pytest.raises(RuleError):
        delete_rule(folder, "../x")
    (tmp_path / "snap").mkdir()
    for name, text in both.files():
        (tmp_path / "snap" / name).write_text(text)
    assert len(RuleSet.load(str(tmp_path / "snap")).rules) == 25


POSITIVE = {
    "root_sensitive_action": dict(event_name="ConsoleLogin", identity_type="Root"), "signin_wrong_password": dict(event_name="ConsoleLogin", error_message="Failed authentication"),
    "user_signin_single_factor": dict(event_name="ConsoleLogin", identity_type="IAMUser", mfa_authenticated=False, response='{"ConsoleLogin":"Success"}'), "membership_changed": dict(event_source="iam.amazonaws.com", event_name="AddUserToGroup"),
    "boundary_removed": dict(event_name="DeleteUserPermissionsBoundary"), "identity_provider_changed": dict(event_source="iam.amazonaws.com", event_name="UpdateSAMLProvider", read_only=False),
    "password_rules_weakened": dict(event_name="UpdateAccountPasswordPolicy", request='{"minimumPasswordLength":13}'), "organization_left": dict(event_source="organizations.amazonaws.com", event_name="LeaveOrganization"),
    "port_opened_to_all": dict(event_name="AuthorizeSecurityGroupIngress", request='{"ipPermissions":{"items":[{"ipRanges":{"items":[{"cidrIp":"0.0.0.0/0"}]}}]}}'), "network_filter_changed": dict(event_source="ec2.amazonaws.com", event_name="ReplaceNetworkAclEntry"),
    "way_out_changed": dict(event_source="ec2.amazonaws.com", event_name="CreateRoute"), "flow_records_deleted": dict(event_name="DeleteFlowLogs"), "bucket_rules_changed": dict(event_source="s3.amazonaws.com", event_name="PutBucketAcl"),
    "image_given_to_all": dict(event_name="ModifyDBSnapshotAttribute", request='{"valuesToAdd":["all"]}'), "recorder_stopped": dict(event_source="config.amazonaws.com", event_name="StopConfigurationRecorder"), "calls_throttled": dict(error_code="ThrottlingException"),
    "client_denied": dict(error_code="HTTP 401"), "target_without_answer": dict(error_code="HTTP 504", response='{"elb_status_code":504}'), "target_slow": dict(response='{"target_processing_time":10.5}'), "firewall_rate_limit": dict(response='{"terminating_rule_type":"RATE_BASED"}'),
    "firewall_challenge": dict(event_name="CAPTCHA"), "integration_slow": dict(response='{"integration_latency":5000}'), "secrets_probed": dict(request='{"url":"w.example/.git/config"}'), "anonymous_write": dict(identity_type="anonymous", event_name="PUT"),
}
NEGATIVE = {
    "root_sensitive_action": dict(identity_type="Root", event_name="ListBuckets"), "user_signin_single_factor": dict(event_name="ConsoleLogin", identity_type="AssumedRole", mfa_authenticated=False, response='{"ConsoleLogin":"Success"}'),
    "password_rules_weakened": dict(event_name="UpdateAccountPasswordPolicy", request='{"minimumPasswordLength":14}'), "port_opened_to_all": dict(event_name="AuthorizeSecurityGroupIngress", request='{"cidrIp":"10.0.0.0/8"}'),
    "image_given_to_all": dict(event_name="ModifyDBSnapshotAttribute", request='{"valuesToAdd":["000000000000"]}'), "target_without_answer": dict(error_code="HTTP 504", response='{"target_status_code":504}'), "target_slow": dict(response='{"target_processing_time":10}'),
    "secrets_probed": dict(request='{"url":"w.example/environment"}'), "identity_provider_changed": dict(event_source="iam.amazonaws.com", event_name="ListSAMLProviders", read_only=True), "anonymous_write": dict(identity_type="member", event_name="PUT"),
}


def test_shipped_rules_find_what_they_name(spark):
    pack = {r.id: r for r in shipped().rules}
    assert POSITIVE.keys() == pack.keys()
    names = ["event_id", "log_type", "event_source", "event_name", "identity_type", "error_code", "error_message", "mfa_authenticated", "read_only", "request", "response"]
    cases = [(i, pack[i].log_type, c) for kind in (POSITIVE, NEGATIVE) for i, c in kind.items()] + [("other", "nginx_access", c) for i, c in POSITIVE.items() if pack[i].log_type == "cloudtrail"]
    rows = [(n, t, *[c.get(x) for x in names[2:]]) for n, (_, t, c) in enumerate(cases)]
    events = spark.createDataFrame(rows, "event_id long, log_type string, event_source string, event_name string, identity_type string, error_code string, error_message string, mfa_authenticated boolean, read_only boolean, request string, response string")
    fired = {(r.rule_id, r.event_id) for r in results.evaluate_all(events, list(pack.values())).collect()}
    for n, (i, t, _) in enumerate(cases):
        if i == "other":
            assert not any(e == n and pack[r].log_type == "cloudtrail" for r, e in fired)
        else:
            assert ((i, n) in fired) == (n < len(POSITIVE)), i
