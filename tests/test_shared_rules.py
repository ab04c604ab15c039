import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsieve.functions.display import canonical
from logsieve.operators import results
from logsieve.plans import shared as S
from logsieve.plans.model import Rule
from logsieve.plans.parser import parse_condition, parse_rules
from tests import rows as R
from tests.test_rules import EVENTS, LEAVES, SCHEMA


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([tuple(e[c.split(" ")[0]] for c in SCHEMA.split(", ")) for e in EVENTS], SCHEMA).repartition(3).cache()


def numbered(texts, meta=None):
    return [Rule(f"r{i}", meta or {}, c.tests, c.condition) for i, c in enumerate(map(parse_condition, texts))]


def check(events, rules):
    """Hits of the rules as data, against the row evaluator."""
    df, left = S.evaluate_index(canonical(events), rules)
    got = [(r.rule_id, r.event_id) for r in df.select("rule_id", "event_id").collect()]
    assert len(got) == len(set(got)), "a match came twice"
    gone = {r.id for r in left}
    want = {(r.id, e["event_id"]) for r in rules if r.id not in gone for e in EVENTS if r.applies_to(e["log_type"]) and R.condition(e, r, r.condition)}
    assert set(got) == want, sorted(set(got) ^ want)[:5]
    return left


def test_every_operator(events):
    assert check(events, numbered(LEAVES)) == []
    assert check(events, numbered(LEAVES, {"log_type": "waf_acl"})) == []


@pytest.mark.parametrize("shape", ["not ({0})", "{0} and {1}", "{0} or {1}", "not ({0} or {1}) and {2}", "({0} and {1}) or ({2} and {3})", "2 of ({0}, {1}, {2})", "not 2 of ({0}, {1}, {2})", "0 of ({0}) or 4 of ({1}, {2})", "not (0 of ({0})) or {1}"])
def test_shapes(events, shape):
    step = [LEAVES[i::5] + LEAVES[:i:5] for i in range(4)]
    check(events, numbered([shape.format(*four) for four in zip(*step)][:40]))


@settings(max_examples=6, deadline=None)
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

    check(events, numbered([some(3) for _ in range(12)]))


def test_bindings_overlapping_needles_and_long_lists(events):
    many = ", ".join(f'"v{i}"' for i in range(3000))
    texts = ['event_name icontains "lo"', 'event_name icontains "log"', 'event_name contains "Login"', 'event_name icontains "og" or event_name icontains "gi" or event_name == "Login"', f'event_name in ({many}, "Login")', f"event_name in ({many}) or source_ip exists"]
    check(events, numbered(texts))
    check(events, parse_rules("""
      rule a { meta: log_type = "waf_acl" fields: $x = event_name == "Login" $x = request.n > 5 $y = request.s exists $z = source_ip missing condition: $x and 1 of ($y, $y, $z) }
      rule b { fields: $x = event_name exists $x = error_code exists condition: 2 of ($x, $x) }
      rule c { condition: $none or event_name == "Login" fields: $none = nothing exists }"""))  # fmt: skip
    assert S.evaluate_index(canonical(events), [])[0].count() == 0


def test_too_many_clauses_stay_with_the_compiler(events):
    pairs = [f'(event_name == "a{i}" and source_ip == "b{i}")' for i in range(8)]
    rules = numbered([" or ".join(pairs), 'event_name == "Login"'])
    assert [r.id for r in check(events, rules)] == ["r0"]
    every = numbered([*LEAVES, " or ".join([*pairs, 'event_name == "Login"'])])
    got = sorted((r.rule_id, r.event_id) for r in results.evaluate_all(events, every).collect()) if "event_time" in events.columns else None
    small = results.evaluate_all(events.withColumn("event_time", F.lit(None).cast("timestamp_ntz")), every)
    assert got is None or got
    want = {(r.id, e["event_id"]) for r in every for e in EVENTS if R.condition(e, r, r.condition)}
    assert len(every) > results.COMPILED_RULES and {(r.rule_id, r.event_id) for r in small.collect()} == want


def test_covers_are_small():
    columns = ["event_name", "source_ip", "request", "log_type"]
    of = lambda text: S.cover(r := parse_condition(text), S.clauses(r), columns)
    assert of('event_name == "a" and request.n > 5') == {("=", "event_name", "a")}
    assert of('event_name in ("a", "b") and source_ip startswith "10."') == {("~", "source_ip", "10.")}
    assert of('event_name == "a" or source_ip == "b"') == {("=", "event_name", "a"), ("=", "source_ip", "b")}
    assert of('2 of (event_name == "a", source_ip == "b", request.n > 5)') == {("=", "event_name", "a"), ("=", "source_ip", "b")}
    assert of('not event_name == "a"') is None and of("request.n > 5") is None and of('event_name contains "x"') is None


@pytest.mark.parametrize("needles", [["a"], ["ab", "abc", "abcde", "b"], ["he", "she", "his", "hers"], ["a.b", "a*", "(", "é", "😀", "a😀b", "\\", "\n"]])
def test_the_pattern_finds_the_longest_at_every_place(spark, needles):
    texts = ["ushers his", "abcdeabcabd ababc", "a.b a*( é😀 a😀b \\ \n", "", "x" * 50 + "abcd"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(S.trie_pattern(needles)), F.lit(1)).alias("m")).collect()
    for r in found:
        want = [max((n for n in needles if r.t.startswith(n, i)), key=len) for i in range(len(r.t)) if any(r.t.startswith(n, i) for n in needles)]
        assert list(r.m) == want, (r.t, needles)


def test_the_plan_does_not_grow_with_the_rules(spark, events):
    sizes = []
    for n in (60, 600):
        rules = [Rule(f"r{i}", {}, c.tests, c.condition) for i in range(n) for c in [parse_condition(f'event_name == "n{i}" and request.n > {i}')]]
        df, _ = S.evaluate_index(canonical(events), rules)
        sizes.append(len(re.sub(r"#\d+", "", df._jdf.queryExecution().optimizedPlan().toString())))
    assert sizes[1] < 1.2 * sizes[0]


def test_a_row_meets_the_rules_of_its_rarest_value(spark, tmp_path):
    rules = numbered([f'event_name == "{"abcde"[i % 5]}" and identity_arn {op} "{text}"' for i in range(50) for op, text in (("endswith", f"/{i}"), ("startswith", f"{i}/"), ("==", f"/{i}/"))])
    events = canonical(spark.createDataFrame([(0, "a", "/10/"), (1, "a", "x/15"), (2, "b", "11/x"), (3, "c", "x/12x"), (4, "d", "x13/x"), (5, "e", "14")], "event_id long, event_name string, identity_arn string").coalesce(1))
    found = S.index(rules, events.columns)
    assert max(len(n) for _, n in found.atoms) <= 3
    met = S.candidates(S.with_facts(events, found), found).select("event_id", "rule.rule_id").collect()
    assert sorted((r.event_id, rules[int(r.rule_id[1:])].tests[1].value) for r in met) == [(0, "/10/"), (1, "/15"), (2, "11/")]
    events.write.parquet(str(tmp_path / "events"))
    hits = S.evaluate_index(spark.read.parquet(str(tmp_path / "events")), rules)[0]
    assert hits.rdd.getNumPartitions() > 1, "a small table is one task's"
    assert sorted((r.event_id, rules[int(r.rule_id[1:])].tests[1].value) for r in hits.collect()) == [(0, "/10/"), (1, "/15"), (2, "11/")]
