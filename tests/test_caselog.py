import threading

import pytest

from logsieve.operators.case import Case
from logsieve.operators.caselog import WHOLE_EVERY, CaseLog
from logsieve.operators.rulesets import RuleSet, shipped
from logsieve.sources.storage import Storage
from tests import fixtures as X


@pytest.fixture
def log(spark, tmp_path):
    return CaseLog(Storage(spark), str(tmp_path / "log"))


def test_states_are_folded_from_commits(log):
    assert log.state() == (0, {"rules": {}, "matches": {}})
    for i in range(2 * WHOLE_EVERY + 3):
        log.commit(lambda s, i=i: s["rules"].__setitem__(f"r{i % 40}", {"n": i}))
    log.commit(lambda s: s["rules"].pop("r0"))
    before, after = log.commit(lambda s: s["matches"].__setitem__("r1", "f"))
    assert before["matches"] == {} and after["matches"] == {"r1": "f"}
    number, state = log.state()
    assert number == 2 * WHOLE_EVERY + 5 and state == after and "r0" not in state["rules"] and state["rules"]["r1"]["n"] == 41
    assert log.commit(lambda s: None)[1] == state and log.state()[0] == number  # no change, no commit
    for name in log.disk.names(log.folder):
        if name.endswith(".whole.json"):
            log.disk.delete(f"{log.folder}/{name}")
    assert log.state() == (number, state)


def test_of_two_writers_one_comes_second(log):
    def slow(state):
        if not state["rules"]:  # another commit comes in between
            log.commit(lambda s: s["rules"].__setitem__("other", {}))
        state["rules"]["own"] = {}

    log.commit(slow)
    assert log.state()[1]["rules"] == {"other": {}, "own": {}} and log.state()[0] == 2


def test_many_writers_lose_nothing(log):
    def write(w):
        for i in range(5):
            log.commit(lambda s: s["rules"].__setitem__(f"{w}-{i}", {"n": i}))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, state = log.state()
    assert number == 20 and len(state["rules"]) == 20


def test_evaluations_at_a_time_both_stay(spark, tmp_path):
    case = Case.create(spark, str(tmp_path), "one", X.write_folder(str(tmp_path / "logs")))
    case.register(shipped())
    rules = {r.id: r for r in shipped().rules}
    names = ["root_sensitive_action", "client_denied"]
    threads = [threading.Thread(target=case.evaluate, args=(rules[n],)) for n in names]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert all(case.rules[n]["evaluated"] for n in names) and {r.rule_id for r in case.matches().select("rule_id").distinct().collect()} <= set(names)
    count = case.matches(names[0]).count()
    case.evaluate(rules[names[0]])
    assert case.matches(names[0]).count() == count and len(case.disk.names(f"{case.path}/matches")) == 2
    case.register(RuleSet())
    assert case.rules == {} and case.matches().count() == 0 and case.disk.names(f"{case.path}/matches") == []
