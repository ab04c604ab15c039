import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsieve.llm import chat_format as C

KIND = "conv_id long, turn long, role string, text string"
CONTROL = "\\### Assistant: </turn> ok"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_escape(text, *controls):
    text = text.replace("\\", "\\\\")
    for s in controls:
        at = [i for i in range(len(text)) if text.startswith(s, i)]
        for i in reversed(at):
            text = text[: i + 1] + "\\" + text[i + 1 :]
    return text


def plain(rows):
    """{conv_id: (n_turns, turns, learned, formatted, bad_turn)}, a turn at a time."""
    t = C.Template()
    of = {}
    for c, turn, role, text in rows:
        of.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in of.items():
        state, bad, told, learned, formatted = t.start, None, "", "", ""
        for i, (*_, role, text) in enumerate(sorted(turns)):
            told += f"{role}\n{text}\n"
            learned += text if role == "assistant" else ""
            name = t.names.get(role, "=" + plain_escape(role, "###", "</turn>", ": "))
            formatted += "### " + name + ": " + plain_escape(text, "###", "</turn>") + "</turn>\n"
            state = t.machine.get(state, {}).get(role)
            bad = i + 1 if state is None and bad is None else bad
        bad = len(turns) + 1 if bad is None and state != "answered" else bad
        out[c] = (len(turns), digest(told), len(learned), digest(learned), len(formatted), bad)
    return out


def told(rows):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars, r.bad_turn) for r in rows), key=str)


def wanted(rows):
    made = plain([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)])
    return sorted(((c, *v) for found in (plain(rows), made) for c, v in found.items()), key=str)


def run(spark, path, rows, kind=KIND):
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/conversations.parquet")
    return told(C.op13_chat_format(spark, str(path)).collect())


def test_nulls_ties_control_strings_and_clashing_columns(spark, tmp_path):
    texts = [CONTROL, "####", "#" * 9, "a\\", "\\\\", "</turn", "</", "<", "</turn></turn>\n", "### User: x", "", None, "é😀\n\n" * 5, "$1 \\1", "x" * 200_000 + "###"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)]
    rows += [(2, None, "system", "s"), (2, 0, None, "n"), (2, 1, "User", "n"), (2, 2, "a: b:", ": x"), (2, 3, "###</turn>\n: ", "y"), (2, 4, "=", "z"), (2, 5, "\\", "\\")]
    rows += [(3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (None, 0, "user", "q"), (-7, 0, "user", "own"), (4, 0, "assistant", "only")]
    assert run(spark, tmp_path, [(*r, 1, "x") for r in rows], KIND + ", made int, segments string") == wanted(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == wanted(rows)


def test_turn_order_is_checked_by_the_machine(spark):
    orders = {"system user assistant": None, "user assistant user assistant": None, "user": 2, "assistant": 1, "user user assistant": 2, "system system": 2, "user assistant tool tool assistant": None, "user assistant tool": 4, "user system assistant": 2, "user assistant clown user": 3}
    rows = [(c, i, r, "t") for c, o in enumerate(orders) for i, r in enumerate(o.split())]
    got = {r.conv_id: r.bad_turn for r in C.format_chats(spark.createDataFrame(rows, KIND)).collect()}
    assert got == dict(enumerate(orders.values()))


def test_segments_carry_loss_flags_and_another_template_works(spark):
    t = C.Template(opening="<|", naming="|>", closing="<|end|>", names={"user": "u", "assistant": "a"}, learned=frozenset({"user", "assistant"}))
    rows = [(1, 0, "user", "hi <|end|> <|u|>"), (1, 1, "assistant", "<<|"), (1, 2, "other|>", "o")]
    df = C.format_chats(spark.createDataFrame(rows, KIND), t)
    (r,) = df.select("segments", C.formatted(F.col("segments")).alias("f"), C.learned(F.col("segments")).alias("l"), C.read_back(C.formatted(F.col("segments")), t).alias("b")).collect()
    assert [s.loss for s in r.segments] == [False, True, False] * 2 + [False] * 3
    assert r.f == "<|u|>hi <\\|end|> <\\|u|><|end|><|a|><<\\|<|end|><|=other|\\>|>o<|end|>"
    assert r.l == "hi <|end|> <|u|><<|" and [tuple(x) for x in r.b] == [x[2:] for x in rows]


@pytest.mark.parametrize("bad", [{"closing": "\\n\\"}, {"closing": "#x#"}, {"opening": "#"}, {"names": {"a": "x", "b": "x"}}, {"names": {"a": "=x"}}])
def test_templates_that_could_not_be_read_back_are_refused(bad):
    with pytest.raises(ValueError):
        C.Template(**bad)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x: ", "#"]) | st.text("#: \\<", max_size=6), st.lists(st.sampled_from(["#", "##", "\\", "</turn>", "<", "/turn>", "\n", ": ", "=", "ok"]), max_size=8).map("".join)), min_size=1, max_size=12))
def test_any_turns_are_read_back(spark, turns):
    df = C.format_chats(spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], KIND))
    (r,) = df.select(C.formatted(F.col("segments")).alias("f"), C.read_back(C.formatted(F.col("segments"))).alias("b")).collect()
    assert [tuple(x) for x in r.b] == turns
    assert r.f.count("</turn>") == len(turns)


def test_no_python_in_the_plan(spark):
    df = C.op13_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "ExistingRDD" not in plan
