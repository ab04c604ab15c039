"""A second evaluator of rules, over one event as a dictionary, to hold the compiled columns against."""

import json
import math
import re

from logsieve.functions.schema import FLAG_COLUMNS, JSON_COLUMNS, TEXT_COLUMNS
from logsieve.plans.model import And, AtLeast, Not, Variable

NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity)", re.I | re.A)


def look_up(event, field):
    """("text" | "flag" | "json", value) or None."""
    name, *path = field.split(".")
    value = event.get(name)
    if name not in (*TEXT_COLUMNS, *FLAG_COLUMNS, *JSON_COLUMNS) or value is None:
        return None
    if not path:
        return ("flag", value) if name in FLAG_COLUMNS else ("text", value)
    if name not in JSON_COLUMNS:
        return None
    try:
        value = json.loads(value)
    except ValueError:
        return None
    for step in path:
        value = value.get(step) if isinstance(value, dict) else None
    if value is None:
        return None
    return ("text", value) if isinstance(value, str) else ("flag", value) if isinstance(value, bool) else ("json", value)


def text(found):
    kind, value = found
    return value if kind == "text" else str(value).lower() if kind == "flag" else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def number(found):
    kind, value = found
    if kind == "json" and isinstance(value, (int, float)):
        return float(value)
    return float(value) if kind == "text" and NUMBER.fullmatch(value) else None


def fold(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def equal(found, value):
    kind, v = found
    if isinstance(value, bool):
        return v == value if kind == "flag" else kind == "text" and v == str(value).lower()
    if isinstance(value, float):
        return kind == "json" and not isinstance(v, (dict, list)) and float(v) == value
    return (kind == "text" and v == value) or (kind == "json" and not isinstance(v, (dict, list)) and text(found) == value)


def holds(event, test):
    found, op, value = look_up(event, test.field), test.operator, test.value
    if found is None:
        return op == "missing"
    if op in ("exists", "missing"):
        return op == "exists"
    if op in ("==", "!="):
        return equal(found, value) == (op == "==")
    if op in (">", ">=", "<", "<="):
        n = number(found)
        if not isinstance(value, float) or n is None or math.isnan(n):
            return False
        return {">": n > value, ">=": n >= value, "<": n < value, "<=": n <= value}[op]
    t = text(found)
    if op == "matches":
        return re.search(value, t) is not None
    if op == "in":
        return t in value
    if not isinstance(value, str):
        return False
    if op.startswith("i"):
        t, value, op = fold(t), fold(value), op[1:]
    return {"contains": value in t, "startswith": t.startswith(value), "endswith": t.endswith(value)}[op]


def variable(event, rule, name):
    return any(holds(event, t) for t in rule.bindings(name))


def condition(event, rule, c):
    if isinstance(c, Variable):
        return variable(event, rule, c.name)
    if isinstance(c, Not):
        return not condition(event, rule, c.part)
    if isinstance(c, AtLeast):
        return sum(variable(event, rule, n) for n in c.names) >= c.n
    return (all if isinstance(c, And) else any)(condition(event, rule, p) for p in c.parts)


def evidence(event, rule):
    out = {}
    for t in rule.tests:
        if holds(event, t):
            out[t.variable] = "" if t.operator == "missing" else text(look_up(event, t.field))
    return out
