"""Rules in words."""

from __future__ import annotations

from logsieve.plans.model import And, AtLeast, Condition, Not, Or, Rule, Test, Variable

_WORDS = {
    "==": "is", "!=": "is not", ">": "is more than", ">=": "is at least", "<": "is less than", "<=": "is at most", "contains": "contains", "startswith": "starts with", "endswith": "ends with",
    "icontains": "contains (any case)", "istartswith": "starts with (any case)", "iendswith": "ends with (any case)", "matches": "matches", "in": "is one of", "exists": "is present", "missing": "is absent",
}


def _value(test: Test) -> str:
    v = test.value
    if isinstance(v, tuple):
        return " " + ", ".join(f'"{x}"' for x in v)
    if isinstance(v, bool):
        return f" {str(v).lower()}"
    if isinstance(v, float):
        return f" {v:g}"
    if v is None:
        return ""
    return f" /{v}/" if test.operator == "matches" else f' "{v}"'


def explain_test(test: Test) -> str:
    return f"{test.field} {_WORDS[test.operator]}{_value(test)}"


def explain(rule: Rule) -> str:
    """One sentence: which log type, and what must hold."""

    def name(variable: str) -> str:
        return " or ".join(map(explain_test, rule.bindings(variable))) or variable

    def say(c: Condition, nested: bool = False) -> str:
        if isinstance(c, Variable):
            text = name(c.name)
            return f"({text})" if nested and len(rule.bindings(c.name)) > 1 else text
        if isinstance(c, Not):
            return f"not ({say(c.part)})"
        if isinstance(c, AtLeast):
            return f"at least {c.n} of: " + "; ".join(map(name, c.names))
        text = (" and " if isinstance(c, And) else " or ").join(say(p, True) for p in c.parts)
        return f"({text})" if nested and isinstance(c, Or) else text

    where = f"In {rule.log_type} events, " if rule.log_type else "In any event, "
    return f"{where}{say(rule.condition)}."
