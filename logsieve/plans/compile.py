"""From syntax trees to Catalyst columns.

A rule becomes three columns: whether it matches, a weaker condition on plain columns that Parquet can
prune by, and the evidence. Absent values make every test but ``missing`` false, so each test is made
two-valued before conditions combine them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.fields import Field, resolve, with_variants
from logsieve.plans.model import ORDERED, And, AtLeast, Condition, Not, Rule, Test, Variable
from logsieve.plans.regex import to_java

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _equal(found: Field, value: str | float | bool) -> Column:
    if isinstance(value, bool):
        text = str(value).lower()
        if found.flag is not None:
            return found.flag == value
        return found.quick == text
    if isinstance(value, float):
        if found.kind is None:
            return F.lit(False)
        number = found.kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
        return number & (found.number == value)
    if found.flag is not None:
        return F.lit(False)
    same = found.quick == value
    if found.kind is not None and (value in ("true", "false") or value[:1] in ("{", "[")):
        same = same & (found.kind == "STRING")  # a boolean or a container is rendered alike
    return same


def _test(test: Test, found: Field | None) -> Column:
    """The test as a column that may still be null where the field is absent."""
    op, value = test.operator, test.value
    if found is None:
        return F.lit(op == "missing")
    if op == "exists":
        return found.present
    if op == "missing":
        return ~found.present
    if op == "==":
        return _equal(found, value)
    if op == "!=":
        return found.present & ~F.coalesce(_equal(found, value), F.lit(False))
    if op in ORDERED:
        if not isinstance(value, float):
            return F.lit(False)
        n = found.number
        return {">": n > value, ">=": n >= value, "<": n < value, "<=": n <= value}[op]
    if op == "matches":
        return found.text.rlike(to_java(value))
    if op == "in":
        return (found.text if any(v[:1] in ("{", "[") for v in value) else found.quick).isin(*value)
    if not isinstance(value, str):
        return F.lit(False)
    text = found.text
    if op.startswith("i"):
        text, value, op = _ascii_lower(text), value.translate(_FOLD), op[1:]
    return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op](text, F.lit(value))


@dataclass
class Compiled:
    rule: Rule
    #: Never null.
    matches: Column
    #: Implied by ``matches`` and made of plain columns, or None.
    pruning: Column | None
    #: JSON object of variable to the value that fired.
    evidence: Column

    @property
    def condition(self) -> Column:
        return self.matches if self.pruning is None else self.pruning & self.matches


class Compiler:
    def __init__(self, columns: list[str]):
        self.columns = columns

    def test(self, test: Test) -> Column:
        return F.coalesce(_test(test, resolve(test.field, self.columns)), F.lit(False))

    def _cost(self, test: Test) -> int:
        return ("." in test.field) * 2 + (test.operator == "matches")

    def variable(self, rule: Rule, name: str) -> Column:
        tests = sorted(rule.bindings(name), key=self._cost)
        return reduce(or_, map(self.test, tests)) if tests else F.lit(False)

    def condition(self, rule: Rule, c: Condition) -> Column:
        if isinstance(c, Variable):
            return self.variable(rule, c.name)
        if isinstance(c, Not):
            return ~self.condition(rule, c.part)
        if isinstance(c, AtLeast):
            if c.n == 0:
                return F.lit(True)
            if c.n > len(c.names):
                return F.lit(False)
            return reduce(lambda a, b: a + b, [self.variable(rule, n).cast("int") for n in c.names]) >= c.n
        return reduce(and_ if isinstance(c, And) else or_, [self.condition(rule, p) for p in c.parts])

    def _plain(self, test: Test) -> Column | None:
        """The test as Parquet can take it, if its field is a plain text column."""
        found = resolve(test.field, self.columns)
        if found is None:
            return F.lit(test.operator == "missing")
        exact = test.operator in ("exists", "missing", "in", "contains", "startswith", "endswith") or (test.operator == "==" and isinstance(test.value, str))
        if found.plain and exact:
            return _test(test, found)
        column = test.field.split(".", 1)[0]
        return None if test.operator == "missing" else F.col(column).isNotNull()

    def weaker(self, rule: Rule, c: Condition) -> Column | None:
        """A condition on plain columns that holds wherever ``c`` holds; None if there is none but true."""
        if isinstance(c, Variable):
            parts = [self._plain(t) for t in rule.bindings(c.name)]
            return reduce(or_, parts) if parts and all(p is not None for p in parts) else None
        if isinstance(c, Not):
            return None
        if isinstance(c, AtLeast):
            if c.n == 0:
                return None
            if c.n > len(c.names):
                return F.lit(False)
            parts = [self.weaker(rule, Variable(n)) for n in c.names]
            every = c.n == len(c.names)
        else:
            parts = [self.weaker(rule, p) for p in c.parts]
            every = isinstance(c, And)
        known = [p for p in parts if p is not None]
        if every:
            return reduce(and_, known) if known else None
        return reduce(or_, known) if len(known) == len(parts) else None

    def evidence(self, rule: Rule) -> Column:
        """Every test that fired, named by its variable; of several for one variable the last."""
        fired: dict[str, list[Column]] = {}
        for t in rule.tests:
            found = resolve(t.field, self.columns)
            text = F.lit("") if t.operator == "missing" else (found.text if found else F.lit(None).cast("string"))
            fired.setdefault(t.variable, []).append(F.when(self.test(t), text))
        if not fired:
            return F.lit("{}")
        return F.to_json(F.struct(*[F.coalesce(*reversed(fired[v])).alias(v) for v in sorted(fired, key=lambda v: v.encode())]))

    def compile(self, rule: Rule) -> Compiled:
        matches, pruning = self.condition(rule, rule.condition), self.weaker(rule, rule.condition)
        if rule.log_type is not None and "log_type" in self.columns:
            own = F.col("log_type") == rule.log_type  # a partition filter where tables are split by type
            matches, pruning = F.coalesce(own, F.lit(False)) & matches, own if pruning is None else own & pruning
        return Compiled(rule, matches, pruning, self.evidence(rule))


def _needs_kind(test: Test) -> bool:
    """Whether the test parses the body into a VARIANT for each row it looks at."""
    if "." not in test.field or test.operator not in ("==", "!="):
        return False
    return isinstance(test.value, float) or (isinstance(test.value, str) and (test.value in ("true", "false") or test.value[:1] in ("{", "[")))


def prepare(events: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Compiled]]:
    """``events`` with what the rules need beside its columns, and the rules compiled to it."""
    events = with_variants(events, {t.field.split(".", 1)[0] for r in rules for t in r.tests if _needs_kind(t)})
    compiler = Compiler(events.columns)
    return events, [compiler.compile(r) for r in rules]
