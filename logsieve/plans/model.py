"""The syntax tree of detection rules."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Operators of a field condition; the first group compares numbers, the second takes text.
ORDERED = (">", ">=", "<", "<=")
TEXTUAL = ("contains", "startswith", "endswith", "icontains", "istartswith", "iendswith")
OPERATORS = ("==", "!=", *ORDERED, *TEXTUAL, "matches", "in", "exists", "missing")


class RuleError(ValueError):
    """A rule text that can't be read; ``line`` counts from 1."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(message if line is None else f"line {line}: {message}")
        self.message, self.line = message, line


class UnknownOperator(RuleError):
    pass


class DuplicateRule(RuleError):
    pass


@dataclass(frozen=True)
class Test:
    """``field operator value``: value is text, a number, a boolean, a tuple of texts, or None."""

    variable: str
    field: str
    operator: str
    value: str | float | bool | tuple[str, ...] | None = None


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Not:
    part: Condition


@dataclass(frozen=True)
class And:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Condition, ...]


@dataclass(frozen=True)
class AtLeast:
    """``n of (…)``: every listed entry counts, repeated ones too."""

    n: int
    names: tuple[str, ...]


Condition = Variable | Not | And | Or | AtLeast


@dataclass(frozen=True)
class Rule:
    id: str
    meta: dict[str, str] = field(default_factory=dict, hash=False)
    tests: tuple[Test, ...] = ()
    condition: Condition = AtLeast(0, ())

    @property
    def name(self) -> str:
        return self.meta.get("name", self.id)

    @property
    def severity(self) -> str:
        return self.meta.get("severity", "unknown")

    @property
    def description(self) -> str:
        return self.meta.get("description", "")

    @property
    def log_type(self) -> str | None:
        return self.meta.get("log_type")

    def applies_to(self, log_type: str) -> bool:
        return self.log_type is None or self.log_type == log_type

    def bindings(self, name: str) -> list[Test]:
        return [t for t in self.tests if t.variable == name]

    @property
    def columns(self) -> set[str]:
        """Event columns that the rule reads."""
        return {t.field.split(".", 1)[0] for t in self.tests}
