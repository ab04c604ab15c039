"""Sets of rules from files: the shipped pack under the analyst's own."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from logsieve.plans.model import Rule, RuleError
from logsieve.plans.parser import parse_rules, rule_sources

PACK = os.path.join(os.path.dirname(os.path.dirname(__file__)), "pack")
SUFFIX = ".rules"
_ID = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,99}")


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    sources: dict[str, str] = field(default_factory=dict)
    origin: dict[str, str] = field(default_factory=dict)
    #: (file, what is wrong with it); such a file's rules are left out, the others stay.
    errors: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, folder: str, origin: str = "user") -> RuleSet:
        out = cls()
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if not name.endswith(SUFFIX):
                continue
            path = os.path.join(folder, name)
            try:
                with open(path, encoding="utf-8") as file:
                    found = rule_sources(file.read())
                for rule, _ in found:
                    if rule.id in out.sources:
                        raise RuleError(f"rule {rule.id} is defined in another file, too")
            except (RuleError, OSError, UnicodeDecodeError) as error:
                out.errors.append((path, str(error)))
                continue
            for rule, source in found:
                out.rules.append(rule)
                out.sources[rule.id], out.origin[rule.id] = source, origin
        return out

    def over(self, upper: RuleSet) -> RuleSet:
        """This set with ``upper`` laid over it: a rule of the same id takes its place, others follow."""
        mine = {r.id: r for r in upper.rules}
        known = {r.id for r in self.rules}
        rules = [mine.get(r.id, r) for r in self.rules] + [r for r in upper.rules if r.id not in known]
        return RuleSet(rules, self.sources | upper.sources, self.origin | upper.origin, self.errors + upper.errors)

    def files(self) -> list[tuple[str, str]]:
        """(file name, text) of every rule, as a case keeps them."""
        return [(f"{self.origin[r.id]}-{r.id}{SUFFIX}", self.sources[r.id] + "\n") for r in self.rules]


def shipped() -> RuleSet:
    return RuleSet.load(PACK, "shipped")


def layered(folder: str) -> RuleSet:
    return shipped().over(RuleSet.load(folder))


def save_rule(folder: str, text: str, replaces: str | None = None) -> Rule:
    """Store one rule as the analyst's own; renames it if ``replaces`` names another id.

    Refused are texts without exactly one rule, ids that aren't plain, and overwriting another rule.
    """
    rules = parse_rules(text)
    if len(rules) != 1:
        raise RuleError(f"the text holds {len(rules)} rules, not one")
    rule = rules[0]
    if not _ID.fullmatch(rule.id):
        raise RuleError(f"{rule.id} can't be a file name")
    path = os.path.join(folder, rule.id + SUFFIX)
    if rule.id != replaces and (os.path.exists(path) or any(r.id == rule.id for r in RuleSet.load(folder).rules)):
        raise RuleError(f"rule {rule.id} exists")
    os.makedirs(folder, exist_ok=True)
    part = path + ".part"
    with open(part, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(part, path)
    if replaces and replaces != rule.id:
        delete_rule(folder, replaces)
    return rule


def delete_rule(folder: str, rule_id: str) -> None:
    if not _ID.fullmatch(rule_id):
        raise RuleError(f"{rule_id} can't be a file name")
    os.unlink(os.path.join(folder, rule_id + SUFFIX))
