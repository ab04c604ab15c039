"""The engine as one object: every verb that an application over it needs."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import case as cases
from logsieve.operators import results, rulesets
from logsieve.operators.case import Case
from logsieve.operators.export import export_file
from logsieve.operators.window import Cursor, Window
from logsieve.plans.explain import explain
from logsieve.plans.model import Rule
from logsieve.plans.parser import parse_condition, parse_rules
from logsieve.sources.detect import detect_all
from logsieve.sources.discovery import Scan, scan
from logsieve.sources.mapping import AUDIT_MAPPING, FieldMap
from logsieve.sources.preview import Preview, preview
from logsieve.sources.storage import Storage

@dataclass
class Page:
    rows: list[dict]
    #: Where the next page begins, or None at the end of the list.
    next: Cursor | None
    #: Counted for the first page only.
    total: int | None


def with_clause(text: str, clause: str) -> str:
    """A typed condition narrowed by one more clause; an ``or`` at its top is put in parentheses."""
    text = text.strip()
    if not text:
        return clause
    bare = re.sub(r'"(?:\\.|[^"\\])*"|/(?:\\.|[^/\\\n])+/', "x", text)
    while (inner := re.sub(r"\([^()]*\)", "x", bare)) != bare:
        bare = inner
    return f"({text}) and {clause}" if re.search(r"\bor\b", bare) else f"{text} and {clause}"


class Engine:
    """Cases under ``root``, which may be in any file system that Spark reaches; the analyst's rules in a local folder."""

    def __init__(self, spark: SparkSession, root: str, rules_folder: str | None = None):
        self.spark, self.root, self.rules_folder = spark, root, rules_folder or os.path.join(root, "rules")

    # Folders and files ---------------------------------------------------------------------------

    def scan_directory(self, folder: str) -> Scan:
        return scan(self.spark, folder)

    def detect_logs(self, folder: str) -> DataFrame:
        return detect_all(self.spark, [c.path for c in scan(self.spark, folder).candidates])

    def default_mapping(self) -> dict[str, tuple[str, ...]]:
        return dict(AUDIT_MAPPING)

    def preview_head(self, path: str, overrides: dict[str, list[str]] | None = None) -> Preview:
        """The first records of a file in any file system that Spark reads; its head is fetched, whatever its size."""
        with Storage(self.spark).open(path) if "://" in path else open(path, "rb") as file:
            return preview(path, file, overrides)

    def preview_mapping(self, record: dict, overrides: dict[str, list[str]] | None = None) -> dict[str, object]:
        from logsieve.sources.normalize import audit_event

        return audit_event(record, FieldMap(overrides))

    # Cases ---------------------------------------------------------------------------------------

    def start_parse(self, case_id: str, folder: str, selected: set[str] | None = None, overrides: dict[str, list[str]] | None = None) -> Case:
        case = Case.create(self.spark, self.root, case_id, folder, selected, overrides)
        case.register(self.rules())
        return case

    def case(self, case_id: str) -> Case:
        return Case(self.spark, f"{self.root}/{cases.safe_id(case_id)}")

    def list_cases(self) -> list[dict[str, object]]:
        return cases.list_cases(self.spark, self.root)

    def delete_case(self, case_id: str) -> None:
        cases.delete_case(self.spark, self.root, case_id)

    @contextmanager
    def cancellable(self, tag: str) -> Iterator[None]:
        """Jobs started inside can be stopped by ``cancel(tag)`` from another thread."""
        self.spark.addTag(tag)
        try:
            yield
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)

    # Rules ---------------------------------------------------------------------------------------

    def rules(self) -> rulesets.RuleSet:
        return rulesets.layered(self.rules_folder)

    def list_rule_sources(self) -> list[dict[str, str]]:
        found = self.rules()
        return [{"id": r.id, "name": r.name, "severity": r.severity, "log_type": r.log_type or "", "origin": found.origin[r.id], "source": found.sources[r.id]} for r in found.rules]

    def save_rule(self, text: str, replaces: str | None = None) -> Rule:
        return rulesets.save_rule(self.rules_folder, text, replaces)

    def delete_rule(self, rule_id: str) -> None:
        rulesets.delete_rule(self.rules_folder, rule_id)

    def explain_rule(self, text: str) -> list[str]:
        return [explain(r) for r in parse_rules(text)]

    def count_rule_matches(self, case_id: str, text: str) -> tuple[int, int]:
        """(events any rule of the text matches, all events), before anything is saved."""
        row = results.draft_count(self.case(case_id).events, parse_rules(text)).first()
        return row.matched, row.scanned

    def evaluate_rule(self, case_id: str, rule_id: str) -> None:
        """Evaluate a rule unless its matches are in place already."""
        case = self.case(case_id)
        if not case.rules.get(rule_id, {}).get("evaluated"):
            rule = next((r for r in self.rules().rules if r.id == rule_id), None)
            if rule is None:
                raise KeyError(f"no rule {rule_id}")
            case.evaluate(rule)

    # Lists ---------------------------------------------------------------------------------------

    def search_condition(self, case_id: str, text: str, rule_id: str | None = None) -> str | None:
        """Run the text as a condition, within a rule if one is selected; None if it isn't a condition."""
        within = next((r for r in self.rules().rules if r.id == rule_id), None)
        return self.case(case_id).search(text, within)

    def search(self, case_id: str, text: str, window: Window | None = None) -> Page:
        """What the search box does: a condition runs as a rule, any other text is looked for in the list."""
        window = window or Window()
        if text and parse_condition(text) is not None:
            return self.query_rule_matches(case_id, self.search_condition(case_id, text), window)
        return self.query_events(case_id, Window(**{**window.__dict__, "search": text}))

    def _page(self, rows: DataFrame, window: Window, total: Callable[[], int]) -> Page:
        found = [r.asDict() for r in rows.collect()]
        more = Cursor(found[-1]["event_id"], found[-1]["time_micros"]) if len(found) == window.size else None
        return Page(found, more, total() if window.after is None else None)

    def query_events(self, case_id: str, window: Window | None = None) -> Page:
        window, case = window or Window(), self.case(case_id)
        return self._page(case.list_events(window), window, lambda: results.count_events(case.events, window).first().events)

    def query_rule_matches(self, case_id: str, rule_id: str, window: Window | None = None) -> Page:
        window, matches = window or Window(), self.case(case_id).matches(rule_id)
        return self._page(results.list_matches(matches, window), window, lambda: results.count_events(matches, window).first().events)

    def query_results(self, case_id: str, window: Window | None = None) -> dict[str, object]:
        """The sidebar: rules with counts, events by type, matched and unmatched."""
        window, case = window or Window(), self.case(case_id)
        return {
            "rules": [r.asDict() for r in case.groups(window).collect()],
            "log_types": {r.log_type: r.events for r in results.log_type_counts(case.events, case.files).collect()},
            "totals": results.matched_unmatched(case.events, case.matches(), window).first().asDict(),
            "days": results.day_span(case.events).first().asDict(),
        }

    def _list(self, case: Case, rule_id: str | None) -> DataFrame | None:
        return None if rule_id is None else case.matches(rule_id)

    def field_stats(self, case_id: str, field: str, window: Window | None = None, rule_id: str | None = None) -> DataFrame:
        case = self.case(case_id)
        return results.field_stats(case.events, field, window or Window(), self._list(case, rule_id))

    def export_results(self, case_id: str, path: str, window: Window | None = None, rule_id: str | None = None, progress: Callable[[int], bool] | None = None) -> int:
        case = self.case(case_id)
        return export_file(case.events, window or Window(), path, self._list(case, rule_id), progress)

    def list_payload_keys(self, case_id: str) -> DataFrame:
        return self.case(case_id).payload_keys

    def get_event(self, case_id: str, event_id: int) -> list[tuple[str, str | None]]:
        return results.event_detail(self.case(case_id).events, event_id)

    def get_raw_record(self, case_id: str, event_id: int) -> str | None:
        return results.raw_record(self.case(case_id).events, event_id)


def as_rows(found: Scan) -> list[dict]:
    """Candidates and skipped files as plain rows."""
    return [asdict(c) for c in found.candidates] + [asdict(s) for s in found.skipped]
