"""Cases: what was ingested from a folder, the rules over it, and their matches, as Parquet tables.

    case/case.json            id, folder, times, status
    case/files/               one row a candidate
    case/events/log_type=…/   canonical events, with VARIANT companions
    case/payload_keys/
    case/zones/               bounds of time and id of each file of events
    case/log/                 commits: rules, whether they are evaluated, and where their matches are
    case/rules/*.rules        snapshot of the rule texts
    case/matches/…/           matches with their summary, a folder for each evaluation

An evaluation writes into a folder of its own, which a commit names when it is complete: a failed or stopped one
leaves the rule pending and without matches, and evaluations of several writers at a time don't touch each other.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.display import SUMMARY
from logsieve.operators import results, zones
from logsieve.operators.caselog import CaseLog, State
from logsieve.operators.rulesets import RuleSet
from logsieve.operators.window import Window
from logsieve.plans.model import Rule
from logsieve.plans.parser import parse_condition
from logsieve.sources.discovery import scan
from logsieve.sources.ingest import COLUMNS, file_outcomes, ingest, with_companions
from logsieve.sources.storage import Storage

MATCHES = "event_id long, event_time timestamp_ntz, log_type string, " + ", ".join(f"{c} string" for c in SUMMARY) + ", matched_fields string, rule_id string"
_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")


def safe_id(name: str) -> str:
    """``name`` if it can be a file name and nothing else; else ValueError."""
    if not _SAFE.fullmatch(name) or ".." in name:
        raise ValueError(f"{name!r} is no safe id")
    return name


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Case:
    """``path`` may be in any file system that Spark reaches; executors must reach it, too."""

    spark: SparkSession
    path: str

    @property
    def disk(self) -> Storage:
        return Storage(self.spark)

    # Tables --------------------------------------------------------------------------------------

    @property
    def meta(self) -> dict[str, object]:
        return json.loads(self.disk.read(f"{self.path}/case.json"))

    def _set(self, **values: object) -> None:
        before = self.meta if self.disk.exists(f"{self.path}/case.json") else {}
        self.disk.write(f"{self.path}/case.json", json.dumps(before | values, indent=1))

    @property
    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    @property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events")

    def list_events(self, window: Window) -> DataFrame:
        """One page of all events, from the files whose bounds come first."""
        table = self.spark.read.schema(zones.ZONES).parquet(f"{self.path}/zones")
        return zones.list_events(self.spark, f"{self.path}/events", table, self.events.schema, window)

    @property
    def payload_keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payload_keys").orderBy("log_type", F.desc("events"), "path")

    def matches(self, rule_id: str | None = None) -> DataFrame:
        """Matches of one rule, or of all; reading one rule's reads its folder alone."""
        known = self.log.state()[1]["matches"]
        folders = list(known.values()) if rule_id is None else [known[rule_id]] if rule_id in known else []
        if not folders:
            return self.spark.createDataFrame([], MATCHES)
        return self.spark.read.schema(MATCHES).parquet(*[f"{self.path}/{f}" for f in folders])

    # Ingest --------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, case_id: str, folder: str, selected: set[str] | None = None, overrides: dict[str, list[str]] | None = None) -> Case:
        """Ingest a folder into a new case. The parse runs once; events and file outcomes are cut from it."""
        case = cls(spark, f"{root}/{safe_id(case_id)}")
        if case.disk.exists(case.path):
            raise FileExistsError(case.path)
        case.disk.make(case.path)
        case._set(case_id=case_id, folder=folder, started_at=_now(), finished_at=None, status="running", mapping=overrides or {})
        try:
            candidates = scan(spark, folder).candidates
            wanted = [c for c in candidates if selected is None or c.path in selected]
            staged = f"{case.path}/staged"
            ingest(spark, wanted, overrides).write.option("compression", "zstd").parquet(staged)
            parsed = spark.read.parquet(staged)
            with_companions(parsed.where("file_status is null").select(COLUMNS)).sortWithinPartitions("log_type", "event_id").write.partitionBy("log_type").option("compression", "zstd").parquet(f"{case.path}/events")
            if not any(x.startswith("log_type=") for x in case.disk.names(f"{case.path}/events")):
                with_companions(parsed.limit(0).select(COLUMNS)).write.mode("overwrite").parquet(f"{case.path}/events")
            known = spark.createDataFrame([(c.file_id, c.path, c.size) for c in candidates], "file_id long, path string, size long")
            outcome = file_outcomes(parsed)
            rows = known.join(outcome, "file_id", "left").withColumns({"status": F.coalesce("status", F.lit("skipped")), "note": F.when(F.col("status").isNull(), F.lit("not selected")).otherwise(F.col("note"))})
            rows.coalesce(1).write.parquet(f"{case.path}/files")
            results.payload_keys(case.events).write.parquet(f"{case.path}/payload_keys")
            zones.zones(case.events).coalesce(1).write.parquet(f"{case.path}/zones")
            case.disk.delete(staged)
            case._set(status="done", finished_at=_now())
        except BaseException:
            case._set(status="failed", finished_at=_now())
            raise
        return case

    # Rules ---------------------------------------------------------------------------------------

    @property
    def log(self) -> CaseLog:
        return CaseLog(self.disk, f"{self.path}/log")

    @property
    def rules(self) -> dict[str, dict[str, object]]:
        return self.log.state()[1]["rules"]

    def _commit(self, change: Callable[[State], None]) -> State:
        """Commit a change; folders of matches that are no longer named go."""
        before, after = self.log.commit(change)
        for folder in set(before["matches"].values()) - set(after["matches"].values()):
            self.disk.delete(f"{self.path}/{folder}")
        return after

    def rules_table(self) -> DataFrame:
        rows = [(i, r["name"], r["severity"], r["description"], r["log_type"], r["evaluated"]) for i, r in self.rules.items()]
        return self.spark.createDataFrame(rows, "rule_id string, name string, severity string, description string, log_type string, evaluated boolean")

    def register(self, rules: RuleSet) -> None:
        """Take the rules in as pending, and keep their texts; rules that are gone lose their matches."""

        def change(state: State) -> None:
            state["rules"] = {r.id: {"name": r.name, "severity": r.severity, "description": r.description, "log_type": r.log_type, "evaluated": False} for r in rules.rules}
            state["matches"] = {k: v for k, v in state["matches"].items() if k == results.SEARCH_RULE}

        self._commit(change)
        self.disk.delete(f"{self.path}/rules")
        for name, text in rules.files():
            self.disk.write(f"{self.path}/rules/{name}", text)

    def _store(self, rule: Rule) -> None:
        folder = f"matches/{uuid.uuid4().hex}"
        try:
            names = [f.split(" ")[0] for f in MATCHES.split(", ")]
            results.evaluate(self.events, rule).select(*names).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")

            def change(state: State) -> None:
                state["matches"][rule.id] = folder
                if rule.id in state["rules"]:
                    state["rules"][rule.id]["evaluated"] = True

            self._commit(change)
        except BaseException:
            self.disk.delete(f"{self.path}/{folder}")
            raise

    def _forget(self, rule_id: str) -> None:
        def change(state: State) -> None:
            state["matches"].pop(rule_id, None)
            if rule_id in state["rules"]:
                state["rules"][rule_id]["evaluated"] = False

        self._commit(change)

    def evaluate(self, rule: Rule) -> None:
        """Pending until all matches are in place; on failure pending with none."""
        self._forget(rule.id)
        self._store(rule)

    def remove(self, rule_id: str) -> None:
        def change(state: State) -> None:
            state["matches"].pop(rule_id, None)
            state["rules"].pop(rule_id, None)

        self._commit(change)

    def search(self, text: str, within: Rule | None = None) -> str | None:
        """Run a typed condition as a rule and return its id, or None if the text is no condition.

        Its matches replace those of the search before; it is no rule in the lists.
        """
        query = parse_condition(text)
        if query is None:
            return None
        self._store(results.condition_rule(query, within))
        return results.SEARCH_RULE

    def groups(self, window: Window | None = None) -> DataFrame:
        """Rules with their matches in scope; rules for types that the case has no events of are left out."""
        present = self.events.select("log_type").distinct()
        rules = self.rules_table()
        rules = rules.where("log_type is null").unionByName(rules.join(present, "log_type", "left_semi").select(rules.columns))
        return results.rule_groups(rules, self.matches(), window or Window())


def list_cases(spark: SparkSession, root: str) -> list[dict[str, object]]:
    """Newest first; folders that hold no readable case are passed over."""
    disk, out = Storage(spark), []
    for name in disk.names(root):
        try:
            out.append(json.loads(disk.read(f"{root}/{name}/case.json")))
        except (OSError, ValueError):
            continue
    return sorted(out, key=lambda c: (str(c.get("started_at")), str(c.get("case_id"))), reverse=True)


def delete_case(spark: SparkSession, root: str, case_id: str) -> None:
    disk, path = Storage(spark), f"{root}/{safe_id(case_id)}"
    if not disk.exists(f"{path}/case.json"):
        raise FileNotFoundError(path)
    disk.delete(path)
