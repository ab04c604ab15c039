"""Result queries over events and matches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.display import canonical, local_time, shown_time, stats_field, summary
from logsieve.functions.schema import FLAG_COLUMNS, JSON_COLUMNS, TEXT_COLUMNS
from logsieve.operators.window import Window, order, page_rows, within
from logsieve.plans.compile import prepare
from logsieve.plans.model import And, Condition, Not, Or, Rule, Test, Variable
from logsieve.plans.shared import evaluate_index

SEARCH_RULE = "#search"
TOP_VALUES = 200
#: Rule sets up to this size are one expression a rule.
COMPILED_RULES = 48
#: Shares that the paths of one log type are ranked in.
RANK_SHARES = 64


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def summarize(events: DataFrame) -> DataFrame:
    """Id, time in microseconds and as shown, and the summary columns."""
    events = canonical(events)
    return events.select("event_id", "log_type", _micros(F.col("event_time")).alias("time_micros"), shown_time(F.col("event_time")).alias("time"), *summary())


# Rules ----------------------------------------------------------------------------------------------


def evaluate(events: DataFrame, rule: Rule) -> DataFrame:
    """Matches of one rule: rule id, event id and time, log type, summary, evidence. One narrow pass."""
    events, (compiled,) = prepare(canonical(events), [rule])
    hits = events.where(compiled.condition)
    return hits.select(F.lit(rule.id).alias("rule_id"), "event_id", "event_time", "log_type", *summary(), compiled.evidence.alias("matched_fields"))


def evaluate_all(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, event_id, event_time, log_type) of every match of every rule, in one scan.

    More than ``COMPILED_RULES`` rules are evaluated as data, so that a row meets those only that may match it.
    """
    if len(rules) <= COMPILED_RULES:
        return _evaluate_compiled(events, rules)
    matches, left = evaluate_index(canonical(events), rules)
    found = matches.select("rule_id", "event_id", "event_time", "log_type")
    return found.unionByName(_evaluate_compiled(events, left)) if left else found


def _evaluate_compiled(events: DataFrame, rules: list[Rule]) -> DataFrame:
    events, compiled = prepare(canonical(events), rules)
    if not compiled:
        return events.select(F.lit("").alias("rule_id"), "event_id", "event_time", "log_type").limit(0)
    fired = F.filter(F.array(*[F.when(c.matches, F.lit(c.rule.id)) for c in compiled]), lambda x: x.isNotNull())
    pruning = [c.pruning for c in compiled]
    if all(p is not None for p in pruning):
        events = events.where(reduce(or_, pruning))
    return events.select(F.explode(fired).alias("rule_id"), "event_id", "event_time", "log_type")


def match_report(events: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """All rules over all events in one scan: (rule_id, event_id, event_time, log_type, matched_fields) of every hit
    in order of rule and event, and (matched, unmatched, total) of the events."""
    prepared, compiled = prepare(canonical(events), rules)
    none = F.lit(None).cast("struct<rule_id:string,matched_fields:string>")
    hits = F.filter(F.array(none, *[F.when(c.matches, F.struct(F.lit(c.rule.id).alias("rule_id"), c.evidence.alias("matched_fields"))) for c in compiled]), lambda x: x.isNotNull())
    rows = prepared.select("event_id", "event_time", "log_type", F.explode(hits).alias("hit")).select("hit.rule_id", "event_id", "event_time", "log_type", "hit.matched_fields")
    totals = draft_count(events, rules).select("matched", (F.col("scanned") - F.col("matched")).alias("unmatched"), F.col("scanned").alias("total"))
    return rows.orderBy("rule_id", "event_id"), totals


def draft_count(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(matched, scanned): events that any of the rules matches, and all events."""
    events, compiled = prepare(canonical(events), rules)
    any_rule = reduce(or_, [c.matches for c in compiled], F.lit(False))
    return events.agg(F.count_if(any_rule).alias("matched"), F.count("*").alias("scanned"))


def condition_rule(query: Rule, within_rule: Rule | None = None) -> Rule:
    """The pseudo-rule of a typed condition, alone or together with the rule that is selected."""

    def renamed(c: Condition) -> Condition:
        if isinstance(c, Variable):
            return Variable(f"search:{c.name}")
        if isinstance(c, Not):
            return Not(renamed(c.part))
        if isinstance(c, (And, Or)):
            return type(c)(tuple(map(renamed, c.parts)))
        return type(c)(c.n, tuple(f"search:{n}" for n in c.names))

    if within_rule is None:
        return Rule(SEARCH_RULE, {}, query.tests, query.condition)
    own = tuple(Test(f"search:{t.variable}", t.field, t.operator, t.value) for t in query.tests)
    meta = {"log_type": within_rule.log_type} if within_rule.log_type else {}
    return Rule(SEARCH_RULE, meta, (*within_rule.tests, *own), And((within_rule.condition, renamed(query.condition))))


# Counts ---------------------------------------------------------------------------------------------


def count_events(events: DataFrame, window: Window) -> DataFrame:
    return within(canonical(events), window).agg(F.count("*").alias("events"))


def rule_groups(rules: DataFrame, matches: DataFrame, window: Window) -> DataFrame:
    """Every rule with the number of its matches in scope, none left out; most matches first.

    Matches are counted before the join, so that it moves one row a rule.
    """
    counts = within(matches, window, searched=False).groupBy("rule_id").agg(F.count("*").alias("matches"))
    return rules.join(counts, "rule_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0))).orderBy(F.desc("matches"), "rule_id")


def matched_unmatched(events: DataFrame, matches: DataFrame, window: Window) -> DataFrame:
    """(matched, unmatched, total) events in scope; condition searches don't count as rules."""
    total = within(canonical(events), window, searched=False).agg(F.count("*").alias("total"))
    hit = within(matches.where(F.col("rule_id") != SEARCH_RULE), window, searched=False).agg(F.countDistinct("event_id").alias("matched"))
    return hit.crossJoin(total).select("matched", F.greatest(F.col("total") - F.col("matched"), F.lit(0)).alias("unmatched"), "total")  # one row each


def summary_counts(matches: DataFrame) -> DataFrame:
    """Matches of each rule that has any."""
    return matches.groupBy("rule_id").agg(F.count("*").alias("matches"))


def log_type_counts(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events of each log type: counted by file first, then by the files' type."""
    by_file = events.groupBy("file_id").agg(F.count("*").alias("n"))
    return by_file.join(files.select("file_id", "log_type"), "file_id").groupBy("log_type").agg(F.sum("n").alias("events"))


def file_spans(files: DataFrame, events: DataFrame) -> DataFrame:
    """Events and last record of each file, files without events included."""
    by_file = events.groupBy("file_id").agg(F.count("*").alias("n"), F.max("record_index").alias("last_index"))
    return files.join(by_file, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def day_span(events: DataFrame) -> DataFrame:
    """First and last day of the events in the display zone."""
    span = events.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    return span.select(*[F.date_format(local_time(F.col(c)), "yyyy-MM-dd").alias(n) for c, n in (("a", "first_day"), ("b", "last_day"))])


# Lists ----------------------------------------------------------------------------------------------


def list_events(events: DataFrame, window: Window) -> DataFrame:
    """One page of all events. The page is found on narrow columns; wide ones are read for its rows only.

    The page's ids, at most ``LARGEST_PAGE``, are found first, so that the second scan can pass over every
    row group that holds none of them (events are stored in order of id).
    """
    events = canonical(events)
    narrow = events.select("event_id", "event_time", "log_type", "event_name", "event_source", "identity_arn", "source_ip")
    ids = [r.event_id for r in page_rows(narrow, window).select("event_id").collect()]
    wanted = events.where(F.col("event_id").between(min(ids), max(ids)) & F.col("event_id").isin(ids)) if ids else events.limit(0)
    return summarize(wanted).orderBy(*_shown_order(window)).limit(max(1, len(ids)))


def list_matches(matches: DataFrame, window: Window) -> DataFrame:
    """One page of a rule's matches: they carry their summary, so no event is read."""
    rows = page_rows(matches, window)
    return rows.withColumns({"time_micros": _micros(F.col("event_time")), "time": shown_time(F.col("event_time"))}).orderBy(*order(window))


def _shown_order(window: Window) -> list[Column]:
    if window.newest_first:
        return [F.col("time_micros").desc_nulls_last(), F.col("event_id").desc()]
    return [F.col("time_micros").asc_nulls_last(), F.col("event_id").asc()]


def raw_record(events: DataFrame, event_id: int) -> str | None:
    row = canonical(events).where(F.col("event_id") == event_id).select("raw").first()
    return row.raw if row else None


def event_detail(events: DataFrame, event_id: int) -> list[tuple[str, str | None]]:
    """(field, text) pairs of one event; an unknown id gives none."""
    columns = [*TEXT_COLUMNS, *FLAG_COLUMNS, *JSON_COLUMNS[:3]]
    row = canonical(events).where(F.col("event_id") == event_id).select(shown_time(F.col("event_time")).alias("event_time"), *[F.col(c).cast("string").alias(c) for c in columns]).first()
    return list(row.asDict().items()) if row else []


def first_event(events: DataFrame) -> DataFrame:
    return events.orderBy("event_id").limit(1)


# Statistics -----------------------------------------------------------------------------------------


def field_stats(events: DataFrame, field: str, window: Window, matches: DataFrame | None = None, top: int = TOP_VALUES) -> DataFrame:
    """(value, n, total, distinct_values): the commonest values of a field, null being one of them.

    ``total`` and ``distinct_values`` speak of all values. With ``matches`` only events that are in it
    count. The windows run over one row a distinct value.
    """
    rows = within(canonical(events), window)
    if matches is not None:
        rows = rows.join(matches.select("event_id").distinct(), "event_id", "left_semi")
    groups = rows.select(stats_field(field).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    every = groups.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))  # one row
    best = groups.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)
    return best.crossJoin(F.broadcast(every)).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def payload_keys(events: DataFrame, deepest: int = 6, last_index: int = 4, most: int = 5000) -> DataFrame:
    """(log_type, path, events): leaf paths of the JSON bodies by log type, the commonest ``most`` of each.

    Objects and arrays are unfolded ``deepest`` levels, arrays up to ``last_index``; null leaves and
    bodies that are no container or no JSON have no path. Of a type with more paths those with the
    highest counts stay, ties by path.
    """
    events = canonical(events)
    bodies = F.array(*[F.struct(F.lit(c).alias("path"), F.try_parse_json(c).alias("v")) for c in JSON_COLUMNS[:3]])
    container = lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
    rows = events.select("log_type", F.inline(bodies)).where(container(F.col("v")))
    for _ in range(deepest):
        # Leaves pass through as they are, so all levels come from one scan.
        rows = rows.withColumn("inner", F.coalesce(container(F.col("v")), F.lit(False)))
        spread = rows.sparkSession.tvf.variant_explode_outer(F.when(F.col("inner"), F.col("v")).outer())
        rows = rows.lateralJoin(spread).where("not inner or key is not null or pos <= " + str(int(last_index)))
        step = F.concat("path", F.lit("."), F.coalesce("key", F.col("pos").cast("string")))
        rows = rows.select("log_type", F.when(F.col("inner"), step).otherwise(F.col("path")).alias("path"), F.when(F.col("inner"), F.col("value")).otherwise(F.col("v")).alias("v"))
    leaves = rows.where(~container(F.col("v")) & ~F.is_variant_null("v"))
    counts = leaves.groupBy("log_type", "path").agg(F.count("*").alias("events"))
    return commonest(counts, most).orderBy("log_type", F.desc("events"), "path")


def commonest(counts: DataFrame, most: int, shares: int = RANK_SHARES) -> DataFrame:
    """Of (log_type, path, events) the ``most`` rows of each type with the highest counts, ties by path.

    Each type's paths are dealt into shares, ranked there, and only the best of each share are ranked together:
    one type's paths are the work of many tasks, and the last one gets ``shares`` times ``most`` rows at most.
    """
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("events"), "path"))).where(F.col("rank") <= most).drop("rank")
    dealt = counts.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(shares)))
    return best(best(dealt, "log_type", "share").drop("share"), "log_type")
