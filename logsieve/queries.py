"""Queries over the driver's tables, each beside the SQL that gives the same rows.

``events`` of the test tables stands in for the canonical event table: its type is the event's name, its
user the identity, its properties the request. Everything runs over the whole table.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.display import shown_time
from logsieve.operators import results
from logsieve.operators.window import Cursor, Window, page_rows, within
from logsieve.plans.compile import prepare
from logsieve.plans.model import Rule
from logsieve.plans.parser import parse_condition, parse_rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The same adapter in DuckDB.
ADAPTED = """(select event_id, ts as event_time, event_type as event_name, nullif(event_type, 'view') as event_source, cast(user_id as varchar) as identity_name,
  'user/' || cast(user_id as varchar) as identity_arn, user_id % 2 = 0 as read_only, case when user_id % 3 = 0 then null else user_id % 3 = 1 end as mfa_authenticated,
  props as request, user_id % 7 as file_id, event_id as record_index,
  case event_type when 'purchase' then 'waf_acl' when 'error' then 'alb_access' else 'cloudtrail' end as log_type, value from events)"""
NAMED = "cast(json_extract_string(request, '$.k') as double)"
SHOWN = "strftime(event_time + interval 9 hour, '%Y-%m-%d %H:%M:%S.%g')"


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").alias("event_time"), F.col("event_type").alias("event_name"), F.nullif(F.col("event_type"), F.lit("view")).alias("event_source"), user.alias("identity_name"),
        F.concat(F.lit("user/"), user).alias("identity_arn"), (F.col("user_id") % 2 == 0).alias("read_only"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3 == 1).alias("mfa_authenticated"),
        F.col("props").alias("request"), (F.col("user_id") % 7).alias("file_id"), F.col("event_id").alias("record_index"),
        F.when(F.col("event_type") == "purchase", "waf_acl").when(F.col("event_type") == "error", "alb_access").otherwise("cloudtrail").alias("log_type"),
    )


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = " ".join(sql.replace("{E}", ADAPTED).replace("{K}", NAMED).replace("{T}", SHOWN).split())
        return f

    return add


def _rule(text: str) -> Rule:
    rule = parse_condition(text)
    assert rule is not None, text
    return rule


def _hits(name: str, text: str, where: str) -> None:
    """A condition over the adapted events, and the WHERE that means the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, (compiled,) = prepare(adapted(spark, sf_dir), [_rule(text)])
        return events.where(compiled.condition).select("event_id", "event_name", "identity_name")

    query(name, f"select event_id, event_name, identity_name from {{E}} where {where}")(run)


_hits("rule_eq_and", 'event_name == "error" and identity_name == "7"', "event_name = 'error' and identity_name = '7'")
_hits("rule_or_not", 'not (event_name == "view" or event_source == "click")', "not (event_name = 'view' or coalesce(event_source = 'click', false))")
_hits("rule_in", 'event_name in ("purchase", "signup")', "event_name in ('purchase', 'signup')")
_hits("rule_not_equal", 'event_source != "click"', "event_source <> 'click'")
_hits("rule_flag", "read_only == true and mfa_authenticated == false", "read_only and mfa_authenticated = false")
_hits("rule_compare", "identity_name >= 20 and identity_name < 40.5", "cast(identity_name as double) >= 20 and cast(identity_name as double) < 40.5")
_hits("rule_json_compare", "request.k > 50", "{K} > 50")
_hits("rule_json_equal", "request.k == 42 or request.k == \"17\"", "{K} in (42, 17)")
_hits("rule_json_missing", "request.none missing and request.k exists and resources missing", "json_extract_string(request, '$.k') is not null")
_hits("rule_n_of", '2 of (event_name == "error", request.k > 70, identity_name startswith "1")', "(event_name = 'error')::int + ({K} > 70)::int + starts_with(identity_name, '1')::int >= 2")
_hits("rule_contains", 'event_name contains "ur"', "contains(event_name, 'ur')")
_hits("rule_startswith", 'identity_arn startswith "user/1"', "starts_with(identity_arn, 'user/1')")
_hits("rule_endswith", 'identity_arn endswith "9"', "suffix(identity_arn, '9')")
_hits("rule_icontains", 'event_name icontains "ERR"', "contains(lower(event_name), 'err')")
_hits("rule_istartswith", 'event_name istartswith "Vi"', "starts_with(lower(event_name), 'vi')")
_hits("rule_iendswith", 'event_name iendswith "UP"', "suffix(lower(event_name), 'up')")
_hits("rule_regex", "identity_arn matches /^user\\/[12]\\d$/", "regexp_matches(identity_arn, '^user/[12][0-9]$')")
_hits("rule_exists_missing", "event_source missing and event_name exists and mfa_authenticated exists", "event_source is null and mfa_authenticated is not null")
_hits("rule_unknown_field", "no_such_field missing and not no_such_field exists", "true")
_hits("rule_or_pushdown", '(event_name == "error" and request.k > 90) or (event_name == "click" and request.k < 5)', "(event_name = 'error' and {K} > 90) or (event_name = 'click' and {K} < 5)")

RULES = """
rule hot_errors { meta: severity = "high" log_type = "alb_access" condition: event_name == "error" and request.k > 50 }
rule purchases { meta: severity = "low" condition: event_name == "purchase" }
rule even_users { fields: $a = read_only == true $b = request.k >= 90 $b = event_source == "signup" condition: $a and $b }
rule never { condition: event_name == "nothing" }
"""
MATCHES = """(select 'hot_errors' as rule_id, * from {E} where log_type = 'alb_access' and event_name = 'error' and {K} > 50
  union all select 'purchases', * from {E} where event_name = 'purchase'
  union all select 'even_users', * from {E} where read_only and ({K} >= 90 or coalesce(event_source = 'signup', false)))"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.evaluate_all(adapted(spark, sf_dir), parse_rules(RULES))


@query("flagship_rule", """select event_id, {T} as shown, event_name, identity_arn, '{"$bad":"error","$big":"' || json_extract_string(request, '$.k') || '"}' as matched_fields
  from {E} where event_name = 'error' and {K} > 50 and event_time >= timestamp '2024-01-02 00:00:00' - interval 9 hour""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with evidence over the events from the second day of the display zone on."""
    rule = parse_rules('rule f { fields: $bad = event_name == "error" $big = request.k > 50 condition: $bad and $big }')[0]
    hits = results.evaluate(within(adapted(spark, sf_dir), Window(start="2024-01-02")), rule)
    return hits.select("event_id", shown_time(F.col("event_time")).alias("shown"), "event_name", "identity_arn", "matched_fields")


@query("rule_evidence", """select event_id, case when {K} >= 90 and coalesce(event_source = 'signup', false) then '{"$a":"true","$b":"signup"}' when {K} >= 90 then '{"$a":"true","$b":"' || json_extract_string(request, '$.k') || '"}'
  else '{"$a":"true","$b":"signup"}' end as matched_fields from {E} where read_only and ({K} >= 90 or coalesce(event_source = 'signup', false))""")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.evaluate(adapted(spark, sf_dir), parse_rules(RULES)[2]).select("event_id", "matched_fields")


@query("rule_set_matches", f"select rule_id, event_id, log_type from {MATCHES}")
def rule_set_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("rule_id", "event_id", "log_type")


@query("rule_set_summary", f"select rule_id, count(*) as matches from {MATCHES} group by 1")
def rule_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary_counts(_matches(spark, sf_dir))


@query("rule_groups", f"""select r.rule_id, count(m.event_id) as matches from (values ('hot_errors'), ('purchases'), ('even_users'), ('never')) r(rule_id)
  left join (select * from {MATCHES} where event_time >= timestamp '2024-01-05' - interval 9 hour and event_time < timestamp '2024-01-11' - interval 9 hour) m using (rule_id) group by 1""")
def rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r.id,) for r in parse_rules(RULES)], "rule_id string")
    return results.rule_groups(rules, _matches(spark, sf_dir), Window(start="2024-01-05", stop="2024-01-10"))


@query("matched_unmatched", f"select m as matched, t - m as unmatched, t as total from (select count(distinct event_id) as m from {MATCHES}), (select count(*) as t from {{E}})")
def matched_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.matched_unmatched(adapted(spark, sf_dir), _matches(spark, sf_dir), Window())


@query("draft_count", f"select (select count(distinct event_id) from {MATCHES}) as matched, count(*) as scanned from {{E}}")
def draft_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.draft_count(adapted(spark, sf_dir), parse_rules(RULES))


@query("condition_search_in_rule", "select event_id from {E} where log_type = 'alb_access' and event_name = 'error' and {K} > 50 and starts_with(identity_name, '2')")
def condition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = results.condition_rule(_rule('identity_name startswith "2"'), parse_rules(RULES)[0])
    return results.evaluate(adapted(spark, sf_dir), rule).select("event_id")


@query("scope_count", "select count(*) as events from {E} where log_type = 'cloudtrail' and event_time >= timestamp '2024-01-03 12:30:00' - interval 9 hour and event_time < timestamp '2024-01-20' - interval 9 hour")
def scope_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.count_events(adapted(spark, sf_dir), Window(log_type="cloudtrail", start="2024-01-03 12:30", stop="2024-01-19"))


@query("text_search", r"select event_id, event_name from {E} where event_name ilike '%RCH%' or event_source ilike '%RCH%' or identity_arn ilike '%RCH%'")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(results.canonical(adapted(spark, sf_dir)), Window(search="RCH")).select("event_id", "event_name")


@query("text_search_escaped", r"select event_id, event_name from (select *, case when event_id % 2 = 0 then 'ip_' else 'ip.' end || identity_name as ip from {E}) where contains(ip, 'p_1')")
def text_search_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The needle's own wildcard stands for itself."""
    ip = F.concat(F.when(F.col("event_id") % 2 == 0, "ip_").otherwise("ip."), F.col("identity_name"))
    return within(results.canonical(adapted(spark, sf_dir).withColumn("source_ip", ip)), Window(search="P_1")).select("event_id", "event_name")


@query("text_search_time", "select event_id, {T} as shown from {E} where event_name like '%-01-1%' or identity_arn like '%-01-1%' or {T} like '%-01-1%'")
def text_search_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within(results.canonical(adapted(spark, sf_dir)), Window(search="-01-1")).select("event_id", shown_time(F.col("event_time")).alias("shown"))


@query("page_newest", "select event_id, {T} as time, event_name, log_type from {E} order by event_time desc nulls last, event_id desc limit 100")
def page_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.list_events(adapted(spark, sf_dir), Window(limit=100)).select("event_id", "time", "event_name", "log_type")


@query("page_oldest_nulls_last", "select event_id from (select event_id, case when event_name = 'view' then null else event_time end as t from {E}) order by t asc nulls last, event_id limit 1000")
def page_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapted(spark, sf_dir).withColumn("event_time", F.when(F.col("event_name") != "view", F.col("event_time")))
    return page_rows(events, Window(limit=5000, newest_first=False)).select("event_id")


@query("page_keyset", "select event_id from {E} where (event_time, event_id) < (timestamp '2024-01-15 00:00:00', 5000) order by event_time desc, event_id desc limit 50")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rows(adapted(spark, sf_dir), Window(limit=50, after=Cursor(5000, 1705276800000000))).select("event_id")


@query("page_keyset_null_time", "select event_id from {E} where event_name = 'view' and event_id < 9000 order by event_id desc limit 50")
def page_keyset_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapted(spark, sf_dir).withColumn("event_time", F.when(F.col("event_name") != "view", F.col("event_time")))
    return page_rows(events, Window(limit=50, after=Cursor(9000, None))).select("event_id")


def _stats(name: str, field: str, sql: str) -> None:
    counted = f"select value, count(*) as n from (select {sql} as value from {{E}}) group by 1"
    oracle = f"select value, n, cast(sum(n) over () as bigint) as total, count(*) over () as distinct_values from ({counted}) order by n desc, value nulls last limit 200"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return results.field_stats(adapted(spark, sf_dir), field, Window())

    query(name, oracle)(run)


_stats("stats_day", "day", "strftime(event_time + interval 9 hour, '%Y-%m-%d')")
_stats("stats_hour", "hour", "strftime(event_time + interval 9 hour, '%Y-%m-%d %H:00')")
_stats("stats_field", "event_source", "event_source")
_stats("stats_flag", "mfa_authenticated", "cast(mfa_authenticated as varchar)")
_stats("stats_payload", "request.k", "json_extract_string(request, '$.k')")


@query("stats_rule_list", """select value, n, cast(sum(n) over () as bigint) as total, count(*) over () as distinct_values from (select identity_name as value, count(*) as n from {E}
  where event_id in (select event_id from {E} where event_name = 'error' and {K} > 50) group by 1) order by n desc, value nulls last limit 200""")
def stats_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapted(spark, sf_dir)
    return results.field_stats(events, "identity_name", Window(), results.evaluate(events, parse_rules(RULES)[0]))


@query("payload_keys", "select log_type, 'request.' || k as path, count(*) as events from (select log_type, unnest(json_keys(request)) as k from {E}) group by 1, 2")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.payload_keys(adapted(spark, sf_dir))


def _files(spark: SparkSession) -> DataFrame:
    kinds = ["cloudtrail", "alb_access", "waf_acl"]
    return spark.createDataFrame([(i, f"f{i}.gz", kinds[i % 3]) for i in range(9)], "file_id long, path string, log_type string")


_FILES = "(select i as file_id, 'f' || i || '.gz' as path, ['cloudtrail', 'alb_access', 'waf_acl'][i % 3 + 1] as log_type from range(9) t(i))"


@query("log_type_counts", f"select f.log_type, count(*) as events from {{E}} e join {_FILES} f using (file_id) group by 1")
def log_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.log_type_counts(adapted(spark, sf_dir), _files(spark))


@query("file_spans", f"select f.file_id, f.path, count(e.event_id) as n, max(e.record_index) as last_index from {_FILES} f left join {{E}} e using (file_id) group by 1, 2")
def file_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.file_spans(_files(spark), adapted(spark, sf_dir)).select("file_id", "path", "n", "last_index")


@query("day_span", "select strftime(min(event_time) + interval 9 hour, '%Y-%m-%d') as first_day, strftime(max(event_time) + interval 9 hour, '%Y-%m-%d') as last_day from {E}")
def day_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.day_span(adapted(spark, sf_dir))


@query("first_event", "select event_id, event_name from {E} order by event_id limit 1")
def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_event(adapted(spark, sf_dir)).select("event_id", "event_name")


@query("event_ids", "select event_id, (file_id << 32) | record_index as packed, ((file_id << 32) | record_index) >> 32 as unpacked from {E}")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.shiftleft(F.col("file_id"), 32).bitwiseOR(F.col("record_index"))
    return adapted(spark, sf_dir).select("event_id", packed.alias("packed"), F.shiftright(packed, 32).alias("unpacked"))


_LINE = """'{"event_id":' || event_id || ',"log_type":"waf_acl","event_time":"' || rtrim(rtrim(strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z","event_source":"purchase","event_name":"purchase","aws_region":null,"account_id":null,"source_ip":null,"user_agent":null,"identity_type":null,'
  || '"identity_arn":"' || identity_arn || '","identity_name":"' || identity_name || '","error_code":null,"error_message":null,"mfa_authenticated":' || coalesce(mfa_authenticated::varchar, 'null') || ',"read_only":' || read_only::varchar
  || ',"management_event":null,"request":' || replace(request::varchar, ' ', '') || ',"response":null,"resources":null,"raw":null}' as line"""


@query("export_lines", f"select {_LINE} from {{E}} where log_type = 'waf_acl'")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.operators.export import export_lines as lines

    return lines(adapted(spark, sf_dir), Window(log_type="waf_acl"))


@query("export_of_files", f"select {_LINE} from {{E}} join (select i as file_id from range(4) t(i)) using (file_id) where log_type = 'waf_acl'")
def export_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.operators.export import export_lines as lines

    return lines(adapted(spark, sf_dir), Window(log_type="waf_acl"), files=_files(spark).where("file_id < 4"))


@query("match_report", f"select rule_id, event_id, log_type from {MATCHES}")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.match_report(adapted(spark, sf_dir), parse_rules(RULES))[0].select("rule_id", "event_id", "log_type")


@query("match_report_totals", f"select count(distinct event_id) as matched, (select count(*) from events) - count(distinct event_id) as unmatched, (select count(*) from events) as total from {MATCHES}")
def match_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.match_report(adapted(spark, sf_dir), parse_rules(RULES))[1]


def _table_rule(name: str, source: str, columns: dict[str, str], text: str, select: str, where: str) -> None:
    """A rule over another table, whose columns stand for event fields."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").select("*", *[F.col(c).alias(n) for n, c in columns.items()])
        rows, (compiled,) = prepare(rows, [_rule(text)])
        return rows.where(compiled.condition).select(*select.split(", "))

    query(name, f"select {select} from {source} where {where}")(run)


_table_rule("rule_pages_url", "pages", {"event_name": "url"}, 'event_name matches /^https?:\\/\\/www\\./ and not event_name icontains "PILLS"', "page_id, url", "regexp_matches(url, '^https?://www[.]') and not contains(lower(url), 'pills')")
_table_rule("rule_orders", "orders", {"event_name": "o_orderstatus", "event_source": "o_orderpriority"}, 'event_name in ("F", "O") and event_source startswith "1-"', "o_orderkey, o_orderstatus", "o_orderstatus in ('F', 'O') and starts_with(o_orderpriority, '1-')")
_table_rule("rule_conversations", "conversations", {"event_name": "role", "error_message": "text"}, 'event_name != "user" and error_message icontains "THE "', "conv_id, turn", "role <> 'user' and contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ')")
_table_rule("rule_documents", "documents", {"event_name": "lang", "raw": "text"}, 'event_name == "en" and raw contains "token = " and raw matches /[0-9a-f]{40}/', "doc_id, lang", "lang = 'en' and contains(text, 'token = ') and regexp_matches(text, '[0-9a-f]{40}')")


# Normalizers: log lines made from the events table, and the columns they must give ------------------


def _normalized(name: str, log_type: str, line: str, columns: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from logsieve.sources.lines import normalize_lines

        rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(3).alias("file_id"), F.col("event_id").alias("record_index"), F.expr(line).alias("line"))
        return normalize_lines(rows, log_type).select(*[F.expr(c) for c in columns.split("; ")])

    query(name, sql)(run)


_K = "json_extract_string(props, '$.k')"
_ID = "(3::bigint << 32) | event_id as event_id"
_TIME = "strftime({} + interval 9 hour, '%Y-%m-%d %H:%M:%S.%g') as shown"
_SHOW = "event_id; date_format(event_time + INTERVAL 9 HOURS, 'yyyy-MM-dd HH:mm:ss.SSS') as shown"

_normalized(
    "normalize_alb", "alb_access",
    """if(event_type = 'signup', concat('junk ', event_id), concat('https ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), ' app/lb/1 10.0.0.', user_id, ':443 ', if(event_type = 'view', '-', '10.1.1.1:80'), ' 0.1 0.2 0.3 ',
       400 + cast(get_json_object(props, '$.k') as int), ' 200 1 2 "', if(event_type = 'click', 'POST', 'GET'), ' https://h.example/', event_type, '?u=', user_id, ' HTTP/1.1" "ua \\\\"x\\\\" y" - - arn:aws:elb:eu-west-1:000000000000:tg/', user_id, ' "t" "d" "-" 0 - "-" "-" "-"'))""",
    f"{_SHOW}; event_name; source_ip; aws_region; error_code; read_only; get_json_object(request, '$.url') as url; cast(get_json_object(response, '$.elb_status_code') as int) as status; get_json_object(resources, '$.target') as target; user_agent",
    f"""select {_ID}, {_TIME.format('ts')}, case event_type when 'click' then 'POST' else 'GET' end as event_name, '10.0.0.' || user_id as source_ip, 'eu-west-1' as aws_region, 'HTTP ' || (400 + {_K}::int) as error_code, event_type <> 'click' as read_only,
      'https://h.example/' || event_type || '?u=' || user_id as url, 400 + {_K}::int as status, case when event_type <> 'view' then '10.1.1.1:80' end as target, 'ua ' || chr(92) || '"x' || chr(92) || '" y' as user_agent from events where event_type <> 'signup'""",
)

_normalized(
    "normalize_waf", "waf_acl",
    """to_json(named_struct('timestamp', unix_millis(cast(ts as timestamp)), 'webaclId', concat('arn:aws:wafv2:us-east-1:', user_id, ':x'), 'terminatingRuleId', concat('r', user_id), 'action', if(event_type = 'error', 'BLOCK', 'ALLOW'),
       'httpRequest', named_struct('clientIp', concat('10.0.0.', user_id), 'country', 'NL', 'uri', concat('/', event_type), 'args', if(event_type = 'view', '', 'a=1'), 'httpMethod', 'GET', 'headers', array(named_struct('name', 'HOST', 'value', event_type)))))""",
    f"{_SHOW}; event_name; account_id; source_ip; error_code; get_json_object(request, '$.url') as url; get_json_object(request, '$.country') as country; get_json_object(resources, '$.host') as host",
    f"""select {_ID}, {_TIME.format("date_trunc('millisecond', ts)")}, case event_type when 'error' then 'BLOCK' else 'ALLOW' end as event_name, user_id::varchar as account_id, '10.0.0.' || user_id as source_ip, case event_type when 'error' then 'r' || user_id end as error_code,
      '/' || event_type || case event_type when 'view' then '' else '?a=1' end as url, 'NL' as country, event_type as host from events""",
)

_normalized(
    "normalize_apigw", "apigw_access",
    """to_json(named_struct('request_id', concat('q', event_id), 'resource_path', '/v', 'http_method', if(event_type = 'click', 'DELETE', 'HEAD'), 'request_time', concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000'), 'status', cast(350 + cast(get_json_object(props, '$.k') as int) as string),
       'path', concat('/', event_type), 'ip', concat('10.0.0.', user_id), 'response_length', '-'))""",
    f"{_SHOW}; event_name; source_ip; error_code; read_only; cast(get_json_object(response, '$.status') as int) as status; get_json_object(response, '$.response_length') as length; get_json_object(request, '$.url') as url",
    f"""select {_ID}, {_TIME.format("date_trunc('second', ts)")}, case event_type when 'click' then 'DELETE' else 'HEAD' end as event_name, '10.0.0.' || user_id as source_ip, case when {_K}::int >= 50 then 'HTTP ' || (350 + {_K}::int) end as error_code, event_type <> 'click' as read_only,
      350 + {_K}::int as status, null::varchar as length, '/' || event_type as url from events""",
)

_normalized(
    "normalize_nginx", "nginx_access",
    """to_json(named_struct('_source', named_struct('@timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+09:00'"), 'birdview', named_struct('request_method', 'PUT', 'status', 350 + cast(get_json_object(props, '$.k') as int), 'client_ip', concat('10.0.0.', user_id),
       'host', if(event_type = 'view', null, 'h.example'), 'request_uri', concat('/', event_type), 'http_referer', '-'))))""",
    f"{_SHOW}; event_name; source_ip; error_code; get_json_object(request, '$.url') as url; get_json_object(request, '$.referer') as referer",
    f"""select {_ID}, {_TIME.format("ts - interval 9 hour")}, 'PUT' as event_name, '10.0.0.' || user_id as source_ip, case when {_K}::int >= 50 then 'HTTP ' || (350 + {_K}::int) end as error_code, case event_type when 'view' then '' else 'h.example' end || '/' || event_type as url, null::varchar as referer from events""",
)

_normalized(
    "normalize_gateway", "gateway_request",
    """to_json(named_struct('requestedtimeutc', date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), 'httpmethod', 'GET', 'apipath', concat('/', event_type), 'memberid', user_id % 5, 'sourceip', concat(' 10.0.0.', user_id, ' , 10.9.9.9'), 'requestheaders', concat('{"user-agent":"', event_type, '","host":"g"}')))""",
    f"{_SHOW}; identity_type; identity_name; source_ip; user_agent; get_json_object(request, '$.headers.host') as host; response",
    f"""select {_ID}, {_TIME.format('ts')}, case user_id % 5 when 0 then 'anonymous' else 'member' end as identity_type, case user_id % 5 when 0 then null else (user_id % 5)::varchar end as identity_name, '10.0.0.' || user_id as source_ip, event_type as user_agent, 'g' as host, '{{}}' as response from events""",
)

_normalized(
    "normalize_audit", "cloudtrail",
    """to_json(named_struct('eventTime', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'eventName', event_type, 'readOnly', if(event_type = 'view', 'Yes', 'no'), 'userIdentity', named_struct('type', 'T', 'userName', if(event_type = 'click', null, concat('u', user_id)), 'sessionContext', named_struct('sessionIssuer', named_struct('userName', 'issuer'))),
       'additionalEventData', named_struct('MFAUsed', if(user_id % 2 = 0, 'Yes', 'No')), 'requestParameters', named_struct('b', 1, 'a', array(user_id))))""",
    f"{_SHOW}; event_name; identity_name; mfa_authenticated; read_only; request",
    f"""select {_ID}, {_TIME.format("date_trunc('second', ts)")}, event_type as event_name, case event_type when 'click' then 'issuer' else 'u' || user_id end as identity_name, user_id % 2 = 0 as mfa_authenticated, case event_type when 'view' then true end as read_only, '{{"a":[' || user_id || '],"b":1}}' as request from events""",
)


# Files: contents made from the events table, as they come from a folder ------------------------------


def _zipped(rows: DataFrame) -> DataFrame:
    """(file_id, path, content) of (file_id, path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"file_id": part.file_id, "path": part.path, "content": [gzip.compress(t.encode(), 1, mtime=0) for t in part.text]})

    return rows.select("file_id", "path", "text").mapInPandas(run, "file_id long, path string, content binary")


def _audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each user: its events are the records, among other keys that hold records of their own."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct("event_id", F.lit("1.08").alias("eventVersion"), time.alias("eventTime"), F.col("event_type").alias("eventSource"), F.concat(F.lit("e"), "event_id").alias("eventName"), F.col("props").alias("requestParameters"))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.sort_array(F.collect_list(record)).alias("r"))
    text = F.concat(F.lit('{"meta":{"Records":[1,2]},"note":"\\"Records\\":[3","Records":'), F.to_json("r"), F.lit(',"after":{"Records":[{"eventName":"no"}]},"n":-1.5}'), F.when(F.col("user_id") % 2 == 0, '{"Records":[]}').otherwise(""))
    return _zipped(users.select(F.col("user_id").alias("file_id"), F.concat(F.lit("/x/"), "user_id", F.lit(".json.gz")).alias("path"), text.alias("text")))


_RANKED = "(select user_id, event_id, event_type, props, ts, row_number() over (partition by user_id order by event_id) - 1 as i from events)"


@query("read_documents", f"select (user_id << 32) | i as event_id, user_id as file_id, i as record_index, 'e' || event_id as event_name, event_type as event_source, 'cloudtrail' as log_type from {_RANKED}")
def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.sources.ingest import read_contents

    return read_contents(_audit_files(spark, sf_dir)).where("file_status is null").select("event_id", "file_id", "record_index", "event_name", "event_source", "log_type")


@query("read_outcomes", "select user_id as file_id, 'parsed' as file_status, count(*) as records from events group by 1")
def read_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.sources.ingest import read_contents

    return read_contents(_audit_files(spark, sf_dir)).where("file_status is not null").select("file_id", "file_status", F.col("record_index").alias("records"))


@query("detect_documents", f"select '/x/' || user_id || '.json.gz' as path, 'cloudtrail' as log_type, 'high' as confidence, count(*) as records, false as estimated, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) filter (i = 0) as sample_time, 'e' || min(event_id) as sample_name from {_RANKED} group by 1, user_id")
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.sources.detect import detect_contents

    return detect_contents(_audit_files(spark, sf_dir)).select("path", "log_type", "confidence", "records", "estimated", "sample_time", "sample_name")


def _line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of JSON lines for each user, every third event being no record, in the form of one of three producers."""
    waf = "to_json(named_struct('webaclId', 'arn:aws:wafv2:us-east-1:000000000000:w', 'action', event_type, 'timestamp', event_id, 'httpRequest', named_struct('clientIp', '10.0.0.1')))"
    api = "to_json(named_struct('request_id', 'q', 'resource_path', '/v', 'http_method', event_type, 'status', cast(event_id % 600 as string)))"
    gate = "to_json(named_struct('requestedtimeutc', '2026-01-01 00:00:00', 'httpmethod', event_type, 'apipath', '/p'))"
    line = F.expr(f"if(event_id % 3 = 0, concat('broken ', event_id), case user_id % 3 when 0 then {waf} when 1 then {api} else {gate} end)")
    first = F.expr(f"case user_id % 3 when 0 then {waf} when 1 then {api} else {gate} end")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.struct("event_id", line.alias("line"), first.alias("first")).alias("x")).groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    text = F.concat(F.col("x")[0]["first"], F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\r\n"))
    return _zipped(lines.select(F.col("user_id").alias("file_id"), F.concat(F.lit("/x/"), "user_id", F.lit(".gz")).alias("path"), text.alias("text")))


_PRODUCER = "['waf_acl', 'apigw_access', 'gateway_request'][user_id % 3 + 1]"


@query(
    "read_lines",
    f"""with r as {_RANKED} select user_id as file_id, i + 1 as record_index, {_PRODUCER} as log_type, event_type as event_name from r where event_id % 3 <> 0
      union all select user_id, 0, {_PRODUCER}, event_type from r where i = 0""",
)
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.sources.ingest import read_contents

    return read_contents(_line_files(spark, sf_dir)).where("file_status is null").select("file_id", "record_index", "log_type", "event_name")


@query(
    "read_lines_outcomes",
    f"select user_id as file_id, {_PRODUCER} as log_type, 'parsed' as file_status, 1 + count(*) filter (event_id % 3 <> 0) as records, count(*) filter (event_id % 3 = 0) as malformed, case when count(*) filter (event_id % 3 = 0) > 0 then count(*) filter (event_id % 3 = 0) || ' malformed records' end as file_note from events group by 1, 2",
)
def read_lines_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logsieve.sources.ingest import read_contents

    return read_contents(_line_files(spark, sf_dir)).where("file_status is not null").select("file_id", "log_type", "file_status", F.col("record_index").alias("records"), "malformed", "file_note")


@query(
    "payload_keys_deep",
    """with e as (select event_id, user_id % 7 as n, case event_type when 'error' then 'alb_access' else 'cloudtrail' end as log_type from events)
      select log_type, path, count(*) as events from (
        select log_type, 'request.a.b.c.d.e.f' as path from e union all select log_type, 'request.list.' || i from e, range(7) t(i) where i < n and i <= 4
        union all select log_type, 'response.flag' from e where n > 3 union all select log_type, 'resources.' || i || '.arn' from e, range(2) t(i)) group by 1, 2""",
)
def payload_keys_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies at depth: six levels of objects, lists beyond the last index, objects in lists, nulls and texts that are no body."""
    n = F.expr("user_id % 7")
    request = F.concat(F.lit('{"none":null,"empty":{},"a":{"b":{"c":{"d":{"e":{"f":1}}}}},"list":'), F.to_json(F.slice(F.array(*[F.lit(i) for i in range(7)]), F.lit(1), n.cast("int"))), F.lit("}"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.when(F.col("event_type") == "error", "alb_access").otherwise("cloudtrail").alias("log_type"), request.alias("request"),
        F.when(n > 3, '{"flag":false}').otherwise("no body").alias("response"), F.lit('[{"arn":"x"},{"arn":"y","z":null}]').alias("resources"),
    )
    return results.payload_keys(events)
