"""Queries that read log files: files made of the events table in the shared folder, read through the data source.

Files are written one a bucket of events, in order of id, so SQL can tell which file and place a record has.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators import results
from logsieve.operators.case import Case
from logsieve.operators.rulesets import RuleSet
from logsieve.operators.window import Window
from logsieve.plans.model import Rule
from logsieve.plans.parser import parse_condition, parse_rules
from logsieve.queries import ADAPTED, NAMED, Query, adapted
from logsieve.queries import RULES as REPORT_RULES
from logsieve.sources.detect import detect_all
from logsieve.sources.discovery import scan
from logsieve.sources.ingest import file_outcomes, ingest, read_contents
from logsieve.sources.preview import preview
from logsieve.sources.remote import open_ranged
from logsieve.sources.source import LogSource
from logsieve.sources.storage import shared_folder

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows of the events with their bucket, which is the file, and their place in it.
PLACED = "(select *, user_id % 8 as bucket, row_number() over (partition by user_id % 8 order by event_id) - 1 as i from events)"
RULES = 1000
#: Bytes of a part in these queries: small, so that the small tables' files have many.
SMALL_PARTS = 8 << 10


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, " ".join(sql.split())
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("bucket", F.col("user_id") % 8)


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).repartition(8, "bucket").sortWithinPartitions("bucket", "event_id")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"


def _rows_folder(spark: SparkSession, sf_dir: str) -> str:
    """Gateway requests as Parquet with small row groups, a file a bucket."""
    dealt = _events(spark, sf_dir).repartitionById(8, F.col("bucket").cast("int"))  # a task a file: hashes of eight buckets meet in fewer
    rows = dealt.sortWithinPartitions("bucket", "event_id").select(
        "bucket", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("requestedtimeutc"), F.lit("GET").alias("httpmethod"), F.concat(F.lit("/"), "event_type").alias("apipath"),
        (F.col("user_id") % 5).alias("memberid"), F.concat(F.lit("10.0.0."), "user_id").alias("sourceip"), F.sha2(F.col("event_id").cast("string"), 256).alias("requestbody"),
    )
    rows.write.option("parquet.block.size", 16 << 10).option("compression", "none").partitionBy("bucket").parquet(folder := _folder(spark))
    return folder


def _lines_folder(spark: SparkSession, sf_dir: str) -> str:
    """JSON lines of an API gateway, every third being broken, a gzip file of one member a bucket."""
    line = "to_json(named_struct('request_id', concat('q', event_id), 'resource_path', '/v', 'http_method', event_type, 'status', cast(event_id % 600 as string), 'ip', concat('10.0.0.', user_id), 'request_time', concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000')))"
    first = F.col("event_id") == F.min("event_id").over(results.W.partitionBy("bucket"))
    rows = _bucketed(spark, sf_dir).withColumn("first", first).sortWithinPartitions("bucket", "event_id")
    rows.select("bucket", F.expr(f"if(event_id % 3 = 0 and not first, concat('broken ', event_id), {line})").alias("value")).write.partitionBy("bucket").option("compression", "gzip").text(folder := _folder(spark))
    return folder


@query("source_parquet_parts", f"select (bucket << 32) | i as event_id, bucket as file_id, i as record_index, 'gateway_request' as log_type, '10.0.0.' || user_id as source_ip, case user_id % 5 when 0 then null else (user_id % 5)::varchar end as identity_name from {PLACED}")
def source_parquet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups of large Parquet files are parts; record numbers go through each file."""
    found = ingest(spark, scan(spark, _rows_folder(spark, sf_dir)).candidates, split_bytes=SMALL_PARTS, columns=["source_ip", "identity_name"])
    return found.where("file_status is null").select("event_id", "file_id", "record_index", "log_type", "source_ip", "identity_name")


_KEPT = f"(select *, event_id % 3 <> 0 or i = 0 as sound from {PLACED})"


@query("source_lines_blocks", f"select (bucket << 32) | i as event_id, bucket as file_id, event_type as event_name, '10.0.0.' || user_id as source_ip, case when event_id % 600 >= 400 then 'HTTP ' || (event_id % 600) end as error_code from {_KEPT} where sound")
def source_lines_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large gzip files of one member: a task each cuts them into blocks of lines, which all cores parse."""
    found = ingest(spark, scan(spark, _lines_folder(spark, sf_dir)).candidates, split_bytes=SMALL_PARTS)
    return found.where("file_status is null").select("event_id", "file_id", "event_name", "source_ip", "error_code")


@query("source_outcomes", f"select bucket as file_id, 'apigw_access' as log_type, 'parsed' as status, count(*) filter (sound) as records, count(*) filter (not sound) as malformed, count(*) filter (not sound) || ' malformed records' as note from {_KEPT} group by 1")
def source_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_outcomes(ingest(spark, scan(spark, _lines_folder(spark, sf_dir)).candidates, split_bytes=SMALL_PARTS))


@query("source_stream", f"select i as record_index, event_type as event_name, '10.0.0.' || user_id as source_ip, (select count(*) from {_KEPT} where sound) as events, 8 as files from {_KEPT} where sound")
def source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, to its end; with the number of different event and file ids."""
    spark.dataSource.register(LogSource)
    at = _folder(spark)
    rows = spark.readStream.format("cloud_logs").schema("event_id long, file_id long, record_index long, event_name string, source_ip string").load(_lines_folder(spark, sf_dir))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    ids = rows.agg(F.countDistinct("event_id").alias("events"), F.countDistinct("file_id").cast("int").alias("files"))
    return rows.crossJoin(F.broadcast(ids)).select("record_index", "event_name", "source_ip", "events", "files")  # one row of counts


@query("source_projection", f"select (bucket << 32) | i as event_id, '/' || event_type as url from {PLACED}")
def source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns of the schema asked for are built."""
    spark.dataSource.register(LogSource)
    rows = spark.read.format("cloud_logs").schema("event_id long, request string").load(_rows_folder(spark, sf_dir))
    return rows.select("event_id", F.get_json_object("request", "$.url").alias("url"))


# Damage ----------------------------------------------------------------------------------------------

_TEN_TIMES = 10_000


def _damaged(part: pd.DataFrame) -> pd.DataFrame:
    """Files of a user's lines, each with what is wrong in one of eight ways."""

    def content(kind: int, lines: str) -> bytes:
        data = lines.encode()
        if kind == 1:  # two members, cut within a line
            return gzip.compress(data[:40], 1, mtime=0) + gzip.compress(data[40:], 1, mtime=0)
        if kind == 2:
            return b"\x1f\x8b" + data
        if kind == 3:
            return gzip.compress(b"[" * _TEN_TIMES * 20, 1, mtime=0)
        if kind == 4:  # a line too deep for any reader, and a number too long
            return gzip.compress(data + b"\n" + b'{"request_id":' + b"[" * _TEN_TIMES * 20 + b"\n" + b'{"request_id":"q","resource_path":"/","http_method":"GET","status":' + b"7" * _TEN_TIMES + b"}", 1, mtime=0)
        if kind == 5:  # the last member is cut off
            return gzip.compress(data + b"\n", 1, mtime=0) + gzip.compress(data, 1, mtime=0)[:-9]
        if kind == 6:
            return b"x"
        if kind == 7:
            return gzip.compress(b'{"Records":[{"eventVersion":"1","eventSource":"s","eventTime":"2024-01-01T00:00:00Z"},' + b"[" * _TEN_TIMES * 20, 1, mtime=0)
        return gzip.compress(data, 1, mtime=0)

    return pd.DataFrame({"file_id": part.file_id, "path": part.path, "content": [content(k, t) for k, t in zip(part.kind, part.text, strict=True)]})


@query(
    "read_damaged",
    """select user_id as file_id, case when user_id % 8 in (2, 3, 6, 7) then 'unknown' else 'apigw_access' end as log_type,
      case user_id % 8 when 2 then 'failed' when 3 then 'skipped' when 5 then 'failed' when 6 then 'failed' else 'parsed' end as status,
      case user_id % 8 when 2 then 0 when 3 then 0 when 4 then count(*) when 5 then 1 + count(*) when 6 then 0 when 7 then 1 else count(*) end as least_records,
      case user_id % 8 when 4 then 2 else 0 end as malformed from events group by user_id""",
)
def read_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever is wrong with a file, the others are read, and its outcome tells. Of a cut member some lines are there."""

    def damage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(_damaged, batches)

    line = F.expr("to_json(named_struct('request_id', concat('q', event_id), 'resource_path', '/v', 'http_method', event_type, 'status', '200'))")
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"), F.count("*").alias("n"))
    files = users.select(F.col("user_id").alias("file_id"), F.concat(F.lit("/x/"), "user_id", F.lit(".gz")).alias("path"), (F.col("user_id") % 8).alias("kind"), "text")
    told = file_outcomes(read_contents(files.mapInPandas(damage, "file_id long, path string, content binary")))
    known = told.join(users.select(F.col("user_id").alias("file_id"), "n"), "file_id")
    cut = (F.col("file_id") % 8 == 5) & (F.col("records") > F.col("n"))
    return known.select("file_id", "log_type", "status", F.when(cut, F.col("n") + 1).otherwise(F.col("records")).alias("least_records"), "malformed")


# Many rules ------------------------------------------------------------------------------------------

_TYPES = ["click", "error", "purchase", "signup", "view"]


def many_rules(n: int = RULES) -> list[Rule]:
    """Rules of four forms, by number: values, ends of texts, lists, and one of many conditions."""
    out = []
    for i in range(n):
        text = [
            f'event_name == "{_TYPES[i // 4 % 5]}" and identity_name == "{i // 4}" and request.k > {i % 97}',
            f'identity_arn endswith "/{i // 4}" and not request.k >= 50',
            f'identity_name in ("{i}", "{i + 1}", "x{i}") and event_source exists',
            f'2 of (identity_arn icontains "USER/{i // 4}", event_name == "error", request.k == {i % 100}) and identity_name startswith "{i // 4}"',
        ][i % 4]
        rule = parse_condition(text)
        out.append(Rule(f"r{i}", {}, rule.tests, rule.condition))
    return out


@query(
    "rules_thousand",
    f"""with e as (select event_id, event_name, event_source, identity_name, identity_arn, {NAMED} as k from {ADAPTED}), r as (select i, cast(i // 4 as varchar) as q from range({RULES}) t(i))
      select 'r' || i as rule_id, event_id from e join r on (i % 4 = 0 and event_name = (['click', 'error', 'purchase', 'signup', 'view'])[i // 4 % 5 + 1] and identity_name = q and k > i % 97)
        or (i % 4 = 1 and suffix(identity_arn, '/' || q) and not coalesce(k >= 50, false)) or (i % 4 = 2 and identity_name in (cast(i as varchar), cast(i + 1 as varchar)) and event_source is not null)
        or (i % 4 = 3 and starts_with(identity_name, q) and contains(identity_arn, 'user/' || q)::int + (event_name = 'error')::int + coalesce(k = i % 100, false)::int >= 2)""",
)
def rules_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand rules in one scan, evaluated as data."""
    return results.evaluate_all(adapted(spark, sf_dir), many_rules()).select("rule_id", "event_id")


# What is known of files, and cases ---------------------------------------------------------------------


@query("detect_folder", "select user_id % 8 as bucket, 'gateway_request' as log_type, 'high' as confidence, count(*) as records, false as estimated from events group by 1")
def detect_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files by their footer and first row."""
    found = detect_all(spark, [c.path for c in scan(spark, _rows_folder(spark, sf_dir)).candidates])
    return found.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "log_type", "confidence", "records", "estimated")


_PATHS = "(values ('request_id', null), ('resource_path', null), ('http_method', 'event_name'), ('status', 'response.status'), ('ip', 'source_ip'), ('request_time', 'event_time')) p(path, label)"


@query("preview_files", f"select bucket, path, label, count(*) as n from {_KEPT}, {_PATHS} where sound and i < 200 group by 1, 2, 3")
def preview_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of every file in labelled pieces, counted by path."""
    files = scan(spark, _lines_folder(spark, sf_dir)).candidates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for file_id, path in zip(part.file_id, part.path, strict=True):
                with open_ranged(path) as file:
                    rows += [(file_id, x.path, x.column) for record in preview(path, file).records for x in record]
            yield pd.DataFrame(rows, columns=["bucket", "path", "label"])

    listed = spark.createDataFrame([(c.file_id, c.path) for c in files], "file_id long, path string").repartition(len(files), "file_id")
    return listed.mapInPandas(run, "bucket long, path string, label string").groupBy("bucket", "path", "label").agg(F.count("*").alias("n"))


def _case(spark: SparkSession, sf_dir: str) -> Case:
    return Case.create(spark, shared_folder(spark), f"case-{uuid.uuid4().hex}", _lines_folder(spark, sf_dir))


_CASE_RULE = """rule failed_clicks { meta: log_type = "apigw_access" fields: $what = event_name == "click" $bad = error_code startswith "HTTP 4" condition: $what and $bad }
rule pending { condition: event_name == "view" }"""


@query("case_matches", f"""select 'failed_clicks' as rule_id, (bucket << 32) | i as event_id, '10.0.0.' || user_id as source_ip, '{{"$bad":"HTTP ' || (event_id % 600) || '","$what":"click"}}' as matched_fields, 1 as evaluated
  from {_KEPT} where sound and event_type = 'click' and event_id % 600 >= 400 and event_id % 600 < 500""")
def case_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder into a case, two rules registered, one evaluated: its matches, and how many rules are evaluated."""
    case = _case(spark, sf_dir)
    rules = parse_rules(_CASE_RULE)
    case.register(RuleSet(rules, {r.id: "" for r in rules}, {r.id: "own" for r in rules}))
    case.evaluate(rules[0])
    done = sum(bool(r["evaluated"]) for r in case.rules.values())
    return case.matches().select("rule_id", "event_id", "source_ip", "matched_fields", F.lit(done).alias("evaluated"))


@query("case_page", f"select (bucket << 32) | i as event_id, event_type as event_name from {_KEPT} where sound order by date_trunc('second', ts) desc, (bucket << 32) | i desc limit 150")
def case_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of a case, from the files whose bounds come first."""
    return _case(spark, sf_dir).list_events(Window(limit=150)).select("event_id", "event_name")


@query("case_files", f"select bucket as file_id, 'parsed' as status, count(*) filter (sound) as records, count(*) filter (not sound) as malformed from {_KEPT} group by 1")
def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case(spark, sf_dir).files.select("file_id", "status", "records", "malformed")


@query(
    "match_report_evidence",
    f"""select row_number() over (order by rule_id, event_id) as place, * from (
      select 'hot_errors' as rule_id, event_id, '{{"event_name":"error","request.k":"' || json_extract_string(request, '$.k') || '"}}' as matched_fields from {ADAPTED} where log_type = 'alb_access' and event_name = 'error' and {NAMED} > 50
      union all select 'purchases', event_id, '{{"event_name":"purchase"}}' from {ADAPTED} where event_name = 'purchase'
      union all select 'even_users', event_id, case when coalesce(event_source = 'signup', false) then '{{"$a":"true","$b":"signup"}}' else '{{"$a":"true","$b":"' || json_extract_string(request, '$.k') || '"}}' end
        from {ADAPTED} where read_only and ({NAMED} >= 90 or coalesce(event_source = 'signup', false)))""",
)
def match_report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with what fired; ``place`` is the row's place in the report's own order, added up over its sorted partitions."""
    report = results.match_report(adapted(spark, sf_dir), parse_rules(REPORT_RULES))[0]
    marked = report.select("rule_id", "event_id", "matched_fields", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    marked.write.parquet(at := _folder(spark))
    marked = spark.read.parquet(at)
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.select(F.col("part").alias("part"), "first", F.coalesce(F.sum("n").over(results.W.orderBy("part").rowsBetween(results.W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    return marked.join(F.broadcast(before), "part").select((F.col("before") + F.col("at") - F.col("first") + 1).alias("place"), "rule_id", "event_id", "matched_fields")
