"""What lists show of an event, and the fixed display zone (nine hours ahead of UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.schema import EVENTS, FLAG_COLUMNS, TEXT_COLUMNS

ZONE = "INTERVAL 9 HOURS"

#: Summary columns in list order.
SUMMARY = ("event_name", "event_source", "identity_arn", "source_ip", "url", "status", "target", "user_agent", "aws_region", "error_code", "resource", "country", "rule", "method")

#: Columns that a list shows for each family of log types.
PROJECTIONS = {
    "http": ("time", "method", "status", "url", "source_ip", "target", "user_agent"),
    "waf": ("time", "event_name", "method", "url", "source_ip", "country", "rule", "user_agent"),
    "audit": ("time", "event_name", "event_source", "identity_arn", "source_ip", "aws_region", "error_code", "resource"),
}


def family(log_type: str | None) -> str:
    if log_type == "waf_acl":
        return "waf"
    return "http" if log_type in ("alb_access", "apigw_access", "nginx_access", "gateway_request") else "audit"


def canonical(events: DataFrame) -> DataFrame:
    """``events`` with nulls for the canonical columns it lacks."""
    missing = {}
    for field in EVENTS.split(", "):
        name, kind = field.split(" ")
        if name not in events.columns:
            missing[name] = F.lit("unknown") if name == "log_type" else F.lit(None).cast(kind)
    return events.withColumns(missing) if missing else events


def local_time(time: Column) -> Column:
    return time + F.expr(ZONE)


def shown_time(time: Column) -> Column:
    """Display time to the millisecond, cut rather than rounded."""
    return F.date_format(local_time(time), "yyyy-MM-dd HH:mm:ss.SSS")


def summary() -> list[Column]:
    """The fourteen summary columns of a canonical event."""
    at = lambda c, p: F.get_json_object(c, p)
    found = {
        "url": at("request", "$.url"),
        "status": F.coalesce(at("response", "$.elb_status_code"), at("response", "$.status")),
        "target": F.coalesce(at("resources", "$.target"), at("resources", "$.host")),
        "resource": at("resources", "$[0].ARN"),
        "country": at("request", "$.country"),
        "rule": at("response", "$.terminating_rule_id"),
        "method": at("request", "$.method"),
    }
    return [found.get(c, F.col(c)).alias(c) for c in SUMMARY]


def stats_field(field: str) -> Column:
    """The text that value statistics group by; raises ValueError for anything but a known field.

    Fields are ``day`` and ``hour`` in the display zone, text and flag columns, and paths into request,
    response and resources whose numeric steps index arrays.
    """
    if field == "day":
        return F.date_format(local_time(F.col("event_time")), "yyyy-MM-dd")
    if field == "hour":
        return F.date_format(local_time(F.col("event_time")), "yyyy-MM-dd HH:00")
    if field in TEXT_COLUMNS:
        return F.col(field)
    if field in FLAG_COLUMNS:
        return F.col(field).cast("string")
    column, _, path = field.partition(".")
    steps = path.split(".") if path else []
    plain = steps and all(s and all(c.isascii() and (c.isalnum() or c in "_-") for c in s) for s in steps)
    if column not in ("request", "response", "resources") or not plain:
        raise ValueError(f"{field} is no field that statistics know")
    return F.get_json_object(column, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps))
