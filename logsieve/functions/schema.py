"""The canonical event table."""

from __future__ import annotations

TEXT_COLUMNS = ("event_source", "event_name", "aws_region", "account_id", "source_ip", "user_agent", "identity_type", "identity_arn", "identity_name", "error_code", "error_message")
FLAG_COLUMNS = ("mfa_authenticated", "read_only", "management_event")
JSON_COLUMNS = ("request", "response", "resources", "raw")
FIELDS = ("event_time", *TEXT_COLUMNS, *FLAG_COLUMNS, *JSON_COLUMNS)

LOG_TYPES = ("cloudtrail", "alb_access", "waf_acl", "apigw_access", "nginx_access", "gateway_request", "cloudtrail_digest", "config_snapshot", "unknown")
#: Producers that write one record to a line, and may come as Parquet.
LINE_TYPES = ("waf_acl", "apigw_access", "nginx_access", "gateway_request")

EVENTS = (
    "event_id long, file_id long, record_index long, log_type string, event_time timestamp_ntz, "
    + ", ".join(f"{c} string" for c in TEXT_COLUMNS)
    + ", "
    + ", ".join(f"{c} boolean" for c in FLAG_COLUMNS)
    + ", "
    + ", ".join(f"{c} string" for c in JSON_COLUMNS)
)
