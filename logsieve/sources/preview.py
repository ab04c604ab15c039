"""What the first records of a file hold and how they would be mapped."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

from logsieve.sources.detect import detect, head_of
from logsieve.sources.json_stream import documents
from logsieve.sources.mapping import FieldMap, at
from logsieve.sources.normalize import alb_tokens

MOST_RECORDS = 200

#: Fixed positions of a load balancer's tokens and the columns or paths they go to.
ALB_POSITIONS = {1: "event_time", 2: "resources.load_balancer", 3: "source_ip", 4: "resources.target", 8: "response.elb_status_code", 9: "response.target_status_code", 10: "response.received_bytes", 11: "response.sent_bytes", 12: "request", 13: "user_agent", 16: "resources.target_group_arn", 17: "request.trace_id", 18: "request.domain_name", 24: "error_message"}

#: Raw paths of the JSON producers and the columns they go to.
JSON_LABELS = {
    "waf_acl": {"timestamp": "event_time", "action": "event_name", "httpRequest.clientIp": "source_ip", "httpRequest.httpMethod": "request.method", "httpRequest.uri": "request.url", "httpRequest.country": "request.country", "terminatingRuleId": "response.terminating_rule_id", "webaclId": "resources.web_acl_id"},
    "apigw_access": {"request_time": "event_time", "http_method": "event_name", "ip": "source_ip", "user_agent": "user_agent", "status": "response.status", "path": "request.url", "api_id": "resources.api_id", "stage": "resources.stage"},
    "nginx_access": {"@timestamp": "event_time", "birdview.request_method": "event_name", "birdview.client_ip": "source_ip", "birdview.http_user_agent": "user_agent", "birdview.status": "response.status", "birdview.request_uri": "request.url", "birdview.host": "resources.host"},
    "gateway_request": {"requestedtimeutc": "event_time", "httpmethod": "event_name", "sourceip": "source_ip", "apipath": "request.url", "memberid": "identity_name", "requestheaders.user-agent": "user_agent"},
}


@dataclass
class Piece:
    path: str
    value: str
    column: str | None


@dataclass
class Preview:
    log_type: str
    records: list[list[Piece]] = field(default_factory=list)
    mapped: int = 0
    names: list[tuple[str, int]] = field(default_factory=list)
    paths: list[tuple[str, int]] = field(default_factory=list)


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, text) of every leaf that isn't null."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}.{i}" if path else str(i))
    elif value is not None:
        yield path, value if isinstance(value, str) else json.dumps(value)


def _common(found: Counter[str]) -> list[tuple[str, int]]:
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def preview(path: str, file: BinaryIO, overrides: dict[str, list[str]] | None = None) -> Preview:
    """Up to ``MOST_RECORDS`` records of a file's first part, in pieces labelled with their column."""
    out = Preview(detect(path, file).log_type)
    text = head_of(file)[0].decode("utf-8", "replace")
    mapping = FieldMap(overrides)
    records: list[Any] = []
    if out.log_type == "alb_access":
        for tokens in filter(None, map(alb_tokens, text.splitlines()[:MOST_RECORDS])):
            out.records.append([Piece(str(i), t, ALB_POSITIONS.get(i)) for i, t in enumerate(tokens)])
    elif out.log_type in JSON_LABELS:
        for line in text.splitlines()[:MOST_RECORDS]:
            try:
                value = json.loads(line)
            except ValueError:
                continue
            records.append(value.get("_source", value) if isinstance(value, dict) else value)
        labels = JSON_LABELS[out.log_type]
        out.records = [[Piece(p, v, labels.get(p)) for p, v in leaves(r)] for r in records]
    elif out.log_type == "cloudtrail":
        try:
            for record in documents(iter([text])):
                records.append(record)
                if len(records) == MOST_RECORDS:
                    break
        except ValueError:
            pass
        # The first source that a record has is the one its column comes from.
        for r in records:
            label = {p: c for c, ps in reversed(mapping.sources.items()) for p in ps if p == next((q for q in ps if at(r, q) is not None), None)}
            out.records.append([Piece(p, v, label.get(p) or next((c for q, c in label.items() if p.startswith(q + ".")), None)) for p, v in leaves(r)])
    out.mapped = sum(any(x.column for x in r) for r in out.records)
    out.names = _common(Counter(x.value for r in out.records for x in r if x.column == "event_name"))
    out.paths = _common(Counter(x.path for r in out.records for x in r))
    return out
