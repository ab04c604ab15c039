"""Where the columns of an audit event come from, and how values are taken."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from typing import Any

from logsieve.functions.schema import FLAG_COLUMNS, JSON_COLUMNS

_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:([Zz])|([+-])(\d\d):(\d\d))")
_LOOSE = re.compile(r"(\d{4})-(\d\d)-(\d\d)[ T](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:([Zz])|([+-])(\d\d)(?::?(\d\d))?)?")
_CLF = re.compile(r"(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-])(\d\d)(\d\d)")
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}

#: Fixed sources of each column, tried in order.
AUDIT_MAPPING: dict[str, tuple[str, ...]] = {
    "event_time": ("eventTime",), "event_source": ("eventSource",), "event_name": ("eventName",), "aws_region": ("awsRegion",), "account_id": ("recipientAccountId",), "source_ip": ("sourceIPAddress",),
    "user_agent": ("userAgent",), "identity_type": ("userIdentity.type",), "identity_arn": ("userIdentity.arn",), "identity_name": ("userIdentity.userName", "userIdentity.sessionContext.sessionIssuer.userName"),
    "mfa_authenticated": ("userIdentity.sessionContext.attributes.mfaAuthenticated", "additionalEventData.MFAUsed"), "error_code": ("errorCode",), "error_message": ("errorMessage",),
    "read_only": ("readOnly",), "management_event": ("managementEvent",), "request": ("requestParameters",), "response": ("responseElements",), "resources": ("resources",),
}


_SORTED = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
_ORDERED = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def compact(value: Any, ordered: bool = False) -> str:
    """Compact JSON; keys are sorted unless the order of ``value`` is meant."""
    return _ORDERED(value) if ordered else _SORTED(value)


def at(value: Any, path: str) -> Any:
    """The value at a dotted path; whole-number steps index arrays."""
    for step in path.split("."):
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return None
    return value


def _stamp(m: re.Match[str] | None) -> datetime | None:
    if m is None:
        return None
    y, mo, d, h, mi, s, fraction, _, sign, oh, om = m.groups()
    try:
        out = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), int((fraction or "")[:6].ljust(6, "0")))
        if sign:
            shift = timedelta(hours=int(oh), minutes=int(om or 0))
            out += shift if sign == "-" else -shift
        return out
    except (ValueError, OverflowError):
        return None


def rfc3339(text: Any) -> datetime | None:
    """UTC, to the microsecond, without a zone."""
    return _stamp(_RFC3339.fullmatch(text)) if isinstance(text, str) else None


def loose_utc(text: Any) -> datetime | None:
    """Like ``rfc3339``, or with a space, or without a zone, which is UTC."""
    return _stamp(_LOOSE.fullmatch(text)) if isinstance(text, str) else None


def clf(text: Any) -> datetime | None:
    m = _CLF.fullmatch(text) if isinstance(text, str) else None
    if m is None or m[2] not in _MONTHS:
        return None
    try:
        at_zone = datetime(int(m[3]), _MONTHS[m[2]], int(m[1]), int(m[4]), int(m[5]), int(m[6]), tzinfo=timezone(timedelta(hours=int(m[7] + m[8]), minutes=int(m[7] + m[9]))))
        return at_zone.astimezone(timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def millis(value: Any) -> datetime | None:
    if isinstance(value, bool) or not isinstance(value, int):
        return None
    try:
        return datetime(1970, 1, 1) + timedelta(milliseconds=value)
    except OverflowError:
        return None


def flag(value: Any) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "Yes": True, "false": False, "No": False}.get(value) if isinstance(value, str) else None


def _coerce(column: str, value: Any) -> Any:
    if value is None:
        return None
    if column == "event_time":
        return rfc3339(value)
    if column in FLAG_COLUMNS:
        return flag(value)
    if column in JSON_COLUMNS:
        return compact(value)
    return value if isinstance(value, str) else None


class FieldMap:
    """Sources of the columns; overrides replace a column's list, and unknown columns are refused."""

    def __init__(self, overrides: dict[str, list[str]] | None = None):
        unknown = set(overrides or {}) - set(AUDIT_MAPPING)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.sources = {c: tuple(p for p in (overrides or {}).get(c, default) if p) for c, default in AUDIT_MAPPING.items()}

    def look_up(self, column: str, record: dict[str, Any]) -> Any:
        """The first source that is there and fits the column's type."""
        for path in self.sources[column]:
            if (found := _coerce(column, at(record, path))) is not None:
                return found
        return None
