"""Fields of events as columns: present or not, rendered as text, with the kind of their value.

A JSON body is read by ``get_json_object``. The kind of a value (text, number, boolean, container) is
only looked up, in a VARIANT, where an operator depends on it; canonical tables carry VARIANT companions
named ``<column>_v``, and ``with_variants`` parses a body once for tables that don't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.schema import FLAG_COLUMNS, JSON_COLUMNS, TEXT_COLUMNS

#: What a number looks like: no spaces, suffixes, hexadecimal or NaN, which a cast alone would take.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\z"


@dataclass
class Field:
    """``text`` is null where the field is absent; ``kind`` is None if it can only be text.

    ``quick`` is the same but for the order of keys in objects, without a look at the kind.
    """

    text: Column
    flag: Column | None = None
    kind: Column | None = None
    plain: bool = False
    quick: Column | None = None

    def __post_init__(self) -> None:
        if self.quick is None:
            self.quick = self.text

    @property
    def present(self) -> Column:
        return self.quick.isNotNull()

    @property
    def number(self) -> Column:
        """The text as a number, null if it is none; flags and containers never are."""
        if self.flag is not None:
            return F.lit(None).cast("double")
        return F.when(self.quick.rlike(NUMBER), self.quick.try_cast("double"))


def time_text(time: Column) -> Column:
    """RFC 3339 in UTC, the fraction without trailing zeros."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(time, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, fraction, F.lit("Z"))


def _steps(path: list[str]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def resolve(field: str, columns: list[str], text: Column | None = None, kind: Column | None = None) -> Field | None:
    """The field of a rule on a table with these columns; None if there is no such field.

    Paths go into request, response, resources and raw by object keys only: a number is a key, too. ``text`` and
    ``kind`` are what a path was found to hold, if it has been looked up.
    """
    name, *path = field.split(".")
    if name not in columns or any(not p or "'" in p for p in path):
        return None
    if not path:
        if name == "event_time":
            return Field(time_text(F.col(name)))
        if name in TEXT_COLUMNS or name in JSON_COLUMNS:
            return Field(F.col(name), plain=True)
        if name in FLAG_COLUMNS:
            return Field(F.col(name).cast("string"), flag=F.col(name))
        return None
    if name not in JSON_COLUMNS:
        return None
    text = F.get_json_object(F.col(name), _steps(path)) if text is None else text
    body = F.col(f"{name}_v") if f"{name}_v" in columns else F.try_parse_json(F.col(name))
    value = F.try_variant_get(body, _steps(path), "variant")
    kind = F.schema_of_variant(value) if kind is None else kind
    container = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    rendered = F.when((text.startswith("{") | text.startswith("[")) & container, F.to_json(value)).otherwise(text)
    return Field(rendered, kind=kind, quick=text)


def with_variants(events: DataFrame, columns: set[str]) -> DataFrame:
    """Add a VARIANT of each JSON column in ``columns`` that has none, parsed once for each row."""
    for c in sorted(columns & set(JSON_COLUMNS)):
        if c in events.columns and f"{c}_v" not in events.columns:
            events = events.select("*", F.inline(F.array(F.struct(F.try_parse_json(c).alias(f"{c}_v")))))
    return events
