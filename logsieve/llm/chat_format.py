"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template says how a turn begins and ends, what each role is called, which roles' texts are learned from, and
which role may follow in which state. Every turn gives three segments: its head, its text and its end; only texts
of the template's ``learned`` roles are under the loss mask. All of it is DataFrame functions.

Escapes make the output readable back: backslashes in a text are doubled, and a backslash goes behind the first
character of each control string (``opening`` and ``closing``; in roles that the template has no name for also
the ``naming`` that ends a head), overlapping ones too. So no control string of a text is left whole, and taking
the first backslash off each pair restores the text. Control strings hold no backslash, have two characters or
more, and ``closing`` doesn't overlap itself, so its first occurrence is always a turn's end.

Defined results: turns of a conversation are in order of turn (null first), then role, then text; a null role or
text is empty. Rows without a conv_id are one conversation. Roles without a name in the template are written out,
behind ``unnamed``; they have no state to go to, so their conversation is invalid. Invalid conversations are
formatted like all others, with the place of the first turn that has no transition in ``bad_turn``; ``bad_turn``
is one more than the number of turns where the conversation ends in a state that isn't final. A formatted
conversation is one row, so it has to fit into Spark's 2 GB of a string. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.shared import table


@dataclass(frozen=True)
class Template:
    """``machine``: state → {role → next state}, from ``start``; a conversation may end in the ``final`` states."""

    opening: str = "### "
    naming: str = ": "
    closing: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    unnamed: str = "="
    learned: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    final: frozenset[str] = frozenset({"answered"})
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "returned"},
            "returned": {"tool": "returned", "assistant": "answered"},
        }
    )

    def __post_init__(self) -> None:
        for s in (self.opening, self.naming, self.closing):
            if len(s) < 2 or "\\" in s:
                raise ValueError(f"a control string needs two characters or more and no backslash: {s!r}")
        if any(self.closing.startswith(self.closing[-k:]) for k in range(1, len(self.closing))):
            raise ValueError(f"the end of a turn overlaps itself: {self.closing!r}")
        if len(set(self.names.values())) < len(self.names) or any(self.naming in n or n.startswith(self.unnamed) for n in self.names.values()):
            raise ValueError("roles need names of their own, without what ends a head or begins an unnamed one")

    def escape(self, text: Column, *more: str) -> Column:
        """``text`` without any control string in one piece."""
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        broken = lambda c, s: F.regexp_replace(c, f"({_quoted(s[0])})(?={_quoted(s[1:])})", r"$1\\")
        return reduce(broken, (_core(self.opening), _core(self.closing), *more), doubled)

    def head(self, role: Column) -> Column:
        """What begins a turn of ``role``."""
        name = F.coalesce(_looked_up(self.names, role), F.concat(F.lit(self.unnamed), self.escape(role, self.naming)))
        return F.concat(F.lit(self.opening), name, F.lit(self.naming))

    def fold(self, roles: Column) -> Column:
        """The place (from 1) of the first role without a transition, one more than the roles for a bad end, or null."""
        moves = {f"{state}\n{role}": after for state, of in self.machine.items() for role, after in of.items()}
        step = lambda s, role: F.struct(F.when(s["state"].isNotNull(), _looked_up(moves, F.concat(s["state"], F.lit("\n"), role))).alias("state"), (s["place"] + s["state"].isNotNull().cast("int")).alias("place"))
        ended = F.aggregate(roles, F.struct(F.lit(self.start).alias("state"), F.lit(0).alias("place")), step)
        return F.when(ended["state"].isNull(), ended["place"]).when(~ended["state"].isin(*self.final), ended["place"] + 1)


def _core(control: str) -> str:
    """A control string without white space around it: what a text may not hold whole."""
    return s if len(s := control.strip()) > 1 else control


def _quoted(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def _looked_up(table_: dict[str, str], key: Column) -> Column:
    """The entry for ``key`` of a small constant table, null for none."""
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(table_.items())[1:], F.when(key == next(iter(table_)), F.lit(table_[next(iter(table_))])))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, turns) of rows (keys, turn, role, text): the turns of each conversation in order, as array<struct<turn, role, text>>."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.select(*keys, F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t"))
    return turns.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_chats(rows: DataFrame, template: Template | None = None, *keys: str) -> DataFrame:
    """(keys, segments, bad_turn) of rows (conv_id or other keys, turn, role, text).

    ``segments`` is array<struct<text, loss>>; the formatted conversation is their texts one after the other.
    """
    template, keys = template or Template(), keys or ("conv_id",)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    of = lambda t: F.array(segment(template.head(t["role"]), no), segment(template.escape(t["text"]), t["role"].isin(*template.learned)), segment(F.lit(template.closing), no))
    told = conversations(rows, *keys)
    return told.select(*keys, F.flatten(F.transform("turns", of)).alias("segments"), template.fold(F.col("turns.role")).alias("bad_turn"))


def formatted(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def learned(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    template = template or Template()
    parts = F.split(text, _quoted(template.closing), -1)
    names = {f"{name}": role for role, name in template.names.items()}

    def turn(part: Column) -> Column:
        rest = F.substr(part, F.lit(len(template.opening) + 1))
        name = F.substring_index(rest, template.naming, 1)
        role = F.coalesce(_looked_up(names, name), unescape(F.substr(name, F.lit(len(template.unnamed) + 1))))
        return F.struct(role.alias("role"), unescape(F.substr(rest, F.char_length(name) + len(template.naming) + 1)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


#: The text of either turn of conversation -7.
CONTROL = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one made of control strings, formatted; the digests are of what is read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("made", F.lit(False))
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"), F.lit(True).alias("made"))
    out = format_chats(given.unionByName(made), None, "conv_id", "made").select("conv_id", "bad_turn", formatted(F.col("segments")).alias("output"), learned(F.col("segments")).alias("learned"))
    out = out.withColumn("turns", read_back(F.col("output")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.char_length("output").cast("long").alias("formatted_chars"), F.col("bad_turn").cast("long").alias("bad_turn"),
    )
