"""Many rules as data: one plan whose size depends on the fields that rules read, not on the number of rules.

``compile`` makes an expression of each rule, which every row goes through. Here a rule set becomes a small table:

* Each rule has a *cover*: atoms of which one holds wherever the rule matches. An atom is a value that a field
  equals, or a text that a field begins with, ends with or holds. Of the parts of a conjunction the one is taken
  whose atoms fewest values hold, as far as the values that all rules name can tell; rules that no atom covers have
  the atom that every row has.
* A row's atoms are the values of its fields, and what multi-literal patterns (a trie of all texts looked for, in
  lower case, tried at the start, at the end from behind, or at every place) find in them. They meet the index,
  atom → rules, in a broadcast hash join. What tests ask of a field is read once a row, before that.
* What is left, a row with a rule that may match, is decided by the rule's tests and clauses, which a second broadcast
  join adds: higher-order functions over arrays, the same for all rules. A rule that several atoms propose is decided
  at the first of them.

Rules whose condition has more than ``MOST_CLAUSES`` clauses in conjunctive form stay with the compiler. Results are
those of ``compile``: tests hold the one against the other.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import fsum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.fields import Field, resolve, with_variants
from logsieve.plans.compile import _ascii_lower, _FOLD, _needs_kind
from logsieve.plans.model import ORDERED, TEXTUAL, And, AtLeast, Condition, Not, Rule, Test, Variable
from logsieve.plans.regex import to_java

MOST_CLAUSES = 64
#: Texts of one character would be found nearly everywhere.
SHORTEST_NEEDLE = 2
EVERY = "*"
#: Bytes for each core, as Spark's statistics know them, below which a table may come in too few parts to keep the cores busy.
PART_BYTES = 128 << 20

#: (test, holds): one that is wanted or, negated, isn't.
Literal = tuple[int, bool]
Clause = frozenset[Literal]
Atom = tuple[str, str, str]  # kind ("=" or "~"), field, text

_TESTS = "array<struct<place:int,op:string,text:string,number:double,flag:boolean,among:array<string>,rendered:boolean,typed:boolean>>"
ATOMS = "atom string, numbers array<int>"
RULES = f"number int, rule struct<rule_id:string,log_type:string,atoms:array<string>,needles:array<string>,tests:{_TESTS},clauses:array<array<struct<test:int,holds:boolean>>>>"


class TooLarge(ValueError):
    """A condition with too many clauses."""


def clauses(rule: Rule) -> list[Clause]:
    """The rule's condition in conjunctive form: every clause needs one of its literals. Raises TooLarge."""
    of = {name: frozenset((i, True) for i, t in enumerate(rule.tests) if t.variable == name) for name in {t.variable for t in rule.tests}}

    def slim(found: set[Clause]) -> set[Clause]:
        found = {c for c in found if not any((i, not holds) in c for i, holds in c)}
        if len(found) > MOST_CLAUSES:
            raise TooLarge(rule.id)
        return {c for c in found if not any(d < c for d in found)}

    def either(parts: list[set[Clause]]) -> set[Clause]:
        return reduce(lambda a, b: slim({x | y for x in a for y in b}), parts, {frozenset()})

    def cnf(c: Condition, wanted: bool) -> set[Clause]:
        if isinstance(c, Variable):
            own = of.get(c.name, frozenset())
            return {own} if wanted else {frozenset({(i, False)}) for i, _ in own}
        if isinstance(c, Not):
            return cnf(c.part, not wanted)
        if isinstance(c, AtLeast):
            # n of k hold if of any k - n + 1 one does; fewer than n hold if of any n one doesn't.
            k = len(c.names)
            if c.n <= 0 or c.n > k:
                return set() if (c.n <= 0) is wanted else {frozenset()}
            groups = combinations(c.names, k - c.n + 1 if wanted else c.n)
            return slim(bounded(frozenset().union(*x) for g in groups for x in products([cnf(Variable(n), wanted) for n in g])))
        parts = [cnf(p, wanted) for p in c.parts]
        return slim(set().union(*parts)) if isinstance(c, And) is wanted else either(parts)

    def products(parts: list[set[Clause]]) -> Iterator[list[Clause]]:
        if not parts:
            yield []
            return
        for x in parts[0]:
            for rest in products(parts[1:]):
                yield [x, *rest]

    def bounded(found: Iterator[Clause]) -> set[Clause]:
        out: set[Clause] = set()
        for c in found:
            out.add(c)
            if len(out) > 16 * MOST_CLAUSES:
                raise TooLarge(rule.id)
        return out

    return sorted(slim(cnf(rule.condition, True)), key=sorted)


def atoms_of(test: Test, found: Field | None) -> frozenset[Atom] | None:
    """Atoms of which one holds wherever the test does; None if there are none."""
    if found is None:
        return None if test.operator == "missing" else frozenset()
    if test.operator == "==" and not isinstance(test.value, float):
        return frozenset({("=", test.field, str(test.value).lower() if isinstance(test.value, bool) else test.value)})
    if test.operator == "in" and not any(v[:1] in ("{", "[") for v in test.value):
        return frozenset(("=", test.field, v) for v in test.value)
    if test.operator in TEXTUAL and isinstance(test.value, str) and len(test.value) >= SHORTEST_NEEDLE:
        return frozenset({("~", test.field, test.value.translate(_FOLD))})
    return None


def _resolved(rules: list[Rule], columns: list[str]) -> dict[str, Field | None]:
    """Every field that the rules read, looked up once: making columns costs far more than the rest of the index."""
    return {f: resolve(f, columns) for f in {t.field for r in rules for t in r.tests}}


def shares(rules: list[Rule]) -> Callable[[Atom], float]:
    """The share of values that hold an atom, estimated from the texts that the rules name for its field."""
    named: dict[str, set[str]] = {}
    for t in (t for r in rules for t in r.tests):
        if t.operator == "in" or t.operator == "==" or t.operator in TEXTUAL:
            named.setdefault(t.field, set()).update(str(v).lower() if isinstance(v, bool) else v.translate(_FOLD) for v in (t.value if t.operator == "in" else [t.value]) if isinstance(v, (str, bool)))
    sides = {f: (sorted(texts), sorted(x[::-1] for x in texts)) for f, texts in named.items()}

    def share(atom: Atom) -> float:
        kind, field, text = atom
        starts, ends = sides[field]
        begun = lambda held, x: bisect_right(held, x, key=lambda y: y[: len(x)]) - bisect_left(held, x)
        n = 1 if kind == "=" else max(1, begun(starts, text) + begun(ends, text[::-1]) - 1)
        return n / (len(starts) + 1)

    return share


def cover(rule: Rule, conditions: list[Clause], columns: list[str], known: dict[str, Field | None] | None = None, share: Callable[[Atom], float] | None = None) -> frozenset[Atom] | None:
    """The set of atoms, of those that one clause of the rule allows for, that fewest values hold; None if there is none."""
    known, share = _resolved([rule], columns) if known is None else known, share or shares([rule])
    found: list[frozenset[Atom]] = []
    for clause in conditions:
        parts = [atoms_of(rule.tests[i], known[rule.tests[i].field]) if holds else None for i, holds in clause]
        if all(p is not None for p in parts):
            found.append(frozenset().union(*parts))
    return min(found, key=lambda a: (fsum(map(share, a)), len(a), sum(kind == "~" for kind, *_ in a), sorted(a)), default=None)


def trie_pattern(needles: list[str]) -> str:
    """A pattern that at every place of a text gives the longest needle that begins there, as its first group."""
    return f"(?=({_trie(needles)}))"


def _trie(needles: list[str]) -> str:
    """A pattern for the longest of the needles at a place."""

    def make(words: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in words:
            if w:
                by.setdefault(w[0], []).append(w[1:])
        parts = [_quoted(first) + make(rest) for first, rest in sorted(by.items())]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?+" if "" in words else body

    return make(sorted(set(needles)))


def _quoted(sign: str) -> str:
    return sign if re.fullmatch(r"\w", sign, re.A) else f"\\x{{{ord(sign):x}}}"


def _name(atom: Atom, places: dict[str, int]) -> str:
    kind, field, text = atom
    return f"{kind}{places[field]}:{text[::-1] if kind == '$' else text}"


def _placed(atom: Atom, rule: Rule) -> Atom:
    """The atom with the place where the rule's tests look for its text: only at the start ("^"), only at the end ("$"), or anywhere ("~")."""
    kind, field, text = atom
    if kind == "=":
        return atom
    asked = {t.operator.removeprefix("i") for t in rule.tests if t.field == field and t.operator in TEXTUAL and isinstance(t.value, str) and t.value.translate(_FOLD) == text}
    return ("^" if asked == {"startswith"} else "$" if asked == {"endswith"} else "~", field, text)


@dataclass
class RuleIndex:
    """Rules as rows of ``ATOMS`` and ``RULES``; ``left`` are those for the compiler."""

    atoms: list[tuple[str, list[int]]]
    rules: list[tuple]
    fields: list[str]
    #: Fields whose values are atoms, and by place and field the texts looked for.
    equal: list[str]
    needles: dict[tuple[str, str], list[str]]
    #: Fields whose kind of value some test asks for.
    kinds: set[str]
    left: list[Rule]


def index(rules: list[Rule], columns: list[str]) -> RuleIndex:
    """The index of a rule set for a table with these columns. Rules that never match are left out."""
    kept, left, known, share = [], [], _resolved(rules, columns), shares(rules)
    for rule in rules:
        try:
            own = clauses(rule)
        except TooLarge:
            left.append(rule)
            continue
        if frozenset() not in own:
            held = cover(rule, own, columns, known, share)
            kept.append((rule, own, held if held is None else {_placed(a, rule) for a in held}))
    fields = sorted({t.field for r, *_ in kept for t in r.tests if known[t.field] is not None})
    places = {f: i for i, f in enumerate(fields)}
    numbers: dict[str, set[int]] = {}
    rows = []
    for number, (rule, own, held) in enumerate(kept):
        names = [EVERY] if held is None else sorted(_name(a, places) for a in held)
        for name in names:
            numbers.setdefault(name, set()).add(number)
        tests = [_told(t, places, known[t.field]) for t in rule.tests]
        rows.append((number, (rule.id, rule.log_type, names, [n for n in names if n[0] in "~^$"], tests, [[(i, holds) for i, holds in sorted(c)] for c in own])))
    covered = {a for *_, held in kept for a in held or ()}
    needles: dict[tuple[str, str], list[str]] = {}
    for kind, field, text in sorted(covered):
        if kind != "=":
            needles.setdefault((kind, field), []).append(text)
    for (kind, field), texts in needles.items():
        whole = set(texts)
        for long in texts:  # a longer needle found at a place stands for all that it begins with, or ends with at the end
            for n in range(SHORTEST_NEEDLE, len(long)):
                if (short := long[-n:] if kind == "$" else long[:n]) in whole:
                    numbers[_name((kind, field, long), places)] |= numbers[_name((kind, field, short), places)]
    kinds = {t.field for r, *_ in kept for t in r.tests if _needs_kind(t) or _renders(t)}
    return RuleIndex([(a, sorted(n)) for a, n in sorted(numbers.items())], rows, fields, sorted({f for kind, f, _ in covered if kind == "="}), needles, kinds, left)


def _renders(test: Test) -> bool:
    """Whether the test looks at containers as text."""
    if "." not in test.field:
        return False
    return test.operator == "matches" or test.operator in TEXTUAL or (test.operator == "in" and any(v[:1] in ("{", "[") for v in test.value))


def _told(t: Test, places: dict[str, int], found: Field | None) -> tuple:
    """A test as a row: place of the field (-1 for none), operator, and its value by kind."""
    if found is None:
        return (-1, "always" if t.operator == "missing" else "never", None, None, None, None, False, False)
    text = t.value if isinstance(t.value, str) else None
    number = t.value if isinstance(t.value, float) else None
    flag = t.value if isinstance(t.value, bool) else None
    op = t.operator
    if op == "matches":
        text = to_java(t.value)
    elif op in ORDERED:
        op = op if number is not None else "never"
    elif op not in ("==", "!=", "in", "exists", "missing"):
        if text is None:
            op = "never"
        elif op.startswith("i"):
            text = text.translate(_FOLD)
    among = list(t.value) if op == "in" else None
    rendered = op == "in" and any(v[:1] in ("{", "[") for v in among)
    typed = found.kind is not None and text is not None and op in ("==", "!=") and (text in ("true", "false") or text[:1] in ("{", "["))
    return (places[t.field], op, text, number, flag, among, rendered, typed)


def _facts(f: Field, typed: bool) -> Column:
    """What tests may ask of a field."""
    none = lambda kind: F.lit(None).cast(kind)
    kind = f.kind if typed else none("string")
    number = F.coalesce(f.kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False)) if typed else F.lit(False)
    text = f.text if typed or f.kind is None else f.quick
    return F.struct(text.alias("text"), f.quick.alias("quick"), (F.coalesce(kind == "STRING", F.lit(False))).alias("string"), number.alias("numeric"), f.number.alias("number"), (f.flag if f.flag is not None else none("boolean")).alias("flag"), F.lit(f.flag is not None).alias("flagged"))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with columns that are computed here: else the optimizer puts them where they are computed again and again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def with_facts(events: DataFrame, found: RuleIndex) -> DataFrame:
    """``events`` with ``facts`` of each field of the index. A path is looked up once a row."""
    columns = events.columns
    fields = {f: resolve(f, columns) for f in found.fields}
    typed = {f: x.kind is not None and f in found.kinds for f, x in fields.items()}
    names = {f: f"_path{i}" for i, f in enumerate(found.fields) if fields[f].kind is not None}
    if names:
        events = _once(events, *[fields[f].quick.alias(n) for f, n in names.items()], *[fields[f].kind.alias(f"{n}_kind") for f, n in names.items() if typed[f]])
        fields |= {f: resolve(f, columns, F.col(n), F.col(f"{n}_kind") if typed[f] else None) for f, n in names.items()}
    facts = F.array(*[_facts(fields[f], typed[f]) for f in found.fields]) if found.fields else F.array().cast("array<struct<text:string,quick:string,string:boolean,numeric:boolean,number:double,flag:boolean,flagged:boolean>>")
    return _once(events, facts.alias("facts")).drop(*names.values(), *[f"{n}_kind" for n in names.values()])


def dealt(events: DataFrame) -> DataFrame:
    """``events`` dealt out to all cores if they are few bytes: a small file is one task's, but its rows may meet many rules."""
    if events.isStreaming:
        return events
    cores = events.sparkSession.sparkContext.defaultParallelism
    size = int(str(events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return events.repartition(2 * cores, "event_id") if "event_id" in events.columns and size < cores * PART_BYTES else events


def _holds(t: Column, facts: Column) -> Column:
    """Whether a test, as a row, holds for the facts of a row's fields; never null."""
    f = F.get(facts, t["place"])
    present = f["quick"].isNotNull()
    equal = (
        F.when(t["flag"].isNotNull(), F.when(f["flagged"], f["flag"] == t["flag"]).otherwise(f["quick"] == t["flag"].cast("string")))
        .when(t["number"].isNotNull(), f["numeric"] & (f["number"] == t["number"]))
        .when(f["flagged"], F.lit(False))
        .otherwise((f["quick"] == t["text"]) & (~t["typed"] | f["string"]))
    )
    op, low = t["op"], _ascii_lower(f["text"])
    found = (
        F.when(op == "==", equal).when(op == "!=", present & ~F.coalesce(equal, F.lit(False)))
        .when(op == "in", F.array_contains(t["among"], F.when(t["rendered"], f["text"]).otherwise(f["quick"])))
        .when(op == "exists", present).when(op == "missing", ~present)
        .when(op == "contains", F.contains(f["text"], t["text"])).when(op == "startswith", F.startswith(f["text"], t["text"])).when(op == "endswith", F.endswith(f["text"], t["text"]))
        .when(op == "icontains", F.contains(low, t["text"])).when(op == "istartswith", F.startswith(low, t["text"])).when(op == "iendswith", F.endswith(low, t["text"]))
        .when(op == "matches", F.rlike(f["text"], t["text"]))
        .when(op == ">", f["number"] > t["number"]).when(op == ">=", f["number"] >= t["number"]).when(op == "<", f["number"] < t["number"]).when(op == "<=", f["number"] <= t["number"])
        .otherwise(op == "always")
    )
    return F.coalesce(found, F.lit(False))


def candidates(events: DataFrame, found: RuleIndex) -> DataFrame:
    """``events`` with facts, with each rule of the index that may match them, as ``rule``."""
    columns, spark = events.columns, events.sparkSession
    named = lambda kind, field: F.lit(f"{kind}{found.fields.index(field)}:")
    fact = lambda field: F.get("facts", F.lit(found.fields.index(field)))
    atoms = [F.array(F.lit(EVERY)), *[F.array(F.concat(named("=", f), fact(f)["quick"])) for f in found.equal]]

    def met_in(kind: str, field: str, needles: list[str]) -> Column:
        prefix, text = named(kind, field), _ascii_lower(fact(field)["text"])
        if kind != "~":
            text, needles = (text, needles) if kind == "^" else (F.reverse(text), [x[::-1] for x in needles])
            return F.array(F.concat(prefix, F.regexp_extract(text, f"\\A({_trie(needles)})", 1)))
        met = F.regexp_extract_all(text, F.lit(trie_pattern(needles)), F.lit(1))
        return F.transform(F.coalesce(met, F.array().cast("array<string>")), lambda x: F.concat(prefix, x))

    atoms += [met_in(*at, n) for at, n in found.needles.items()]
    rows = _once(events, F.array_distinct(F.concat(*atoms)).alias("atoms"))
    # The tables grow with the rules that someone wrote, not with the events.
    met = rows.select("*", F.explode("atoms").alias("atom")).join(F.broadcast(spark.createDataFrame(found.atoms, ATOMS)), "atom")
    met = met.select("*", F.explode("numbers").alias("number")).drop("numbers").join(F.broadcast(spark.createDataFrame(found.rules, RULES)), "number")
    own = F.col("rule.log_type").isNull() | F.coalesce(F.col("log_type") == F.col("rule.log_type"), F.lit(False)) if "log_type" in columns else F.lit(True)
    # Of a rule's atoms that the row has, the first decides; a longer needle counts for the shorter ones in it.
    earlier = F.slice("atoms", F.lit(1), F.array_position("atoms", F.col("atom")).cast("int") - 1)
    told = F.exists(earlier, lambda a: F.array_contains("rule.atoms", a) | F.exists("rule.needles", lambda b: F.startswith(a, b)))
    return met.where(own & ~F.coalesce(told, F.lit(False))).drop("atoms", "atom", "number")


def evaluate_index(events: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Rule]]:
    """(``events`` with ``rule_id`` for every match, rules left to the compiler)."""
    found = index(rules, events.columns)
    if not found.rules:
        return events.select("*", F.lit("").alias("rule_id")).where("false"), found.left
    events = with_variants(dealt(events), {f.split(".", 1)[0] for f in found.kinds})
    met = candidates(with_facts(events, found), found)
    met = _once(met, F.transform(F.col("rule.tests"), lambda t: _holds(t, F.col("facts"))).alias("held"))
    matched = F.forall(F.col("rule.clauses"), lambda c: F.exists(c, lambda x: F.get(F.col("held"), x["test"]) == x["holds"]))
    return met.where(matched).withColumn("rule_id", F.col("rule.rule_id")).drop("rule", "facts", "held"), found.left
