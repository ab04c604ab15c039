"""Exact removal of long repeated byte strings by a distributed, sparse suffix array.

A byte goes if a ``length``-byte string that covers it also starts anywhere else. Each such string (a
*window*) is named by the leftmost of its smallest-hashed k-grams, so equal windows always name equal
k-grams, and neighbouring windows mostly name the same one: only the suffixes at those positions, one
in some seventy, need sorting. A *run* is a stretch of windows that name the same position.

1. Texts that are equal as a whole are folded into one row with a count (``contents``), bucketed by key.
2. The suffix of every run is range-partitioned by its leading tokens (hash of its k-gram, hash of all
   bytes the run's windows cover, place) with sampled splitters. As the place belongs to the key, a
   common string fills many buckets rather than one. Buckets sort locally by multikey quicksort and
   compare neighbours; the outermost rows of neighbouring buckets are compared across boundaries.
3. Runs that equal another in all their bytes are settled. Runs that share the k-gram only are settled
   window by window among the runs of that k-gram; k-grams with more than ``group_limit`` such runs
   have their windows sorted by step 2 again instead, so no group is held in one task.
4. Settled windows are joined back to their contents, united, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.llm.shared import materialize, save_bucketed, small_batches, table

LENGTH = 200
GRAM = 48
KEY = ["k1", "k2"]
SUFFIX = "h long, s long, k1 long, k2 long, pos long"
_PLACE = np.uint64((1 << 30) - 1)
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_SEGMENT = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up[:n], cls.down[:n]


def _named(flat: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``flat`` the position of the k-gram that names it."""
    n, width = len(flat), length - gram + 1
    up, down = _Powers.get(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    value = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value = value & ~_PLACE | np.arange(len(value), dtype=np.uint64)
    blocks = -(-len(value) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(value)] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(value) - width + 1
    return (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int64)


def runs(data: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(index in ``data``, first window, windows, position of the k-gram) of every run."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(data), np.uint8)
    if not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = _named(flat, length, gram)
    many = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(data)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + starts[owner]
    at = at[place]
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    owner = owner[first]
    return owner, place[first] - starts[owner], np.diff(first, append=len(at)), at[first] - starts[owner]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def suffixes(contents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(h, s, k1, k2, pos) of each run: k-gram hash, hash of all covered bytes, content, and place.

    ``pos`` holds first window, windows and whether the content occurs once. Texts are processed in
    segments that overlap by a window, so memory doesn't grow with the longest text.
    """

    def segments(part: pd.DataFrame) -> Iterator[tuple[int, int, bytes]]:
        for i, text in enumerate(part.text):
            for at in range(0, max(1, len(text) - length + 1), _CHUNK):
                yield i, at, text[at : at + _CHUNK + length - 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for part in batches:
            k1, k2, once = part.k1.to_numpy(), part.k2.to_numpy(), (part.copies == 1).to_numpy().astype(np.int64)
            held: list[tuple[int, int, bytes]] = []
            size = 0

            def flush() -> pd.DataFrame:
                data = [x for _, _, x in held]
                owner, low, many, at = runs(data, length, gram)
                row = np.array([i for i, _, _ in held], np.int64)[owner]
                shift = np.array([s for _, s, _ in held], np.int64)[owner]
                whole = list(zip(owner.tolist(), low.tolist(), many.tolist(), at.tolist(), strict=True))
                h = _signed([digest(data[o][a : a + gram]) for o, _, _, a in whole])
                # The seed tells where the run lies around its k-gram.
                s = _signed([digest(data[o][p : p + m + length - 1], (a - p) << 20 | m) for o, p, m, a in whole])
                return pd.DataFrame({"h": h, "s": s, "k1": k1[row], "k2": k2[row], "pos": (low + shift) << 9 | many << 1 | once[row]})

            for piece in segments(part):
                held.append(piece)
                size += len(piece[2])
                if size >= _SEGMENT:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    return contents.select(*KEY, "copies", F.col("text").cast("binary").alias("text")).mapInPandas(run, SUFFIX)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Sort by several keys, looking at a further key only where all before it are equal."""
    order = np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)  # differs from the row before in the keys so far
    new[:1] = True
    for before, column in zip(columns, columns[1:], strict=False):
        new[1:] |= before[order][1:] != before[order][:-1]
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        order[at] = order[at][np.lexsort((column[order[at]], np.cumsum(new)[at]))]
    return order


def _compare(h: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
    """What a sorted bucket's rows share with their neighbours."""
    n = len(h)
    near_h = h[1:] == h[:-1]
    near_s = near_h & (s[1:] == s[:-1])
    same_h, same_s = np.zeros(n, bool), np.zeros(n, bool)
    for near, same in ((near_h, same_h), (near_s, same_s)):
        same[1:] |= near
        same[:-1] |= near
    group = np.cumsum(np.concatenate(([True], ~near_h))) - 1
    first = np.concatenate(([True], ~near_s))
    mixed = (np.bincount(group, weights=first) > 1)[group]
    edge = (group == 0) | (group == group[-1])
    return {"same_h": same_h, "same_s": same_s, "first": first, "mixed": mixed, "edge": edge}


def compare_sorted(rows: DataFrame, bucket_rows: int = 200_000) -> DataFrame:
    """``rows`` that share ``h`` with another, and ``same_s``: whether ``s`` too; ``rep``: first of equal ones
    in a group that holds others as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        part = pd.concat(parts, ignore_index=True)
        parts.clear()
        part = part.iloc[multikey_order([part[c].to_numpy() for c in ("h", "s", "k1", "k2", "pos")])]
        found = _compare(part.h.to_numpy(), part.s.to_numpy())
        part = part.assign(**found, bucket=TaskContext.get().partitionId())
        yield part[found["same_h"] | found["edge"]]

    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // bucket_rows)), "h", "s", "k1", "k2", "pos")
    near = materialize(ranged.mapInPandas(run, f"{SUFFIX}, same_h boolean, same_s boolean, first boolean, mixed boolean, edge boolean, bucket int"), "buckets")
    # Where the last suffix of one bucket and the first of the next begin alike: at most a row a bucket,
    # so one for every ``bucket_rows`` suffixes, which bounds what is broadcast.
    ends = near.where("edge").groupBy("bucket").agg(F.min(F.struct("h", "s")).alias("low"), F.max(F.struct("h", "s")).alias("high"))
    met = ends.select("low", F.lag("high").over(Window.orderBy("bucket")).alias("before")).where(F.col("low.h") == F.col("before.h"))
    met = materialize(met.select(F.col("low.h").alias("h"), F.when(F.col("low.s") == F.col("before.s"), F.col("low.s")).alias("s")), "boundaries")
    over_h = met.select("h").distinct().withColumn("over_h", F.lit(True))
    over_s = met.where("s is not null").distinct().withColumn("over_s", F.lit(True))
    every = near.join(F.broadcast(over_h), "h", "left").join(F.broadcast(over_s), ["h", "s"], "left").select(
        "h", "s", "k1", "k2", "pos", (F.col("same_h") | F.coalesce("over_h", F.lit(False))).alias("same_h"),
        (F.col("same_s") | F.coalesce("over_s", F.lit(False))).alias("same_s"), "first", (F.col("mixed") | F.coalesce("over_h", F.lit(False))).alias("mixed"),
    ).where("same_h")
    return every.select("h", "s", "k1", "k2", "pos", "same_s", (F.col("first") & F.col("same_s") & F.col("mixed")).alias("rep"))


def _place(pos: str = "pos") -> list[F.Column]:
    return [F.shiftright(pos, 9).alias("low"), F.shiftright(pos, 1).bitwiseAND(F.lit(255)).alias("many"), (F.col(pos) % 2 == 1).alias("once")]


def _windows(batch: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window in the run, hash) of every window of the runs in ``batch``."""
    digest = xxhash.xxh3_64_intdigest
    many = batch.many.to_numpy()
    row = np.repeat(np.arange(len(batch)), many)
    shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return row, shift, _signed([digest(c[i : i + length]) for c, m in zip(batch.bytes, many.tolist(), strict=True) for i in range(m)])


def _among_group(length: int):
    """Windows that occur twice among the runs of one k-gram; the rows arrive ordered by ``h``."""

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        row, shift, value = _windows(part, length)
        h = part.h.to_numpy()[row]
        order = np.lexsort((value, h))
        near = (h[order][1:] == h[order][:-1]) & (value[order][1:] == value[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:]] |= near
        twice[order[:-1]] |= near
        twice &= part.once.to_numpy()[row]
        row, shift = row[twice], shift[twice]
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shift, prepend=-9) != 1))
        owner = row[start]
        return pd.DataFrame({"k1": part.k1.to_numpy()[owner], "k2": part.k2.to_numpy()[owner], "low": part.low.to_numpy()[owner] + shift[start], "many": np.diff(start, append=len(row))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for part in batches:
            if not len(part):
                continue
            last = part.h.to_numpy() == part.h.iloc[-1]
            if not last.all() or (kept and kept[-1].h.iloc[-1] != part.h.iloc[-1]):
                yield settle(pd.concat([*kept, part[~last]], ignore_index=True))
                kept = []
            kept.append(part[last])
        if kept:
            yield settle(pd.concat(kept, ignore_index=True))

    return run


def _explode_windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                part = whole.iloc[at : at + 2000].reset_index(drop=True)
                row, shift, value = _windows(part, length)
                low = part.low.to_numpy()[row] + shift
                yield pd.DataFrame({"h": part.h.to_numpy()[row], "s": value, "k1": part.k1.to_numpy()[row], "k2": part.k2.to_numpy()[row], "pos": low << 9 | 2 | part.once.to_numpy()[row]})

    return run


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for k1, k2, text, low, many in zip(part.k1, part.k2, part.text, part.low, part.many, strict=True):
                low, high = np.asarray(low, np.int64), np.asarray(low, np.int64) + np.asarray(many, np.int64) + length - 1
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.concatenate(([True], low[1:] > high[:-1]))
                starts, stops = low[new].tolist(), high[np.concatenate((new[1:], [True]))].tolist()
                left = b"".join([text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True)])
                rows.append((k1, k2, len(text) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _key(text: F.Column) -> list[F.Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, group_limit: int = 20_000, bucket_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(contents, cut): folded texts of at least ``length`` bytes, and what is cut from those that occur once.

    contents: k1, k2, copies; all windows of contents with more copies than one repeat. cut: k1, k2,
    n_removed, n_spans, kept_sha256, kept (the text left over if asked for; a character that a cut
    runs through is dropped).
    """
    spark = docs.sparkSession
    if not gram <= length < gram + 255:
        raise ValueError("length must be at least gram and less than gram + 255: a run holds up to length - gram + 1 windows in 8 bits")
    small_batches(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    folded = docs.select(text.alias("text")).where(F.octet_length("text") >= length).select(*_key(F.col("text")), "text").groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    contents = save_bucketed(folded, *KEY)

    near = materialize(compare_sorted(materialize(suffixes(contents, length, gram), "suffixes"), bucket_rows), "near")
    open_runs = near.where("rep or not same_s").select("h", *KEY, *_place())
    hot = open_runs.groupBy("h").count().where(F.col("count") > group_limit).select("h")
    wanted = open_runs.groupBy(*KEY).agg(F.collect_list(F.struct("h", "low", "many", "once")).alias("runs"))
    binary = F.col("text").cast("binary")
    slices = F.transform("runs", lambda r: F.struct(r.h.alias("h"), r.low.alias("low"), r.many.alias("many"), r.once.alias("once"), F.substring(binary, (r.low + 1).cast("int"), (r.many + length - 1).cast("int")).alias("bytes")))
    pieces = contents.join(wanted, KEY).select(*KEY, slices.alias("runs")).select(*KEY, F.explode("runs").alias("r")).select(*KEY, "r.*")
    pieces = materialize(pieces, "open")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = pieces.join(hot, "h", "left_anti").repartition(parts, "h").sortWithinPartitions("h").mapInPandas(_among_group(length), "k1 long, k2 long, low long, many long")
    found = near.where("same_s").select(*KEY, *_place()).where("once").drop("once").unionByName(cold)
    if hot.limit(1).count():
        single = materialize(pieces.join(hot, "h", "left_semi").mapInPandas(_explode_windows(length), SUFFIX), "windows")
        found = found.unionByName(compare_sorted(single, bucket_rows).where("same_s").select(*KEY, *_place()).where("once").drop("once"))
    gathered = found.groupBy(*KEY).agg(F.collect_list("low").alias("low"), F.collect_list("many").alias("many"))
    cut = contents.join(gathered, KEY).select(*KEY, binary.alias("text"), "low", "many").mapInPandas(_cut(length, with_text), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return contents.select(*KEY, "copies"), cut


def removed_bytes(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null text is an empty one; texts shorter than ``length`` lose nothing; a text that occurs twice
    or more loses all if it is long enough; rows may repeat and doc_id may be null; other columns are
    ignored; an empty table gives no rows.
    """
    contents, cut = repeats(docs, length, **options)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_key(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    facts = cut.drop("kept").unionByName(contents.where("copies > 1").select(*KEY, F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256")))
    met = rows.join(facts, KEY, "left")
    gone = F.when(F.col("n_spans").isNotNull(), F.coalesce("n_removed", "n_bytes")).otherwise(F.lit(0)).cast("long")
    return met.select("doc_id", "n_bytes", gone.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(table(spark, sf_dir, "documents"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their repeated strings; documents with no word left because of it go.

    ``n_chars``, where there is one, is counted anew; every other column stays.
    """
    contents, cut = repeats(docs, with_text=True)
    facts = cut.select(*KEY, "kept").unionByName(contents.where("copies > 1").select(*KEY, F.lit("").alias("kept")))
    text = F.coalesce(docs["text"], F.lit(""))
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    met = docs.select(*_key(text), *[docs[c].alias(inner[c]) for c in docs.columns]).join(facts, KEY, "left")
    met = met.where("kept is null or kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = F.coalesce("kept", inner["text"])
    out = {c: F.col(inner[c]) for c in docs.columns} | {"text": new}
    if "n_chars" in inner:
        out["n_chars"] = F.when(F.col("kept").isNull(), F.col(inner["n_chars"])).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return met.select(*[out[c].alias(c) for c in docs.columns])
