"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model.

The tokens are Unicode code points of any script (decimal digits of ASCII are one), the order is five. All
trusted text that isn't held out or kept for calibration is counted: each task adds up the n-grams of what
it reads, and the counts meet in shards by n-gram. Continuation counts are counts of the distinct n-grams
one order up; each order's probabilities come from joins in shards, with the sums of its contexts and with
the order below. The model holds every n-gram of the trusted text, so it grows with the corpus.

Documents are scored against the model by their distinct n-grams. While the finished model is at most
``SHIPPED_BYTES`` it is shipped to the tasks as a hash table. Beyond that texts are gathered in batches of
bounded size, the distinct n-grams of each batch are joined to the model in shards, backing off order by
order, and the answers meet their batch again. A document is kept when its perplexity is within the
quantile of the calibration documents of its language.

An n-gram is two longs of up to three code points each, aligned to the right; 0 is a text's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.shared import fold, held_out, materialize, save_bucketed, small_batches, table

ORDER = 5
_BITS = 21
_ONE, _TWO = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1
#: Largest model (16 bytes for each n-gram or context) that is shipped to the tasks.
SHIPPED_BYTES = 32 << 20
#: Characters of a batch whose distinct n-grams are joined to a larger model, and n-grams summed up in a task at once.
BATCH_CHARS = 16_000_000
TASK_GRAMS = 2_000_000
#: Trusted ids are broadcast up to this many (16 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Of the five folds by id, 0 is held out and this one sets the thresholds.
CALIBRATION = 1
LEAST_TRUSTED = 30
BROADCAST_LANGUAGES = 10_000
GRAM = ["a", "b"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half) of the n-gram that ends at each character, and where each text starts and ends."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.concatenate(raw).astype(np.int64) + 1 if len(raw) else np.zeros(0, np.int64)
    flat[(flat > 48) & (flat <= 58)] = 49
    symbol = np.zeros(len(flat) + (ORDER - 1) * len(raw), np.int64)
    body = np.arange(len(flat)) + np.repeat(np.arange(1, len(raw) + 1) * (ORDER - 1), sizes)
    symbol[body] = flat
    half = symbol.copy()
    half[1:] |= symbol[:-1] << _BITS
    half[2:] |= symbol[:-2] << 2 * _BITS
    return half[body - 3] & _TWO, half[body], np.concatenate(([0], np.cumsum(sizes)))


def _shorter(a, b, order: int):
    """The n-gram of ``order`` without its first symbol; for arrays and for columns."""
    band = lambda x, mask: x.bitwiseAND(F.lit(mask)) if hasattr(x, "bitwiseAND") else x & mask
    if order > 3:
        return band(a, {5: _ONE, 4: 0}[order]), b
    return a, band(b, {3: _TWO, 2: _ONE, 1: 0}[order])


def _context(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram without its last symbol."""
    return a >> _BITS, b >> _BITS | (a & _ONE) << 2 * _BITS


def _context_columns() -> list[F.Column]:
    a, b = F.col("a"), F.col("b")
    return [F.shiftright(a, _BITS).alias("ca"), F.shiftright(b, _BITS).bitwiseOR(F.shiftleft(a.bitwiseAND(F.lit(_ONE)), 2 * _BITS)).alias("cb")]


def _key(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """64 bits, never 0, that name an n-gram of an order."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + b.astype(np.uint64)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31) | np.uint64(1)


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """(a, b, n): counts of all n-grams of the trusted texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def fold_in(last: bool) -> Iterator[pd.DataFrame]:
            a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, inverse = np.unique(_key(a, b, ORDER), return_index=True, return_inverse=True)
            held[:] = [(a[first], b[first], np.bincount(inverse, n).astype(np.int64))]
            if last or len(first) > TASK_GRAMS:
                yield pd.DataFrame(dict(zip(("a", "b", "n"), held.pop(), strict=True)))

        for part in batches:
            a, b, _ = grams(part.text.tolist())
            held.append((a, b, np.ones(len(a), np.int64)))
            yield from fold_in(False)
        if held:
            yield from fold_in(True)

    return trusted.select("text").mapInPandas(run, "a long, b long, n long").groupBy(*GRAM).agg(F.sum("n").alias("n"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified discounts for counts 1, 2 and 3 or more."""
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, low), high) for x, low, high in zip(d, (0.05, 0.05, 0.05), (0.95, 1.9, 2.9), strict=True)]


@dataclass
class Model:
    """By order: log probabilities (a, b, v) of the n-grams, and log weights (a, b, v) of what a context leaves to the order below."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    unknown: float
    rows: int


def train(trusted: DataFrame) -> Model | None:
    """The model, or None without any trusted text."""
    small_batches(trusted.sparkSession)
    counts = [materialize(ngram_counts(trusted), "ngrams")]
    for order in range(ORDER, 1, -1):
        a, b = _shorter(F.col("a"), F.col("b"), order)
        counts.append(materialize(counts[-1].select(a.alias("a"), b.alias("b")).groupBy(*GRAM).agg(F.count("*").alias("n")), "ngrams"))
    model = Model([], [], 0.0, 0)
    for order, now in enumerate(reversed(counts), 1):
        found = now.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)], F.sum("n"), F.count("*")).first()
        if not found[5]:
            return None
        d = _discounts(*found[:4])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = now.select(*GRAM, F.col("n").cast("double").alias("n"), cut.alias("d"), *_context_columns())
        if order == 1:
            left = rows.agg(F.sum("d")).first()[0] / found[4]
            base = left / (found[5] + 1)
            model.unknown = float(np.log(base))
            p = rows.select(*GRAM, F.log((F.col("n") - F.col("d")) / F.lit(float(found[4])) + F.lit(base)).alias("v"))
        else:
            sums = rows.groupBy("ca", "cb").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"))
            sums = materialize(sums, "contexts")
            a, b = _shorter(F.col("a"), F.col("b"), order)
            lower = model.grams[-1].select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.exp("v").alias("below"))
            met = rows.join(sums, ["ca", "cb"]).withColumns({"sa": a, "sb": b}).join(lower, ["sa", "sb"])
            p = met.select(*GRAM, F.log((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")).alias("v"))
            model.contexts.append(sums.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.log("left").alias("v")))
            model.rows += sums.count()
        model.grams.append(materialize(p, "probabilities"))
        model.rows += found[5]
    return model


class Lookup:
    """A hash table of 64-bit keys in two arrays; many keys are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.float32)
        at = keys & self.mask
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, at = keys[rest], values[rest], at[rest] + np.uint64(1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN where a key isn't there."""
        out, left, at = np.full(len(keys), np.nan, np.float32), np.arange(len(keys)), keys & self.mask
        while len(left):
            held = self.keys[at]
            hit = held == keys
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held != 0)
            left, keys, at = left[go], keys[go], at[go] + np.uint64(1) & self.mask
        return out


class Shipped:
    """The model as arrays; a task makes its hash tables when it first needs them."""

    def __init__(self, model: Model):
        def held(tables: list[DataFrame], first: int) -> tuple[np.ndarray, np.ndarray]:
            keys, values = [], []
            for order, t in enumerate(tables, first):
                part = t.select(*GRAM, F.col("v").cast("float").alias("v")).toArrow()
                keys.append(_key(part["a"].to_numpy(), part["b"].to_numpy(), order))
                values.append(part["v"].to_numpy())
            return np.concatenate(keys), np.concatenate(values)

        self.parts, self.unknown = (held(model.grams, 1), held(model.contexts, 2)), model.unknown
        self.tables: list[Lookup] = []

    def log_probabilities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.tables:
            self.tables = [Lookup(*p) for p in self.parts]
        found_in, weights = self.tables
        out, left = np.zeros(len(a)), np.arange(len(a))
        for order in range(ORDER, 0, -1):
            v = found_in.get(_key(a, b, order))
            found = ~np.isnan(v)
            out[left[found]] += v[found]
            left, a, b = left[~found], a[~found], b[~found]
            if not len(left):
                return out
            if order > 1:
                out[left] += np.nan_to_num(weights.get(_key(*_context(a, b), order)))
                a, b = _shorter(a, b, order)
        out[left] += self.unknown
        return out


def _sums(logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums, has = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds))
    if len(has):
        sums[has] = np.add.reduceat(logs, bounds[has])
    return sums


def _scored_by_shipping(rows: DataFrame, model: Model | None) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(Shipped(model) if model else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            a, b, bounds = grams(part.text.tolist())
            logs = shipped.value.log_probabilities(a, b) if shipped.value else np.full(len(a), -np.log(0x110000))
            yield pd.DataFrame({"doc_id": part.doc_id, "lang": part.lang, "n_symbols": np.diff(bounds), "log_sum": _sums(logs, bounds)})

    return rows.mapInPandas(run, "doc_id long, lang string, n_symbols long, log_sum double")


def gram_scores(wanted: DataFrame, model: Model) -> DataFrame:
    """(a, b, v): the log probability of each distinct n-gram, by joins that back off order by order."""
    now = wanted.select(*GRAM, F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0.0).alias("v"))
    done = []
    for order in range(ORDER, 0, -1):
        own = model.grams[order - 1].select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("v").alias("own"))
        met = materialize(now.join(own, ["x", "y"], "left"), "backoff")
        done.append(met.where("own is not null").select(*GRAM, (F.col("v") + F.col("own")).alias("v")))
        now = met.where("own is null").drop("own")
        if order > 1:
            left = model.contexts[order - 2].select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("v").alias("left"))
            ca, cb = F.shiftright("x", _BITS), F.shiftright("y", _BITS).bitwiseOR(F.shiftleft(F.col("x").bitwiseAND(F.lit(_ONE)), 2 * _BITS))
            now = now.withColumns({"ca": ca, "cb": cb}).join(left, ["ca", "cb"], "left")
            x, y = _shorter(F.col("x"), F.col("y"), order)
            now = now.select(*GRAM, x.alias("x"), y.alias("y"), (F.col("v") + F.coalesce("left", F.lit(0.0))).alias("v"))
    out = now.select(*GRAM, (F.col("v") + F.lit(model.unknown)).alias("v"))
    for d in done:
        out = out.unionByName(d)
    return out


def _scored_by_joins(rows: DataFrame, model: Model) -> DataFrame:
    """Equal texts are scored once; a batch's texts lie together on disk, so only n-grams are shuffled."""
    spark = rows.sparkSession
    keyed = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    facts = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    batches = max(1, -(-facts // BATCH_CHARS))
    contents = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).withColumn("batch", F.pmod(F.col("k1"), F.lit(batches)))
    contents = save_bucketed(contents, "batch")

    def distinct(part: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = grams(part.text.tolist())
        first = np.unique(_key(a, b, ORDER), return_index=True)[1]
        return pd.DataFrame({"batch": part.batch.iloc[0], "a": a[first], "b": b[first]})

    asked = materialize(contents.select("batch", "text").groupBy("batch").applyInPandas(distinct, "batch long, a long, b long"), "asked")
    answers = asked.join(materialize(gram_scores(asked.select(*GRAM).distinct(), model), "answers"), GRAM)

    def score(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        a, b, bounds = grams(texts.text.tolist())
        key = _key(found.a.to_numpy(), found.b.to_numpy(), ORDER)
        order = np.argsort(key)
        logs = found.v.to_numpy()[order][np.searchsorted(key[order], _key(a, b, ORDER))] if len(a) else np.zeros(0)
        return pd.DataFrame({"k1": texts.k1, "k2": texts.k2, "n_symbols": np.diff(bounds), "log_sum": _sums(logs, bounds)})

    scored = contents.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, "k1 long, k2 long, n_symbols long, log_sum double")
    return keyed.drop("text").join(materialize(scored, "scored"), ["k1", "k2"]).select("doc_id", "lang", "n_symbols", "log_sum")


def perplexities(docs: DataFrame, model: Model | None, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity) of every row; without a model all code points are equally likely."""
    small_batches(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    scored = _scored_by_shipping(rows, model) if model is None or 16 * model.rows <= shipped_bytes else _scored_by_joins(rows, model)
    return scored.select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(-F.col("log_sum") / F.col("n_symbols"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, kept) of every row.

    Trusted are documents labelled quality 1 that are not held out. A fold of them (by the id's checksum)
    isn't counted but sets the thresholds, as texts that were counted look better than they are. The
    threshold of a language is that quantile of its calibration documents' perplexities, or of all
    calibration documents' where the language is null or has fewer than ``LEAST_TRUSTED`` (of all trusted
    ones where the fold is empty). A perplexity at the threshold is kept. An empty or null text has no
    perplexity and isn't kept; without trusted text there is no threshold and all other texts are kept. Rows
    may repeat, doc_id may be null, other columns are ignored.
    """
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out(F.col("doc_id"))).distinct()
    ids = materialize(ids.withColumn("counted", fold(F.col("doc_id")) != CALIBRATION), "trusted")
    if not ids.where("not counted").limit(1).count():
        ids = ids.withColumn("calibrates", F.lit(True))
    else:
        ids = ids.withColumn("calibrates", ~F.col("counted"))
    small = ids.count() <= BROADCAST_IDS
    counted = ids.where("counted").select("doc_id")
    trusted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(counted) if small else counted, "doc_id", "left_semi")
    rows = materialize(perplexities(docs, train(trusted), shipped_bytes), "perplexities")
    good = rows.where("perplexity is not null").join(ids.where("calibrates"), "doc_id", "left_semi")
    own = good.where("lang is not null").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED).drop("n")
    own = materialize(own, "quantiles")
    own = F.broadcast(own) if own.count() <= BROADCAST_LANGUAGES else own  # one language may hold most rows
    every = good.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    met = rows.join(own, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(every).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return met.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"))


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
