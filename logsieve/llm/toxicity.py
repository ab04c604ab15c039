"""Toxicity by a linear-chain conditional random field.

Training takes a bounded, documented sample of labelled documents (``PER_CLASS`` of either class, each
of at most ``LONGEST`` characters, near copies left out). Words that occur in far more toxic documents
than clean ones are labelled toxic tokens there, everything else is labelled clean; a two-state chain
with word, affix, shape and neighbour features is fitted to whole texts by its exact gradient. Scoring
runs forward-backward over each whole text, many texts at once: stretches of ``STRETCH`` tokens become
2x2 products whose messages are handed on from stretch to stretch, so the stretches leave no trace in the
result. The marginals give the offending offsets, and their greatest value, sum and mean give the
document's score through a logistic model fitted on the same sample with the classes' true weights.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.shared import WORD, held_out, small_batches, table

PER_CLASS = 1500
LONGEST = 20_000
#: Tokens that are worked through one after the other, all stretches of all texts at once.
STRETCH = 64
#: Lengths of the beginnings that count as features, and buckets that each is hashed into.
PREFIXES = (4, 5, 6)
AFFIXES = 8192
#: Marginals below this add nothing to a document's sum and share.
FAINT = 0.2
#: Tokens whose part of the gradient is held at once.
BLOCK_TOKENS = 1 << 17
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_CACHE_WORDS = 150_000


def tokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens in lower case, index of each token, first token of each text and the end)."""
    lists = pc.ascii_split_whitespace(pa.array([" ".join(t.lower().split(" ")).strip(" \t\n\r\x0b\x0c") for t in texts], pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if "" in words:  # a text without words gives one empty token
        keep = index != words.index("")
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        index = index[keep]
    return words, index, bounds


def core(token: str) -> str:
    """The token without leading and trailing signs and digits; the token itself if nothing is left."""
    return token if token.isalpha() else _EDGES.sub("", token) or token


@dataclass
class Crf:
    """Weights are differences toxic minus clean; ``moves[i][j]`` is the factor of state j after i (1: toxic)."""

    own: dict[str, float] = field(default_factory=dict)
    left: dict[str, float] = field(default_factory=dict)
    right: dict[str, float] = field(default_factory=dict)
    other: tuple[float, float, float] = (0.0, 0.0, 0.0)
    outside: tuple[float, float] = (0.0, 0.0)
    affix: np.ndarray = field(default_factory=lambda: np.zeros((len(PREFIXES) + 1) * AFFIXES))
    shape: np.ndarray = field(default_factory=lambda: np.zeros(16))
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0, 0.0]))
    known: dict[str, tuple[float, float, float]] = field(default_factory=dict, repr=False)

    def _word(self, token: str) -> tuple[float, float, float]:
        word = core(token)
        own = self.own.get(word, self.other[0]) + self.affix[affixes(word)].sum() + self.shape[shape(token, word)]
        return own, self.left.get(word, self.other[1]), self.right.get(word, self.other[2])

    def factors(self, words: list[str], index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log factor of the toxic state at every token."""
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        known.update((w, self._word(w)) for w in words if w not in known)
        own, left, right = np.array([known[w] for w in words]).reshape(-1, 3).T
        out = own[index]
        has = np.flatnonzero(np.diff(bounds))
        first, last = bounds[has], bounds[has + 1] - 1
        before, after = np.full(len(index), self.outside[0]), np.full(len(index), self.outside[1])
        before[1:], after[:-1] = left[index[:-1]], right[index[1:]]
        before[first], after[last] = self.outside
        return np.clip(out + before + after, -25, 25)

    def marginals(self, words: list[str], index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return chain(self.factors(words, index, bounds), bounds, self.moves)[0]

    def documents(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x = summary(p, bounds)
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def affixes(word: str) -> list[int]:
    """Buckets of the word's beginnings, each length in a range of its own, and of its last three letters."""
    parts = [word[:k] for k in PREFIXES] + [word[-3:]]
    return [n * AFFIXES + zlib.crc32(x.encode()) % AFFIXES for n, x in enumerate(parts)]


def shape(token: str, word: str) -> int:
    return min(len(word), 15) // 2 * 2 + (token != word)


def stretches(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, stretches of the text before it) of every stretch; none crosses a text's end."""
    sizes = np.diff(bounds)
    many = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = bounds[owner] + nth * STRETCH
    return first, np.minimum(STRETCH, bounds[owner + 1] - first), nth


def _messages(weight: np.ndarray, valid: np.ndarray, nth: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds that come into every stretch from the one before it, and from the one after it (1 at a text's end)."""
    ahead, behind = np.ones(len(nth)), np.ones(len(nth))
    long = np.flatnonzero((nth > 0) | (np.append(nth[1:], 0) > 0))  # stretches of texts that have several
    if not len(long):
        return ahead, behind
    (oo, ot), (to, tt) = moves
    w, ok, n = weight[:, long], valid[:, long], nth[long]
    # The product of all steps of a stretch; the first step of a text has no move before it.
    start = n == 0
    p = np.where(start, 1.0, oo), np.where(start, 0.0, ot * w[0]), np.where(start, 0.0, to), np.where(start, w[0], tt * w[0])
    for t in range(1, STRETCH):
        a, b, c, d = p
        g = w[t]
        q = a * oo + b * to, (a * ot + b * tt) * g, c * oo + d * to, (c * ot + d * tt) * g
        size = q[0] + q[1] + q[2] + q[3]
        p = tuple(np.where(ok[t], x / size, y) for x, y in zip(q, p, strict=True))
    a, b, c, d = p
    order = np.argsort(n, kind="stable")
    ends = np.searchsorted(n[order], np.arange(n.max() + 2))
    last = np.append(n[1:], 0) == 0
    into, back = np.ones(len(long)), np.ones(len(long))
    for k in range(n.max()):
        i = order[ends[k] : ends[k + 1]]
        i = i[~last[i]]
        into[i + 1] = (b[i] + into[i] * d[i]) / (a[i] + into[i] * c[i])
    for k in range(n.max(), 0, -1):
        i = order[ends[k] : ends[k + 1]]
        back[i - 1] = (c[i] + d[i] * back[i]) / (a[i] + b[i] * back[i])
    ahead[long], behind[long] = into, back
    return ahead, behind


def chain(factor: np.ndarray, bounds: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(toxic) of each token, and expected moves if asked for."""
    first, size, nth = stretches(bounds)
    p, expected = np.zeros(len(factor)), np.zeros((2, 2))
    if not len(first):
        return p, expected
    at = np.minimum(first + np.arange(STRETCH)[:, None], len(factor) - 1)
    valid = np.arange(STRETCH)[:, None] < size
    weight = np.exp(factor)[at]
    (oo, ot), (to, tt) = moves
    into, back = _messages(weight, valid, nth, moves)
    ahead, behind = np.empty_like(weight), np.empty_like(weight)
    inner = nth > 0
    ahead[0] = weight[0] * np.where(inner, (into * tt + ot) / (into * to + oo), 1.0)
    for t in range(1, STRETCH):
        ahead[t] = weight[t] * (ahead[t - 1] * tt + ot) / (ahead[t - 1] * to + oo)
    behind[-1] = back
    for t in range(STRETCH - 2, -1, -1):
        g = weight[t + 1] * behind[t + 1]
        behind[t] = np.where(valid[t + 1], (tt * g + to) / (ot * g + oo), back)
    odds = ahead * behind
    p[at[valid]] = (odds / (1 + odds))[valid]
    if pairs:
        g, before = weight * behind, np.concatenate((into[None, :], ahead[:-1]))
        each = np.stack([np.full_like(g, oo), ot * g, before * to, before * tt * g])
        valid = valid.copy()
        valid[0] &= inner
        expected = ((each / each.sum(axis=0)) * valid).sum(axis=(1, 2)).reshape(2, 2)
    return p, expected


def summary(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(1, greatest, log of 1 + sum, share) of the marginals of each text; a text without words has 1, 0, 0, 0.

    Sum and share leave out marginals below ``FAINT``, which would add up in long texts.
    """
    out = np.zeros((len(bounds) - 1, 4))
    out[:, 0] = 1
    has = np.flatnonzero(np.diff(bounds))
    if len(has):
        total = np.add.reduceat(np.where(p >= FAINT, p, 0.0), bounds[has])
        out[has, 1] = np.maximum.reduceat(p, bounds[has])
        out[has, 2] = np.log1p(total)
        out[has, 3] = total / np.diff(bounds)[has]
    return out


def _without_copies(texts: list[str]) -> list[int]:
    """Indices of texts that share none of three minima of hashed 4-word shingles with an earlier one."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, text in enumerate(texts):
        words = text.split()
        hashes = np.array([zlib.crc32(" ".join(words[k : k + 4]).encode()) for k in range(max(1, len(words) - 3))], np.uint64)
        marks = {(k, int((hashes * np.uint64(odd) % np.uint64(2**32)).min())) for k, odd in enumerate((2654435761, 40503 * 2 + 1, 2246822519))}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def _toxic_tokens(cores: list[str], index: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which distinct tokens are a toxic word, or begin like one (four to seven letters).

    Toxic are words and beginnings that are eight times commoner in toxic texts than in clean ones, beyond
    chance: were labels dealt at random over the pairs of text and word, one as uneven as this would be
    expected less than once in a hundred samples, counting all words of the sample (Chernoff's bound).
    """
    doc = np.repeat(np.arange(len(label)), np.diff(bounds))
    texts, out = np.bincount(label, minlength=2), np.zeros(len(cores), bool)
    shorter = lambda k: [c if k is None else c[:k] if len(c) > k else "" for c in cores]
    kinds = (None, *range(4, 8))
    least = np.log(100.0 * max(1, sum(len(set(shorter(k))) for k in kinds)))
    for kind in kinds:
        unit, names = pd.factorize(np.array(shorter(kind), object))
        pair = np.unique(doc * len(names) + unit[index])
        of, toxic = pair % len(names), label[pair // len(names)]
        bad, clean = (np.bincount(of[toxic == t], minlength=len(names)).astype(float) for t in (1, 0))
        share = bad.sum() / max(1.0, bad.sum() + clean.sum())
        both = np.maximum(bad + clean, 1)
        part = np.clip(bad / both, 1e-12, 1 - 1e-12)
        far = part * np.log(part / share) + (1 - part) * np.log((1 - part) / (1 - share))
        found = (bad >= 3) & (bad / texts[1] > 8 * (clean + 0.5) / (texts[0] + 0.5)) & (both * far > least) & (names != "")
        out |= found[unit]
    return out


def train(texts: list[str], label: list[int], weights: tuple[float, float] | None = None, rounds: int = 60, penalty: float = 0.3) -> Crf:
    """Fit the chain and the document model; ``weights`` are the classes' shares (clean, toxic) outside the sample."""
    kept = _without_copies(texts)
    texts, marks = [texts[i] for i in kept], np.array([label[i] for i in kept], np.int64)
    model = Crf()
    if len(set(marks.tolist())) < 2:
        if len(marks) and marks[0] == 1:
            model.document = -model.document
        return model
    words, index, bounds = tokens(texts)
    cores = [core(w) for w in words]
    truth = _toxic_tokens(cores, index, bounds, marks)[index] & np.repeat(marks == 1, np.diff(bounds))
    often = Counter(cores[i] for i in index.tolist())
    common = {w: k for k, w in enumerate((w for w, n in often.items() if n > 1), 1)}
    number = np.array([common.get(c, 0) for c in cores])
    v = len(common) + 1
    ends_of = np.array([affixes(c) for c in cores], np.int32).reshape(len(cores), -1).T
    form = np.array([shape(t, c) for t, c in zip(words, cores, strict=True)], np.int32)
    ends = np.zeros(len(index) + 2, np.int64)
    ends[1:-1] = number[index]
    before, after = ends[:-2].copy(), ends[2:].copy()
    has = np.flatnonzero(np.diff(bounds))
    before[bounds[has]] = v
    after[bounds[has + 1] - 1] = v
    w = v + 1
    a = (len(PREFIXES) + 1) * AFFIXES
    feature = [f.astype(np.int32) for f in (number[index], w + before, 2 * w + after, *(3 * w + e[index] for e in ends_of), 3 * w + a + form[index])]
    theta, seen = np.zeros(3 * w + a + 16), truth.astype(float)
    log_moves, first_moment, second = np.zeros((2, 2)), np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    y = truth.astype(np.int64)
    inner = np.ones(len(y), bool)
    inner[bounds[has]] = False
    observed = np.bincount(2 * y[:-1][inner[1:]] + y[1:][inner[1:]], minlength=4).reshape(2, 2)
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, len(y), BLOCK_TOKENS)), len(bounds) - 1))
    for step in range(1, rounds + 1):
        slope, expected = -penalty * theta, np.zeros((2, 2))
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = bounds[low : high + 1]
            block = slice(part[0], part[-1])
            p, moved = chain(np.clip(sum(theta[f[block]] for f in feature), -25, 25), part - part[0], np.exp(log_moves), pairs=True)
            slope += sum(np.bincount(f[block], seen[block] - p, len(theta)) for f in feature)
            expected += moved
        slope = np.concatenate((slope, (observed - expected).ravel() - penalty * log_moves.ravel()))
        first_moment = 0.9 * first_moment + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.2 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta += move[: len(theta)]
        log_moves += move[len(theta) :].reshape(2, 2)
    named = {c: k for c, k in common.items()}
    model = Crf(
        {c: float(theta[k]) for c, k in named.items()}, {c: float(theta[w + k]) for c, k in named.items()}, {c: float(theta[2 * w + k]) for c, k in named.items()},
        (float(theta[0]), float(theta[w]), float(theta[2 * w])), (float(theta[w + v]), float(theta[2 * w + v])),
        theta[3 * w : 3 * w + a].copy(), theta[3 * w + a :].copy(), np.exp(log_moves),
    )
    rows = []
    for at in range(0, len(texts), 200):
        words, index, bounds = tokens(texts[at : at + 200])
        rows.append(summary(model.marginals(words, index, bounds), bounds))
        model.known.clear()
    x = np.concatenate(rows)
    share = np.bincount(marks, minlength=2)
    each = (np.array(weights if weights and min(weights) > 0 else share) / share)[marks]
    model.document = _logistic(x, marks, each / each.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Newton's method; the constant is not penalized."""
    beta, ridge = np.zeros(x.shape[1]), penalty * np.diag([1e-9, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        beta = beta + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Crf:
    """Train on documents whose labels may be learned from: those that are not held out.

    The sample is the ``per_class`` documents of either class whose hashed id is smallest. Null ids and
    labels other than 0 and 1 are passed over; without both classes every document scores near 0, or
    near 1 where all labelled documents are toxic.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    shares = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    samples = []
    for toxic in (0, 1):
        # Twice as many ids as texts: some documents are too long, and some labels have no document.
        chosen = usable.where(F.col("toxic") == toxic).select("doc_id").distinct().orderBy(*order).limit(2 * per_class)
        met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.char_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
        samples.append(met.orderBy(*order).limit(per_class).select(F.lit(toxic).alias("toxic"), order[0].alias("hash"), "doc_id", "text"))
    weights = (shares.get(0, 0), shares.get(1, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"toxic": [], "hash": [], "doc_id": [], "text": []})]).sort_values(["toxic", "hash", "doc_id", "text"], kind="stable")
        model = train(rows.text.tolist(), [int(t) for t in rows.toxic], weights)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # The sample has a bound, so one task can hold it; the driver holds the model only.
    fitted = samples[0].unionByName(samples[1]).repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(fitted.model) if fitted else train([], [], weights)  # an empty table may have no task


SCORES = "doc_id long, score double, predicted int, spans array<struct<start:int,stop:int>>"


def score(docs: DataFrame, model: Crf, spans: bool = True) -> DataFrame:
    """(doc_id, score, predicted, spans) of every row; spans are the code points of offending words.

    A null text is an empty one; texts without words score as the model scores the absence of any
    evidence; rows may repeat and doc_id may be null; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shipped.value
        for part in batches:
            texts = part.text.tolist()
            words, index, bounds = tokens(texts)
            p = crf.marginals(words, index, bounds)
            value = crf.documents(p, bounds)
            found: list[list[dict[str, int]]] = [[] for _ in texts]
            hot = np.flatnonzero(p >= 0.5) if spans else np.zeros(0, np.int64)
            owner = np.searchsorted(bounds, hot, "right") - 1
            for d in np.unique(owner).tolist():
                places = [m.span() for m in WORD.finditer(texts[d])]
                found[d] = [{"start": places[k][0], "stop": places[k][1]} for k in (hot[owner == d] - bounds[d]).tolist()]
            yield pd.DataFrame({"doc_id": part.doc_id, "score": value, "predicted": (value >= 0.5).astype(np.int32), "spans": found})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCORES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "spans")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows predicted toxic go. Each is judged by its own text, also where its doc_id is null or repeated."""
    shipped = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shipped.value
        for part in batches:
            words, index, bounds = tokens([t or "" for t in part.column("text").to_pylist()])
            value = crf.documents(crf.marginals(words, index, bounds), bounds)
            yield part.filter(pa.array(value < 0.5))

    return docs.mapInArrow(run, docs.schema)
