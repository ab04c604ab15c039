"""Near copies by the Jaccard similarity of five-word shingles, for the pipeline's SimHash stage.

Contents (texts with equal words, in lower case) get the operator's fingerprint over five-word shingles,
and its multi-index hashing proposes pairs within two bits. Two bits reach similarities of about 0.97 and
more only: at 0.8 some ten of 64 bits differ, and balls that wide hold more entries than a table has
buckets. What is less alike meets by MinHash: ``BANDS`` keys of ``ROWS`` minima each. A pair of similarity
0.8 shares a key with probability 0.997, one of 0.9 with 1 - 5e-7.

Every proposed pair is confirmed on its complete sets of shingles. First every member of a bucket is held
against its first; then the members of a bucket that are in different groups still are held against one
another, so no pair is passed over because its bucket is large:

* Of a bucket with up to ``PAIR_LIMIT`` members the pairs are listed.
* In a larger one only pairs that touch a member outside its largest group are left. Members are dealt into
  blocks, those of the largest group apart; a pair of blocks, one of them outside, is one task that counts
  common shingles by matrix products. With up to ``BLOCK_MEMBERS`` outside that moves each text at most twice.
* Members of buckets with more outside (pages that share a frame and nothing else) meet by their rarest
  shingles instead, in an order of shingles that is the same for all: of two sets of similarity 0.8 the rarest
  ninth of the smaller and the rarest fifth of the larger share one. A shingle's rank is the count of its slot,
  of ``SLOTS``, over all such members, so what many share comes last. A shingle in somebody's rarest ninth is
  treated as a bucket was, blocks included: exact, and quadratic only in members outside the largest group
  whose rarest ninth is common as well. Pages of one frame have it in common only if they are similar.

Only groups are asked for, and most pairs of a large group of near copies are similar. So a task compares all
pairs of its blocks, but hands on a forest of them: enough similar pairs to connect what all of them connect,
fewer than the groups that the task has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.components import connected_components
from logsieve.llm.shared import materialize, small_batches
from logsieve.llm.simhash import links, majority

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 11
#: Members of a bucket whose pairs are listed, members of a block of a larger one, and shingles of a matrix.
PAIR_LIMIT, BLOCK_MEMBERS, COLUMNS = 64, 256, 8192
#: Slots in which shingles of members of very crowded buckets are counted: what the driver gets, whatever the rows.
SLOTS = 1 << 16
_DRAWN = np.random.default_rng(11).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_FACTOR, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]
#: Odd multipliers of the polynomial and of the mixing.
_TIMES, _MIX = (np.random.default_rng(12).integers(0, 1 << 64, 2, np.uint64) | np.uint64(1))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


class WordHashes(dict):
    """XXH64 of every word met so far; one for each batch, so it stays as small as the batch."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def hashed(words: list[bytes], known: WordHashes | None = None) -> np.ndarray:
    """The hashes of the shingles, repeats included; fewer than ``WIDTH`` words are one shingle, no word is none.

    The hash of a shingle is a polynomial of its words' hashes, mixed so that every bit counts.
    """
    if not words:
        return np.zeros(0, np.uint64)
    known = WordHashes() if known is None else known
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    out = each[:n].copy()
    for k in range(1, width):
        out *= _TIMES
        out += each[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def shingles(words: list[bytes], known: WordHashes | None = None) -> np.ndarray:
    return np.unique(hashed(words, known))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed key of every band; none for a text without words. Minima are of the hashes' upper halves."""
    if not len(hashes):
        return []
    upper, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), _BLOCK):
        drawn = _FACTOR * upper[at : at + _BLOCK]
        drawn += _PLUS
        np.minimum(least, drawn.min(axis=1), out=least)
    raw = b"".join([xxhash.xxh64_digest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)])
    return np.frombuffer(raw, ">i8").tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sketches(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            keys, bands, prints, known = [], [], [], WordHashes()
            for text in part.text:
                words = _words(text)
                each = hashed(words, known)
                keys.append(np.frombuffer(xxhash.xxh128_digest(b" ".join(words)), ">i8"))
                bands.append(band_keys(np.unique(each)))
                prints.append(majority(each))
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"row": part.row, "doc_id": part.doc_id, "k1": k[:, 0], "k2": k[:, 1], "fp": np.array(prints, np.int64), "bands": bands})

    return rows.select("row", "doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(run, "row long, doc_id long, k1 long, k2 long, fp long, bands array<long>")


def _confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros(0, np.uint64)
        for part in batches:
            keep, known = np.zeros(len(part), bool), WordHashes()
            for k, (u, a, b) in enumerate(zip(part.u.tolist(), part.a, part.b, strict=True)):
                if u != last:
                    last, held = u, shingles(_words(a), known)
                keep[k] = similarity(held, shingles(_words(b), known)) >= SIMILARITY
            yield part.loc[keep, ["u", "v"]]

    text = lambda node, name: rows.select(F.col("row").alias(node), F.col("text").cast("binary").alias(name))
    return pairs.join(text("v", "b"), "v").join(text("u", "a"), "u").select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the sets ``left`` are similar to which of ``right``, by products of incidence matrices."""
    sizes = np.array([len(x) for x in (*left, *right)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, many = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    shared = many[code] > 1  # a shingle of one set only is in no intersection
    _, code = np.unique(code[shared], return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[shared][order]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        held = np.zeros((len(sizes), COLUMNS), np.float32)
        held[owner[a:b], code[a:b] - low] = 1
        both += held[: len(left)] @ held[len(left) :].T
    return both >= SIMILARITY * (sizes[: len(left), None] + sizes[None, len(left) :] - both)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links a[i]-b[i] that connect the same ends as all of them, without a circle."""
    _, places = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1, return_index=True)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for k, x, y in zip(places.tolist(), a[places].tolist(), b[places].tolist(), strict=True):
        if (x := top(x)) != (y := top(y)):
            above[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _among_blocks(told: DataFrame, rows: DataFrame) -> DataFrame:
    """Similar pairs (u, v) that connect all roots with a similar pair within a key of (key, node, root, n, n_top, top).

    Each task gives a forest over the roots of its two blocks, so its rows grow with its members, not with their
    pairs. The first blocks hold the largest root, ``top``; no two of them are held against one another.
    """
    of_top, outside = F.ceil(F.col("n_top") / BLOCK_MEMBERS).cast("int"), F.ceil((F.col("n") - F.col("n_top")) / BLOCK_MEMBERS).cast("int")
    in_top, at = F.col("root") == F.col("top"), F.xxhash64("node")
    own = F.when(in_top, F.pmod(at, of_top)).otherwise(of_top + F.pmod(at, outside)).cast("int")
    first = F.when(in_top, of_top).otherwise(F.lit(0))
    dealt = told.select("key", "node", "root", own.alias("own"), F.explode(F.sequence(first, of_top + outside - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    texts = dealt.join(rows.select(F.col("row").alias("node"), F.col("text").cast("binary").alias("text")), "node")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        first, second = part[part.own == part.i.iloc[0]], part[part.own == part.j.iloc[0]]
        known = WordHashes()
        sets = {n: shingles(_words(t), known) for n, t in zip(part.node, part.text, strict=True)}
        found = similar_pairs([sets[n] for n in first.node], [sets[n] for n in second.node]) if len(first) and len(second) else np.zeros((0, 0), bool)
        a, b = np.nonzero(found)
        kept = forest(first.root.to_numpy()[a], second.root.to_numpy()[b])
        u, v = first.node.to_numpy()[a[kept]], second.node.to_numpy()[b[kept]]
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return texts.groupBy("key", "i", "j").applyInPandas(run, "u long, v long")


def rarest(held: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, and how many of them do if it is the smaller one of a pair.

    A similar set shares at least ``SIMILARITY`` of the larger one and, of the smaller one, twice that by one
    more; the rarest common shingle has all others behind it.
    """
    beyond = lambda share: len(held) - int(np.ceil(share * len(held) - 1e-9)) + 1
    return held[np.lexsort((held, ranks[held % np.uint64(SLOTS)]))][: beyond(SIMILARITY)], beyond(2 * SIMILARITY / (1 + SIMILARITY))


def _by_rarest(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, node, root) of (node, root): each member under its rarest shingles, without those that no smaller member could meet in."""
    text = rows.select(F.col("row").alias("node"), F.col("text").cast("binary").alias("text"))
    texts = materialize(text.join(members, "node"), "crowded")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for part in batches:
            known = WordHashes()
            for t in part.text:
                counts += np.bincount((shingles(_words(t), known) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": met, "n": counts[met]})

    found = texts.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    ranks = np.zeros(SLOTS, np.int64)
    ranks[found.slot.to_numpy(np.int64)] = found.n.to_numpy(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            known = WordHashes()
            found = [rarest(shingles(_words(t), known), ranks) for t in part.text]
            yield pd.DataFrame({"node": part.node, "root": part.root, "keys": [k.view(np.int64) for k, _ in found], "few": [n for _, n in found]})

    spread = texts.mapInPandas(run, "node long, root long, keys array<long>, few int").select(F.posexplode("keys").alias("at", "key"), "node", "root", "few")
    spread = materialize(spread.select("key", "node", "root", (F.col("at") < F.col("few")).alias("own")), "rarest")
    meeting = spread.groupBy("key").agg(F.bool_or("own").alias("own"), F.count("*").alias("n")).where("own and n > 1").select("key")
    return spread.select("key", "node", "root").join(meeting, "key", "left_semi")


def _mixed(told: DataFrame) -> DataFrame:
    """(key, node, root, n, n_top, top) of the keys of (key, node, root) with more than one root; ``top`` is the most frequent."""
    by_root = told.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("n_top"), F.max_by("root", F.struct("n", "root")).alias("top")).where("n > n_top")
    return materialize(told.join(mixed, "key"), "mixed")


def _listed(told: DataFrame) -> DataFrame:
    """The pairs (u, v) of different roots in keys of few members."""
    few = told.where(F.col("n") <= PAIR_LIMIT)
    other = few.select("key", F.col("node").alias("v"), F.col("root").alias("root_v"))
    return few.join(other, "key").where("node < v and root <> root_v").select(F.col("node").alias("u"), "v")


def _apart(members: DataFrame, roots: DataFrame, rows: DataFrame, stars: DataFrame) -> DataFrame:
    """Similar pairs (u, v) that connect all groups with a similar pair among the members of a bucket."""
    told = materialize(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "told")
    told = _mixed(told)
    many, outside = F.col("n") > PAIR_LIMIT, F.col("n") - F.col("n_top")
    listed, blocks = _listed(told), _among_blocks(told.where(many & (outside <= BLOCK_MEMBERS)), rows)
    crowd = told.where(many & (outside > BLOCK_MEMBERS)).select("node", "root").distinct()
    if crowd.limit(1).count():
        told = _mixed(materialize(_by_rarest(crowd, rows), "meeting"))
        listed, blocks = listed.unionByName(_listed(told)), blocks.unionByName(_among_blocks(told.where(many), rows))
    listed = materialize(listed.distinct().join(stars, ["u", "v"], "left_anti"), "apart")
    return materialize(_confirmed(listed, rows).unionByName(blocks).distinct(), "confirmed")


def _proposed_by_prints(contents: DataFrame) -> DataFrame:
    """Pairs (u, v) of contents whose fingerprints are equal or linked by multi-index hashing."""
    prints = materialize(contents.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = contents.select("fp", "node").join(prints, "fp").where("first < node").select(F.col("first").alias("u"), F.col("node").alias("v"))
    name = lambda a, b: prints.select(F.col("fp").alias(a), F.col("first").alias(b))
    near = links(prints).join(name("u", "x"), "u").join(name("v", "y"), "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return same.unionByName(near)


def groups(rows: DataFrame) -> DataFrame:
    """(row, first) of every row of (row, doc_id, text): the row of its group that has the smallest doc_id.

    ``row`` names a row; it has to be stored with the rows. Rows without a doc_id come after all others.
    Null and wordless texts are one group.
    """
    small_batches(rows.sparkSession)
    marked = materialize(_sketches(rows), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    contents = marked.groupBy("k1", "k2").agg(F.min(order).alias("least"), F.min_by(F.struct("fp", "bands"), order).alias("m"))
    contents = materialize(contents.select("k1", "k2", "least", "m.fp", "m.bands", F.col("least.row").alias("node")), "contents")
    keyed = contents.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(keyed.join(shared, "key"), "members")
    stars = members.where("low < node").select(F.col("low").alias("u"), F.col("node").alias("v"))
    stars = materialize(stars.unionByName(_proposed_by_prints(contents)).distinct(), "stars")
    found = materialize(_confirmed(stars, rows), "confirmed")

    roots = connected_components(found)
    more = _apart(members, roots, rows, stars)
    if more.limit(1).count():
        hung = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = connected_components(hung.unionByName(more))
    placed = materialize(contents.join(roots, "node", "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root")), "placed")
    firsts = placed.groupBy("root").agg(F.min("least").getField("row").alias("first"))
    return marked.select("row", "k1", "k2").join(placed.join(firsts, "root").select("k1", "k2", "first"), ["k1", "k2"]).select("row", "first")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the smallest doc_id stays.

    Every row is judged by its own text, whether its doc_id is null or repeated.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of ours can clash with the table's
    rows = materialize(docs.select(*[docs[c].alias(n) for c, n in inner.items()]).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = groups(rows.select("row", F.col(inner["doc_id"]).cast("long").alias("doc_id"), F.col(inner["text"]).alias("text")))
    gone = materialize(found.where("row <> first").select("row"), "copies")
    return rows.join(gone, "row", "left_anti").select(*[F.col(n).alias(c) for c, n in inner.items()])
