"""Best-fit packing of tokenized documents into fixed-length sequences, improved by swaps.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into shards of bounded size;
each shard starts from a best-fit-decreasing packing and is then improved by local search: documents of
the emptiest bin are moved into, or exchanged one-for-one, two-for-one and one-for-two with documents
of, other underfull bins. Every step raises the sum of squared fills, so the emptiest bins run dry
and disappear. Bins that stay underfull in the first round are opened again and their pieces packed
across shards in a second one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.bpe import default_path, tokenizer
from logsieve.llm.shared import materialize, small_batches, table

CAPACITY = 4096
END = (1).to_bytes(4, "little")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Bins of whole-number sizes; an integer's bits tell which gaps occur."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.fill = capacity, [], []
        self.by_gap: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.gaps = 0

    def _enter(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        self.by_gap[gap].add(b)
        self.gaps |= 1 << gap

    def _leave(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        self.by_gap[gap].discard(b)
        if not self.by_gap[gap]:
            self.gaps &= ~(1 << gap)

    def new(self) -> int:
        self.held.append([])
        self.fill.append(0)
        self._enter(len(self.fill) - 1)
        return len(self.fill) - 1

    def tightest(self, size: int) -> int | None:
        """A bin with the smallest gap that takes ``size``."""
        fitting = self.gaps >> size
        if not fitting:
            return None
        return next(iter(self.by_gap[size + (fitting & -fitting).bit_length() - 1]))

    def change(self, b: int, out: list[tuple[int, int]], into: list[tuple[int, int]]) -> None:
        """Documents are (size, id); each bin keeps its own in order of size."""
        self._leave(b)
        for x in out:
            del self.held[b][bisect_left(self.held[b], x)]
            self.fill[b] -= x[0]
        for x in into:
            insort(self.held[b], x)
            self.fill[b] += x[0]
        self._enter(b)

    def close(self, b: int) -> None:
        self._leave(b)


def best_fit(sizes: np.ndarray, ids: list[int], capacity: int) -> Bins:
    """Put each size, in the order given, into the fullest bin that takes it."""
    bins = Bins(capacity)
    for size, i in zip(sizes.tolist(), ids, strict=True):
        b = bins.tightest(size)
        bins.change(bins.new() if b is None else b, [], [(size, i)])
    return bins


def _pair(docs: list[tuple[int, int]], low: int, high: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """Two of the ordered ``docs`` whose sizes add up to ``low`` to ``high``, the least sum found."""
    i, j, best = 0, len(docs) - 1, None
    while i < j:
        total = docs[i][0] + docs[j][0]
        if total < low:
            i += 1
        else:
            if total <= high and (best is None or total < best[0][0] + best[1][0]):
                best = docs[i], docs[j]
            j -= 1
    return best


def _step(bins: Bins, a: int, budget: list[int]) -> bool:
    """Make bin ``a`` emptier by one move or exchange that raises the squared fill; False if none is found."""
    for x in reversed(bins.held[a]):
        fitting = bins.gaps >> x[0] << x[0]
        while fitting:
            gap = (fitting & -fitting).bit_length() - 1
            b = next((b for b in bins.by_gap[gap] if b != a), None)
            if b is not None and bins.fill[b] + x[0] <= bins.fill[a]:
                break  # it would only level the two, and wider gaps even more
            if b is not None:
                bins.change(a, [x], [])
                bins.change(b, [], [x])
                return True
            fitting &= fitting - 1
    gaps = bins.gaps & ~1
    while gaps:
        gap = gaps.bit_length() - 1
        gaps &= ~(1 << gap)
        for b in list(bins.by_gap[gap]):
            if b == a or bins.fill[b] < bins.fill[a]:
                continue
            budget[0] -= 1
            if budget[0] < 0:
                return False
            mine, theirs = bins.held[a], bins.held[b]
            for x in reversed(mine):  # one for one, then one of mine for two of theirs
                at = bisect_left(theirs, (x[0] - gap, -1))
                if at < len(theirs) and theirs[at][0] < x[0]:
                    y = theirs[at]
                    bins.change(a, [x], [y])
                    bins.change(b, [y], [x])
                    return True
                if two := _pair(theirs, x[0] - gap, x[0] - 1):
                    bins.change(a, [x], list(two))
                    bins.change(b, list(two), [x])
                    return True
            for y in theirs:  # two of mine for one of theirs
                if two := _pair(mine, y[0] + 1, y[0] + gap):
                    bins.change(a, list(two), [y])
                    bins.change(b, [y], list(two))
                    return True
    return False


def improve(bins: Bins, least: int, looks: int) -> None:
    """Move and exchange until ``least`` bins hold all, nothing raises the squared fill, or ``looks`` bins were examined."""
    budget, filled, changed = [looks], sum(map(bool, bins.held)), True
    while changed and filled > least and budget[0] > 0:
        changed = False
        for a in sorted((a for a, held in enumerate(bins.held) if held), key=bins.fill.__getitem__):
            if filled <= least or budget[0] <= 0 or bins.fill[a] == bins.capacity:
                break
            while bins.held[a] and _step(bins, a, budget):
                changed = True
                if not bins.held[a]:
                    bins.close(a)
                    filled -= 1


def pack(sizes: np.ndarray, capacity: int = CAPACITY, looks: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of that bin) of each size; sizes are 1 to ``capacity``.

    ``looks`` bounds the work of the improvement; every document stays packed.
    """
    bins = best_fit(sizes[(order := np.argsort(-sizes, kind="stable"))], order.tolist(), capacity)
    improve(bins, -(-int(sizes.sum()) // capacity), looks)
    number, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for n, held in enumerate(h for h in bins.held if h):
        at = 0
        for size, i in held:
            number[i], offset[i] = n, at
            at += size
        fill[[i for _, i in held]] = at
    return number, offset, fill


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each stretch of at most ``capacity`` tokens of a document, with a random ``deal``."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, deal = tokenizer(path), np.random.default_rng(TaskContext.get().partitionId())
        for part in batches:
            rows = []
            for doc_id, (ids, _) in zip(part.doc_id, bpe.encode_batch(part.text.tolist(), decoded=False), strict=True):
                ids += END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"), deal=deal.integers(0, 1 << 62, len(out)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"{PIECE}, deal long")


def _pack_round(rows: DataFrame, n: int, shard_rows: int, capacity: int, turn: int) -> DataFrame:
    shards = max(1, -(-n // shard_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        number, offset, fill = pack(part.length.to_numpy(), capacity)
        return part.assign(sequence_id=(turn << 60) + (part.shard.to_numpy().astype(np.int64) << 28) + number, offset=offset, fill=fill).drop(columns="shard")

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("deal"), F.lit(turn)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, f"{PIECE}, deal long, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard_rows: int = 40_000, closed: float = 0.995) -> DataFrame:
    """Place of every piece of every document.

    A null or empty text is a document of its end token alone; repeated rows and rows with a null
    doc_id are documents of their own; other columns are ignored; an empty table gives no rows.
    Pieces are dealt into shards by a random number stored with them, so neither a common doc_id nor
    a common length crowds a shard. Bins at least ``closed`` full stay as the first round leaves them.
    """
    small_batches(docs.sparkSession)
    cut = materialize(pieces(docs, path, capacity), "pieces")
    n = cut.count()
    first = materialize(_pack_round(cut, n, shard_rows, capacity, 1), "packed")
    if n > shard_rows:
        again = first.where(F.col("fill") < closed * capacity).drop("sequence_id", "offset", "fill")
        second = _pack_round(again, again.count(), shard_rows, capacity, 2)
        first = first.where(F.col("fill") >= closed * capacity).unionByName(second)
    return first.drop("deal", "fill")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences that the documents left over make."""
    return pack_documents(docs)
