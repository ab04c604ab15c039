"""Quality rules on repetition, from a suffix array over each document's words.

The words of many documents lie in one array; prefix doubling ranks all their suffixes, sorting at each
step only suffixes that are still tied with another. The ranks of every step give the longest common
prefix of neighbours in the array, and so the intervals of maximal repeated word sequences. Their spans
are united; a document is rejected when they cover too large a part of it or when the longest repeat is
too long. The same ranks, at eight words, give the windows of the plain repeat count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.shared import small_batches, table

#: Fixed values of the plain rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
_STRIP = " \t\n\r\x0b\x0c"

OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, spans array<struct<start:int,stop:int>>"
)


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, code points of each word, first word of each text and the end)."""
    lists = pc.ascii_split_whitespace(pa.array([t.strip(_STRIP) for t in texts], pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    index = coded.indices.to_numpy().astype(np.int64)
    length = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    keep = length > 0  # a text without words gives one empty word
    return index[keep], length[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


class SuffixArray:
    """Suffixes of all texts of a batch; a suffix ends with its text, and those of different texts never tie.

    ``ranks[k][i]`` is the place in sorted order of the first suffix that shares its first 2^k words with
    ``i``; ``tied[k]`` are the suffixes that share them with another. Both end where no two are tied.
    """

    def __init__(self, number: np.ndarray, bounds: np.ndarray):
        n = self.n = len(number)
        sizes = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        left = bounds[self.doc + 1] - np.arange(n)
        at = np.arange(n)
        first, second = np.zeros(n, np.int64), self.doc * (int(number.max(initial=0)) + 1) + number
        value, width = np.zeros(n, np.int32), 1
        self.ranks: list[np.ndarray] = []
        self.tied: list[np.ndarray] = []
        while len(at):
            order = np.lexsort((second, first))
            a, b, place = first[order], second[order], np.arange(len(order))
            run = np.ones(len(order), bool)
            run[1:] = a[1:] != a[:-1]
            part = run.copy()
            part[1:] |= b[1:] != b[:-1]
            start = np.maximum.accumulate(np.where(part, place, 0))
            value = value.copy()
            value[at[order]] = a + start - np.maximum.accumulate(np.where(run, place, 0))
            shared = ~part
            shared[:-1] |= ~part[1:]
            at = np.sort(at[order[shared]])
            self.ranks.append(value)
            self.tied.append(at)
            # Told apart next by the ``width`` words that follow; a text's end comes before any word.
            first = value[at].astype(np.int64)
            second = np.where(left[at] > width, value[np.minimum(at + width, n - 1)], -1)
            width *= 2

    def windows_twice(self, width: int = WINDOW) -> np.ndarray:
        """Whether the ``width`` words (a power of two) from each place occur elsewhere in the text."""
        out, k = np.zeros(self.n, bool), width.bit_length() - 1
        if k < len(self.tied):
            out[self.tied[k]] = True
        return out

    def longest(self, least: int) -> np.ndarray:
        """For each suffix the longest prefix, of ``least`` words or more, that starts elsewhere in its text too.

        It is the greater of the common prefixes with both neighbours in sorted order.
        """
        out, k = np.zeros(self.n, np.int64), least.bit_length() - 1
        if k >= len(self.tied) or not len(self.tied[k]):
            return out
        at = self.tied[k]
        order = at[np.argsort(self.ranks[-1][at])]
        common = self._common(order[:-1], order[1:])
        for i in (order[:-1], order[1:]):
            out[i] = np.maximum(out[i], common)
        out[out < least] = 0
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes ``a`` and ``b`` share, by the ranks of ever fewer words."""
        total, i, j = np.zeros(len(a), np.int64), a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = (i < self.n) & (j < self.n)
            same = inside & (self.ranks[k][np.where(inside, i, 0)] == self.ranks[k][np.where(inside, j, 0)]) & (i != j)
            total[same] += 1 << k
            i, j = i + (same << k), j + (same << k)
        return total


def _cover(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return len(lines) - len(set(lines))


def judge(texts: list[str], least: int, most_covered: float, longest_allowed: int) -> pd.DataFrame:
    number, length, bounds = word_numbers(texts)
    array = SuffixArray(number, bounds)
    twice = array.windows_twice()
    at = np.flatnonzero(twice)
    repeated = _per_text(_cover(at, np.full(len(at), WINDOW), len(number)), bounds)
    longest = array.longest(least)
    at = np.flatnonzero(longest)
    inside = _cover(at, longest[at], len(number))
    covered, top = _per_text(inside, bounds), np.zeros(len(texts), np.int64)
    np.maximum.at(top, array.doc[at], longest[at])
    opens, closes = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    has = np.flatnonzero(np.diff(bounds))
    opens[bounds[has]] = closes[bounds[has + 1] - 1] = True
    opens[1:] |= ~inside[:-1]
    closes[:-1] |= ~inside[1:]
    edge, stop = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    spans: list[list[dict[str, int]]] = [[] for _ in texts]
    for a, b in zip(edge.tolist(), stop.tolist(), strict=True):
        d = int(array.doc[a])
        spans[d].append({"start": a - int(bounds[d]), "stop": b - int(bounds[d])})
    n = np.diff(bounds)
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)
    good = (covered <= most_covered * n) & (top <= longest_allowed)
    symbols = pc.count_substring_regex(pa.array(texts, pa.large_string()), SYMBOLS).to_numpy(zero_copy_only=False)
    return pd.DataFrame({
        "n_words": n, "word_chars": _per_text(length, bounds), "n_symbols": symbols.astype(np.int64), "n_dup_lines": [duplicate_lines(t) for t in texts], "n_repeat_words": repeated,
        "base_failed": failed, "kept": ~failed & good, "covered_words": covered, "longest_repeat": top, "spans": spans,
    })


def quality_rules(docs: DataFrame, least: int = 6, most_covered: float = 0.25, longest_allowed: int = 60) -> DataFrame:
    """Measures and verdict of every row, with the repeated spans as word numbers.

    Repeats of fewer than ``least`` words don't count. A null or empty text has no words and fails; rows
    may repeat and doc_id may be null; other columns are ignored; an empty table gives no rows. A batch
    is bounded in bytes, and a longer text is a batch of its own.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = judge(part.text.tolist(), least, most_covered, longest_allowed)
            out.insert(0, "doc_id", part.doc_id)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, OUT)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("spans", "longest_repeat")
