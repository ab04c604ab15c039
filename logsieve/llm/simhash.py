"""SimHash near-duplicate detection with multi-index hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a document's word
shingles. Two fingerprints are linked when they differ in at most ``distance`` bits; documents are
grouped by the connected components of those links.

Links are found by multi-index hashing: the fingerprint is cut into ``segments`` pieces, so that two
linked fingerprints must be within a small Hamming ball of one another in at least one piece. Every
distinct fingerprint enumerates that ball, fetches the table entries of each member and verifies the
complete distance. Only the member of a differing pair that holds the lowest differing bit probes, so
a pair meets once. A table bucket of more than ``bucket_limit`` fingerprints is not compared pairwise:
its members and whatever probes it are linked through the midpoints they share, which is exact for an
even distance and needs 65 rows per fingerprint, however large the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.components import connected_components
from logsieve.llm.shared import materialize, small_batches, table

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one UTF-8 text; 0 for a null text or one without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of the hashes of a text's shingles; 0 for none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        votes += np.unpackbits(hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; the 64 bits are held in a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part.doc_id, "fp": np.array([_signed(fingerprint(x, width)) for x in part.text], np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInPandas(run, "doc_id long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment, from the lowest bits up."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(prints: DataFrame, distance: int = 2, segments: int = 2, bucket_limit: int = 32) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) within ``distance`` bits.

    All edges are emitted outside crowded buckets; inside them enough to connect the same components.
    """
    if distance % 2:
        raise ValueError("the distance must be even: crowded buckets are linked through midpoints")
    radius, extra = divmod(distance, segments)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    found, crowded = [], []
    for i, (shift, bits) in enumerate(_segments(segments)):
        reach = radius if i <= extra else radius - 1
        if reach < 0:
            continue
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
        entries = prints.select("fp", segment.alias("key"))
        sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
        hot = sizes.where(F.col("n") > bucket_limit).select("key")
        masks = F.array(*[F.lit(_signed(m)) for m in _ball(bits, reach)])
        lowest = lambda m: m.bitwiseAND(-m)
        own = F.filter(masks, lambda m: (m == 0) | (F.col("key").bitwiseAND(lowest(m)) != 0))
        probes = entries.select("fp", F.explode(own).alias("mask"), "key").select("fp", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), (F.col("mask") == 0).alias("same"))
        cold = entries.join(hot, "key", "left_anti").select("key", F.col("fp").alias("other"))
        found.append(probes.join(cold, (probes.key == cold.key) & near & (~probes.same | (F.col("fp") < F.col("other")))).select(F.col("fp").alias("u"), F.col("other").alias("v")))
        crowded.append(probes.join(hot, "key", "left_semi").select("fp"))
    members = crowded[0]
    for more in crowded[1:]:
        members = members.unionByName(more)
    flips = F.array(*[F.lit(_signed(m)) for m in _ball(BITS, distance // 2)])
    middles = members.distinct().select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("middle"))
    # A midpoint is shared by at most the members of one ball (65 for a distance of 2): the list is bounded.
    met = middles.groupBy("middle").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    found.append(met.select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("v")))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(docs: DataFrame, distance: int = 2, segments: int = 2, bucket_limit: int = 32, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the group of every document, named by its smallest doc_id.

    Null and wordless texts have fingerprint 0 and are linked like any other; repeated rows stay
    repeated; rows with a null doc_id are grouped but never name a group (a group of such rows alone
    has a null component_id); other columns are ignored; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = connected_components(links(prints, distance, segments, bucket_limit))
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(placed.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
