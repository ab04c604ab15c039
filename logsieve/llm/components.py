"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.shared import materialize


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest node of its neighbourhood.

    ``large`` hangs the greater neighbours, otherwise the smaller ones and the node itself. The
    minimum is aggregated map-side and joined back, so a hub with a huge neighbourhood is a skewed
    join that adaptive execution splits; no neighbourhood is ever gathered.
    """
    low = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = directed.join(low, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    rest = met.where("v < u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node either hangs on one smaller node on which alone others hang, or is such a node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    of = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return of.where("hangs + holds > 1").limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map each node of ``edges`` (u long, v long) to the smallest node it can reach.

    Returns (node, root). Self loops, repeated edges and either direction are allowed; a self loop
    alone yields no row; an empty table yields an empty table. Every round is written to the shared
    folder; the rounds grow with the logarithm of the longest path.
    """
    now = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        stars = _star(_undirected(now), large=True).distinct()
        now = materialize(_star(materialize(stars, "large").where("v < u"), large=False).distinct(), "small")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
