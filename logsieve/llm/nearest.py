"""Approximate nearest neighbours by inner product: an adaptive dimension scan over inverted lists.

Largest inner product becomes smallest distance by one more component, which lifts every candidate to
the greatest norm of the table; all vectors are scaled by one power of two first, which changes no digit,
so that no square overflows. Vectors are dealt to the lists of their nearest centre; centres, the random
rotation, the number of lists to probe and every query's first threshold come from a bounded sample of
``SAMPLE`` to ``LARGEST_SAMPLE`` rows, the index from all rows. There are as many lists as the square root
of the rows, up to an eighth of the sample; beyond ``COARSE_OVER`` they are found in two levels. Within a
probed list the rotated vectors are scanned in column blocks: after each block a hypothesis test compares
the scaled partial distance with the query's threshold and abandons candidates that are too far with high
probability. What is left is scored in double precision on the original vectors.

Lists and their queries are cut into blocks of bounded size, so a list that holds a third of all rows is
many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.llm.shared import materialize, table

#: Rows that the index is fitted to: eight for each list, within these bounds. 262,144 rows give 32,768 lists,
#: the square root of 10^9 rows; with more rows than that lists grow in proportion.
SAMPLE, LARGEST_SAMPLE = 20_000, 262_144
#: More centres than this are found within coarse cells; a vector is held against those of its nearest cells.
COARSE_OVER, COARSE_CELLS = 1024, 8
#: Of the sample's true neighbours, the part that the probed lists must hold.
COVER = 0.97
#: What single precision may be off by in a squared distance, the greatest norm being one at most.
SLACK = 1e-4
#: Error bound of the hypothesis test, in standard errors of the partial distance.
EPSILON = 2.1
LIST_ROWS = 8192
QUERY_ROWS = 16_384
_CHUNK, _QUERIES = 1024, 2048
#: Queries whose lists one task chooses.
QUERIES_A_TASK = 4096


@dataclass
class Index:
    """``norm2`` and the vectors that ``lift`` takes are scaled by two to the power of ``-exponent``."""

    exponent: int
    norm2: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray
    #: With two levels: the coarse centres, and where the centres of each begin and end.
    coarse: np.ndarray | None = None
    bounds: np.ndarray | None = None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -self.exponent)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors with the extra component, in single precision."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return (np.concatenate((x, rest[:, None]), axis=1) @ self.rotation).astype(np.float32)

    def assign(self, lifted: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        if self.coarse is None:
            return _nearest(lifted, self.centres)
        out = np.zeros(len(lifted), np.int64)
        for at in range(0, len(lifted), 4096):
            x = lifted[at : at + 4096]
            cells = np.argpartition(_square(x, self.coarse), COARSE_CELLS - 1, axis=1)[:, :COARSE_CELLS] if len(self.coarse) > COARSE_CELLS else np.tile(np.arange(len(self.coarse)), (len(x), 1))
            least = np.full(len(x), np.inf, np.float32)
            for c in np.unique(cells).tolist():
                rows = np.flatnonzero((cells == c).any(axis=1))
                low, high = self.bounds[c], self.bounds[c + 1]
                far = _square(x[rows], self.centres[low:high])
                near = far.argmin(axis=1)
                far = far[np.arange(len(rows)), near]
                better = far < least[rows]
                least[rows[better]], out[at + rows[better]] = far[better], low + near[better]
        return out


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _centres(x: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """``many`` centres of ``x`` by Lloyd's rounds."""
    centres = x[rng.choice(len(x), many, replace=False)]
    for _ in range(8 if many > 1 else 1):
        near = _nearest(x, centres)
        held = np.bincount(near, minlength=many)
        total = np.stack([np.bincount(near, x[:, c], many) for c in range(x.shape[1])], axis=1)
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres).astype(np.float32)
    return centres


def build(vectors: np.ndarray, ids: np.ndarray, rows: int, norm2: float, k: int, exponent: int = 0, seed: int = 11, coarse_over: int = COARSE_OVER) -> Index:
    """Fit the index to a sample of (scaled) ``vectors`` out of ``rows``."""
    rng = np.random.default_rng(seed)
    dim = vectors.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0]
    index = Index(exponent, norm2, rotation, np.zeros((1, dim + 1), np.float32), 1, vectors, ids)
    lifted, asked = index.lift(vectors, False), index.lift(vectors, True)
    lists = max(1, min(int(rows**0.5), len(vectors) // 8))
    if lists <= coarse_over:
        index.centres = _centres(lifted, lists, rng)
    else:
        coarse = _centres(lifted, int(lists**0.5), rng)
        cell = _nearest(lifted, coarse)
        members = [np.flatnonzero(cell == c) for c in range(len(coarse))]
        coarse, members = coarse[[len(m) > 0 for m in members]], [m for m in members if len(m)]
        parts = [_centres(lifted[m], max(1, round(lists * len(m) / len(lifted))), rng) for m in members]
        index.coarse, index.centres, index.bounds = coarse, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    lists = len(index.centres)
    near = index.assign(lifted)
    test = rng.choice(len(lifted), min(256, len(lifted)), replace=False)
    ip = vectors[test] @ vectors.T
    ip[np.arange(len(test)), test] = -np.inf
    best = np.argsort(-ip, axis=1)[:, : min(k, len(lifted) - 1)]
    if best.size:
        order = np.argsort(_square(asked[test], index.centres), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(lists)[None, :].repeat(len(test), 0), axis=1)
        needed = np.take_along_axis(rank, near[best], axis=1).ravel()
        index.probes = int(np.sort(needed)[min(len(needed) - 1, int(COVER * len(needed)))]) + 1
    return index


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
    return order[rank < k]


def scan(index: Index, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the up to ``k`` best candidates of each query within its limit.

    ``limit`` is a squared distance in lifted space that some ``k`` candidates are known to lie within.
    """
    parts = [_scan(index, queries[i : i + _QUERIES], own[i : i + _QUERIES], limit[i : i + _QUERIES], vectors, ids, k) for i in range(0, len(queries), _QUERIES)]
    at = np.concatenate([p[0] + n * _QUERIES for n, p in enumerate(parts)])
    return at, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _scores(index: Index, q: np.ndarray, v: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """Inner products of the original vectors. Scaling back is exact, but for products too small to have been kept."""
    out = np.ldexp(scaled, 2 * index.exponent)
    faint = np.flatnonzero(np.abs(scaled) < 1e-280)
    if len(faint):
        exact = np.einsum("ij,ij->i", q[faint], v[faint])
        out[faint] = np.where(np.isfinite(exact), exact, out[faint])
    return out


@np.errstate(over="ignore", under="ignore", invalid="ignore")
def _scan(index: Index, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    small_q, small_v = index.scaled(queries), index.scaled(vectors)
    asked, held = index.lift(small_q, True), index.lift(small_v, False)
    d = asked.shape[1]
    cuts = sorted({min(d, c) for c in (max(1, d // 2), max(1, 3 * d // 4), d)})
    limit, constant = limit.copy(), (small_q * small_q).sum(axis=1) + index.norm2
    found_q, found_at, found_dot, found_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for at in range(0, len(held), _CHUNK):
        x = held[at : at + _CHUNK]
        part = _square(asked[:, : cuts[0]], x[:, : cuts[0]])
        keep = part * (d / cuts[0]) <= (limit * (1 + EPSILON / cuts[0] ** 0.5) ** 2)[:, None] + SLACK
        q, c = np.nonzero(keep)
        far = part[q, c]
        for low, high in zip(cuts, cuts[1:], strict=False):
            step = asked[q, low:high] - x[c, low:high]
            far = far + (step * step).sum(axis=1)
            slack = (1 + EPSILON / high**0.5) ** 2 if high < d else 1 + 1e-4
            keep = far * (d / high) <= limit[q] * slack + SLACK
            q, c, far = q[keep], c[keep], far[keep]
        other = ids[at + c] != own[q]
        q, c = q[other], at + c[other]
        dot = np.einsum("ij,ij->i", small_q[q], small_v[c])
        score = _scores(index, queries[q], vectors[c], dot)
        found_q, found_at, found_dot, found_score = (np.concatenate(x) for x in ((found_q, q), (found_at, c), (found_dot, dot), (found_score, score)))
        top = _best(found_q, ids[found_at], found_score, k)
        found_q, found_at, found_dot, found_score = found_q[top], found_at[top], found_dot[top], found_score[top]
        many = np.bincount(found_q, minlength=len(queries))
        full = np.flatnonzero(many >= k)
        last = np.cumsum(many)[full] - 1
        limit[full] = np.minimum(limit[full], constant[full] - 2 * found_dot[last])
    return found_q, ids[found_at], found_score


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, zero, ragged or non-finite vectors, no null id."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


RESULT = "query long, query_id long, vec_id long, score double"


def _facts(rows: DataFrame) -> tuple[int, int, float] | None:
    """(length, rows, binary logarithm of the greatest norm) of the vectors of the most common length."""
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    share = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") / most) * (x.cast("double") / most))
    plain = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select(F.size("v").alias("dim"), plain.alias("plain"), "v")
    norm = F.when(F.col("plain").between(1e-200, 1e200), F.log2("plain") / 2).otherwise(F.log2(most) + F.log2(share) / 2)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm"))
    best = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    return None if best is None else (best.dim, best.n, best.norm)


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, coarse_over: int = COARSE_OVER) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Vectors take part if they are not null or zero, hold only finite components, and have the most common
    length of the table (the greater if two are as common). Equal rows are one query; rows that share an id
    but not a vector are queries of their own. A candidate with the query's own id is never returned; rows
    that repeat an id are candidates of their own. A query has fewer than ``k`` rows only if there are fewer
    candidates. Products beyond the range of doubles have infinite scores; of candidates tied by that, those
    that were found stay, the smaller ids first. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, column)
    facts = _facts(rows)
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, norm = facts
    exponent = int(np.ceil(norm))
    norm2 = 2.0 ** (2 * (norm - exponent)) * (1 + 1e-9)
    rows = rows.where(F.size("v") == dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, min(LARGEST_SAMPLE, 8 * int(n**0.5)))).toArrow()
    index = build(np.ldexp(_matrix(drawn["v"], dim), -exponent), drawn["vec_id"].to_numpy(), n, norm2, k, exponent, coarse_over=coarse_over)
    index.sample, index.sample_ids = index.sample[:sample], index.sample_ids[:sample]
    shipped = spark.sparkContext.broadcast(index)
    kind = rows.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for batch in batches:
            near = ix.assign(ix.lift(ix.scaled(_matrix(batch.column("v"), dim)), False))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32())], ["vec_id", "v", "list"])

    listed = materialize(rows.mapInArrow(assign, f"vec_id long, v {kind}, list int"), "lists")
    # At most an eighth of the sample's rows.
    sizes = {r.list: r["count"] for r in listed.groupBy("list").count().collect()}
    many = np.array([sizes.get(i, 0) for i in range(len(index.centres))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        lifted = ix.lift(ix.sample, False)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                ids, q = batch.column("vec_id").to_numpy(), ix.scaled(_matrix(batch.column("v"), dim))
                asked = ix.lift(q, True)
                order = np.argsort(_square(asked, ix.centres), axis=1)
                held = np.cumsum(many[order], axis=1)
                free = held - many[order] < k + 1  # lists that make sure of k candidates are searched without a limit
                take = free | (np.arange(order.shape[1]) < ix.probes)
                limit = np.full(len(q), np.inf)
                far = _square(asked, lifted)
                far[ix.sample_ids[None, :] == ids[:, None]] = np.inf
                if far.shape[1] > k:
                    limit = np.partition(far, k - 1, axis=1)[:, k - 1].astype(float) * (1 + 1e-4) + SLACK
                row, col = np.nonzero(take & (many[order] > 0))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query").take(at), pa.array(ids[row]), batch.column("v").take(at), pa.array(order[row, col].astype(np.int32)), pa.array(np.where(free[row, col], np.inf, limit[row]))], ["query", "query_id", "q", "list", "limit"]
                )

    parts = max(spark.sparkContext.defaultParallelism, n // every // QUERIES_A_TASK)
    asking = materialize(rows.where(F.col("vec_id") % every == 0).repartition(parts, "vec_id").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    queries = materialize(asking.mapInArrow(probe, f"query long, query_id long, q {kind}, list int, limit double"), "probes")
    asked = queries.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("qs"))
    grid = F.broadcast(listed.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("vs")).join(asked, "list"))  # a row for each list
    left = queries.join(grid, "list").select("list", F.pmod(F.xxhash64("query", F.lit(1)), "qs").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vb"), "query", "query_id", "q", "limit")
    right = listed.join(grid, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), F.pmod(F.xxhash64("vec_id", F.lit(2)), "vs").cast("int").alias("vb"), "vec_id", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            q, ids, score, own, number = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64))
        else:
            own, number = a["query_id"].to_numpy(), a["query"].to_numpy()
            q, ids, score = scan(shipped.value, _matrix(a["q"], dim), own, a["limit"].to_numpy(), _matrix(b["v"], dim), b["vec_id"].to_numpy(), k)
        return pa.table({"query": number[q], "query_id": own[q], "vec_id": ids, "score": score})

    keys = ["list", "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, RESULT)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
