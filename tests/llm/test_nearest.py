import math

import numpy as np
import pytest

from logsieve.llm import nearest as N


def brute(ids, x, every=20, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in zip(ids, x) if j != i))[:k]
    return out


def compare(rows, want, least):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == {q for q, w in want.items() if w}
    hit = 0
    for q, w in want.items():
        found = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(w) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len({r.vec_id for r in found} & {j for _, j in w})
    recall = hit / max(1, sum(map(len, want.values())))
    assert recall >= least, recall
    return recall


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    data = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = data.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got = N.search(data).collect()
    print(sf, "recall", compare(got, brute(ids, x), 0.93))
    place = {j: v for j, v in zip(ids, x)}
    assert all(math.isclose(r.score, float(place[r.query_id] @ place[r.vec_id]), rel_tol=1e-12, abs_tol=1e-14) for r in got)


def test_norms_clusters_and_crowded_list(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 50)
    monkeypatch.setattr(N, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(300, 6)) * rng.uniform(0.1, 9, (300, 1)), np.tile([1.0, 2, 3, 4, 5, 6], (150, 1)), rng.normal(size=(100, 6)) * 0.01 + 5))
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    compare(N.search(data).collect(), brute(range(len(x)), x), 0.9)


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i % 7) + 1, float(i % 5) - 2, 1.0]) for i in range(1, 15)]
    bad = [(0, None), (20, [0.0, 0.0, 0.0]), (40, [1.0, None, 2.0]), (60, [float("nan"), 1.0, 1.0]), (80, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 2.0]), (120, [])]
    data = spark.createDataFrame([*good, *bad, (140, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as rank")
    ids, x = [i for i, _ in good] + [140], np.array([v for _, v in good] + [[1.0, 1.0, 1.0]])
    compare(N.search(data).collect(), brute(ids, x), 1.0)
    assert N.search(data.limit(0)).count() == 0
    assert N.search(data.where("vec_id = 140")).count() == 0


def test_repeated_rows_ids_and_ties(spark):
    """Equal rows are one query; every candidate row counts, ties go to the smaller id."""
    x = np.random.default_rng(5).integers(-2, 3, (60, 3)).astype(float)
    x[(x == 0).all(axis=1)] = 1.0
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(0, x[0].tolist()), (7, x[7].tolist()), (7, x[7].tolist()), (20, [2.0, -1.0, 1.0])]
    got = {}
    for r in N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, vectors in {0: [x[0]], 20: [x[20], np.array([2.0, -1.0, 1.0])], 40: [x[40]]}.items():
        want = []
        for v in vectors:
            best = sorted((-float(v @ np.array(w)), j) for j, w in rows if j != q)[:20]
            want += [(k, j, -s) for k, (s, j) in enumerate(best, 1)]
        assert sorted(got[q]) == sorted(want)


@pytest.mark.parametrize("size", [1e25, 1e-100, 1e160])
def test_sizes_at_the_edge_of_doubles(spark, size):
    x = np.random.default_rng(6).normal(size=(100, 8)) * size
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = N.search(data).collect()
    assert len(got) == 100
    if size < 1e100:
        compare(got, brute(range(100), x), 1.0)
    else:  # the products are beyond doubles: all of those found are infinite, and really so
        assert all(r.score == math.inf and float(x[r.query_id] / size @ (x[r.vec_id] / size)) > 0 for r in got)


@pytest.mark.parametrize("coarse_over", [1024, 8])
def test_recall_where_the_rows_exceed_the_sample(spark, coarse_over):
    """2,000 rows, fitted on 400; with one level of centres and with two."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(0, 20, 2000)]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    print("recall", compare(N.search(data, sample=400, coarse_over=coarse_over).collect(), brute(range(2000), x), 0.95))
