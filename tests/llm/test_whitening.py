import math

import numpy as np
import pytest

from logsieve.llm import whitening as W

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, k=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector) pairs, in whole numbers and numpy's own solver."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    if not width:
        return {}
    y = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return {(i, c + 1): (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), abs((np.array(v) - np.array(sums) / n) @ u[:, c] / math.sqrt(e[c])) if e[c] > width * 1e-15 * e[0] else None, e[c] / e.sum() if e.sum() else None) for i, v in kept for c in range(min(k, width))}


def held_against(got, rows):
    want = plain(rows)
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want)
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert (r.whitened is None) == (whitened is None) and (whitened is None or math.isclose(abs(r.whitened), whitened, rel_tol=1e-8, abs_tol=1e-8))
        assert explained is None or math.isclose(r.explained, explained, rel_tol=1e-9)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error is None or r.identity_error < 1e-9 for r in got)


@pytest.fixture
def run(spark, tmp_path):
    def go(df):
        df.write.parquet(f"{tmp_path}/embeddings.parquet")
        return W.op11_whitening(spark, str(tmp_path)).collect()

    return go


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_query_equals_the_plain_way_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    held_against(W.op11_whitening(spark, f"/root/testdata/sf{sf}").collect(), rows)


def test_signs_are_the_same_for_all_rows(spark):
    got = W.op11_whitening(spark, "/root/testdata/sf0.01").collect()
    z = {(r.vec_id, r.component): r.whitened for r in got}
    ids = sorted({i for i, _ in z})
    m = np.array([[z[i, c] for c in range(1, 5)] for i in ids])
    assert np.allclose(m.T @ m / len(m), np.eye(4), atol=1e-3)


def test_rows_that_take_no_part_copies_and_clashing_columns(spark, run):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # a vector that most rows have
    rows += [(7, rows[5][1]), (None, rows[6][1])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (203, [float("inf")] + [0.0] * 5), (204, [-float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + bad], f"{KIND}, x string, whitened int")
    got = run(df)
    assert len(got) == 4 * len(rows) and sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 7 for r in got) == 8
    want = plain([(-1 if i is None else i, np.float32(v).tolist()) for i, v in rows])
    for r in got:
        n, deviation, whitened, explained = want[-1 if r.vec_id is None else r.vec_id, r.component]
        if r.vec_id != 7:
            assert (r.n, r.deviation) == (n, deviation) and math.isclose(abs(r.whitened), whitened, rel_tol=1e-8, abs_tol=1e-8) and math.isclose(r.explained, explained)
    assert got[0].n == 40


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None)],
        [(1, [])],
        [(1, [0.5, 0.25])],  # one vector: no variance
        [(1, [0.5, 0.25]), (2, [0.5, 0.25])],
        [(1, [0.5, 0.25, 1.0]), (2, [0.5, -0.25, 1.0])],  # one direction only
        [(1, [0.5, 0.25]), (2, [0.5]), (3, [0.5, 0.0]), (4, [])],  # short ones are filled up
    ],
)
def test_few_and_short_vectors(run, spark, rows):
    held_against(run(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)), rows)


def test_large_entries_stay_exact(spark, run):
    rows = [(i, [float(2**40 + i), float(-(2**40)), float(i * i)]) for i in range(6)]
    got = run(spark.createDataFrame([(i, v, 0) for i, v in rows], KIND.replace("float", "double")))
    want = plain(rows)
    assert {(r.vec_id, r.component): r.deviation for r in got} == {k: v[1] for k, v in want.items()}
    assert W._deviation(np.array([[2**62, 0], [1, 0]]), 3, [5, 0]) == [None, 4]


def _known(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 60, 60),
        np.r_[5.0, 5.0 + 1e-9, 5.0 + 2e-9, 3.0, 3.0 + 1e-12, 1.0],  # clusters that single precision can't tell apart
        np.r_[np.full(10, 2.0), np.full(5, 1.0), 0.0],  # equal ones
        np.r_[7.0, 1e-7, 2e-7, 1e-12, 0.0, 0.0],
        np.geomspace(1e-10, 1e6, 40),
        np.r_[np.linspace(1, 1 + 1e-6, 30), np.linspace(2, 2 + 1e-10, 30)],
        np.zeros(4),
        [3.0],
    ],
)
def test_refined_eigenvectors(values):
    a = _known(list(values))
    e, x = W.symmetric_eigen(a)
    norm = max(np.abs(a).sum(axis=1).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ x - x * e).max() / norm < 1e-14 * max(10, len(a))
    assert np.all(np.diff(e) <= 1e-15 * norm) and np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-14 * norm * len(a), rtol=0)


def test_refinement_is_needed():
    a = _known(np.linspace(1, 2, 50))
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    e = np.einsum("ij,ij->j", single, a @ single)
    assert np.abs(a @ single - single * e).max() > 1e-8


def test_general_interface_gives_every_component(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    from pyspark.sql import functions as F

    vectors = W.whole_vectors(rows, F.col("embedding"))
    model = W.fit(vectors)
    assert model.components.shape == (64, 64) and model.identity_error < 1e-9 and math.isclose(sum(model.explained), 1)
    z = np.array([r.whitened for r in W.apply(vectors, model, "vec_id").collect()])
    assert np.abs(z.T @ z / len(z) - np.eye(64)).max() < 1e-9
