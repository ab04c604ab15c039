import itertools
import random

import numpy as np
import pytest

from logsieve.llm import toxicity as T
from logsieve.llm.shared import held_out_py


@pytest.mark.parametrize("stretch", [2, 3, 5, 64])
def test_forward_backward_equals_enumeration(monkeypatch, stretch):
    """Of whole texts: the length of the stretches leaves no trace."""
    monkeypatch.setattr(T, "STRETCH", stretch)
    rnd = np.random.default_rng(3)
    factor, bounds, moves = rnd.normal(size=23), np.array([0, 0, 7, 12, 23, 23]), np.exp(rnd.normal(size=(2, 2)))
    p, expected = T.chain(factor, bounds, moves, pairs=True)
    want, pairs = np.zeros(23), np.zeros((2, 2))
    for a, b in ((0, 7), (7, 12), (12, 23)):
        total = 0.0
        for ys in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(factor[a + i] for i, y in enumerate(ys) if y)) * np.prod([moves[i, j] for i, j in zip(ys, ys[1:])])
            total += w
        for ys in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(factor[a + i] for i, y in enumerate(ys) if y)) * np.prod([moves[i, j] for i, j in zip(ys, ys[1:])]) / total
            want[a:b] += w * np.array(ys)
            for i, j in zip(ys, ys[1:]):
                pairs[i, j] += w
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_a_span_reaches_beyond_any_stretch():
    """What lies 64 tokens back or ahead counts: the same as in one long stretch, in texts of many stretches too."""
    factor = np.full(10_000, -2.0)
    factor[60:64] = 6.0
    factor[4000:4003] = 5.0
    bounds, moves = np.array([0, 3000, 10_000]), np.array([[1.0, 0.1], [0.1, 6.0]])
    p, _ = T.chain(factor, bounds, moves)
    ahead, behind = np.zeros(10_000), np.ones(10_000)
    for a, b in ((0, 3000), (3000, 10_000)):
        ahead[a] = np.exp(factor[a])
        for t in range(a + 1, b):
            ahead[t] = np.exp(factor[t]) * (ahead[t - 1] * moves[1, 1] + moves[0, 1]) / (ahead[t - 1] * moves[1, 0] + moves[0, 0])
        for t in range(b - 2, a - 1, -1):
            g = np.exp(factor[t + 1]) * behind[t + 1]
            behind[t] = (moves[1, 1] * g + moves[1, 0]) / (moves[0, 1] * g + moves[0, 0])
    assert np.allclose(p, ahead * behind / (1 + ahead * behind), rtol=1e-9) and p[64] > 0.3


def test_tokens_of_odd_texts():
    words, index, bounds = T.tokens(["", " \n", "A b  a\n", "\x0bx\x1cy z "])
    assert [[words[i] for i in index[a:b]] for a, b in zip(bounds, bounds[1:])] == [[], [], ["a", "b", "a"], ["x\x1cy", "z"]]


def test_learned_words_and_spans(spark):
    rnd = random.Random(1)
    clean = lambda n: " ".join("".join(rnd.choices("aeioubcdst", k=rnd.randrange(2, 8))) for _ in range(n))
    texts, marks = [], []
    for i in range(400):
        words = clean(rnd.randrange(5, 150)).split()
        if i % 2:
            for _ in range(rnd.randrange(1, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vile,", "VILE!!", "rotten", "Scorn."]))
        texts.append(" ".join(words))
        marks.append(i % 2)
    model = T.train(texts, marks)
    docs = spark.createDataFrame([(1, "xx yy VILE*** zz " + clean(30)), (2, clean(500)), (3, None), (None, "rotten scorn"), (4, ""), (4, "")], "doc_id long, text string").selectExpr("*", "0.5 as score")
    got = {(r.doc_id, r.score >= 0.5): [(s.start, s.stop) for s in r.spans] for r in T.score(docs, model).collect()}
    assert got == {(1, True): [(6, 13)], (2, False): [], (3, False): [], (None, True): [(0, 6), (7, 12)], (4, False): []}
    assert T.score(docs.limit(0), model).count() == 0


def test_one_class_only():
    assert (T.train(["a b", "c d"], [0, 0]).documents(np.zeros(0), np.array([0, 0])) < 0.5).all()
    assert (T.train([], []).documents(np.zeros(0), np.array([0, 0])) < 0.5).all()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in T.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == held_out_py(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [(got[d].score, y) for d, y in labels.items() if d in got and got[d].held_out]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    accuracy = np.mean([(s >= 0.5) == y for s, y in test])
    print("auc", auc, "accuracy", accuracy, "recall", np.mean([p >= 0.5 for p in pos]), "false", np.mean([n >= 0.5 for n in neg]), len(pos), len(neg))
    assert auc > 0.85 and accuracy > 0.93


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = T.drop_toxic(spark, docs, "/root/testdata/sf0.01")
    assert kept.schema == docs.schema
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = kept.join(labels, "doc_id").groupBy("toxic").count().collect()
    left = {r.toxic: r["count"] for r in left}
    assert left[0] >= 345 and left[1] <= 25


def test_stage_judges_each_row_by_its_text(spark, monkeypatch):
    texts = ["vile rotten scorn " * 3 + f"a{i} b{i} c{i} d{i}" if i % 2 else f"kind words e{i} f{i} g{i} h{i}" for i in range(400)]
    model = T.train(texts, [i % 2 for i in range(400)])
    monkeypatch.setattr(T, "fit", lambda docs, labels: model)
    rows = [(None, texts[1]), (None, texts[0]), (7, texts[3]), (7, texts[2]), (8, None)]
    kept = T.drop_toxic(spark, spark.createDataFrame(rows, "doc_id long, text string"), "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, texts[0]), (7, texts[2]), (8, "")]


def test_late_texts_are_learned_from(monkeypatch):
    """Blocks of any size give the same model, and the last toxic texts count like the first."""
    rnd = random.Random(2)
    noise = lambda: " ".join("".join(rnd.choices("aeioubcdst", k=5)) for _ in range(60))
    early = [f"{noise()} vile {noise()} vile {noise()} vile {noise()} vile" for _ in range(1200)]
    late = [f"{noise()} rotten" for _ in range(100)]
    texts = [noise() for _ in range(300)] + early + late
    model = T.train(texts, [0] * 300 + [1] * 1300, rounds=20)
    assert "rotten" in model.own and model.own["rotten"] > model.other[0] + 0.5
    monkeypatch.setattr(T, "BLOCK_TOKENS", 1 << 30)
    whole = T.train(texts, [0] * 300 + [1] * 1300, rounds=20)
    assert np.allclose(model.affix, whole.affix, atol=1e-3) and np.allclose(model.moves, whole.moves, rtol=1e-3)
