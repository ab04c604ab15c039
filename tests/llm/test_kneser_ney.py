import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from logsieve.llm import kneser_ney as K
from logsieve.llm.shared import held_out_py

TEXTS = ["the cat sat on the mat", "the dog sat on the log.\nThe END!", "a b c", "Éte é", "", "кот сидел на столе", "猫坐在桌子上", "the cat sat on 12 mats", "the cat sat on the mat"]


def slow_model(texts):
    """Interpolated modified Kneser-Ney over dictionaries; None stands for a text's start."""
    symbols = [[None] * 4 + ["0" if c in "0123456789" else c for c in t] for t in texts]
    counts = {5: Counter(tuple(s[i - 4 : i + 1]) for s in symbols for i in range(4, len(s)))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, kinds, discount = {}, {}, {}
    for k, table in counts.items():
        n = [sum(v == c for v in table.values()) for c in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
        discount[k] = [min(max(v, lo), hi) for v, lo, hi in zip(d, (0, 0.05, 0.05, 0.05), (0, 0.95, 1.9, 2.9))]
        total[k], kinds[k] = defaultdict(int), defaultdict(float)
        for g, v in table.items():
            total[k][g[:-1]] += v
            kinds[k][g[:-1]] += discount[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k = len(g)
        if not total[k][g[:-1]]:
            return p(g[1:])
        v = counts[k][g]
        return (v - discount[k][min(v, 3)]) / total[k][g[:-1]] + kinds[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])

    return p


def test_model_equals_the_definition(spark):
    """Both ways of scoring, on texts that were counted, on others, and on signs of any script that were not."""
    model = K.train(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    p = slow_model(TEXTS)
    asked = [*TEXTS, "the mat sat", "кот на мате 猫", "\U0001f600 new", "\x00", "99 cats", "x" * 3000]
    want = [-sum(math.log(p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))) for s in ([None] * 4 + ["0" if c in "0123456789" else c for c in t] for t in asked)]
    docs = spark.createDataFrame(list(enumerate(asked)) + [(4, asked[4]), (0, asked[0])], "doc_id long, text string")
    for limit in (0, K.SHIPPED_BYTES):
        rows = K.perplexities(docs, model, shipped_bytes=limit).collect()
        assert len(rows) == len(asked) + 2
        for r in rows:
            n = len(asked[r.doc_id])
            assert r.n_symbols == n and (r.perplexity is None if not n else math.isclose(math.log(r.perplexity) * n, want[r.doc_id], rel_tol=1e-5)), asked[r.doc_id]


def test_batches_don_t_show(spark, monkeypatch):
    """Joined scores don't depend on how texts are dealt to batches, nor counts on how often a task gives them on."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = K.train(docs.where("text is not null"))
    monkeypatch.setattr(K, "TASK_GRAMS", 1000)
    monkeypatch.setattr(K, "BATCH_CHARS", 20_000)
    two = K.train(docs.where("text is not null"))
    shipped, joined = ({r.doc_id: r.perplexity for r in K.perplexities(docs, m, n).collect()} for m, n in ((one, K.SHIPPED_BYTES), (two, 0)))
    assert shipped.keys() == joined.keys() and all(math.isclose(shipped[d] or 0, joined[d] or 0, rel_tol=1e-4) for d in shipped)


def test_order_counts_in_any_script(spark):
    """Russian and Chinese texts are told from their own characters, and words, in another order."""
    rnd = random.Random(3)
    russian = "мама мыла раму отец читал газету дети играли во дворе кошка спала на окне вечером все пили чай с вареньем и слушали радио".split()
    chinese = "我 今天 早上 去 学校 学习 中文 老师 给 我们 讲 了 一个 有趣 的 故事 然后 大家 一起 吃 午饭 下午 在 图书馆 看书".split()
    pairs = lambda ws: {w: rnd.sample(ws, 3) for w in ws}

    def text(follow, joint, n=60):
        out = [rnd.choice(list(follow))]
        while len(out) < n:
            out.append(rnd.choice(follow[out[-1]]))
        return joint.join(out)

    made = [(pairs(russian), " "), (pairs(chinese), "")]
    good = [text(f, j) for f, j in made for _ in range(150)]
    model = K.train(spark.createDataFrame([(t,) for t in good], "text string"))
    fresh = [text(f, j) for f, j in made for _ in range(20)]
    letters = ["".join(rnd.sample(t, len(t))) for t in fresh]
    words = [" ".join(rnd.choices(russian, k=60)) for _ in range(20)] + ["".join(rnd.choices(chinese, k=60)) for _ in range(20)]
    got = {r.doc_id: r.perplexity for r in K.perplexities(spark.createDataFrame(list(enumerate([*fresh, *letters, *words])), "doc_id long, text string"), model).collect()}
    for low in (0, 20):
        worst = max(got[i] for i in range(low, low + 20))
        assert worst < min(got[40 + i] for i in range(low, low + 20)) and worst < min(got[80 + i] for i in range(low, low + 20))


def test_verdicts_against_a_plain_version(spark):
    """The whole query's thresholds and verdicts, from its perplexities: nearest-rank quantiles by language, ties kept."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = K.classify(docs, labels, quantile=0.9).collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not held_out_py(r.doc_id) and zlib.crc32(str(r.doc_id).encode()) % 5 == 1}
    by = defaultdict(list)
    for r in rows:
        if r.doc_id in good and r.perplexity is not None:
            by[None].append(r.perplexity)
            by[r.lang].append(r.perplexity)
    rank = lambda x: sorted(x)[max(0, math.ceil(0.9 * len(x)) - 1)]
    for r in rows:
        limit = rank(by[r.lang] if len(by[r.lang]) >= K.LEAST_TRUSTED else by[None])
        assert math.isclose(r.threshold, limit, rel_tol=1e-9) and r.kept == (r.perplexity is not None and r.perplexity <= limit)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, "plain words in a row %d" % i, "en") for i in range(120)] + [(500, None, "en"), (501, "", None), (None, "plain words in a row 1", None), (503, "plain words in a row 7" * 30_000, "en"), (502, "\U0001f600\U0001f600%%%%###", "xx"), (502, "\U0001f600\U0001f600%%%%###", "xx")], "doc_id long, text string, lang string").withColumn("perplexity", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(None, 1), (502, None)], "doc_id long, quality int")
    rows = K.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    kept = {(r.doc_id, r.kept) for r in rows if r.doc_id is None or r.doc_id >= 500}
    assert kept == {(500, False), (501, False), (None, True), (502, False), (503, False)}
    bare = K.classify(docs, labels.limit(0)).collect()
    assert all(r.kept == bool(r.n_symbols) and r.threshold is None for r in bare)
    assert K.classify(docs.limit(0), labels).count() == 0


def test_shuffled_ids_give_the_same(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one = sorted((r.doc_id, round(r.perplexity, 6), r.kept) for r in K.classify(docs, labels).collect())
    monkeypatch.setattr(K, "BROADCAST_IDS", 0)
    assert one == sorted((r.doc_id, round(r.perplexity, 6), r.kept) for r in K.classify(docs, labels).collect())


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in K.op10_quality_lm(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if held_out_py(r.doc_id)}
    good = np.mean([got[d].kept for d, q in labels.items() if q])
    bad = np.mean([got[d].kept for d, q in labels.items() if not q])
    pos, neg = [got[d].perplexity for d, q in labels.items() if q], [got[d].perplexity for d, q in labels.items() if not q]
    print("kept of good", good, "kept of bad", bad, "auc", np.mean([(n > p) + 0.5 * (n == p) for p in pos for n in neg]))
    assert good > 0.97 and bad < 0.6
