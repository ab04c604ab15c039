import random
import re
from collections import Counter

import pytest

from logsieve.llm import repetition as R


def brute(text, least=6):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    eight = {k for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    covered, top = set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                covered |= {*range(i, i + k), *range(j, j + k)}
                top = max(top, k)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(R.SYMBOLS, text or "")), len(lines) - len(set(lines)), len(eight), len(covered), top


def texts_of(seed):
    rnd = random.Random(seed)
    out = ["", " \n\t", "one", "a " * 50, "a b " * 40, "x\x0by\x1cz\n\nx\x0by\x1cz\n", "ü# *é\n" * 9, "l1\nl2\nl1\n \n \nl1"]
    for _ in range(25):
        words = rnd.choices("abcdefg"[: rnd.randrange(2, 8)], k=rnd.randrange(120)) if rnd.random() < 0.6 else [str(rnd.randrange(500)) for _ in range(rnd.randrange(150))]
        for _ in range(rnd.randrange(3)):
            i, k = rnd.randrange(len(words) + 1), rnd.randrange(30)
            words += words[i : i + k]
        out.append("".join(w + rnd.choice([" ", " ", "\n", "  "]) for w in words))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_against_brute_force(seed):
    texts = texts_of(seed)
    for group in (texts, texts[:1], texts[1:2], [texts[-1]]):
        got = R.judge(group, 6, 0.25, 60)
        want = [brute(t) for t in group]
        columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
        assert [tuple(r) for r in got[columns].to_numpy().tolist()] == want
        for spans, covered in zip(got.spans, got.covered_words):
            assert sum(s["stop"] - s["start"] for s in spans) == covered
        for r, w in zip(got.itertuples(), want):
            failed = w[0] < 20 or 100 * w[4] > 30 * w[0]
            assert r.base_failed == failed and r.kept == (not failed and w[5] <= 0.25 * w[0] and w[6] <= 60)


def test_long_text():
    rnd = random.Random(3)
    words = [str(rnd.randrange(10**6)) for _ in range(200_000)]
    got = R.judge([" ".join(words + words[500:600]), "z " * 100_000], 6, 0.25, 60)
    assert got.longest_repeat.tolist()[0] >= 100 and got.longest_repeat.tolist()[1] == 99_999 and got.covered_words.tolist()[1] == 100_000
    assert got.kept.tolist() == [False, False]


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "q " * 30, 3), (2, " ".join(map(str, range(40))), None), (2, " ".join(map(str, range(40))), None)], "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in R.quality_rules(docs).collect())
    assert got == [(0, 30, True, False), (1, 0, True, False), (2, 40, False, True), (2, 40, False, True)]
    assert R.quality_rules(docs.limit(0)).count() == 0
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in R.quality_rules(documents).collect()}
    for r in documents.where("n_chars < 3000").collect():
        w = brute(r.text)
        assert (rows[r.doc_id].n_words, rows[r.doc_id].n_repeat_words, rows[r.doc_id].covered_words) == (w[0], w[4], w[5])


def test_labelled_quality(spark):
    got = R.quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    kept = {(r.quality, r.kept): r["count"] for r in got if not r.base_failed}
    assert kept[1, True] / (kept[1, True] + kept.get((1, False), 0)) > 0.99
