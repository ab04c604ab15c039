import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logsieve.llm import suffix_dedup as S


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(d)]
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc_id, len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_multikey_order():
    rnd = np.random.default_rng(1)
    cols = [rnd.integers(0, 4, 500), rnd.integers(0, 4, 500), rnd.integers(0, 9, 500)]
    assert [tuple(c[i] for c in cols) for i in S.multikey_order(cols)] == sorted(zip(*cols))


def test_equal_windows_name_equal_grams():
    rnd = random.Random(2)
    shared = bytes(rnd.choices(b"abc", k=400))
    data = [bytes(rnd.choices(b"abc", k=n)) + shared + bytes(rnd.choices(b"abc", k=50)) for n in (0, 7, 300)] + [b"ab" * 300, b"x" * 500, b"short"]
    owner, low, many, at = S.runs(data, 60, 12)
    names = {}
    for o, p, m, a in zip(owner, low, many, at):
        for w in range(p, p + m):
            name = data[o][a : a + 12], a - w
            assert 0 <= a - w <= 48 and names.setdefault(data[o][w : w + 60], name) == name
    assert sum(many) == sum(max(0, len(d) - 59) for d in data)


def rows_of(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abdeé ", k=rnd.randrange(1, 6)))
    text = lambda n: "".join(word() for _ in range(n))
    passage, copy = text(60), text(120)
    rows = [(i, text(rnd.randrange(0, 80))) for i in range(25)]
    rows += [(100 + i, text(rnd.randrange(30)) + passage[i : len(passage) - 2 * i] + text(rnd.randrange(30))) for i in range(25)]
    rows += [(200 + i, copy) for i in range(5)] + [(300 + i, copy[:150] + "#" + copy[150 + i :]) for i in range(6)]
    rows += [(400, "=" * 700), (401, "=-" * 200), (402, text(20) + passage + text(5) + passage), (403, None), (404, ""), (None, copy), (405, "é" * 300), (406, "x" * 60), (406, "x" * 60)]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"bucket_rows": 40}), (3, {"group_limit": 3, "bucket_rows": 60}), (4, {"group_limit": 1, "bucket_rows": 25})])
def test_against_brute_force(spark, seed, options):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as k1", "1 as h").repartition(3)
    assert got(S.removed_bytes(docs, length=60, gram=16, **options)) == brute(rows, 60)


def test_long_text_in_segments(spark, monkeypatch):
    rnd = random.Random(9)
    long = "".join(rnd.choices("abcdefgh", k=9000))
    rows = [(1, long), (2, long[2000:5000] + "z" * 30 + long[100:400]), (3, long[:50])]
    monkeypatch.setattr(S, "_CHUNK", 700)
    monkeypatch.setattr(S, "_SEGMENT", 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.removed_bytes(docs, length=60, gram=16)) == brute(rows, 60)


def test_documents_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(S.removed_bytes(docs)) == brute(rows, 200)
    assert got(S.removed_bytes(docs.limit(0))) == []


def test_stage(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choices("abcdefg ", k=n))
    shared = text(250)
    rows = [(1, "one:" + shared + " end", "en", 5), (2, shared, "de", 5), (3, "lone", "fr", 4), (4, None, None, None), (5, "two;" + shared, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    kept = S.cut_repeats(spark, docs, "")
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "one: end", "en", 8), (3, "lone", "fr", 4), (4, None, None, None), (5, "two;", "en", 4)], key=repr)
