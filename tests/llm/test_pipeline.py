import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from logsieve.llm.bpe import default_path
from logsieve.llm.suffix_dedup import removed_bytes
from tests.llm.test_suffix_dedup import brute

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    """Every stage against its own input: what it takes away, and that clean documents stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.materialize(stage(spark, seen[-1], SF), "test"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "secrets", "packing"]
    assert all(x.columns == columns for x in seen[:5])
    rows = [{r.doc_id: r for r in x.collect()} for x in seen[:5]]

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = rows[0].keys() - rows[1].keys()
    assert sum(labels.get(d) == 0 for d in gone) <= 3 and sum(labels.get(d) == 1 for d in gone) >= 30

    # One row of each group stays: brute force over all pairs, by sets of five-word shingles.
    def sets(text):
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "", re.A)]
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {""}

    each, first, where = {d: sets(r.text) for d, r in rows[1].items()}, {}, {}
    for d, x in each.items():
        for one in x:
            where.setdefault(one, []).append(d)
    find = lambda d: d if first.setdefault(d, d) == d else find(first[d])
    for d, x in each.items():
        met = Counter(o for one in x for o in where[one] if o < d)
        for o, n in met.items():
            if n >= 0.8 * (len(x) + len(each[o]) - n):
                a, b = sorted((find(d), find(o)))
                first[b] = a
    assert rows[2].keys() == {find(d) for d in each}

    facts = {r[0]: r for r in brute([(d, r.text) for d, r in rows[2].items()], 200)}
    for d, r in rows[2].items():
        if facts[d][2] == 0:
            assert rows[3][d].text == r.text
        else:
            left = rows[3][d].text if d in rows[3] else ""
            assert len(r.text.encode()) - len(left.encode()) >= facts[d][2] or d not in rows[3]

    assert rows[3].keys() == rows[4].keys()
    for d, r in rows[3].items():
        planted = re.findall(r'token = "[0-9a-f]{40}"', r.text, re.I)
        assert not re.search(r'token = "[0-9a-f]{40}"', rows[4][d].text, re.I)
        assert rows[4][d].n_chars == len(rows[4][d].text) or rows[4][d].text == rows[0][d].text
        if not planted:
            assert abs(len(rows[4][d].text) - len(r.text)) < 60

    library = Tokenizer.from_file(default_path())
    want = set()
    for d, r in rows[4].items():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        want |= {(d, k, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in seen[5].collect()} == want


def test_run_equals_its_stages(spark):
    one = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert one.count() > 0 and "sequence_id" in one.columns
    assert removed_bytes(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count() == 200


def test_stages_on_odd_rows_and_on_none(spark):
    """Nulls in every column, empty texts, repeated rows, a long text, and columns that clash with our own names."""
    long = " ".join(f"w{i}" for i in range(60_000))
    secret = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "some plain words here", "en", "s", 21), (3, "some plain words here", "en", "s", 21), (None, "other plain words", None, None, 17), (4, long, "de", None, len(long)), (5, secret, None, "s", len(secret))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("k1", "k2", "kept", "copies", "fp", "score", "new", "c0", "row", "component_id", "toxic", "predicted", "length", "shard"):
        docs = docs.selectExpr("*", f"'{name}' as {name}")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            was, now = now, corpus_pipeline.materialize(stage(spark, now, "/root/testdata/sf0.001"), "odd")
            if name != "packing":
                assert now.columns == docs.columns and all(r[c] == c for r in now.collect() for c in docs.columns[5:])
        if empty:
            assert now.count() == 0
            continue
        left = sorted((r.doc_id or 0, r.text, r.n_chars) for r in was.collect() if r.text and len(r.text) < 100)
        assert left == [(0, "other plain words", 17), (3, "some plain words here", 21), (5, 'x token = "[SECRET:assignment]" y', 33)]
        assert {r.doc_id for r in was.collect()} == {None, 1, 3, 4, 5} and sum(r.length for r in now.where("doc_id = 4").collect()) > 60_000
