import random
import re

import xxhash
from pyspark.sql import functions as F

from logsieve.llm.components import connected_components
from logsieve.llm.near_copies import keep_first
from logsieve.llm.simhash import fingerprint, links, near_duplicates

MASK = (1 << 64) - 1


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance=2):
    """Brute force: smallest index reachable over pairs within the distance."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & MASK).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_matches_definition(spark):
    texts = [None, "", " \n", "One", "one TWO", "Ünï çode ÄÖ x\x0by\x1cz A B", "a b c a b c a b c", "w " * 200_000, " ".join(random.Random(1).choices("abcdefgh", k=300))]
    assert [fingerprint(t.encode() if t is not None else None) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h & MASK == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components_chain_star_and_duplicates(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2), (2, 3), (500, 501)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_equal_brute_force_in_cold_and_crowded_buckets(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    values = set(base) | {0, 1, 3, MASK}
    for b in base[:12]:
        for _ in range(30):
            values.add(b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 4))) & MASK)
    values = sorted(v & MASK for v in values)
    want = groups(values)
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for limit in (1, 4, 1000):
        pairs = [(r.u & MASK, r.v & MASK) for r in links(prints, bucket_limit=limit).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        if limit == 1000:
            assert {tuple(sorted(p)) for p in pairs} == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2}
        place = {v: i for i, v in enumerate(values)}
        root = list(range(len(values)))
        for _ in range(len(values)):
            changed = False
            for a, b in pairs:
                low = min(root[place[a]], root[place[b]])
                changed |= root[place[a]] != low or root[place[b]] != low
                root[place[a]] = root[place[b]] = low
            if not changed:
                break
        assert root == want


ROWS = [(5, "The quick brown fox jumps over the lazy dog again and again", "x"), (3, "the QUICK brown fox jumps over the lazy dog again and again", "y"), (9, None, "z"), (8, "", "z"), (7, "something else entirely is written in here", None), (7, "something else entirely is written in here", None), (None, "another text that has no id at all in it", None)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    kept = keep_first(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 7, 8]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = groups([slow_fingerprint(r.text) for r in rows])
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {r.doc_id: rows[w].doc_id for r, w in zip(rows, want)}
