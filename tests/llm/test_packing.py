import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from logsieve.llm.bpe import default_path
from logsieve.llm.packing import Bins, best_fit, improve, pack, pack_documents


def filled(sizes, number, offset, capacity):
    bins = {}
    for s, b, o in zip(sizes, number, offset):
        bins.setdefault(b, []).append((o, s))
    for held in bins.values():
        at = 0
        for o, s in sorted(held):
            assert o == at
            at += s
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_valid_and_never_worse_than_best_fit(seed):
    rnd = np.random.default_rng(seed)
    sizes = rnd.integers(1, [4097, 1500, 2200, 50, 4097, 1800][seed], [400, 900, 700, 3000, 1, 600][seed])
    number, offset, fill = pack(sizes)
    n = filled(sizes, number, offset, 4096)
    assert -(-sizes.sum() // 4096) <= n <= len(best_fit(np.sort(sizes)[::-1], list(range(len(sizes))), 4096).fill)
    assert [sizes[number == b].sum() for b in number] == fill.tolist()


@pytest.mark.parametrize("low,high", [(10, 50), (150, 400), (5, 90)])
def test_swaps_empty_bins_of_a_poor_start(low, high):
    saved = 0
    for seed in range(10):
        sizes = np.random.default_rng(seed).integers(low, high, 200)
        bins = best_fit(sizes, list(range(200)), 10 * high // 4)
        before, squares = len(bins.fill), sum(f * f for f in bins.fill)
        improve(bins, 0, 100_000)
        held = sorted(i for h in bins.held for _, i in h)
        assert held == list(range(200)) and all(sum(s for s, _ in h) == f <= bins.capacity for h, f in zip(bins.held, bins.fill))
        assert sum(f * f for f in bins.fill) >= squares
        saved += before - sum(map(bool, bins.held))
    assert saved > 0


def test_squared_fill_rises():
    bins = Bins(10)
    for held in ([4, 3], [5], [3]):
        bins.change(bins.new(), [], [(s, 10 * i + s) for i, s in enumerate(held)])
    assert bins.tightest(4) is not None and bins.tightest(8) is None


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(900001, None), (900002, ""), (None, "hello"), (900003, "x " * 9000)], "doc_id long, text string"), allowMissingColumns=True)
    library = Tokenizer.from_file(default_path())
    for shard_rows in (40_000, 60):
        rows = pack_documents(docs, shard_rows=shard_rows).collect()
        want = set()
        for r in docs.collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            for k, at in enumerate(range(0, len(ids), 4096)):
                want.add((r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())))
        assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
        n = filled([r.length for r in rows], [r.sequence_id for r in rows], [r.offset for r in rows], 4096)
        least = -(-sum(r.length for r in rows) // 4096)
        assert least <= n <= least + (1 if shard_rows == 40_000 else 8)
    assert pack_documents(docs.limit(0)).count() == 0
