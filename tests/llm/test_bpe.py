import hashlib
import random
import sys
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from logsieve.llm import bpe as module
from logsieve.llm.bpe import WORDS, WordBpe, default_path, digests, encode_documents, split_words


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def same(library, texts, bpe=None):
    bpe = bpe or WordBpe(default_path())
    for text, (ids, decoded) in zip(texts, bpe.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:200]
        assert decoded.decode() == library.decode(want, skip_special_tokens=False), text[:200]
        assert bpe.decode(np.frombuffer(ids, "<u4")) == decoded.decode()


HARD = ["", " ", "aaa aaaa aaaaaaa", "It's we'll they've I'd 'S 'LL o'clock", "ΟΔΟΣ Σ ΑΣΑ", "İstanbul ǅ ß ẞ", "é Å ẛ̣", "a\x1cb\x1d\x1e c\x85d\xa0e f​g", "x<|endoftext|>Y <|startoftext|><|endoftext|> <|end", "1234 ½ ² Ⅷ ٣", "漢字かな 한국어 \U0001f600\U0001f468‍\U0001f469", "\x00\x01\x7f", "a" * 5000, "ab" * 3000 + "!" * 500, "=" * 999 + "\n\t\r"]


def test_hard_texts(library):
    same(library, HARD)


def test_every_character_of_the_basic_plane(library):
    assigned = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    same(library, ["a" + "a ".join(assigned[i : i + 500]) + "b" for i in range(0, len(assigned), 500)])


def test_every_code_point_between_letters_and_alone(library):
    bpe = WordBpe(default_path())
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000]
    texts = [f"a{chr(c)}b {chr(c)}" for c in [*every, *range(0x40000, 0xE0000, 997)]]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        want = library.encode_batch(part, add_special_tokens=False)
        got = bpe.encode_batch(part, decoded=False)
        assert [np.frombuffer(a, "<u4").tolist() for a, _ in got] == [w.ids for w in want]


def test_marks_in_any_order(library):
    rnd = random.Random(8)
    marks = [chr(c) for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c))]
    bases = [*"aeé'1 ", *map(chr, range(0x1100, 0x1108)), *map(chr, range(0x1161, 0x1168)), "\u11a8", "\U00011935", "\U00011930", "\u1c89", "\ua7cb"]
    same(library, ["".join(rnd.choice(bases) + "".join(rnd.choices(marks, k=rnd.randrange(4))) for _ in range(8)) for _ in range(5000)])
    same(library, [b + m + n for b in "aé" for m in marks for n in "\u0323\u0315\u0345"])


def test_random_words_and_small_cache(library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdeéèß .,'\n-1THE", k=rnd.randrange(400))) for _ in range(300)]
    same(library, texts)
    small = WordBpe(default_path(), cache_bytes=20_000)
    for i in range(0, 300, 50):
        same(library, texts[i : i + 50], small)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in digests(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "hello hello", None), (2, "hello hello", "y"), (2, "hello hello", "y")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, len(r.ids) // 4, r.decoded) for r in encode_documents(docs).collect())
    assert got == [(0, 2, "hello</w> hello</w>"), (1, 0, ""), (1, 0, ""), (2, 2, "hello</w> hello</w>"), (2, 2, "hello</w> hello</w>")]
    assert digests(docs.limit(0)).count() == 0


def test_words_are_what_the_pattern_finds(library):
    rnd = random.Random(5)
    texts = ["", "'", "'s", " '", "''s", "'s's 'sst'll'l'llll !'ve've' s 'r e'\n'", *("".join(rnd.choices("'''stmdrevla1\xb2\xe9!\u2014\x85\xa0\u2003\x1c\u6f22\U0001f600\u0301 \n", k=rnd.randrange(30))) for _ in range(20_000))]
    words, bounds = split_words(texts)
    found = [w.decode() for w in words.to_pylist()]
    assert [found[a:b] for a, b in zip(bounds, bounds[1:])] == [WORDS.findall(t) for t in texts]
    same(library, texts[:3000])


def test_long_texts_are_cut_at_spaces(library, monkeypatch):
    monkeypatch.setattr(module, "_STRETCH", 40)
    rnd = random.Random(6)
    same(library, ["".join(rnd.choices("abcé'.\n ", k=rnd.randrange(400))) + rnd.choice(["", "<|endoftext|>", "<|endoftext|>it's " * 9]) for _ in range(200)])
    same(library, ["x" * 100 + " y" * 100, " " * 90, "\u2003" * 90, "<|endoftext|>" * 3 + " " * 50 + "<|endoftext|>"])


def test_python_does_not_handle_single_words():
    """The calls made for a batch depend on its texts, not on how many different words it has."""
    rnd = random.Random(7)
    made = ["".join(rnd.choices("abcdefgh", k=5)) + f"-{n}." for n in range(20_000)]

    def calls(words):
        bpe, n = WordBpe(default_path()), 0

        def count(frame, event, arg):
            nonlocal n
            n += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            bpe.encode_batch([" ".join(words)], decoded=False)
        finally:
            sys.setprofile(None)
        return n

    WordBpe(default_path()).encode_batch(["a"])  # tables that are built once
    assert calls(made) < 2 * calls(made[:500])
