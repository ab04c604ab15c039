"""BPE encoding and decoding in batched numpy merge rounds.

``WordBpe`` reads the vocabulary file of a public word-end BPE tokenizer (canonical composition, lower
case, white space dropped, byte-level symbols, ``</w>`` on the last symbol of a word) and gives the ids
that the tokenizers library gives.

Texts are cut into words by the kinds of their code points, many texts in one flat array. The symbols of
many words lie in one flat array, too. A round looks every neighbouring pair up by binary search over the
sorted pair keys, takes the lowest rank of each word and merges all its occurrences at once; finished
words leave the array. Words that are already known are taken from a bounded cache, so only new words are
merged.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers

from logsieve.llm.shared import small_batches, table

#: Fixed values of the tokenizer: its word pattern and the characters it takes as white space.
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Letters and numbers that are newer than the tokenizer's own tables, where they are symbols.
NEW_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
NEW_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
LETTER, NUMBER = rf"[\p{{L}}--[{NEW_LETTERS}]]", rf"[\p{{N}}--[{NEW_NUMBERS}]]"
WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|[^{SPACE}{LETTER}{NUMBER}]+")
#: The kinds of code points; ``_KIND`` masks them in ``kinds()``.
_LETTER, _NUMBER, _SYMBOL, _KIND = 1, 2, 3, 3
#: From here on no text is composed and put in lower case by Python's data.
_BEYOND = chr(0x33480)

NONE = np.int64(1) << 40
_CACHE_BYTES = 16 << 20
_ROUND_BYTES = 1 << 20
#: Characters that are split at once; texts beyond are cut at a space.
_STRETCH = 8 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@cache
def unsure_characters() -> frozenset[str]:
    """Characters below ``_BEYOND`` that Python's Unicode data may compose, order or lower unlike the tokenizer's.

    Those it doesn't assign, and those whose combining class or decomposition is younger than Unicode 3.2
    (older ones are stable by Unicode's policy).
    """
    old, found = unicodedata.ucd_3_2_0, []
    for c in map(chr, range(128, ord(_BEYOND))):
        if unicodedata.category(c) == "Cn" or unicodedata.combining(c) != old.combining(c) or unicodedata.decomposition(c) != old.decomposition(c):
            found.append(c)
    return frozenset(found)


@cache
def _library_normal() -> normalizers.Sequence:
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


@cache
def kinds() -> np.ndarray:
    """What each code point is to ``WORDS`` (0: white space), and four times its bytes in UTF-8 (white space: 0)."""
    found = np.full(0x110000, _SYMBOL | 4 * 4, np.uint8)
    for least, size in ((0x10000, 3), (0x800, 2), (0x80, 1)):
        found[:least] = _SYMBOL | 4 * size
    below = "".join(map(chr, range(0x40000)))  # beyond are neither letters nor numbers
    for kind, one in ((_LETTER, LETTER), (_NUMBER, NUMBER)):
        for run in regex.finditer(f"(?V1){one}+", below):
            found[run.start() : run.end()] -= _SYMBOL - kind
    for run in regex.finditer(f"[{SPACE}]+", below):
        found[run.start() : run.end()] = 0
    return found


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What ``WORDS`` finds in each text, as one array of UTF-8, and where each text's words begin and end in it."""
    points = np.frombuffer("\n".join(["", *texts, "", ""]).encode("utf-32-le"), np.uint32)
    known = kinds()[points]
    kind = known & _KIND
    begins = kind != 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    # 's, 't, 'm, 'd, 're, 've and 'll: the mark is a whole run of symbols, letters follow.
    at = np.flatnonzero(points == ord("'"))
    at = at[begins[at] & (kind[at + 1] == _LETTER)]
    one, two = points[at + 1], points[at + 2]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(np.isin(one, [*map(ord, "stmd")]), 2, 3 * long)
    at, size = at[size > 0], size[size > 0]
    begins[at + 1] = False
    begins[at + size] |= kind[at + size] == _LETTER
    first = np.flatnonzero(begins)
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    sizes = np.add.reduceat(known >> 2, first, dtype=np.int64) if len(first) else first
    data = points[kind != 0].tobytes().decode("utf-32-le").encode()
    return _strings(data, sizes), np.searchsorted(first, starts)


def _strings(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary strings of ``sizes`` that lie in ``data`` one behind the other."""
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary strings, one behind the other, and where each begins and ends in them."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _joined(lists: np.ndarray, strings: pa.Array) -> pa.Array:
    """The strings of each list, joined by spaces; list i is from ``lists[i]`` to ``lists[i + 1]``."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(lists, pa.int64()), strings), pa.scalar(b" ", pa.large_binary()))


class WordBpe:
    def __init__(self, path: str, cache_bytes: int = _CACHE_BYTES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix, symbols = model["vocab"], model["end_of_word_suffix"], _byte_symbols()
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.merged = keys, first.astype(np.int64), made[first]
        self.by_rank = np.zeros(len(pairs), np.int64)
        self.by_rank[first] = made[first]
        self.token_bytes = pa.array([self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)], pa.large_binary())
        self.cache_bytes, self.decoded = cache_bytes, True
        self._forget()

    def _forget(self) -> None:
        """Known words, their ids (little-endian, 32 bits) and, if asked for, their decoded text."""
        self.words = self.ids = self.texts = pa.array([], pa.large_binary())

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (bytes one behind the other, none empty) in one array, and how many each word has."""
        ends = np.cumsum(lengths) - 1
        symbol = self.inner[flat]
        symbol[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbol), NONE)
        rank[:-1] = self._rank(symbol[:-1], symbol[1:])
        rank[ends] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = low < NONE
            if not live.all():
                done.append((word[~live], symbol[~live]))
                word, symbol, rank, low = word[live], symbol[live], rank[live], low[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == low)
            # Of overlapping occurrences (a a a) every other one from the left is merged.
            runs = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(runs, np.diff(runs, append=len(hit)))) % 2 == 0]
            symbol[hit] = self.by_rank[rank[hit]]
            rank[hit] = rank[hit + 1]  # the end of a word stays one
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(word)]
                i = i[word[i] == word[i + 1]]
                rank[i] = self._rank(symbol[i], symbol[i + 1])
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        symbol = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(lengths))

    def _learn(self, words: pa.Array, decoded: bool) -> tuple[pa.Array, pa.Array]:
        """Ids (little-endian, 32 bits) and, if asked for, decoded text of each word."""
        data, offsets = _parts(words)
        at, done = 0, []
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _ROUND_BYTES, "right")) - 1)
            done.append(self.merge(data[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1])))
            at = to
        ids, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        texts = _joined(np.concatenate(([0], np.cumsum(counts))), self.token_bytes.take(pa.array(ids))) if decoded else self.texts[:0]
        return _strings(ids.astype("<u4"), 4 * counts), texts

    def _normal(self, text: str) -> str:
        """Composed and in lower case; the few texts with a character of ``unsure_characters`` by the library's normalizer."""
        if not text or text.isascii():
            return text.lower()
        used = set(text)
        if max(used) >= _BEYOND or not unsure_characters().isdisjoint(used):
            return _library_normal().normalize_str(text)
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _known(self, words: pa.Array, decoded: bool) -> np.ndarray:
        """Places of distinct words in the cache, newly merged where they weren't in it."""
        if decoded != self.decoded:
            self.decoded = decoded
            self._forget()
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        new = at < 0
        if new.any():
            fresh = words.filter(pa.array(new))
            ids, texts = self._learn(fresh, decoded)
            if sum(x.nbytes for x in (self.words, self.ids, self.texts, fresh, ids, texts)) > self.cache_bytes:
                held = pa.array(at[~new])
                self.words, self.ids, self.texts = self.words.take(held), self.ids.take(held), self.texts.take(held) if decoded else self.texts
                at[~new] = np.arange(len(held))
            at[new] = np.arange(len(self.words), len(self.words) + len(fresh))
            self.words, self.ids, self.texts = (pa.concat_arrays(x) for x in ((self.words, fresh), (self.ids, ids), (self.texts, texts)))
        return at

    def _encode_plain(self, texts: list[str], decoded: bool) -> list[tuple[bytes, bytes]]:
        """Normal texts without special tokens: their distinct words are encoded, then dealt out to the texts."""
        words, bounds = split_words(texts)
        coded = words.dictionary_encode()
        word = pa.array(self._known(coded.dictionary, decoded)).take(coded.indices)
        data, offsets = _parts(self.ids.take(word))
        data, cuts = data.tobytes(), offsets[bounds].tolist()
        shown = _joined(bounds, self.texts.take(word)).to_pylist() if decoded else [b""] * len(texts)
        return [(data[a:b], x) for a, b, x in zip(cuts, cuts[1:], shown, strict=False)]

    def encode_batch(self, texts: list[str | None], decoded: bool = True) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers, and its decoded text in UTF-8."""
        out: list[list[tuple[bytes, bytes]]] = [[] for _ in texts]
        waiting, size = [], 0

        def flush() -> None:
            for (i, k, _), found in zip(waiting, self._encode_plain([t for _, _, t in waiting], decoded), strict=True):
                out[i][k] = found
            waiting.clear()

        for i, t in enumerate(texts):
            # A special token's own string cuts the text before all else; then long texts are cut at a space.
            for p, part in enumerate(self.special_split.split(t) if t and "<|" in t else [t or ""]):
                if p % 2:
                    out[i].append((self.special[part].to_bytes(4, "little"), part.encode()))
                    continue
                part, at = self._normal(part), 0
                while at < len(part):
                    to = len(part) if len(part) - at <= _STRETCH or (cut := part.find(" ", at + _STRETCH)) < 0 else cut
                    waiting.append((i, len(out[i]), part[at:to]))
                    out[i].append((b"", b""))
                    size, at = size + to - at, to
                    if size >= _STRETCH:
                        flush()
                        size = 0
        flush()
        return [x[0] if len(x) == 1 else (b"".join([a for a, _ in x]), b" ".join([b for _, b in x if b])) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by a space, special tokens included, as the vocabulary has no decoder."""
        return " ".join([self.tokens[i] for i in np.asarray(ids).tolist() if i in self.tokens])


@cache
def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each file and Python process."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row; ids are little-endian 32-bit integers.

    A null text is an empty one and has no ids; rows may repeat and doc_id may be null; other columns
    are ignored. Whole texts are encoded, however long.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for part in batches:
            found = bpe.encode_batch(part.text.tolist())
            yield pd.DataFrame({"doc_id": part.doc_id, "ids": [a for a, _ in found], "decoded": [b.decode() for _, b in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What ``encode_documents`` gives as counts and SHA-256 digests, without moving the ids."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for part in batches:
            found = bpe.encode_batch(part.text.tolist())
            yield pd.DataFrame({"doc_id": part.doc_id, "n_tokens": [len(a) // 4 for a, _ in found], "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in found], "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
