"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern.  Tier one: a
minimal perfect hash over the vocabulary maps every pre-token that is an entry
to its rank in a vectorised probe.  Tier two: the rest is merged by a heap of
adjacent pairs over a doubly linked list of bytes, lowest rank first, leftmost
first among equals.  Every task gets the tables by broadcast; rows never move.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import require

CACHE = 1_000_000
#: Pre-tokens that a codec keeps in each of two generations where memory counts more than time: 15 MB of them in all.
SMALL = 1 << 15
#: Ids or bytes that gather before they leave a task, so that no batch of texts is held with all that it becomes.
FLUSH = 1 << 18
#: Letters and numbers of Unicode 16.0 that Python's own tables of 15.1 lack.
NEWER = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}


def read_ranks(path: str) -> dict[bytes, int]:
    """The bytes and rank of every line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of distinct byte strings onto 0..n-1, with the keys kept to verify hits.

    Keys that land alone in a level's bit table stay there, the others go to
    the next level; a key's number is the count of set bits before its own.
    """

    GAMMA = 2

    def __init__(self, keys: list[bytes]) -> None:
        code = _codes(keys)
        left, self.levels, found, before = np.arange(len(keys)), [], [], 0
        while len(left):
            size, level = max(64, self.GAMMA * len(left)), len(self.levels)
            if level > 64:
                raise ValueError("keys are repeated or share a 64-bit code")
            slot = _slots(code[left], level, size)
            alone = np.bincount(slot, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + before
            self.levels.append((size, alone, rank))
            here = alone[slot]
            found.append((rank[slot[here]], left[here]))
            before += int(alone.sum())
            left = left[~here]
        self.code_at = np.zeros(len(keys), dtype=np.uint64)
        self.key_at = np.zeros(len(keys), dtype=np.int64)
        for number, key in found:
            self.key_at[number], self.code_at[number] = key, code[key]
        self.keys = keys

    def find(self, words: list[bytes]) -> list[int]:
        """The index in the key list of every word, -1 for words that are no keys."""
        if not words:
            return []
        code = _codes(words)
        out, left = np.full(len(words), -1, dtype=np.int64), np.arange(len(words))
        for level, (size, alone, rank) in enumerate(self.levels):
            slot = _slots(code[left], level, size)
            here = alone[slot]
            number, at = rank[slot[here]], left[here]
            same = self.code_at[number] == code[at]
            out[at[same]] = self.key_at[number[same]]
            left = left[~here]
        return [k if k >= 0 and self.keys[k] == w else -1 for k, w in zip(out.tolist(), words, strict=True)]


def _codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit code of every byte string, vectorised over all of them."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    total, end = np.zeros(len(data) + 1, dtype=np.uint64), np.cumsum(length)
    start = end - length
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ _mix(place)), out=total[1:])
        return _mix(total[end] - total[start] + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(code: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mix(code ^ np.uint64(level * 0x9E3779B9 + 1)) % np.uint64(size)).astype(np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: pairs leave a heap in order of rank, over linked bytes."""
    n = len(piece)
    bits = n.bit_length()
    low, get = (1 << bits) - 1, ranks.get
    # after[i] ends the part that starts at i (0: i starts none), back[i] starts the part before it
    after, back = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        key = heappop(heap)
        i, end = key >> bits & low, key & low
        mid = after[i]
        if not mid or mid == n or after[mid] != end:
            continue
        after[i], after[mid] = end, 0
        if end < n:
            back[end] = i
            right = after[end]
            if (r := get(piece[i:right])) is not None:
                heappush(heap, (r << bits | i) << bits | right)
        h = back[i]
        if h >= 0 and (r := get(piece[h:end])) is not None:
            heappush(heap, (r << bits | h) << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


@lru_cache
def splitter(pattern: str, last: int = sys.maxunicode) -> re.Pattern | regex.Pattern:
    r"""`pattern` for texts without code points above `last`.

    It is compiled for `re`, which is some times faster than `regex`, by
    spelling out \p{L}, \p{N} and \s as ranges; a pattern with other Unicode
    properties stays with `regex`.
    """
    pattern = pattern.replace(r"(?!\S)", r"(?![^\s])")
    if re.search(r"\\p\{(?!L\}|N\})|\\[PSwWdDbB]", pattern):
        return regex.compile(pattern)
    inside, out = False, []
    for part in re.split(r"(\\p\{L\}|\\p\{N\}|\\s|\\.|\[|\])", pattern):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            out.append(_ranges(part, last) if inside else f"[{_ranges(part, last)}]")
            continue
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return re.compile("".join(out))


@lru_cache
def _ranges(kind: str, last: int) -> str:
    """The code points of a property up to `last` as the inside of a character class."""
    space = regex.compile(r"\p{White_Space}")
    bounds = [[int(x, 16) for x in r.split("-")] for r in NEWER.get(kind[3:4], "").split()]
    newer = {chr(c) for b in bounds for c in range(b[0], b[-1] + 1)}
    has = space.match if kind == r"\s" else lambda c: unicodedata.category(c)[0] == kind[3] or c in newer
    spans: list[list[int]] = []
    for c in range(last + 1):
        if has(chr(c)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


class Codec:
    """Encodes texts to ids and ids to bytes; holds a bounded cache of pre-tokens.

    The cache has two generations of `most` each: a full one grows old, and the
    one before it goes but for what has been met again since, so that common
    pre-tokens stay and memory does not grow with the texts seen.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = CACHE // 2) -> None:
        self.most = most
        self.ranks = ranks
        self.pattern = pattern
        self.table = PerfectHash(list(ranks))
        self.id_at = list(ranks.values())
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "old": {}}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null counts as empty."""
        text = text or ""
        tokens = splitter(self.pattern, sys.maxunicode if ASTRAL.search(text) else 0xFFFF).findall(text)
        if len(self.cache) > self.most:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        if new := set(tokens).difference(cache):
            # not new.intersection(old), which would walk all of a dict
            if again := {t for t in new if t in old}:
                cache.update((t, old[t]) for t in again)
                new -= again
            raw = [t.encode("utf-8", "surrogatepass") for t in new]
            for t, piece, k in zip(new, raw, self.table.find(raw), strict=True):
                cache[t] = (self.id_at[k],) if k >= 0 else tuple(merge(piece, self.ranks))
        return list(chain.from_iterable(map(cache.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; unknown ids raise KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _runs(column: pa.Array, f: Callable) -> Iterator[tuple[int, list]]:
    """(first row, results) of `f` over the values of `column`, a run ending once its results have FLUSH items."""
    first, out, n = 0, [], 0
    for i, value in enumerate(column):
        out.append(f(value.as_py()))
        n += len(out[-1])
        if n >= FLUSH:
            yield first, out
            first, out, n = i + 1, [], 0
    if out:
        yield first, out


def _codec(spark: SparkSession, path: str, pattern: str, most: int = CACHE // 2):
    """The codec of a rank file, broadcast; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Codec(read_ranks(path), pattern, most))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids array<int>) of every row, as the vocabulary's own library would encode it.

    Null and empty texts give no ids, repeated rows repeated rows, an empty
    table an empty one; other columns are left out.
    """
    require(docs, id_col, text_col)
    codec, kind = _codec(docs.sparkSession, path, pattern, SMALL), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, ids in _runs(b.column(1), codec.value.encode):
                own = b.column(0).slice(at, len(ids))
                yield pa.RecordBatch.from_arrays([own, pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "token_ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, decoded binary) of every row of ids; a null list gives no bytes, an unknown id an error."""
    require(tokens, id_col, ids_col)
    codec, kind = _codec(tokens.sparkSession, path, pattern), tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, out in _runs(b.column(1), lambda ids: codec.value.decode(ids or [])):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(out)), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("token_ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row, and return digests of both instead of the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    require(docs, id_col, text_col)
    codec, kind = _codec(docs.sparkSession, path, pattern), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        decimal = {i: str(i) for i in c.bytes_of}
        for b in batches:
            n, a, d = [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
