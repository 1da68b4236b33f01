"""Byte-level BPE: encoding by ranked merges, decoding by concatenation (3).

A text is cut by the tokenizer's pattern; every distinct match is encoded once
by folding the ranked merges over its bytes (the adjacent pair whose joined
bytes have the lowest rank is merged first, leftmost of equals) and
remembered; a text's ids are the concatenation of its matches' ids.  Decoding
concatenates the ids' byte pieces.

The fold runs inside Arrow batches, where a Python worker keeps the rank map
and the words it has met.  :func:`fold_words` is the same fold in Spark
higher-order functions with a literal rank map, for tables of words; see the
README for why whole texts take the other way.

Null texts count as empty and have no ids.  Repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ship_by_value, text_or_empty, worker_store

ship_by_value(__name__)

#: Words and pattern matches that a Python worker remembers.
CACHED_WORDS, CACHED_PIECES = 600_000, 600_000
#: Longer matches are folded with a heap.
LONG_PIECE = 200
_NONE = 1 << 60

#: A space between two other characters always starts a new match.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_LOOSE = re.compile(r"\s | \s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def fold_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pattern match."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_PIECE:
        return _fold_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    rank = ranks.get
    pairs = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == _NONE:
            break
        i = pairs.index(low)
        merged = parts[i] + parts[i + 1]
        parts[i:i + 2] = [merged]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(merged + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + merged, _NONE)
    return [ranks[p] for p in parts]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in n log n steps: a linked list and a heap of pairs."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(path)
        self.pieces = {rank: word for word, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        #: ids by word; of a text's later words without the space before them
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        out = []
        for match in self.find(word):
            ids = self.matches.get(match)
            if ids is None:
                ids = array("I", fold_merges(match.encode(), self.ranks)).tobytes()
                self.matches[match] = ids
            out.append(ids)
        return b"".join(out)

    def _remember(self, known: dict[str, bytes], words: list[str], prefix: str) -> None:
        for word in set(filterfalse(known.__contains__, words)):
            known[word] = self._word(prefix + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.first) + len(self.later) > CACHED_WORDS:
            self.first.clear()
            self.later.clear()
        if len(self.matches) > CACHED_PIECES:
            self.matches.clear()
        words = _SPLIT.split(text) if _LOOSE.search(text) else text.split(" ")
        head, rest = words[:1], words[1:]
        self._remember(self.first, head, "")
        self._remember(self.later, rest, " ")
        return self.first[head[0]] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(path: str, pattern: str) -> Codec:
    store = worker_store()
    if ("bpe", path, pattern) not in store:
        store["bpe", path, pattern] = Codec(path, pattern)
    return store["bpe", path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as binary, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``bytes``: the ids' pieces joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                text = [codec.decode(i) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


# -- the same fold in Spark expressions, for a table of words ---------------

_SLOTS = 1 << 15


def _slot(word: Column) -> Column:
    return F.crc32(word).bitwiseAND(F.lit(_SLOTS - 1)).cast("int") + 1


def _literal_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: an array of short lists, by a hash of the
    bytes, because a map literal of this size is searched from end to end."""
    import zlib

    slots: list[list] = [[] for _ in range(_SLOTS)]
    for word, rank in ranks.items():
        slots[zlib.crc32(word) & (_SLOTS - 1)].append({"w": base64.b64encode(word).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<w:binary,r:int>>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``words`` (word binary) with ``ids``: one merge per step of an
    ``aggregate`` over the word's bytes, until no adjacent pair has a rank."""
    table = _literal_ranks(ranks)

    def rank(piece: Column) -> Column:
        hits = F.filter(F.element_at(table, _slot(piece)), lambda e: e["w"] == piece)
        return F.get(hits, F.lit(0))["r"]

    def merge(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
            rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        i = best["i"]
        joined = F.concat(F.slice(parts, F.lit(1), i - 1),
                          F.array(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))),
                          F.slice(parts, i + 2, F.size(parts)))
        return F.when((F.size(parts) < 2) | best.isNull(), parts).otherwise(joined)

    word = F.col("word")
    size = F.octet_length(word)
    parts = F.when(size == 0, F.array().cast("array<binary>")).otherwise(
        F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, 1)))
    folded = F.aggregate(F.when(size < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(2), size)), parts, merge)
    whole = rank(word)
    return words.select("word", F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank)).alias("ids"))
