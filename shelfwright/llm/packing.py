"""Sequence packing by Karmarkar-Karp multiway differencing (10).

Tokenisation gives each document's ids plus the end id.  A document is cut at
the capacity, so its full pieces are sequences of their own, and a remainder
over ``MAX_ITEM`` ids is cut once more.  What is left is dealt into groups of
about ``GROUP_ITEMS`` items by a hash of its place in the written table, so
that rows which repeat spread as well; each group is partitioned into windows
by differencing: every item starts as a partial partition, the two with the
largest imbalance are merged with opposing orders until one is left.  Its
windows are nearly equal; while the fullest exceeds the capacity, the window
count rises and the differencing starts anew.  Nothing is cut then, so every
id lies in exactly one piece.

Null and empty texts have the end id alone.  Documents that repeat (even the
doc_id) are packed each on its own.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship_by_value, stage, text_or_empty, worker_store

ship_by_value(__name__)

CAPACITY, MAX_ITEM, GROUP_ITEMS = 4096, 1024, 1024
#: Words and pattern matches whose ids a Python worker remembers.
CACHED_WORDS, CACHED_PIECES = 800_000, 500_000

#: Python splits at these, the tokenizer doesn't: such texts are encoded whole.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Below U+0300 lower-casing commutes with the tokenizer's composition (NFC).
_BEYOND = re.compile("[̀-\U0010ffff]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable ones themselves, the others numbered from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never joins
    across it or special tokens' strings, so a text's ids are those of its words; each word, and each
    match of the tokenizer's pattern in one, is encoded once and remembered."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for words: what is left when they are cut out
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        # strings of special tokens are cut out of the raw text before anything else
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.matches = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [text]
        return (text if _BEYOND.search(text) else text.lower()).split()

    def _word(self, word: str) -> bytes:
        if _SEPARATORS.search(word) or _BEYOND.search(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        out = []
        for piece in self.matches(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                letters = piece.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
                self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        for text in texts:
            out = []
            for part in self.cuts.split(text) if self.cuts and self.cuts.search(text) else (text,):
                if part in self.special:
                    out.append(self.special[part])
                    continue
                words = self._words(part)
                for word in set(filterfalse(known.__contains__, words)):
                    known[word] = self._word(word)
                out += map(known.__getitem__, words)
            yield b"".join(out)


def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store = worker_store()
    if ("words", path) not in store:
        store["words", path] = WordEncoder(path)
    return store["words", path]


def cut_points(n: int, capacity: int = CAPACITY, max_item: int = MAX_ITEM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, then the remainder
    in pieces of ``max_item`` at most."""
    whole = n - n % capacity
    return ([(s, capacity) for s in range(0, whole, capacity)]
            + [(s, min(max_item, n - s)) for s in range(whole, n, max_item)])


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                  max_item: int = MAX_ITEM) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) per piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encoder = array("I", [end_id]).tobytes(), _encoder(tokenizer)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    out += [(doc, s, m, zlib.crc32(ids[4 * s:4 * (s + m)]), n)
                            for s, m in cut_points(n, capacity, max_item)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each window.  A partial partition is a
    descending array of window sums, less its smallest, with a chain of items
    for each window; merging adds the largest windows of one to the smallest
    of the other."""
    joins: list[tuple[int, int]] = []  # chain n + j holds the two chains joins[j]
    n = len(sizes)
    heap = []
    for k, size in enumerate(sizes):
        sums, chains = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], chains[0] = size, k
        heap.append((-(size if windows > 1 else 0), k, sums, chains))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, s, c = heapq.heappop(heap)
        _, tie, t, d = heapq.heappop(heap)
        t, d = t[::-1], d[::-1]
        both = np.flatnonzero((c >= 0) & (d >= 0))
        chains = np.where(c >= 0, c, d)
        for w in both:
            joins.append((int(c[w]), int(d[w])))
            chains[w] = n + len(joins) - 1
        sums = s + t
        order = np.argsort(-sums, kind="stable")
        sums, chains = sums[order], chains[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, chains))
    found = []
    for top in heap[0][3].tolist() if heap else []:
        items, open_ = [], [top] if top >= 0 else []
        while open_:
            x = open_.pop()
            if x < n:
                items.append(x)
            else:
                open_ += joins[x - n]
        found.append(sorted(items))
    return found


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; their count starts at the least
    possible and rises while the fullest window exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        over = max((sum(sizes[i] for i in w) for w in found), default=0) - capacity
        if over <= 0:
            return [w for w in found if w]
        windows += max(1, over * windows // (4 * capacity))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
         max_item: int = MAX_ITEM, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The pieces of :func:`cut_documents` with ``sequence_id`` and
    ``offset``; offsets of a sequence are gapless from 0."""
    pieces = stage(cut_documents(docs, tokenizer, end_id, capacity, max_item), "pieces")
    full = F.col("length") == capacity
    groups = max(1, -(-pieces.filter(~full).count() // group_items))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        sizes = pdf["length"].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for w, items in enumerate(pack_group(sizes, capacity)):
            at = 0
            for i in items:
                seq[i], off[i] = w, at
                at += sizes[i]
        return pdf.assign(sequence_id=pdf["grp"] * 2 ** 24 + seq, offset=off).drop(columns="grp")

    cols = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = dealt.filter(~full).groupBy("grp").applyInPandas(run, cols)
    # ids above those of the groups; one per full piece of the written table
    alone = dealt.filter(full).drop("grp").withColumn(
        "sequence_id", F.lit(2 ** 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)
