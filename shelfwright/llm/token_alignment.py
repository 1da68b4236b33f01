"""Cross-tokenizer alignment by inverted pair bitmaps (12).

Every text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with
byte fallback).  Byte offsets where both end a token cut the tokens into
groups; an A and a B token whose byte ranges overlap are a link, of the pair
of their ids.

The index is inverted: per pair a compressed bitmap of the documents that hold
it, in blocks of ``DOCS`` documents, with planes that spell its multiplicity
there in binary.  Bitmaps are sparse lists of 64-bit words; those of a block's
parts are OR-merged where the texts are read.  Pop counts of the bitmaps, summed
by Spark, are a pair's documents and, weighted by plane, its links in the whole
corpus.  Then the postings return the scores: each block's bitmaps add their
pair's counts to the documents whose bits are set.

Only rows of (block, pair) are shuffled, never links or texts, and a pair that
every document holds has one row a block.  A block is bounded by documents and
bytes; a longer text is a block of its own.

Texts that are null, empty or that the tokens don't spell have zeros and an
empty ``groups_sha256``.  Documents that repeat (even the doc_id) each count
and have a row each; a null doc_id is an id.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship_by_value, stage, worker_store
from .packing import _byte_letters

ship_by_value(__name__)

#: Documents and bytes of a block; bytes of texts aligned at once.
DOCS, BLOCK_BYTES, PART_BYTES = 4096, 8 << 20, 1 << 20
WORDS = DOCS // 64
#: Blocks whose documents a task sums at once.
OPEN_BLOCKS = 256
#: Ids below 2**ID_BITS; places (plane, word) below 2**PLACE_BITS.
ID_BITS, POS_BITS, PLACE_BITS = 20, DOCS.bit_length() - 1, 12

INDEX = ("block long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "a int, b int, docs long, links long, places binary, words binary")


# ------------------------------------------------------------------ tokens

class ByteLevel:
    """Ids and token bytes of a byte-level BPE vocabulary (JSON).  Where ids
    follow the order of the merges they are ranks and the faster library
    encodes; its own library does otherwise and where that one fails."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.path, self.own, self.fast = path, None, None
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order == sorted(order) and sorted(ranks.values()) == list(range(len(ranks))):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001 - a panic of the native code on an extreme text
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
            self.own.encode_special_tokens = True
        return self.own.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Tokenizers(NamedTuple):
    a: ByteLevel
    b: Pieces
    a_lengths: np.ndarray
    b_lengths: np.ndarray
    names: list[bytes]  # decimal id and what follows it, three an id


def _tokenizers(path_a: str, path_b: str, pattern: str) -> Tokenizers:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store, key = worker_store(), ("alignment", path_a, path_b, pattern)
    if key not in store:
        a, b = ByteLevel(path_a, pattern), Pieces(path_b)
        most = max(len(a.bytes), len(b.bytes))
        if most > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")
        store[key] = Tokenizers(a, b, np.array([len(t) for t in a.bytes]), np.array([len(t) for t in b.bytes]),
                                [b"%d%s" % (i, end) for i in range(most) for end in (b",", b"|", b";")])
    return store[key]


class Aligned(NamedTuple):
    """Per text: tokens, groups, links and the groups' digest; per link: text
    number and the ids."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(texts: list[str | None], t: Tokenizers) -> Aligned:
    """Tokens, groups and links of some texts, all at once: their bytes laid
    end to end."""
    n = len(texts)
    given = [k for k, x in enumerate(texts) if x]
    ids_a, ids_b = [[]] * n, [[]] * n
    for k, found in zip(given, t.b.encode([texts[k] for k in given]) if given else []):
        text, own = " " + texts[k], t.a.encode(" " + texts[k])
        raw = text.encode()
        if b"".join(map(t.a.bytes.__getitem__, own)) == raw == b"".join(map(t.b.bytes.__getitem__, found)):
            ids_a[k], ids_b[k] = own, found
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a = np.fromiter((i for x in ids_a for i in x), np.int64, int(n_a.sum()))
    b = np.fromiter((i for x in ids_b for i in x), np.int64, int(n_b.sum()))
    ends_a, ends_b = np.cumsum(t.a_lengths[a]), np.cumsum(t.b_lengths[b])
    size = int(ends_a[-1]) + 1 if len(a) else 1
    is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
    is_a[ends_a], is_b[ends_b] = True, True
    cuts = np.flatnonzero(is_a | is_b)  # a link ends at each: the tokens that cover the bytes before it
    cut_a, cut_b = is_a[cuts], is_b[cuts]
    both = cut_a & cut_b
    at_a, at_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    of_a = np.repeat(np.arange(n), n_a)
    text = of_a[at_a]
    n_groups = np.bincount(text[both], minlength=n)
    n_links = np.bincount(text, minlength=n)
    # the groups as text: tokens of A, then of B, group by group
    group = np.cumsum(both) - both
    group_a, group_b = group[cut_a], group[cut_b]
    total = int(both.sum())
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=total)), np.cumsum(np.bincount(group_b, minlength=total))
    parts = np.empty(len(a) + len(b), np.int64)
    if len(a):
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        before_b = upto_b - np.bincount(group_b, minlength=total)
        parts[np.arange(len(a)) + before_b[group_a]] = 3 * a + last_a
        parts[np.arange(len(b)) + upto_a[group_b]] = 3 * b + 2 * last_b
    names, where, digests = list(map(t.names.__getitem__, parts.tolist())), np.cumsum(n_a + n_b).tolist(), []
    for lo, hi in zip([0, *where], where):
        digests.append(hashlib.sha256(b"".join(names[lo:hi])[:-1]).hexdigest() if hi > lo else "")
    return Aligned(n_a, n_b, n_groups, n_links, digests, text, a[at_a], b[at_b])


# ------------------------------------------------------------------ bitmaps

def or_merge(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of equal keys (pair and place) joined by OR, in order of keys."""
    order = np.argsort(keys, kind="stable")
    keys, words = keys[order], words[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.bitwise_or.reduceat(words, first) if len(first) else words


def bitmaps(pair: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair and place, word) of links: plane 0 has the documents' bits, the
    planes above spell the multiplicity less one."""
    keys, times = np.unique(pair << POS_BITS | pos, return_counts=True)
    out_keys, out_words, plane, rest = [], [], 0, times - 1
    while True:
        in_plane = np.ones(len(keys), bool) if plane == 0 else (rest >> (plane - 1)) & 1 == 1
        k = keys[in_plane]
        at = k & (DOCS - 1)
        out_keys.append((k >> POS_BITS) << PLACE_BITS | (plane * WORDS + (at >> 6)))
        out_words.append(np.uint64(1) << (at & 63).astype(np.uint64))
        if not (rest >> plane).any():
            break
        plane += 1
    if (plane + 1) * WORDS > 1 << PLACE_BITS:
        raise ValueError("a pair has too many links in one text")
    return or_merge(np.concatenate(out_keys), np.concatenate(out_words))


def _weights(places: np.ndarray) -> np.ndarray:
    """Links that a bit of each place stands for."""
    plane = places // WORDS
    return np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0))


def _strings(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary cells: ``values`` cut at ``first``."""
    cuts = (np.append(first, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values))])


def _posting_rows(block: int, keys: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    pair, places = keys >> PLACE_BITS, keys & ((1 << PLACE_BITS) - 1)
    bits = np.bitwise_count(words).astype(np.int64)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    docs = np.add.reduceat(np.where(places < WORDS, bits, 0), first)
    links = np.add.reduceat(bits * _weights(places), first)
    pair = pair[first]
    whole = {"block": pa.array(np.full(len(first), block)), "a": pa.array((pair & ((1 << ID_BITS) - 1)).astype(np.int32)),
             "b": pa.array((pair >> ID_BITS).astype(np.int32)), "docs": pa.array(docs), "links": pa.array(links),
             "places": _strings(places.astype(np.uint16), first), "words": _strings(words, first)}
    yield from _rows(whole, len(first))


def _rows(columns: dict[str, pa.Array], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of the index; columns that are not given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in INDEX.split(", ")]
    batch = pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(n, kinds[k]) for f, k in fields],
                                       names=[f for f, _ in fields])
    for lo in range(0, n, 1 << 15):
        yield batch.slice(lo, 1 << 15)


class _Block:
    """The block that a task fills."""

    def __init__(self, block: int) -> None:
        self.block, self.docs, self.bytes = block, 0, 0
        self.keys: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str | None], size: int, t: Tokenizers) -> Iterator[pa.RecordBatch]:
        x = align(texts, t)
        keys, words = bitmaps(x.b << ID_BITS | x.a, x.text + self.docs)
        self.keys.append(keys)
        self.words.append(words)
        n = len(texts)
        yield from _rows({
            "block": pa.array(np.full(n, self.block)), "pos": pa.array(np.arange(self.docs, self.docs + n, dtype=np.int32)),
            "doc_id": pa.array(ids, pa.int64()), "n_a": pa.array(x.n_a), "n_b": pa.array(x.n_b), "n_groups": pa.array(x.n_groups),
            "n_links": pa.array(x.n_links), "groups_sha256": pa.array(x.digests)}, n)
        self.docs, self.bytes = self.docs + n, self.bytes + size

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield from _posting_rows(self.block, *or_merge(np.concatenate(self.keys), np.concatenate(self.words)))


def pair_index(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, pattern: str) -> DataFrame:
    """The index as a written table: a row per document (``pos`` is its bit in
    its block) and a row per block and pair (``pos`` is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = _tokenizers(tokenizer_a, tokenizer_b, pattern)
        task, made = TaskContext.get().partitionId(), 0
        block = _Block(task << 32)
        ids: list = []
        texts: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, made, ids, texts, size
            if texts:
                yield from block.add(ids, texts, size, t)
                ids, texts, size = [], [], 0

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = len(text or "")
                if block.docs + len(texts) >= DOCS or block.bytes + size + own > BLOCK_BYTES and block.docs + len(texts):
                    yield from flush()
                    yield from block.close()
                    made += 1
                    block = _Block(task << 32 | made)
                elif size + own > PART_BYTES:
                    yield from flush()
                ids.append(i)
                texts.append(text)
                size += own
        yield from flush()
        yield from block.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(run, INDEX), "pair-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, docs, links, best) per pair of ids: documents and links in the
    whole corpus, and whether no other pair of its B id has more links."""
    counts = stage(index.filter("pos IS NULL").groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")),
                   "pair-counts")
    most = counts.groupBy(F.col("b").alias("of")).agg(F.max("links").alias("most"))
    return counts.join(most, F.col("b") == F.col("of")).select("a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def returned(index: DataFrame, scores: DataFrame) -> DataFrame:
    """(block, pos, n_best, count_sum, docs_sum) per document with links: the
    bitmaps carry their pair's scores to the documents."""
    score = scores.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("docs").alias("in_docs"),
                          F.col("links").alias("in_links"), F.col("best").cast("long").alias("best"))
    postings = index.filter("pos IS NULL").select("block", "a", "b", "places", "words")
    # both sides grow: always a merge of two shuffles, whatever their size
    scored = (postings.join(stage(score, "pair-scores").hint("merge"), (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")))
              .select("block", "places", "words", "best", "in_links", "in_docs"))

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, s in sums.items():
            pos = np.flatnonzero(s[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pos), block)), pa.array(pos.astype(np.int32)), *(pa.array(x[pos]) for x in s)],
                names=["block", "pos", "n_best", "count_sum", "docs_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            block, places, words = (batch.column(k) for k in range(3))
            at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1] // 8
            place = np.frombuffer(places.buffers()[2], np.uint16)[at[0]:at[-1]].astype(np.int64)
            word = np.frombuffer(words.buffers()[2], np.uint64)[at[0]:at[-1]]
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            blocks, of = np.unique(block.to_numpy(), return_inverse=True)
            local = np.zeros((3, len(blocks) * DOCS), np.int64)
            weight = _weights(place)
            given = [batch.column(k).to_numpy()[row] * weight for k in (3, 4, 5)]
            base = of[row] * DOCS + (place % WORDS) * 64
            for lo in range(0, len(word), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                bits = np.flatnonzero(np.unpackbits(word[part].view(np.uint8), bitorder="little"))
                entry = lo + (bits >> 6)
                pos = base[entry] + (bits & 63)
                for s, g in zip(local, given):
                    np.add.at(s, pos, g[entry])
            for k, b in enumerate(blocks.tolist()):
                s = local[:, k * DOCS:(k + 1) * DOCS]
                sums[b] = sums[b] + s if b in sums else s.copy()
            if len(sums) > OPEN_BLOCKS:
                yield from emit(sums)
                sums = {}
        yield from emit(sums)

    parts = scored.repartition("block").mapInArrow(run, "block long, pos int, n_best long, count_sum long, docs_sum long")
    return parts.groupBy("block", "pos").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum", "docs_sum")))


def align_documents(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, pattern: str) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, docs_sum`` (the sum of its links' document counts)."""
    index = pair_index(docs, tokenizer_a, tokenizer_b, pattern)
    scores = returned(index, pair_counts(index)).select(
        F.col("block").alias("of"), F.col("pos").alias("bit"), "n_best", "count_sum", "docs_sum")
    rows = index.filter("pos IS NOT NULL")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(scores.hint("merge"), (F.col("block") == F.col("of")) & (F.col("pos") == F.col("bit")), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("docs_sum"))
