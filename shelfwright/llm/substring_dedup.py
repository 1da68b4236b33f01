"""Substring dedup by recompression (8).

A window is WINDOW consecutive words of one document; every word covered by a
window whose word sequence starts anywhere else too is removed.

Recompression rounds rename a document's words: first runs of two equal words,
then, round after round, adjacent pairs whose left symbol falls into the left
and whose right symbol into the right half of all names (a hash bit decides).
A name is a hash of what it stands for, so the naming is global without a
lookup: equal substrings get equal symbols except near their ends.  Symbols
are kept to ``CAPS`` words, which bounds how far an end's influence reaches:
a round disturbs at most one symbol (or a short run) at either end of a
window, ``EDGE`` words in all.  Hence the symbols in a window's middle are the
same wherever its word sequence occurs, and so is the one of smallest priority
among them, the window's anchor.  Anchors whose symbol and context (the words
that all of the anchor's windows share) occur once are done with.  For the
others the windows themselves are hashed and counted, which verifies the
repeat over all its words.

Copies of a whole document are counted as such: their windows all occur
elsewhere, one of them stands for them in the comparison.  Counting keys and
windows are partial aggregates, and joining the repeated ones back runs on
written tables, where the adaptive skew-join rule splits a passage that a
third of all documents share.

A null text has no words.  Repeated rows are copies of each other.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._common import release_shuffles, ship_by_value, stage, text_or_empty, unstage

ship_by_value(__name__)

WINDOW = 35
#: Longest symbol in words after each round of pairs; runs name two words.
CAPS = (2, 3, 4)
#: Words at either end of a window whose symbols may depend on what is around.
EDGE = 2 + 2 + CAPS[0] + CAPS[1]
#: Symbols that start at these places lie in a window's undisturbed middle.
SPAN = WINDOW - 2 * EDGE - CAPS[-1] + 1
#: Words on either side of an anchor that all its windows share.
LEFT, RIGHT = EDGE, WINDOW - EDGE - SPAN + 1

_SALTS = np.random.default_rng(23).integers(1, 2 ** 63, 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_NEVER = np.uint64(2 ** 64 - 1)


def recompress(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol names and the word each one starts at; ``text`` numbers the
    document of every word."""
    name, start, doc = words, np.arange(len(words)), text
    size = np.ones(len(words), np.int64)

    def merge(first: np.ndarray, names: np.ndarray) -> None:
        nonlocal name, start, doc, size
        name, size = name.copy(), size.copy()
        name[first] = names
        size[first] += size[first + 1]
        keep = np.ones(len(name), bool)
        keep[first + 1] = False
        name, start, doc, size = name[keep], start[keep], doc[keep], size[keep]

    if len(name) < 2:
        return name, start
    same = np.zeros(len(name) + 2, bool)  # same[i + 1]: symbol i equals symbol i + 1
    same[1:-2] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    runs = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:])
    merge(runs, _words.mix(name[runs] * _SALTS[0]))
    for k, cap in enumerate(CAPS, 1):
        right = (_words.mix(name ^ _SALTS[k]) >> np.uint64(63)).astype(bool)
        pairs = np.flatnonzero(~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= cap))
        merge(pairs, _words.mix(name[pairs] * _SALTS[5] + name[pairs + 1] * _SALTS[6] + np.uint64(k)))
    return name, start


class Parsed:
    """Anchors and sequence hashes of a block of texts."""

    def __init__(self, column: pa.Array, lo: int, hi: int) -> None:
        with np.errstate(over="ignore"):
            self.words = w = _words.words(column, lo, hi)
            n, count = len(w.hashes), np.diff(w.of)
            text = np.repeat(np.arange(hi - lo), count)
            self.spans = self._doubled(w.hashes)
            name, start = recompress(w.hashes, text)
            names = np.zeros(n, np.uint64)
            names[start] = name
            self.names = names
            priority = np.full(n, _NEVER)
            priority[start] = _words.mix(name ^ _SALTS[7]) >> np.uint64(1)
            rest = np.repeat(w.of[1:], count) - np.arange(n)
            self.starts = np.flatnonzero(rest >= WINDOW)
            if len(self.starts):
                views = np.lib.stride_tricks.sliding_window_view(priority, SPAN)
                self.anchor = self.starts + EDGE + views[self.starts + EDGE].argmin(1)
            else:
                self.anchor = self.starts
            self.text = text

    @staticmethod
    def _doubled(hashes: np.ndarray) -> dict[int, np.ndarray]:
        """Hashes of the 2**k words from each place, for the spans that
        :meth:`sequence` needs; each is mixed from two of half the length."""
        needed, spans, size = {n.bit_length() - 1 for n in (WINDOW, LEFT + RIGHT)}, {}, 0
        now = hashes
        while True:
            if size in needed:
                spans[size] = now
            if size == max(needed):
                return spans
            half = min(1 << size, len(now))
            now = _words.mix(now[:len(now) - half] * _SALTS[9] + now[half:] * _SALTS[10] + np.uint64(size))
            size += 1

    def sequence(self, a: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``length`` words from each place of ``a``: two spans that
        cover them, which may overlap."""
        k = length.bit_length() - 1
        span = self.spans[k]
        with np.errstate(over="ignore"):
            return _words.mix(span[a] * _SALTS[11] + span[a + length - (1 << k)] * _SALTS[8] + np.uint64(length))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, key): the anchors and what must repeat around them."""
        at = np.unique(self.anchor)
        with np.errstate(over="ignore"):
            return at, _words.mix(self.sequence(at - LEFT, LEFT + RIGHT) + self.names[at] * _SALTS[8])


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): a row is named by its id and its text's hash."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"),
                       text.cast("binary").alias("text"))


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _parse(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n_words, sha, keys, places) per row; ``sha`` is that of
    the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for lo, hi in _words.blocks(text):
                p = Parsed(text, lo, hi)
                w, at, keys = p.words, *p.anchors()
                cut = np.searchsorted(at, w.of)
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in text.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(w.of)),
                     pa.array(sha),
                     _lists(cut, keys.astype(np.int64)),
                     _lists(cut, (at - w.of[p.text[at]]).astype(np.int32))],
                    names=["doc_id", "tid", "n_words", "sha", "keys", "places"])

    return _identified(docs).mapInArrow(run, "doc_id long, tid long, n_words long, sha string, "
                                             "keys array<long>, places array<int>")


def _windows(found: DataFrame) -> DataFrame:
    """(doc_id, tid, twice, hashes, starts) of the windows whose anchors are
    among ``places`` of ``found`` (doc_id, tid, twice, places, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(4)
            for lo, hi in _words.blocks(text):
                p = Parsed(text, lo, hi)
                w = p.words
                repeated = np.zeros(len(w.hashes), bool)
                for t, places in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist()):
                    repeated[np.array(places, np.int64) + w.of[t]] = True
                at = p.starts[repeated[p.anchor]]
                cut = np.searchsorted(at, w.of)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in range(3)),
                     _lists(cut, p.sequence(at, WINDOW).astype(np.int64)),
                     _lists(cut, (at - w.of[p.text[at]] if len(at) else at).astype(np.int32))],
                    names=["doc_id", "tid", "twice", "hashes", "starts"])

    return found.select("doc_id", "tid", "twice", "places", "text").mapInArrow(
        run, "doc_id long, tid long, twice boolean, hashes array<long>, starts array<int>")


def _remove(found: DataFrame) -> DataFrame:
    """(doc_id, tid, n_removed, kept) of rows with repeated window ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, left = [], []
            for starts, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.array(starts) + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                left.append(b" ".join(words[k] for k in np.flatnonzero(~gone)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(left, pa.binary())],
                names=["doc_id", "tid", "n_removed", "kept"])

    return found.select("doc_id", "tid", "starts", "text").mapInArrow(
        run, "doc_id long, tid long, n_removed long, kept binary")


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, tid), null ids included."""
    low = F.lit(-(2 ** 63))
    left = a.withColumn("_id", F.coalesce("doc_id", low))
    right = b.withColumn("_id", F.coalesce("doc_id", low)).drop("doc_id")
    return left.join(right, ["_id", "tid"], how).drop("_id")


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parsed`` rows of all documents with their number of ``copies``, and
    (doc_id, tid, starts, text) of those that have repeated windows without
    being copies."""
    spark = docs.sparkSession
    parsed = stage(_parse(docs), "parsed")
    groups = stage(parsed.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct(
        F.coalesce("doc_id", F.lit(-(2 ** 63))), "tid")).alias("first")), "copy-groups")
    rows = stage(parsed.select("doc_id", "tid", "n_words", "sha").join(groups, "sha").select(
        "doc_id", "tid", "n_words", "sha", "copies",
        (F.col("first") == F.struct(F.coalesce("doc_id", F.lit(-(2 ** 63))), F.col("tid"))).alias("leads")), "parsed-rows")
    counts = parsed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    keys = stage(counts.filter("n > 1").select("key"), "repeated-keys")
    release_shuffles(spark)
    at = stage(parsed.select("doc_id", "tid", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))).alias("a"))
               .select("doc_id", "tid", "a.key", "a.place").join(keys, "key", "left_semi").drop("key"), "repeated-anchors")
    unstage(parsed, groups, keys)
    release_shuffles(spark)
    leads = rows.filter("leads").select("doc_id", "tid", (F.col("copies") > 1).alias("twice")).distinct()
    places = at.groupBy("doc_id", "tid").agg(F.collect_list("place").alias("places"))
    found = stage(_same(_identified(docs), _same(places, leads)).select("doc_id", "tid", "twice", "places", "text"), "repeated-texts")
    unstage(at)
    release_shuffles(spark)
    windows = stage(_windows(found), "windows")
    counts = (windows.select(F.explode("hashes").alias("hash"), F.when(F.col("twice"), 2).otherwise(1).alias("w"))
              .groupBy("hash").agg(F.sum("w").alias("n")))
    hashes = stage(counts.filter("n > 1").select("hash"), "repeated-windows")
    single = windows.filter("NOT twice").select("doc_id", "tid", F.explode(
        F.arrays_zip(F.col("hashes").alias("hash"), F.col("starts").alias("start"))).alias("w"))
    hit = stage(single.select("doc_id", "tid", "w.hash", "w.start").join(hashes, "hash", "left_semi").drop("hash"), "hits")
    unstage(windows, hashes)
    release_shuffles(spark)
    starts = hit.groupBy("doc_id", "tid").agg(F.collect_set("start").alias("starts"))
    return rows, _same(found.filter("NOT twice").select("doc_id", "tid", "text"), starts)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    rows, hits = repeated_windows(docs)
    changed = stage(_remove(hits).select("doc_id", "tid", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "changed")
    gone = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    return _same(rows, changed, "left").select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
