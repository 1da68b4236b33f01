"""Quality classifier: an additive model with pairwise interactions (9).

Every feature has a lookup table over its bins, learnt by cyclic boosting:
round after round each feature in turn gets a shallow tree (three leaves) on
the current residual, added to its table with a small step.  The pairs of
features that explain most of what is left get two-dimensional tables the same
way.  A score is the logistic of the sum of table entries, computed by
vectorised bin lookups and additions inside Arrow batches.

The fit uses at most ``MAX_TRAINING_ROWS`` labelled rows (those of smallest
hash of the id), whose features are a bounded table; every text is scored, as
a whole.  A null text counts as empty.  Repeated rows score alike.  Labels
without both classes give every text one score, the share of label 1 (1 if
there is no label).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from . import _words
from ._common import ship_by_value, text_or_empty

ship_by_value(__name__)

#: Documented bound of the training sample.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, STEP = 150, 60, 0.15

FEATURES = ("log_bytes", "doubled", "symbols", "capitals", "bangs", "digits", "stops", "newlines", "wide",
            "word_bytes", "repeats", "distinct", "top_word", "capital_words", "symbol_words")

_CLASSES = {"symbols": b"#$%&*@^~<>{}[]\\=+_", "capitals": bytes(range(65, 91)), "bangs": b"!",
            "digits": b"0123456789", "stops": b".,;:?", "newlines": b"\n", "wide": bytes(range(128, 256))}


def features(column: pa.Array, lo: int, hi: int) -> np.ndarray:
    """One row of FEATURES per text."""
    w = _words.words(column, lo, hi)
    n = np.diff(w.at)
    out = np.zeros((hi - lo, len(FEATURES)))
    out[:, 0] = np.log1p(n)
    size = np.maximum(n, 1)
    member = {}
    plain = np.ones(256, bool)  # neither letters, digits nor white space
    plain[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *range(9, 14), 32]] = False
    again = np.zeros(len(w.data), bool)
    again[1:] = (w.data[1:] == w.data[:-1]) & plain[w.data[1:]]
    again[w.at[:-1][w.at[:-1] < len(again)]] = False
    total = np.concatenate([[0], np.cumsum(again)])
    out[:, 1] = (total[w.at[1:]] - total[w.at[:-1]]) / size
    for k, name in enumerate(FEATURES[2:9], 2):
        table = np.zeros(256, bool)
        table[list(_CLASSES[name])] = True
        member[name] = total = np.concatenate([[0], np.cumsum(table[w.data])])
        out[:, k] = (total[w.at[1:]] - total[w.at[:-1]]) / size
    count = np.diff(w.of)
    some = np.maximum(count, 1)
    text = np.repeat(np.arange(hi - lo), count)
    if len(text):
        per = lambda x: np.bincount(text, x, hi - lo) / some
        out[:, 9] = per(w.ends - w.starts)
        same = np.zeros(len(text), bool)
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
        out[:, 10] = per(same)
        order = np.lexsort((w.hashes, text))
        h, t = w.hashes[order], text[order]
        first = np.ones(len(t), bool)
        first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        out[:, 11] = np.bincount(t[first], minlength=hi - lo) / some
        runs = np.diff(np.append(np.flatnonzero(first), len(t)))
        np.maximum.at(out[:, 12], t[first], runs)
        out[:, 12] /= some
        out[:, 13] = per(member["capitals"][w.ends] - member["capitals"][w.starts] > 1)
        out[:, 14] = per(member["symbols"][w.ends] - member["symbols"][w.starts] > 0)
    return out


class Model(NamedTuple):
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        for f, g, ef, eg, t in self.pairs:
            total += t[np.searchsorted(ef, x[:, f], "right"), np.searchsorted(eg, x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per-bin values of the best tree of three leaves on binned gradients."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = (left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
                    - all_g ** 2 / (all_h + 1))
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), (a, a + k + 1, b)), key=lambda t: t[0])
        if best[1] is None:
            break
        a, k, b = best[1]
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and per-cell values of the best cut of both features at once."""
    out, best = np.zeros(g.shape), 0.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    base = cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j],
                           cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j],
                           ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((gs ** 2 / (hs + 1)).sum() - base)
            if gain > best:
                best, v = gain, _leaf(gs, hs)
                out = np.empty(g.shape)
                out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0
        share = min(max(float(share), 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), [], [], [])
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    p = y.mean()
    intercept = float(np.log(p / (1 - p)))
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for f, b in enumerate(binned):
            g, h = slopes()
            t = STEP * _shallow_tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])))
            tables[f] += t
            total += t[b]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def summed(f: int, k: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(cells[f] * shape[1] + cells[k], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(summed(f, k, g), summed(f, k, h))[0], f, k)
                     for f in range(x.shape[1]) for k in range(f)), reverse=True)[:PAIRS]
    pairs = [(f, k, coarse[f], coarse[k], np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)))
             for gain, f, k in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, k, _, _, table in pairs:
            g, h = slopes()
            t = STEP * _quadrants(summed(f, k, g), summed(f, k, h))[1]
            table += t
            total += t[cells[f], cells[k]]
    return Model(intercept, edges, tables, pairs)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _binary(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), *extra)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on the labelled rows that aren't held out, ``max_rows`` at most."""
    bound_batches(docs.sparkSession)
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
              .filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))
    known = _binary(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for lo, hi in _words.blocks(text):
                x = features(text, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *map(pa.array, x.T)],
                    names=["doc_id", "quality", *FEATURES])

    rows = known.mapInArrow(run, "doc_id long, quality double, " + ", ".join(f"{f} double" for f in FEATURES))
    # one row per (doc_id, label), whichever documents share the id: at most max_rows rows of numbers
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "quality", "x.*")
    pdf = one.toPandas().sort_values(["doc_id", "quality"], ignore_index=True)
    return fit(pdf[list(FEATURES)].to_numpy(float), pdf["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for lo, hi in _words.blocks(text):
                s = np.round(shared.value.score(features(text, lo, hi)), 6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    scored = _binary(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay, and
    no join is needed, as rows are judged where they are read."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(text):  # noqa: ANN001, ANN202
        column = pa.array(text, pa.binary())
        parts = [shared.value.score(features(column, lo, hi)) for lo, hi in _words.blocks(column)]
        import pandas as pd
        return pd.Series(np.round(np.concatenate(parts), 6) if parts else np.zeros(0))

    return docs.filter(judge(text_or_empty().cast("binary")) >= threshold)
