"""Document fingerprints by a randomised edit embedding (5).

A shared random walk copies a text's characters to a longer output: at output
place j the current character is written, and a random bit that depends only
on j and that character decides whether the walk steps to the next one.  Texts
at a small edit distance fall back into step after an edit, so their outputs
have a small Hamming distance.  A fingerprint samples output places, by the
same random choices for all texts of about one length, and keeps eight hashed
bits of the character written there; the likeness of two fingerprints is the
share of equal samples.  Bands of samples give candidates, which
:func:`near_pairs` verifies by the fingerprints and the edit distance.

Null and empty texts count as empty: all samples say "past the end".  Equal
texts have equal fingerprints.  The next document is the one with the next
smaller doc_id (ties by text; null ids last; after the last comes the first;
a lone document follows itself).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ship_by_value, stage, text_or_empty

ship_by_value(__name__)

SAMPLES = 128
_CLASSES, _PERIOD = 64, 1 << 14
#: Characters that walk side by side, and texts handed over at once.
CELLS, TEXT_CHARS = 4_000_000, 2_000_000
#: Members of a common band that are compared with one another in a task.
BAND_BLOCK = 512
_END = np.uint64(0xFFFFFFFF)


def _walk_table() -> np.ndarray:
    """Steps that a character of each class stays, by output place."""
    bits = np.random.default_rng(7).integers(0, 2, (_CLASSES, _PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    stay = np.ones((_CLASSES, _PERIOD), np.int32)
    for j in range(_PERIOD - 2, -1, -1):
        stay[:, j] = np.where(bits[:, j] == 1, 1, stay[:, j + 1] + 1)
    return stay.ravel()


def _sample_records() -> np.ndarray:
    """For every sample the places that hold the smallest random value so far;
    the last one before L is a uniform choice below L, shared by lengths."""
    rng, rows = np.random.default_rng(11), []
    for _ in range(SAMPLES):
        at, least, row = 0, rng.random(), [0]
        while at < 1 << 40:
            at += 1 + int(np.log(1 - rng.random()) / np.log1p(-least)) if least > 1e-300 else 1 << 41
            row.append(at)
            least *= rng.random()
        rows.append(row)
    width = max(map(len, rows))
    return np.array([r + [1 << 41] * (width - len(r)) for r in rows])


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.update(walk=_walk_table(), records=_sample_records(),
                       salts=np.random.default_rng(13).integers(1, 2 ** 63, SAMPLES).astype(np.uint64))
    return _TABLES["walk"], _TABLES["records"], _TABLES["salts"]


def _walk(chars: list[np.ndarray], stay: np.ndarray) -> np.ndarray:
    """places[i, b]: first output place of character i of text b; texts come
    longest first."""
    sizes = np.array([len(c) for c in chars])
    longest, n = int(sizes[0]), len(chars)
    classes = np.zeros((longest, n), np.int32)
    for b, c in enumerate(chars):
        classes[:len(c), b] = ((c * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int32) * _PERIOD
    places = np.zeros((longest + 1, n), np.int32)
    active = n - np.searchsorted(sizes[::-1], np.arange(longest), "right")
    for i, a in enumerate(active.tolist()):
        now = places[i, :a]
        places[i + 1, :a] = now + stay[classes[i, :a] + (now & (_PERIOD - 1))]
    return places


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SAMPLES bytes per text."""
    stay, records, salts = _tables()
    chars = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out = np.empty((len(texts), SAMPLES), np.uint8)
    order = sorted(range(len(texts)), key=lambda k: -len(chars[k]))
    lo = 0
    while lo < len(order):
        longest = max(1, len(chars[order[lo]]))
        hi = min(len(order), lo + max(1, CELLS // longest))
        part = order[lo:hi]
        places = _walk([chars[k] for k in part], stay)
        for b, k in enumerate(part):
            c, n = chars[k], len(chars[k])
            wanted = records[np.arange(SAMPLES), np.maximum((records < 2 * n).sum(1) - 1, 0)]
            i = np.searchsorted(places[:n + 1, b], wanted, "right") - 1
            drawn = np.full(SAMPLES, _END, np.uint64)
            inside = (i < n) & (n > 0)
            drawn[inside] = c[i[inside]]
            h = (drawn + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ salts
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out[k] = (h >> np.uint64(56)).astype(np.uint8)
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited_text(text: str, following: str) -> str:
    """The last third's code points replaced by the first of ``following``."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (descending) above ``key``, in two short searches."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    above = lambda xs: F.size(F.filter(xs, lambda b: b > key))
    chunk = above(array([c[0] for c in chunks]))
    return F.when(chunk == 0, 0).otherwise(
        (chunk - 1) * width + above(F.element_at(F.array(*map(array, chunks)), F.greatest(chunk, F.lit(1)))))


def with_following(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, ahead), partitioned and sorted so that each
    row's next document is the next row of its bucket.

    Buckets are ranges of ids; a bucket's first row is sent to the bucket
    before as well (``ahead``), so each partition can be streamed on its own.
    The driver sees one id per bucket.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(2 ** 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"), text_or_empty().alias("text"))
    cuts = 4 * n
    bounds = rows.select("key").approxQuantile("key", [k / cuts for k in range(1, cuts)], 0.2 / cuts)
    bounds = sorted({int(b) for b in bounds}, reverse=True)
    rows = rows.withColumn("bucket", _bucket(F.col("key"), bounds))
    firsts = sorted((r["bucket"], r["first"]) for r in
                    rows.groupBy("bucket").agg(F.max("key").alias("first")).collect())
    before = [(key, firsts[k - 1][0]) for k, (_, key) in enumerate(firsts)]
    heads = spark.createDataFrame(before, "key long, previous int")
    own = F.struct("bucket", F.lit(False).alias("ahead"))
    placed = rows.join(F.broadcast(heads), "key", "left").withColumn("at", F.explode(F.when(
        F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, F.struct(
            F.col("previous").alias("bucket"), F.lit(True).alias("ahead"))))))
    return (placed.select("doc_id", "text", "key", "at.bucket", "at.ahead").repartition(n, "bucket")
            .sortWithinPartitions("bucket", "ahead", F.desc("key"), "text").drop("key"))


def _hex(row: np.ndarray) -> str:
    return row.tobytes().hex()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row, see the module's docstring."""

    def finish(rows: list[tuple], last: str) -> pa.RecordBatch:
        """``rows``: (doc_id, text); ``last`` follows the last of them."""
        texts = [t for _, t in rows] + [last]
        edited = [edited_text(t, f) for t, f in zip(texts, texts[1:])]
        prints = fingerprints(texts + edited)
        own, changed = prints[:len(texts)], prints[len(texts):]
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(map(_hex, own[:-1]), pa.string()), pa.array(map(_hex, changed), pa.string()),
            pa.array(likeness(own[:-1], changed), pa.float64()), pa.array(likeness(own[:-1], own[1:]), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars, bucket = 0, None
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                for doc, text, b, ahead in zip(*(c.to_pylist() for c in part.columns)):
                    if held and (ahead or chars > TEXT_CHARS):
                        yield finish(held, text)
                        held, chars = [], 0
                    if not ahead:
                        held.append((doc, text))
                        chars += len(text)

    return with_following(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def near_pairs(docs: DataFrame, max_edits: int, min_likeness: float = 0.6, bands: int = 32, rows: int = 4) -> DataFrame:
    """(doc_id, near_id, edits): links of documents within ``max_edits`` edits,
    near_id being the smaller id.  A band hashes ``rows`` samples; all that
    share a band are compared, first by fingerprint, then by edit distance,
    a common band's members in blocks of about ``BAND_BLOCK``.  Of documents
    with the same smallest near document only the links to that one are
    given, which connect them."""
    prints = fingerprint_documents(docs).select("doc_id", "fingerprint")
    width = 2 * rows
    keys = F.array(*(F.concat_ws(":", F.lit(b), F.substring("fingerprint", b * width + 1, width)) for b in range(bands)))
    banded = stage(prints.select("doc_id", "fingerprint", F.explode(keys).alias("band")), "bands")
    sizes = banded.groupBy("band").agg(F.ceil(F.count("*") / BAND_BLOCK).cast("int").alias("blocks"), F.count("*").alias("size"))
    dealt = banded.join(sizes.filter("size > 1"), "band").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = dealt.select("band", "doc_id", "fingerprint", F.col("own").alias("x"), others.alias("y"))
    two = dealt.select("band", F.col("doc_id").alias("near_id"), F.col("fingerprint").alias("near"), F.col("own").alias("y"), others.alias("x"))
    same = sum(F.when(F.substring("fingerprint", 2 * k + 1, 2) == F.substring("near", 2 * k + 1, 2), 1)
               .otherwise(0) for k in range(SAMPLES))
    found = (one.join(two, ["band", "x", "y"]).filter("near_id < doc_id").filter(same >= min_likeness * SAMPLES)
             .select("doc_id", "near_id").distinct())
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    both = (found.join(text, "doc_id")
            .join(text.select(F.col("doc_id").alias("near_id"), F.col("text").alias("near_text")), "near_id"))
    edits = F.levenshtein("text", "near_text", max_edits)
    links = stage(both.select("doc_id", "near_id", edits.alias("edits")).filter("edits >= 0"), "near-links")
    least = links.groupBy("doc_id").agg(F.min("near_id").alias("least"))
    of_near = least.select(F.col("doc_id").alias("near_id"), F.col("least").alias("near_least"))
    return (links.join(least, "doc_id").join(of_near, "near_id", "left").filter("near_least IS NULL OR least <> near_least")
            .select("doc_id", "near_id", "edits"))
