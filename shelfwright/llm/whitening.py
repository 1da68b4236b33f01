"""Embedding whitening by spectrum slicing (11).

Entries become integers, so the fit is exact: one pass sums each dimension,
a second multiplies integers centred at the rounded means, and the small rest
of the centring is taken off in whole numbers.  Row sums of products meet in
tasks; the driver sees one d x d matrix, however many rows there are.

Components come from the covariance V alone.  The pivots of an LDLt
factorisation of V - s*I count the eigenvalues above s (inertia); slicing by
such counts isolates each leading eigenvalue, Rayleigh quotient iteration
converges cubically from inside its slice, and two more counts beside the
result certify its number.  Eigenvalues closer than double precision tells
apart share a slice and get an orthonormal basis.

Rows whose vector is null or holds null, NaN or infinite entries are dropped.
Where lengths differ, the most frequent one counts (of ties the longest) and
other rows are dropped.  Repeated rows count as often as they stand.  A null
id is an id.  Eigenvalues that are zero to double precision have no whitened
value, so their components are left out; an empty table gives no rows.  A
``deviation`` beyond a long is null.  Entries of 2**24 or more in size stop
the job.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship_by_value

ship_by_value(__name__)

COMPONENTS = 32
#: x = floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
LARGEST = 2 ** 30
#: Rows handled at once in a task.
ROWS = 8192
#: Slices narrower than this share of the trace are not cut again.
NARROW = 2.0 ** -44

OUTPUT = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


# ------------------------------------------------------------------ rows

def _vectors(batch: pa.RecordBatch, d: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of the usable vectors of a batch, by length (only ``d``)."""
    for k in range(0, len(batch), ROWS):
        part = batch.slice(k, ROWS)
        ids, lists = part.column(0), part.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
        of = np.repeat(np.arange(len(part)), np.maximum(lengths, 0))
        good = lengths > 0
        good[of[~np.isfinite(values)]] = False
        for length in {d} if d else set(lengths[good].tolist()):
            rows = np.flatnonzero(good & (lengths == length))
            if not len(rows):
                continue
            keep = np.zeros(len(part), bool)
            keep[rows] = True
            scaled = np.floor(values[keep[of]].reshape(-1, length) * SCALE)
            if np.abs(scaled).max() >= LARGEST:
                raise ValueError(f"an entry is {LARGEST // SCALE} or more in size")
            yield ids.take(pa.array(rows)), scaled.astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _vectors(batch):
                n, s = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = (n + len(x), s + x.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()),
             pa.array([s for _, s in found.values()], pa.list_(pa.int64()))], names=["d", "n", "sums"])

    parts = rows.mapInArrow(run, "d long, n long, sums array<long>")
    top = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return 0, []
    sums = (parts.filter(F.col("d") == top["d"]).select(F.posexplode("sums").alias("k", "s"))
            .groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect())  # d rows
    return top["n"], [r["s"] for r in sums]


def _products(rows: DataFrame, d: int, centre: list[int]) -> list[list[int]]:
    """Sums over all vectors of the products of entries less ``centre``."""
    at = np.array(centre, np.int64)

    def emit(gram: np.ndarray) -> pa.RecordBatch:
        # two halves, whose sums over any number of tasks fit a long
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d)), pa.array(list(gram >> 32), pa.list_(pa.int64())),
             pa.array(list(gram & 0xFFFFFFFF), pa.list_(pa.int64()))], names=["k", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, bound = np.zeros((d, d), np.int64), 0
        for batch in batches:
            for _, x in _vectors(batch, d):
                y = x - at
                most = max(int(np.abs(y).max()) ** 2, 1)
                step = max(1, 2 ** 62 // most)
                for k in range(0, len(y), step):
                    z = y[k:k + step]
                    if bound + len(z) * most >= 2 ** 63:
                        yield emit(gram)
                        gram, bound = np.zeros((d, d), np.int64), 0
                    exact = len(z) * most < 2 ** 53  # whole numbers that doubles hold
                    gram += (z.T.astype(np.float64) @ z.astype(np.float64)).astype(np.int64) if exact else z.T @ z
                    bound += len(z) * most
        yield emit(gram)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, high, low in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                s = sums.setdefault(int(k), [0, 0])
                s[0], s[1] = s[0] + high, s[1] + low
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s[0] for s in sums.values()], pa.list_(pa.int64())),
             pa.array([s[1] for s in sums.values()], pa.list_(pa.int64()))], names=["k", "high", "low"])

    schema = "k long, high array<long>, low array<long>"
    found = rows.mapInArrow(run, schema).repartition("k").mapInArrow(merge, schema).orderBy("k").collect()  # d rows
    return [[(h << 32) + low for h, low in zip(r["high"], r["low"])] for r in found]


def covariance(n: int, sums: list[int], centre: list[int], products: list[list[int]]) -> np.ndarray:
    """Divisor n; the whole numbers are divided last, each rounded once."""
    rest = [s - n * c for s, c in zip(sums, centre)]
    return np.array([[(n * p - a * b) / (n * n) for p, b in zip(row, rest)] for row, a in zip(products, rest)])


# ------------------------------------------------------------------ spectrum

def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: the positive pivots
    of LDLt with 1x1 and 2x2 pivots (a 2x2 pivot has one of each sign)."""
    a = matrix - shift * np.eye(len(matrix))
    ratio, count, k, n = (1 + 17 ** 0.5) / 8, 0, 0, len(a)
    while k < n:
        below = np.abs(a[k + 1:, k])
        most = below.max() if len(below) else 0.0
        here, two = abs(a[k, k]), False
        if here < ratio * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            widest = row.max()
            if here * widest < ratio * most * most:
                two = abs(a[r, r]) < ratio * widest
                p = k + 1 if two else k
                a[[p, r]] = a[[r, p]]
                a[:, [p, r]] = a[:, [r, p]]
        if two:
            count += 1
            block, side = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
            a[k + 2:, k + 2:] -= side @ inverse @ side.T
            k += 2
        else:
            if a[k, k] != 0:
                count += bool(a[k, k] > 0)
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k + 1:, k] / a[k, k])
            k += 1
    return count


def slices(count: Callable[[float], int], top: float, least: float, wanted: int, narrow: float) -> list[tuple[float, float, int, int]]:
    """(low, high, eigenvalues above high, eigenvalues inside), falling, of
    the ``wanted`` largest eigenvalues above ``least``: one a slice, or more
    that lie within ``narrow``."""
    open_, found = [(least, top, count(least), 0)], []
    while open_:
        low, high, n_low, n_high = open_.pop()
        if n_low == n_high or n_high >= wanted:
            continue
        if n_low - n_high == 1 and high - low < 0.25 * max(abs(high), narrow) or high - low <= narrow:
            found.append((low, high, n_high, n_low - n_high))
            continue
        mid = (low + high) / 2
        n_mid = count(mid)
        open_ += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
    return sorted(found, key=lambda s: s[2])


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    for _ in range(8):
        try:
            x = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
            if np.isfinite(x).all():
                return x
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge
    raise ArithmeticError("no solution beside the shift")


def _orthogonal(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            x = x - np.outer(v, v @ x) if x.ndim == 2 else x - v * (v @ x)
    return x


def leading_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """(eigenvalue, unit eigenvector) of the largest eigenvalues, falling;
    those that are zero to double precision are left out."""
    trace = float(np.trace(matrix))
    d, rng = len(matrix), np.random.default_rng(11)
    if trace <= 0:
        return []
    tiny = np.finfo(float).eps * trace
    narrow, known = max(NARROW * trace, 16 * tiny), {}

    def count(s: float) -> int:
        if s not in known:
            known[s] = above(matrix, s)
        return known[s]

    found: list[tuple[float, np.ndarray]] = []
    work = slices(count, trace * (1 + 1e-9), 8 * d * tiny, min(wanted, d), narrow)[::-1]
    while work:
        low, high, before, inside = work.pop()
        vectors = [v for _, v in found]
        if inside > 1:  # a cluster: any orthonormal basis of its space
            block = np.linalg.qr(_orthogonal(rng.standard_normal((d, inside)), vectors))[0]
            for _ in range(6):
                block = np.linalg.qr(_orthogonal(_solve(matrix, (low + high) / 2, block, tiny), vectors))[0]
            pairs = sorted(((float(v @ matrix @ v), v) for v in block.T), key=lambda p: -p[0])
            found += pairs
            continue
        v = _orthogonal(rng.standard_normal(d), vectors)
        shift, value, done = (low + high) / 2, 0.0, False
        for step in range(40):
            v = _orthogonal(_solve(matrix, shift, v / np.linalg.norm(v), tiny), vectors)
            v /= np.linalg.norm(v)
            value = float(v @ matrix @ v)
            rest = np.linalg.norm(matrix @ v - value * v)
            if done:  # one step beyond the bound
                break
            done = rest <= 8 * d ** 0.5 * tiny
            # Rayleigh quotients once they lie safely inside the slice
            shift = value if step >= 1 and low < value - rest and value + rest < high else shift
        side = max(narrow, 1e-13 * trace)
        # the counts beside the value certify its number
        if done and count(value + side) <= before and count(value - side) >= before + 1:
            found.append((value, v))
            continue
        mid = (low + high) / 2
        if high - low <= 2 * narrow:
            raise ArithmeticError(f"eigenvalue {before + 1} was not certified")
        n_mid = count(mid)
        work += [s for s in ((low, mid, n_mid, before + inside - n_mid), (mid, high, before, n_mid - before)) if s[3]]
    signed = []
    for value, v in sorted(found, key=lambda p: -p[0])[:wanted]:
        signed.append((value, v if v[np.abs(v).argmax()] > 0 else -v))
    return signed


# ------------------------------------------------------------------ operator

def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    n, sums = _sums(rows)
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    found: list[tuple[float, np.ndarray]] = []
    if d:
        matrix = covariance(n, sums, centre, _products(rows, d, centre))
        found = leading_components(matrix, components)
    if not found:
        return spark.createDataFrame([], OUTPUT)
    trace, k = float(np.trace(matrix)), len(found)
    basis = np.array([v / e ** 0.5 for e, v in found]).T
    at = np.array(centre, np.int64)
    rest = [s - n * c for s, c in zip(sums, centre)]

    def projected(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(ids, n*x - S, whitened) of the usable vectors."""
        for ids, x in _vectors(batch, d):
            y = x - at
            small = n * (int(np.abs(y).max()) + 1) < 2 ** 62
            z = y * n - np.array(rest) if small else y.astype(object) * n - np.array(rest, object)
            yield ids, z, (z / n).astype(np.float64) @ basis

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, _, w in projected(batch):
                gram += w.T @ w
                total += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram.ravel(), total])], pa.list_(pa.float64()))], names=["s"])

    sums_of = (rows.mapInArrow(measure, "s array<double>").select(F.posexplode("s").alias("k", "s"))
               .groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect())  # k * k + k rows
    s = np.array([r["s"] for r in sums_of]) / n
    off = s[:k * k].reshape(k, k) - np.outer(s[k * k:], s[k * k:]) - np.eye(k)
    # rounded, because tasks are added in no fixed order
    error = round(float(np.abs(off).max()), 12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, z, w in projected(batch):
                if z.dtype == object or d * (int(np.abs(z).max()) ** 2) >= 2 ** 63:
                    exact = (z.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([int(v) if v < 2 ** 63 else None for v in exact], pa.int64())
                else:
                    deviation = pa.array((z * z).sum(axis=1))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([ids, deviation, values], names=["vec_id", "deviation", "w"])

    shares = F.array(*(F.lit(e / trace) for e, _ in found))
    return (rows.mapInArrow(run, "vec_id long, deviation long, w array<double>")
            .select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"),
                    F.lit(error).alias("identity_error")))
