"""Near-duplicates by a chosen-path set similarity join (4).

A document's set holds its distinct 5-word shingles (words between ASCII white
space, A-Z lower-cased); with fewer words the whole sequence is the one
shingle.  Documents of equal sets are one vertex from the start.

Each tree starts with one minwise token per vertex and branches a node's
members by further tokens, chosen by the node itself: one, or two with the
odds that keep a pair at the threshold together in one child on average.  A
node branches only while it is large; small nodes are compared exhaustively,
and so are those that are still large at the last level, in blocks.  Trees are
independent; ``TREES`` of them make a pair at the threshold meet with
probability 0.999.  Comparison uses 256-bit sketches; each member proposes its
``NEAREST`` most similar partners of a node, so proposals grow with members
and not with pairs.

Proposals only group vertices: every group's texts then meet, and links are
confirmed on the full sets, all pairs that the sketches allow in the order of
likeness, skipping those already connected.  Groups too large for a task are
cut into blocks of about ``GROUP_VERTICES``, and a task holds one block, later
the members of two.  Then the nodes are compared again: whatever pairs
the sketches allow between different components meet in pairs of blocks of
their groups, so that no allowed pair of a node is left unchecked.  Where
groups have many blocks, the likeliest pair of every two components goes
first, which leaves little for the blocks.

Null texts and texts without words have an empty set and are linked with
nothing.  Repeated rows belong together like any equal texts.  A component of
null ids alone has a null id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import as_row, ship_by_value, stage, text_or_empty, unstage
from ._components import components

ship_by_value(__name__)

SHINGLE_WORDS, THRESHOLD = 5, 85
TREES, LEVELS, SMALL_NODE, BLOCK, NEAREST = 8, 3, 512, 1024, 4
#: Rounds of components that are enough to bring proposals' texts together.
GROUPING_ROUNDS = 2
GROUP_VERTICES, GROUP_SHINGLES = 512, 1_000_000
#: Blocks of a group from which components are joined by their likeliest pairs first.
MANY_BLOCKS = 8
BINS, COORDS = 256, 64

_SALTS = np.random.default_rng(17).integers(1, 2 ** 63, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TOKEN_SALTS = np.random.default_rng(19).integers(1, 2 ** 63, TREES + COORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Where the branching tokens' ranges of hashes begin.
_RANGES = np.arange(COORDS).astype(np.uint64) * np.uint64(BINS // COORDS) << np.uint64(56)
_LOW_KEY = -(2 ** 63)


def shingle_sets(column: pa.Array, lo: int, hi: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w = _words.words(column, lo, hi, lower=True)
    h, k = w.hashes, SHINGLE_WORDS
    with np.errstate(over="ignore"):
        if len(h) >= k:
            rolled = sum(h[i:len(h) - k + 1 + i] * _SALTS[i] for i in range(k))
            rolled = _words.mix(rolled)
        else:
            rolled = np.zeros(0, np.uint64)
        out = []
        for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a:b - k + 1]))
            elif b > a:
                short = (h[a:b] * _SALTS[5:5 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(_words.mix(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sum_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = _words.mix(s ^ _SALTS[10]).sum(dtype=np.uint64)
        b = _words.mix(s ^ _SALTS[11]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest hash of each of BINS ranges of hashes; an empty range
    borrows from the next one that has any, mixed with the distance."""
    bins = (s >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = bins[1:] != bins[:-1]
    held, least = bins[first], s[first]
    places = np.arange(BINS)
    at = np.searchsorted(held, places) % len(held)
    far = ((held[at] - places) % BINS).astype(np.uint64)
    with np.errstate(over="ignore"):
        return _words.mix(least[at] + far * _SALTS[12])


def tokens_of(sets: list[np.ndarray]) -> np.ndarray:
    """TREES minwise values of each set by hash functions of their own, one a
    tree, then COORDS for branching: the least hash of every fourth of the
    BINS ranges, an empty one filled by its own hash function.  Two sets agree
    in each with the probability of their likeness, independently."""
    out = np.empty((len(sets), TREES + COORDS), np.uint64)
    held = np.flatnonzero([len(s) for s in sets])
    if not len(held):
        return out.astype("<u4")
    every = np.concatenate([sets[k] for k in held])
    begin = np.cumsum([0, *(len(sets[k]) for k in held[:-1])])
    with np.errstate(over="ignore"):
        for t in range(TREES):
            out[held, t] = np.minimum.reduceat(_words.mix(every ^ _TOKEN_SALTS[t]), begin)
        for k in held.tolist():
            s = sets[k]
            at = np.searchsorted(s, _RANGES)
            least = s[np.minimum(at, len(s) - 1)]
            empty = np.flatnonzero((at == len(s)) | (least >> np.uint64(56) != _RANGES >> np.uint64(56)))
            least = _words.mix(least)
            if len(empty):
                least[empty] = _words.mix(s ^ _TOKEN_SALTS[TREES + empty][:, None]).min(axis=1)
            out[k, TREES:] = least
    # low bits: those of a minimum's top are nearly all zero
    return (out & np.uint64(0xFFFFFFFF)).astype("<u4")


def _allowed(n: np.ndarray, threshold: int) -> np.ndarray:
    """Least likeness of sketches that a pair at the threshold may show, four
    standard deviations down; sketches of short texts vary more."""
    return threshold / 100 - 4 * (0.035 + 0.55 / np.sqrt(np.maximum(n, 1)))


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n, k1, k2, tokens, bits) per row; tid is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for lo, hi in _words.blocks(text):
                n, keys, tokens, bits = [], [], [], []
                sets = shingle_sets(text, lo, hi)
                for s, token in zip(sets, tokens_of(sets)):
                    n.append(len(s))
                    keys.append(_sum_key(s))
                    if len(s):
                        tokens.append(token.tobytes())
                        bits.append(np.packbits((minwise(s) & np.uint64(1)).astype(np.uint8)).tobytes())
                    else:
                        tokens.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary())],
                    names=["doc_id", "tid", "n", "k1", "k2", "tokens", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tid"),
                       text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tid long, n long, k1 long, k2 long, tokens binary, bits binary")


def _fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    data, _ = _words.block_bytes(column, 0, len(column))
    return data.view(dtype).reshape(len(column), width)


def _branch(members: DataFrame, level: int, threshold: int = THRESHOLD) -> DataFrame:
    """Children (node, sid) of ``members`` (node, sid, tokens); at level 0
    every vertex enters all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sid, tokens = batch.column(1), _fixed(batch.column(2), "<u4", TREES + COORDS).astype(np.uint64)
            rows = np.arange(len(batch))
            out = []
            with np.errstate(over="ignore"):
                if level == 0:
                    for t in range(TREES):
                        root = np.uint64(t + 1) * _SALTS[13]
                        out.append((rows, _words.mix(root + tokens[:, t] * _SALTS[14])))
                else:
                    node, tokens = batch.column(0).to_numpy().astype(np.uint64), tokens[:, TREES:]
                    pick = _words.mix(node ^ _SALTS[15])
                    c = (pick % np.uint64(COORDS)).astype(np.int64)
                    out.append((rows, _words.mix(node + tokens[rows, c] * _SALTS[14] + c.astype(np.uint64))))
                    more = np.flatnonzero((pick >> np.uint64(40)) % np.uint64(1000) < np.uint64(1000 * (100 - threshold) // threshold))
                    c2 = (c[more] + 1 + ((pick[more] >> np.uint64(16)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
                    out.append((more, _words.mix(node[more] + tokens[more, c2] * _SALTS[14] + c2.astype(np.uint64))))
            at = np.concatenate([o[0] for o in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)), sid.take(pa.array(at))], names=["node", "sid"])

    return members.select("node", "sid", "tokens").mapInArrow(run, "node long, sid long")


def _leaves(vertices: DataFrame, threshold: int) -> list[DataFrame]:
    """Members (node, sid, size) of all nodes that are to be compared."""
    found, members = [], vertices.withColumn("node", F.lit(0).cast("long"))
    for level in range(LEVELS):
        children = stage(_branch(members, level, threshold), "children")
        sizes = stage(children.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node-sizes")
        sized = stage(children.join(sizes, "node"), "members")
        unstage(children, sizes)
        last = level == LEVELS - 1
        found.append(sized if last else sized.filter(F.col("size") <= SMALL_NODE))
        large = sized.filter(F.col("size") > SMALL_NODE)
        if last or not large.take(1):
            break
        members = large.join(vertices.select("sid", "tokens"), "sid").select("node", "sid", "tokens")
    return found


def _sorted_groups(batches: Iterator[pa.RecordBatch], key: int = 0, rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by an integer column, recut so that no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            held.append(batch.slice(0, cut))
            if sum(map(len, held)) >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        elif held and held[-1].column(key)[-1].as_py() != k[-1] and sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def similar_pairs(group: np.ndarray, bits: np.ndarray, n: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i, j, likeness) inside the groups of a sorted array whose
    sketches and sizes allow a link."""
    out_i, out_j, out_s = [], [], []
    step, rows = 1, np.arange(len(group))
    while True:
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        other = rows + step
        apart = np.bitwise_count(bits[rows] ^ bits[other]).sum(1)
        like = 1 - 2 * apart / BINS
        small, large = np.minimum(n[rows], n[other]), np.maximum(n[rows], n[other])
        ok = (like >= _allowed(small, threshold)) & (100 * small >= threshold * large)
        out_i.append(rows[ok])
        out_j.append(other[ok])
        out_s.append(like[ok])
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), np.concatenate([np.zeros(0), *out_s]))


def _nearest(i: np.ndarray, j: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which pairs are among the NEAREST of either member."""
    ends, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-like[pair], ends))
    ends, pair = ends[order], pair[order]
    start = np.ones(len(ends), bool)
    start[1:] = ends[1:] != ends[:-1]
    rank = np.arange(len(ends)) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(ends))))
    return np.unique(pair[rank < NEAREST])


def _dealt(members: DataFrame, vertices: DataFrame, partitions: int, *more: str) -> DataFrame:
    """(grp, sid, n, bits, *more) of all nodes' members, a group being a node
    or two blocks of a large one."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    mates = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.xxhash64(
        "node", F.least(b, F.col("own")), F.greatest(b, F.col("own"))))
    return (members.withColumn("own", own).select(F.explode(mates).alias("grp"), "sid")
            .join(vertices.select("sid", "n", "bits", *more), "sid")
            .repartition(partitions, "grp").sortWithinPartitions("grp").select("grp", "sid", "n", "bits", *more))


def _proposals(members: DataFrame, vertices: DataFrame, partitions: int, threshold: int) -> DataFrame:
    """Links (u, v) that comparing all nodes proposes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _sorted_groups(batches):
            sid = _column(table, "sid").to_numpy()
            i, j, like = similar_pairs(_column(table, "grp").to_numpy(), _fixed(_column(table, "bits"), "<u8", BINS // 64),
                                       _column(table, "n").to_numpy(), threshold)
            keep = _nearest(i, j, like)
            u, v = sid[i[keep]], sid[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return _dealt(members, vertices, partitions).mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def _open(members: DataFrame, placed: DataFrame, partitions: int, likeliest: bool, threshold: int) -> DataFrame:
    """(part, vertex) of what the sketches allow between different components
    (``label``) of nodes, a block's own pairs being decided: a part is two blocks of ``placed`` and holds their
    vertices with such a pair, or, ``likeliest``, those of the likeliest pairs
    of two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _sorted_groups(batches):
            sid, label, block = (_column(table, c).to_numpy() for c in ("sid", "label", "block"))
            i, j, like = similar_pairs(_column(table, "grp").to_numpy(), _fixed(_column(table, "bits"), "<u8", BINS // 64),
                                       _column(table, "n").to_numpy(), threshold)
            apart = (label[i] != label[j]) & (block[i] != block[j])
            i, j, like = i[apart], j[apart], like[apart]
            if likeliest:
                keep = _nearest(i, j, like)
                i, j, like = i[keep], j[keep], like[keep]
            with np.errstate(over="ignore"):
                low, high = np.minimum(block[i], block[j]).astype(np.uint64), np.maximum(block[i], block[j]).astype(np.uint64)
                part = _words.mix(low * _SALTS[13] + high * _SALTS[14]).astype(np.int64)
            if likeliest:
                a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                columns = [a, b, like, part, sid[i], sid[j]]
            else:
                columns = list(np.unique(np.stack([np.tile(part, 2), np.concatenate([sid[i], sid[j]])]), axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())

    dealt = _dealt(members, placed.withColumnRenamed("vertex", "sid"), partitions, "label", "block")
    if not likeliest:
        names = "part vertex"
        return dealt.mapInArrow(run, "part long, vertex long").distinct()
    names = "a b like part u v"
    pairs = dealt.mapInArrow(run, "a long, b long, like double, part long, u long, v long")
    best = pairs.groupBy("a", "b").agg(F.max(F.struct("like", "part", "u", "v")).alias("best"))
    return best.select("best.part", F.explode(F.array("best.u", "best.v")).alias("vertex")).distinct()


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


#: Comparisons a member may fail, on average, before a group is finished by
#: counting shared shingles.
FAILURES = 4


def _shared(sets: list[np.ndarray]):
    """A function of i: how many shingles set i shares with every set."""
    sizes = np.array([len(s) for s in sets])
    _, ids, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    first = np.concatenate([[0], np.cumsum(holders)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes)])

    def count(i: int) -> np.ndarray:
        mine = ids[begin[i]:begin[i + 1]]
        long = holders[mine]
        at = np.repeat(first[mine] - np.cumsum(long) + long, long) + np.arange(long.sum())
        return np.bincount(owner[at], minlength=len(sets))

    return count


def _confirm(labels: np.ndarray, sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(label, smallest label of its component) inside one group, by links
    confirmed on the full sets; sets of one label are connected already.  The
    likeliest pairs come first, skipping those connected; where many fail,
    shared shingles of whatever is outside the largest component are counted
    instead, which decides all of its pairs at once."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        return [(int(max(labels)), int(min(labels)))] if labels[0] != labels[1] and linked(*sets, threshold) else []
    bits = np.array([np.packbits((minwise(s) & np.uint64(1)).astype(np.uint8)) for s in sets]).view("<u8")
    i, j, like = similar_pairs(np.zeros(len(sets), np.int64), bits, n, threshold)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left = len(sets) - 1

    def join(x: int, y: int) -> None:
        nonlocal left
        a, b = find(x), find(y)
        if a != b:
            root[a], left = b, left - 1

    seen: dict[int, int] = {}
    for x, label in enumerate(labels.tolist()):
        join(x, seen.setdefault(label, x))
    failed = 0
    for p in np.argsort(-like, kind="stable").tolist():
        x, y = int(i[p]), int(j[p])
        if find(x) == find(y):
            continue
        if linked(sets[x], sets[y], threshold):
            join(x, y)
        else:
            failed += 1
        if not left or failed > FAILURES * len(sets):
            break
    if failed > FAILURES * len(sets):
        parts = np.array([find(x) for x in range(len(sets))])
        count = _shared(sets)
        for x in np.flatnonzero(parts != np.bincount(parts).argmax()).tolist():
            both = count(x)
            for y in np.flatnonzero(100 * both >= threshold * (n[x] + n - both)).tolist():
                join(x, y)
    least: dict[int, int] = {}
    for label, x in seen.items():
        least[find(x)] = min(label, least.get(find(x), label))
    return [(label, least[find(x)]) for label, x in seen.items() if label != least[find(x)]]


def _confirmed(docs: DataFrame, members: DataFrame, vertices: DataFrame, partitions: int, threshold: int) -> DataFrame:
    """(vertex, root) of linked vertices; links are confirmed on the texts'
    full sets until no pair of a node that the sketches allow is left."""
    proposals = stage(_proposals(members, vertices, partitions, threshold), "proposals")
    groups = stage(components(proposals, GROUPING_ROUNDS), "proposal-groups")
    info = vertices.select(F.col("sid").alias("vertex"), "n", "bits", "k1", "k2", "doc_key")
    grouped = stage(groups.join(info, "vertex"), "group-members")
    parts = stage(grouped.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / GROUP_VERTICES), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts")), "group-parts")
    placed = stage(grouped.join(parts, "root").withColumn(
        "block", F.xxhash64("root", F.pmod(F.xxhash64("vertex"), F.col("parts")))).drop("root", "parts"), "placed")
    links = _links(docs, placed.withColumn("part", F.col("block")).withColumn("label", F.col("vertex")), partitions, threshold)
    many = parts.filter(F.col("parts") >= MANY_BLOCKS).take(1)
    for likeliest in (True, False) if many else (False,):
        roots = stage(components(links), "linked")
        now = stage(placed.join(roots.withColumnRenamed("root", "label"), "vertex", "left").withColumn(
            "label", F.coalesce("label", "vertex")), "labelled")
        left = stage(_open(members, now, partitions, likeliest, threshold), "open")
        if not left.take(1):
            return roots
        more = _links(docs, left.join(now, "vertex"), partitions, threshold)
        if not more.take(1) and not likeliest:
            return roots
        links = stage(links.union(more), "all-links")
    return components(links)


def _links(docs: DataFrame, needed: DataFrame, partitions: int, threshold: int) -> DataFrame:
    """Links (u, v) of labels to the smallest one of their component in a
    part; ``needed``: (part, vertex, label, k1, k2, doc_key)."""
    needed = stage(needed.select("part", "vertex", "label", "k1", "k2", "doc_key"), "needed-texts")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW_KEY)).alias("doc_key"),
                       text_or_empty().cast("binary").alias("text"))
    # by id at every size: texts are too large to depend on what is broadcast
    dealt = (text.join(needed.hint("merge"), "doc_key").select("part", "vertex", "label", "k1", "k2", "text")
             .repartition(partitions, "part").sortWithinPartitions("part", "vertex"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> None:
            if len(sets) > 1:
                out.extend(_confirm(np.array(labels), sets, threshold))
            sids.clear()
            labels.clear()
            sets.clear()

        now, sids, labels, sets, out = None, [], [], [], []
        for batch in batches:
            part, vertex, label, k1, k2 = (batch.column(c).to_pylist() for c in range(5))
            text = batch.column(5)
            for lo, hi in _words.blocks(text):
                for row, s in enumerate(shingle_sets(text, lo, hi), lo):
                    if part[row] != now:
                        flush()
                        now = part[row]
                    # a repeated id may bring another text, a repeated row the same one
                    if _sum_key(s) == (k1[row], k2[row]) and (not sids or sids[-1] != vertex[row]):
                        sids.append(vertex[row])
                        labels.append(label[row])
                        sets.append(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return stage(dealt.mapInArrow(run, "u long, v long"), "confirmed-links")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _components_of_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, tid, n, root, component_id) for every row of ``docs``; root
    names the component, null for empty sets."""
    partitions = _partitions(docs.sparkSession)
    rows = stage(_describe(docs), "shingled")
    vertices = stage(
        rows.filter("n > 0").groupBy("k1", "k2").agg(
            F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"),
            F.coalesce(F.min("doc_id"), F.lit(_LOW_KEY)).alias("doc_key"))
        .withColumn("sid", F.monotonically_increasing_id()), "vertices")
    leaves = _leaves(vertices, threshold)
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    roots = _confirmed(docs, members, vertices, partitions, threshold).select(F.col("vertex").alias("sid"), "root")
    unstage(*leaves)
    owned = stage(vertices.select("sid", "k1", "k2", "doc_key").join(roots, "sid", "left").select(
        "k1", "k2", F.coalesce("root", "sid").alias("root"), "doc_key"), "rooted")
    # a vertex's doc_key is its smallest id already
    smallest = stage(owned.groupBy("root").agg(F.min(F.when(
        F.col("doc_key") != _LOW_KEY, F.col("doc_key"))).alias("component_id")), "smallest")
    named = stage(owned.join(smallest, "root").select("k1", "k2", "root", "component_id"), "named")
    # keys of empty sets are nulled: they all are one key
    slim = rows.select("doc_id", "tid", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return slim.join(named, ["k1", "k2"], "left").select("doc_id", "tid", "n", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``;
    a link is a likeness of ``threshold`` percent or more."""
    return _components_of_rows(docs, threshold).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of every component, that of the smallest id
    (ties: text hash); rows that repeat both id and text stay alike."""
    rows = stage(_components_of_rows(docs, threshold).filter("root IS NOT NULL"), "near-rows")
    me = F.struct(F.coalesce("doc_id", F.lit(_LOW_KEY)).alias("id"), F.col("tid").alias("tid"))
    first = stage(rows.groupBy("root").agg(F.min(me).alias("first")), "near-firsts")
    gone = rows.join(first, "root").filter(me != F.col("first")).select(me.alias("me")).distinct()
    mine = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW_KEY)).alias("id"),
                    F.xxhash64(text_or_empty()).alias("tid"))
    return as_row(docs, mine=mine).join(gone, F.col("mine") == F.col("me"), "left_anti").select("row.*")
