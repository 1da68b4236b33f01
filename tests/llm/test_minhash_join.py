import random

import numpy as np
import pyarrow as pa
import pytest
from docs import documents, near_components

from shelfwright.llm import minhash_join as M
from shelfwright.llm._components import components


def sentence(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()) + str(rng.randrange(50))
            for _ in range(n)]


def corpus(rng):
    """Near copies of several sizes, links at the threshold's sides, chains."""
    texts = []
    for size in (2, 3, 40, 150):
        base = sentence(rng, 260)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10 ** 6))
            texts.append(" ".join(w))
    chain = sentence(rng, 120)
    for k in range(12):  # neighbours are linked, the ends are not
        texts.append(" ".join(chain[5 * k:] + sentence(rng, 5 * k)))
    shared = sentence(rng, 60)
    texts += [" ".join(shared + sentence(rng, 60)) for _ in range(60)]
    texts += [" ".join(sentence(rng, rng.randrange(1, 9))) for _ in range(60)]
    return texts


def check(spark, texts, ids):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(documents(spark, texts, ids)).collect()), key=str)
    want = near_components(list(zip(ids, texts)))
    assert got == sorted(((ids[k], n, c, ids[k] == c) for k, (n, c) in want.items()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # all nodes large, groups dealt to several tasks, blocks in use
        for name, value in (("SMALL_NODE", 4), ("BLOCK", 16), ("GROUP_VERTICES", 24)):
            monkeypatch.setattr(M, name, value)
    texts = corpus(random.Random(9))
    texts += [texts[0], texts[0].upper(), "\t" + texts[0].replace(" ", "\n"), None, "", " \n ", "one", "One", "one two", "x " * 30_000]
    check(spark, texts, random.Random(1).sample(range(10 ** 6), len(texts)))


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word[:n]


def test_long_words_that_polynomials_confuse(spark):
    """Disjoint sets of one word each, and of shingles with such words."""
    a, b = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    check(spark, [a, b, f"one two {a} three four five", f"one two {b} three four five"], [1, 2, 3, 4])


def test_ties_null_ids_and_repeated_rows(spark):
    t = "a b c d e f g h"
    check(spark, [t, t, t, "q", "q", None], [4, 4, None, None, None, None])
    assert M.near_duplicates(documents(spark, [])).count() == 0


def test_drop_near_copies(spark):
    rng = random.Random(3)
    base = sentence(rng, 200)
    texts = [" ".join(base), " ".join(base[:-1]), "other text of its own", None, "", "z"]
    docs = documents(spark, texts, [5, 3, 3, 7, 8, None])
    got = M.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text and r.text[:5]) for r in got.collect()) == sorted(
        [("3", " ".join(base)[:5]), ("3", "other"), ("7", None), ("8", ""), ("None", "z")], key=str)


def test_pairs_meet_and_sketches_agree():
    a = np.unique(np.random.default_rng(1).integers(0, 2 ** 63, 900).astype(np.uint64))
    other = np.concatenate([a[:-70], np.random.default_rng(2).integers(0, 2 ** 63, 70).astype(np.uint64)])
    b = np.unique(other)
    assert M.linked(a, b) and abs((M.minwise(a) == M.minwise(b)).mean() - 0.85) < 0.1


def test_components(spark):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(0, 90)] + [(1000, k) for k in range(200, 400)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in links:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_confirming_a_group_of_near_misses(monkeypatch):
    """Many pairs just below the threshold: the links found are those of all pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2 ** 64, 400, dtype=np.uint64)
    sets = []
    for k in range(120):
        own = rng.integers(0, 2 ** 64, 400, dtype=np.uint64)
        keep = rng.random(400) < (0.97 if k % 6 == 0 else 0.9)
        sets.append(np.unique(np.where(keep, base, own)))
    sets.append(np.unique(np.concatenate([sets[1][:-20], own[:20]])))
    want = {frozenset(c) for c in _classes(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if M.linked(sets[a], sets[b])])}
    for failures in (0, 4, 10 ** 6):
        monkeypatch.setattr(M, "FAILURES", failures)
        got = M._confirm(np.arange(len(sets)), sets)
        assert {frozenset(c) for c in _classes(len(sets), got)} == want
    assert 1 < len(want) < len(sets)


def _classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for x in range(n):
        out.setdefault(find(x), []).append(x)
    return out.values()


@pytest.mark.parametrize("copies", [6, 50])
def test_two_versions_of_a_text(spark, monkeypatch, copies):
    """Every copy's nearest are of its own version; the versions are linked all the same."""
    monkeypatch.setattr(M, "GROUP_VERTICES", 8)
    for many in (2, 10 ** 6):
        monkeypatch.setattr(M, "MANY_BLOCKS", many)
        rng = random.Random(copies)
        texts = []
        for _ in range(6):
            base = sentence(rng, 300)
            other = base[:265] + sentence(rng, 19) + base[284:]  # likeness of about 0.86 with base
            for version in (base, other):
                for _ in range(copies):  # one place edited, 0.97 within a version
                    w = list(version)
                    w[2] = "edit" + str(rng.randrange(10 ** 6))
                    texts.append(" ".join(w))
        check(spark, texts, random.Random(2).sample(range(10 ** 6), len(texts)))


@pytest.mark.parametrize("n", [7, 8, 10, 14, 20])
def test_trees_of_short_texts_are_independent(n):
    """Share of pairs of short sets, likeness 0.867 to 0.909, that meet in no tree."""
    rng = np.random.default_rng(n)
    sets = []
    for _ in range(4000):
        a = rng.integers(0, 2 ** 64, n + 1, dtype=np.uint64)
        sets += [np.sort(a[:-1]), np.sort(a if n < 12 else np.append(a[1:-1], rng.integers(0, 2 ** 64, 1, dtype=np.uint64)))]
    size = 8000
    vertices = pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int64)), pa.array(np.arange(size)),
                                           pa.array([t.tobytes() for t in M.tokens_of(sets)], pa.binary())], names=["node", "sid", "tokens"])

    class Local:  # runs the level in this process
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return pa.Table.from_batches(run(iter([vertices])))

    node = M._branch(Local(), 0).column("node").to_numpy().reshape(M.TREES, size // 2, 2)
    assert (node[:, :, 0] != node[:, :, 1]).all(axis=0).mean() <= 0.001


def test_tasks_hold_two_blocks(spark, monkeypatch):
    """A text that all others are copies of draws no family into one task."""
    monkeypatch.setattr(M, "GROUP_VERTICES", 16)
    held = []
    links = M._links

    def seen(docs, needed, *rest):
        held.append(max(r["count"] for r in needed.groupBy("part").count().collect()))
        return links(docs, needed, *rest)

    monkeypatch.setattr(M, "_links", seen)
    rng = random.Random(4)
    base, texts = sentence(rng, 300), []
    for k in range(400):
        w = list(base)
        for at in rng.sample(range(300), 4 if k else 0):
            w[at] = "edit" + str(rng.randrange(10 ** 6))
        texts.append(" ".join(w))
    check(spark, texts, list(range(len(texts))))
    assert held[0] <= 40 and max(held) <= 80


def test_drop_near_copies_from_80_percent(spark):
    """The join against brute force at 0.8, likeness on both sides of 0.8 and 0.85."""
    rng = np.random.default_rng(5)
    texts = []
    for family in range(12):
        base = [f"w{family}x{k}" for k in range(200)]
        texts.append(" ".join(base))
        for edits in (2, 3, 4, 5, 6):
            w = list(base)
            for at in rng.choice(range(10, 190), edits, replace=False):
                w[at] = f"e{rng.integers(10 ** 9)}"
            texts.append(" ".join(w))
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    between = 0
    for a in range(len(texts)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            between += 80 * either <= 100 * both < 85 * either
            if 100 * both >= 80 * either:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    want = {k for k, r in enumerate(root) if k == r}
    got = {r.doc_id for r in M.drop_near_copies(documents(spark, texts), threshold=80).collect()}
    assert between and got == want
