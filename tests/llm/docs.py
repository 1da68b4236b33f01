"""Rows that every operator on documents must handle, and brute-force
versions of the operators."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

CLASHING = ("doc_id long, text string, lang string, source string, n_chars long, digest string, blob string, "
            "row string, n long, key string, spans string, root long, tid long, word string")


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "d", "b", "r", 7, "k", "s", 1, 2, "w") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, CLASHING)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows, threshold=85):
    """{row number: (set size, component id)} by comparing all that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter((a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {k: (len(sets[k]), least.get(find(k)) if sets[k] else rows[k][0]) for k in range(len(rows))}


def without_repeats(texts, window=35):
    """(words, removed, sha of what is kept) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = True
        out.append((len(w), int(gone.sum()), sha(b" ".join(w[k] for k in np.flatnonzero(~gone)))))
    return out
