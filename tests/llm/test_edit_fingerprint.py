import random

import numpy as np
from docs import documents, sha

from shelfwright.llm import edit_fingerprint as E


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_rows_against_brute_force(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(300)] + [None, "", "é😀", "z" * 200_000]
    ids = rng.sample(range(-1000, 10 ** 12, 10 ** 7), len(texts))
    got = {r.doc_id: r for r in E.fingerprint_documents(documents(spark, texts, ids)).collect()}
    ordered = sorted(zip(ids, (t or "" for t in texts)), reverse=True)
    assert len(got) == len(ordered)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 3
        edited = t[:len(t) - n] + following[:n]
        own, changed, other = E.fingerprints([t, edited, following])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), changed.tobytes().hex())
        assert (r.near_edited, r.near_next) == (np.mean(own == changed), np.mean(own == other))


def test_likeness_follows_edits():
    rng = random.Random(4)
    texts = [words(rng, 300) for _ in range(40)]
    few, many = [], []
    for t in texts:
        for share, out in ((0.005, few), (0.1, many)):
            c = list(t)
            for _ in range(int(len(c) * share)):
                k = rng.randrange(len(c))
                c[k:k + 1] = rng.choice([[], ["q"], [c[k], "q"]])
            out.append("".join(c))
    a, b, c = (E.fingerprints(x) for x in (texts, few, many))
    close, far, other = (E.likeness(a, x).mean() for x in (b, c, np.roll(a, 1, 0)))
    assert close > 0.6 and close > far + 0.2 and other < 0.2
    assert (E.fingerprints(texts) == E.fingerprints(texts[::-1])[::-1]).all()


def test_ties_nulls_single_and_empty_tables(spark):
    docs = documents(spark, ["abc", "abc", None, "x"], [1, 1, None, None])
    assert E.fingerprint_documents(docs).count() == 4
    alone = E.fingerprint_documents(documents(spark, ["abcdef"], [3])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha("abcdab")
    assert E.fingerprint_documents(documents(spark, [])).count() == 0


def test_banding_and_verification(spark):
    rng = random.Random(6)
    base = words(rng, 200)
    texts = [base, base[:500] + "q" + base[500:], words(rng, 200), base]
    got = {(r.doc_id, r.near_id): r.edits for r in E.near_pairs(documents(spark, texts), 20).collect()}
    assert got == {(1, 0): 1, (3, 0): 0}


def test_near_documents_behind_unrelated_band_heads(spark, monkeypatch):
    """Two letters only: nearly every band's smallest document is unrelated."""
    monkeypatch.setattr(E, "BAND_BLOCK", 8)
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(90)]
    want = set()
    for k in range(80, 90):
        at = rng.randrange(250, 300)
        want.add((len(texts), k))
        texts.append(texts[k][:at] + "b" + texts[k][at:])
    prints = E.fingerprints(texts)
    want = {(c, b) for c, b in want if E.likeness(prints[b], prints[c]) >= 0.6}
    assert len(want) >= 8
    assert {(r.doc_id, r.near_id) for r in E.near_pairs(documents(spark, texts), 20).collect()} == want
