import random

import pytest
from docs import documents, without_repeats

from shelfwright.llm import substring_dedup as D


def check(spark, texts, ids=None):
    docs = documents(spark, texts, ids)
    got = sorted(tuple(map(str, r)) for r in D.remove_repeats(docs).collect())
    ids = range(len(texts)) if ids is None else ids
    assert got == sorted(tuple(map(str, (i, *x))) for i, x in zip(ids, without_repeats(texts)))


@pytest.mark.parametrize("letters", [2, 3, 12])
def test_small_alphabets(spark, letters):
    """Few different words: runs, periods and overlapping repeats everywhere."""
    rng = random.Random(letters)
    texts = []
    for _ in range(120):
        w = [rng.choice("abcdefghijkl"[:letters]) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = (w[:rng.randrange(1, 6)] or ["a"]) * rng.randrange(20)
        texts.append(" ".join(w))
    check(spark, texts)


def test_passages_at_every_place_and_length(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10 ** 6))
    passage = [word() for _ in range(60)]
    texts = []
    for length in (33, 34, 35, 36, 40, 48, 60):
        for lead in range(0, 40, 3):
            k = rng.randrange(60 - length + 1)
            texts.append(" ".join([word() for _ in range(lead)] + passage[k:k + length] + [word() for _ in range(rng.randrange(30))]))
    same = [word() for _ in range(50)]
    texts += [" ".join(same + ["mid"] + same), " ".join(["a"] * 35), " ".join(["a"] * 36), " ".join(["b", "c"] * 40)]
    check(spark, texts)


def test_copies_nulls_ties_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    part = " ".join(f"w{k}" for k in range(100, 160))
    texts = [long, long, part, part + " tail", None, "", "short text", "short text", long.replace(" ", "\n"), "é " * 40, "x " * 50]
    check(spark, texts)
    check(spark, [part, part, part + " y", "a b", "a b", None], [1, 1, None, 2, 2, None])
    assert D.remove_repeats(documents(spark, [])).count() == 0


def test_words_and_windows_that_polynomials_confuse(spark):
    """Windows that differ in one long word, or in the order of two words."""
    from test_minhash_join import thue_morse
    a, b = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    words = [f"w{k}" for k in range(35)]
    texts = [" ".join([*words[:30], x, *words[31:]]) for x in (a, b)]
    for n in (35, 64, 2048):  # the same for words in place of letters
        texts += [" ".join("sun" if c == "a" else "moon" for c in thue_morse(n, *p)) for p in ("ab", "ba")]
    check(spark, texts)
