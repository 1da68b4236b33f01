import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from docs import documents

from shelfwright.llm import byte_bpe as B

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def test_words_and_odd_spaces(reference):
    codec, rng = B.Codec(RANKS, P.PATTERN), random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u180e", "a", "b", "é", "'s", "'t", "1", "２", "!", "#", "日", "本",
                "\u200b", "😀", "e\u0301", "\r\n", "\u3000"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += ["", "a" * 5000, "ab" * 3000, "!" * 3000, " " * 2000 + "x", "日本" * 900, "".join(rng.choice("abcdefgh") for _ in range(4000))]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t[:40])
        assert codec.decode(ids) == t.encode()


def test_caches_may_be_cleared(reference, monkeypatch):
    monkeypatch.setattr(B, "CACHED_WORDS", 2)
    monkeypatch.setattr(B, "CACHED_PIECES", 2)
    codec = B.Codec(RANKS, P.PATTERN)
    for t in ("one two three four", "three two one", "five five one"):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_round_trip_of_rows(spark, reference):
    texts = ["Hello world", None, "", "Hello world", "x " * 50_000]
    rows = B.decode(B.encode(documents(spark, texts), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    for r in sorted(rows, key=lambda r: r.doc_id):
        want = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(want) and bytes(r.bytes) == want.encode()
    assert B.encode(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_fold_in_expressions(spark):
    ranks = {k: v for k, v in B.read_ranks(RANKS).items() if v < 3000}
    words = [b"", b"a", b" there", b"thntblere", "éèê".encode(), b"!!!!", b"\xff\x00", b"tionation"]
    got = B.fold_words(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"), ranks).collect()
    assert [list(r.ids) for r in got] == [B.fold_merges(bytes(r.word), ranks) for r in got]
