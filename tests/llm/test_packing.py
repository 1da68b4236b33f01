import random
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
from docs import documents
from tokenizers import Tokenizer

from shelfwright.llm import packing as K

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_encode_like_whole_texts(tokenizer):
    rng, encoder = random.Random(1), K.WordEncoder(PATH)
    alphabet = [" ", "\n", "\x1c", "\x85", "\xa0", "᠎", "a", "B", "é", "É", "J̌", "é", "Σ", "ΑΣ", "İ", "ß", "'s", "'LL", "don't", "12",
                "２", "!", "...", "#", "日本", "😀", "K", "Å", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_cover_every_id_once(spark, tokenizer):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["sun", "moon", "Überfluss", "x1", "tree."]) for _ in range(rng.randrange(1, 1500))) for _ in range(150)]
    texts += [None, "", "a " * 9000, "same", "same", "b " * 4095, "x <|endoftext|> y", "x<|startoftext|><|endoftext|>y z"]
    rows = K.pack(documents(spark, texts), PATH, group_items=40).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at:at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    # every group may leave part of a window empty
    small = sum(r.length < 4096 for r in rows)
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 4096) + -(-small // 40)


def test_repeated_ids_and_empty_table(spark):
    rows = K.pack(documents(spark, ["a b", "a b", "c"], [1, 1, None]), PATH).collect()
    assert sorted(r.offset for r in rows) == [0, 2, 5] or sum(r.length for r in rows) == 8
    assert K.pack(documents(spark, []), PATH).count() == 0


def test_many_repeated_rows_spread_over_the_groups(spark):
    """Groups stay small although all rows are the same."""
    rows = documents(spark, ["same words"], [1]).crossJoin(spark.range(20_000).select()).repartition(4)
    assert rows.count() == 20_000
    packed = K.pack(rows, PATH, group_items=500)
    sizes = packed.selectExpr("sequence_id DIV 16777216 AS g").groupBy("g").count().collect()
    assert len(sizes) == 40 and max(r["count"] for r in sizes) < 700
    assert packed.selectExpr("count(*)", "sum(length)").first()[:2] == (20_000, 60_000)


def test_differencing():
    sizes = [8, 7, 6, 5, 4]
    parts = K.difference(sizes, 2)
    assert sorted(sum(sizes[i] for i in p) for p in parts) == [14, 16]
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1025) for _ in range(600)]
    parts = K.difference(sizes, 75)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(600)) and max(sums) - min(sums) < 40


def test_window_count_rises():
    assert len(K.pack_group([3, 3, 3], 5)) == 3
    assert K.pack_group([]) == [] and K.pack_group([4096]) == [[0]]
