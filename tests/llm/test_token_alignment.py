import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from docs import documents, sha
from tokenizers import Tokenizer

from shelfwright.llm import token_alignment as T
from shelfwright.llm.queries import registry

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
D = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two", "x ", "\n\n\t", "<s>x</s><unk> <|endoftext|>", "▁x", "a▁", "é́", "ﬁn", "日本語 😀", "\x00",
       "İΑΣ", "ab" * 3000, " " * 5000, "don't we'll", "１２ 3", "　\xa0\x85", "the the the the"]


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: k for k, c in T._byte_letters().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at = out[-1][2]
        return out

    def one(text):
        if not text:
            return [], [], []
        ia, ib, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
        if b"".join(map(bytes_a, ia)) != raw or b"".join(map(piece, ib)) != raw:
            return [], [], []
        sa, sb = spans(ia, bytes_a), spans(ib, piece)
        links, k = [], 0
        for i, lo, hi in sa:
            while sb[k][2] <= lo:
                k += 1
            j = k
            while j < len(sb) and sb[j][1] < hi:
                links.append((i, sb[j][0]))
                j += 1
        groups, cut = [], sorted({s[2] for s in sa} & {s[2] for s in sb})
        ga, gb = iter(sa), iter(sb)
        for end in cut:
            part = [[], []]
            for side, it in ((0, ga), (1, gb)):
                for i, _, hi in it:
                    part[side].append(str(i))
                    if hi == end:
                        break
            groups.append(",".join(part[0]) + "|" + ",".join(part[1]))
        return links, groups, [len(sa), len(sb)]

    def run(texts):
        found = [one(t) for t in texts]
        links = Counter(x for f in found for x in f[0])
        docs = Counter(x for f in found for x in set(f[0]))
        most = Counter()
        for (_, j), c in links.items():
            most[j] = max(most[j], c)
        return [(f[2][0], f[2][1], len(f[1]), len(f[0]), sum(links[x] == most[x[1]] for x in f[0]), sum(links[x] for x in f[0]),
                 sha(";".join(f[1])), sum(docs[x] for x in f[0])) if f[0] else (0, 0, 0, 0, 0, 0, "", 0) for f in found]

    return run


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "docs_sum"]


def check(rows, ids, want):
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows)
    assert got == Counter((i, *w) for i, w in zip(ids, want))


def test_query_equals_brute_force(spark, brute):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    check(registry()["op12_token_alignment"](spark, D).collect(), [r.doc_id for r in docs], brute([r.text for r in docs]))


def test_odd_texts_in_small_blocks(spark, brute, monkeypatch):
    rng = random.Random(5)
    alphabet = [" ", "\n", "a", "B", "é", "the", "ing", "▁", "😀", "日", "0", "!!", "'s", "<s>", "\xa0", "ß"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)] + ODD
    monkeypatch.setattr(T, "PART_BYTES", 300)  # several parts a block are OR-merged
    monkeypatch.setattr(T, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(T, "OPEN_BLOCKS", 1)
    ids = [None, 7, 7, *range(len(texts) - 3)]
    check(T.align_documents(documents(spark, texts, ids), A, B, P.PATTERN).collect(), ids, brute(texts))


def test_empty_table(spark):
    assert T.align_documents(documents(spark, []), A, B, P.PATTERN).count() == 0
    assert T.align_documents(documents(spark, [None, ""]), A, B, P.PATTERN).count() == 2


def test_pair_counts(spark, brute):
    docs = documents(spark, ["the cat", "the the", "cat", None])
    rows = T.pair_counts(T.pair_index(docs, A, B, P.PATTERN)).collect()
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    the = (a.token_to_id("Ġthe"), b.piece_to_id("▁the"))
    assert [(r.docs, r.links, r.best) for r in rows if (r.a, r.b) == the] == [(2, 3, True)]


def test_ids_equal_the_vocabularys_own_library():
    """Same ids by the faster library, on every alphabet and on long runs."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    own, rng = T.ByteLevel(A, P.PATTERN), random.Random(6)
    assert own.fast is not None
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(some if rng.random() < 0.3 else " \n'sd19aé.") for _ in range(30)) for _ in range(3000)]
    texts += [" " * 1_500_000 + "x", "\n " * 400_000, "a" * 300_000, "<|endoftext|>"]
    for x in texts:
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids, repr(x[:40])
