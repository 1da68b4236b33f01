"""The pipeline against brute force, stage by stage, each on its own input."""

import re

import numpy as np
import public_tokenizers as P
from docs import documents, near_components
from tokenizers import Tokenizer

import corpus_pipeline as C
from shelfwright.llm import quality
from test_secret_scan import brute

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == names
        path = C.scratch_path(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            want = {i: r for i, r in rows.items() if i in good}
        elif name == "exact dedup":
            last = {}
            for i in sorted(rows):
                last[rows[i].text or ""] = i
            want = {i: rows[i] for i in last.values()}
        elif name == "near dedup":
            order = sorted(rows)
            found = near_components([(i, rows[i].text) for i in order], 80)
            want = {i: rows[i] for k, i in enumerate(order) if found[k][1] == i}
        else:
            assert set(kept) == set(rows)
            for i, r in kept.items():
                spans = [tuple(map(int, s.split(":")[1:])) for s in brute(rows[i].text).split(",") if s]
                if not spans:
                    assert r == rows[i]
                    continue
                secret = np.zeros(len(rows[i].text), bool)
                for a, b in spans:
                    secret[a:b] = True
                clear = "".join(c for c, s in zip(rows[i].text, secret) if not s)
                assert re.sub(re.escape("[secret]"), "", r.text) == clear and r.n_chars == len(r.text)
            want = kept
        assert kept == want, name
        assert name != "quality" or 0 < len(kept) < len(rows)
        rows = kept
    pieces = C.pack(spark, docs, D).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    total = {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == total


def test_run_and_odd_rows(spark, tmp_dir):
    docs = documents(spark, [None, "", "Some words that are fine here. " * 9, "Some words that are fine here. " * 9, "x"], [1, 2, 3, 4, None])
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    assert {r.doc_id for r in C.run(spark, tmp_dir).collect()} == {2, 4, None}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_dir}/documents.parquet")
    assert C.run(spark, tmp_dir).count() == 0
