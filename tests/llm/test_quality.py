import numpy as np
import pytest
from docs import documents

from shelfwright.llm import quality as Q


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = Q.train(docs, labels)
    return model, Q.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").toPandas()


def auc(p):
    good, bad = (p[p.quality == q].score.to_numpy() for q in (1, 0))
    return (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2


def test_held_out_rows_are_told_apart(scored):
    p = scored[1][scored[1].held_out]
    assert len(p) > 500 and auc(p) > 0.99
    assert (p.predicted == p.quality).mean() > 0.98
    assert ((p.score >= Q.THRESHOLD) == (p.predicted == 1)).all()


def test_held_out_is_the_crc(scored):
    import zlib
    for r in scored[1].head(300).itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_odd_texts_and_repeated_rows(spark, scored):
    texts = [None, "", " ", "one", "| " * 200_000, "é😀", "same words here", "same words here"]
    rows = sorted(Q.score(documents(spark, texts), scored[0]).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[6].score == rows[7].score and rows[4].predicted == 0
    kept = Q.keep_good(documents(spark, texts), scored[0])
    assert kept.columns == documents(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in rows if r.predicted]
    assert Q.score(documents(spark, []), scored[0]).count() == 0 and Q.keep_good(documents(spark, []), scored[0]).count() == 0


def test_labels_without_both_classes(spark):
    docs = documents(spark, ["a", "b"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.999999}
    ones = spark.createDataFrame([(k, 1) for k in range(2)] + [(None, 0), (1, None)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in Q.score(docs, Q.train(docs, ones)).collect())


def test_pairwise_tables_learn_an_interaction():
    x = np.random.default_rng(1).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert any({f, g} == {0, 1} for f, g, *_ in model.pairs)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
