from docs import documents, sha

import numpy as np

from shelfwright.llm import exact_dedup as X


def test_perfect_hash_has_no_gaps():
    for m in (1, 2, 7, 64, 1000, 15752):
        r = np.random.default_rng(m)
        a, b, c = (r.integers(0, 1 << 28, m) for _ in range(3))
        _, slots = X._place(a, b, c, r.integers(0, max(1, m // 4), m), 0)
        assert sorted(slots.tolist()) == list(range(m))


def test_ties_nulls_and_repeats(spark):
    texts = ["a", "a", None, "", "b", "x" * 300_000, "x" * 300_000, "c", "c", "c"]
    ids = [1, 5, 2, 3, 4, 6, 7, None, None, 8]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept, r.text_sha256)
                 for r in X.exact_dedup(documents(spark, texts, ids)).collect())
    assert got == [(-1, 8, 3, False, sha("c")), (-1, 8, 3, False, sha("c")), (1, 5, 2, False, sha("a")), (2, 3, 2, False, sha("")),
                   (3, 3, 2, True, sha("")), (4, 4, 1, True, sha("b")), (5, 5, 2, True, sha("a")),
                   (6, 7, 2, False, sha("x" * 300_000)), (7, 7, 2, True, sha("x" * 300_000)), (8, 8, 3, True, sha("c"))]


def test_history_names_the_winner_and_nonmembers_group_apart(spark):
    history = spark.createDataFrame([(sha(f"old{k}"), k, 2) for k in range(500)], "digest string, winner long, n long")
    docs = documents(spark, ["old7", "new", "new", "old499", "other"], [1000, 1001, 1002, 1003, 1004])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(docs, history).collect()}
    assert got == {1000: (7, 3, False), 1001: (1002, 2, False), 1002: (1002, 2, True), 1003: (499, 3, False), 1004: (1004, 1, True)}


def test_history_grows_by_members_and_nonmembers(spark):
    history = spark.createDataFrame([(sha("a"), 5, 2), (sha("b"), 9, 1), (sha("n"), None, 1)], "digest string, winner long, n long")
    groups = spark.createDataFrame([(sha("a"), 7, 3), (sha("b"), 3, 1), (sha("c"), 4, 2), (sha("n"), None, 2)], "digest string, own long, own_n long")
    got = {r.digest: (r.winner, r.n) for r in X.update_history(history, groups).collect()}
    assert got == {sha("a"): (7, 5), sha("b"): (9, 2), sha("c"): (4, 2), sha("n"): (None, 3)}
    none = X.update_history(history.limit(0), groups)
    assert {r.digest: (r.winner, r.n) for r in none.collect()} == {sha("a"): (7, 3), sha("b"): (3, 1), sha("c"): (4, 2), sha("n"): (None, 2)}


def test_both_halves_hold_members_and_nonmembers(spark):
    texts = [f"t{k % 170}" for k in range(400)] + ["hot"] * 200
    want = {}
    for k, t in enumerate(texts):
        want.setdefault(t, []).append(k)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(documents(spark, texts)).collect()}
    assert got == {k: (max(want[t]), len(want[t]), k == max(want[t])) for k, t in enumerate(texts)}


def test_lookup_compares_all_bytes(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_KEYS", 64)
    keys = [sha(str(k)) for k in range(1000)]
    index = X.build_index(spark.createDataFrame([(d, k, 1) for k, d in enumerate(keys)], "digest string, winner long, n long"))
    assert index.buckets == 16
    probes = keys + [sha(f"no{k}") for k in range(1000)]
    got = {r.digest: r.winner for r in X.lookup(spark.createDataFrame([(p,) for p in probes], "digest string"), index).collect()}
    assert got == {p: (k if k < 1000 else None) for k, p in enumerate(probes)}


def test_empty_table(spark):
    assert X.exact_dedup(documents(spark, [])).count() == 0
    assert X.drop_copies(documents(spark, [])).count() == 0


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = documents(spark, ["a", "a", "b", "b", None], [1, 2, 3, 3, 4])
    got = X.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.digest) for r in got.collect()) == [(2, "a", "d"), (3, "b", "d"), (4, None, "d")]
