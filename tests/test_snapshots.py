"""Catalogue snapshots, the title index, listing in tasks, replayed batches."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import catalog as G
from shelfwright.plans import fixtures as X
from shelfwright.sources import library as L
from shelfwright.sources import snapshots as S
from test_scale import conf
from test_sources import BOOK, write, zip_bytes

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cat(spark):
    base = X.cat_parsed_base(spark, D).persist()
    return base, G.build_catalog(base)


def keys(cat):
    return (sorted(r.digest for r in cat.books.collect()), sorted(r.normalized_name for r in cat.persons.collect()),
            sorted((r.book_id, r.person_id) for r in cat.links.collect()), sorted(r.id for r in cat.titles.collect()))


def test_a_run_that_dies_between_tables_shows_nothing(spark, tmp_dir, cat, monkeypatch):
    base, whole = cat
    root = f"{tmp_dir}/c"
    part = G.build_catalog(base.filter("book_no % 3 = 0"))
    L.write_catalog(part, root, bulk=True)
    before = keys(L.read_catalog(spark, root))
    add = L._add_files

    def dies(rows, root, name, bulk):
        if name == "book_authors":
            raise OSError("killed")
        return add(rows, root, name, bulk)

    new = G.upsert(L.read_catalog(spark, root), base)
    monkeypatch.setattr(L, "_add_files", dies)
    with pytest.raises(OSError):
        L.write_catalog(new, root)
    monkeypatch.undo()
    assert keys(L.read_catalog(spark, root)) == before
    assert len(S.table_files(spark, root, "books")) > len(S.latest(spark, root)[1]["books"])
    L.write_catalog(G.upsert(L.read_catalog(spark, root), base), root)  # the run again
    after = keys(L.read_catalog(spark, root))
    assert after[:3] == (sorted(r.digest for r in whole.books.collect()), sorted(r.normalized_name for r in whole.persons.collect()),
                         sorted((r.book_id, r.person_id) for r in whole.links.collect()))
    assert S.vacuum(spark, root) > 0 and keys(L.read_catalog(spark, root)) == after


def test_delete_and_compact_are_snapshots(spark, tmp_dir, cat):
    base, whole = cat
    root = f"{tmp_dir}/c"
    L.write_catalog(whole, root)
    first = L.read_catalog(spark, root)
    before = keys(first)
    gone = first.books.orderBy("digest").limit(3).select("digest").unionByName(spark.createDataFrame([("nobody",)], "digest string"))
    status = L.delete_from_catalog(spark, root, gone)
    assert sorted(r.status for r in status.collect()) == ["deleted"] * 3 + ["not found"]
    after = keys(L.read_catalog(spark, root))
    assert after[0] == before[0][3:] and after[1] == before[1] and len(after[3]) == len(before[3]) - 3
    assert keys(first) == before  # an older snapshot stays readable
    small = L.compact_catalog(spark, root)
    assert keys(small) == after and S.numbers(spark, root) == [1, 2, 3]
    assert S.vacuum(spark, root) > 0 and keys(L.read_catalog(spark, root)) == after
    with pytest.raises(ValueError):
        L.write_catalog(whole, root, mode="errorifexists")


def test_only_one_writer_gets_a_number(spark, tmp_dir):
    S.commit(spark, tmp_dir, 1, {"books": ["a"]})
    with pytest.raises(S.CommitConflict):
        S.commit(spark, tmp_dir, 1, {"books": ["b"]})
    assert S.latest(spark, tmp_dir) == (1, {"books": ["a"]}) and S.numbers(spark, tmp_dir) == [1]


def test_a_folder_without_manifests_is_adopted(spark, tmp_dir, cat):
    base, whole = cat
    root = f"{tmp_dir}/c"
    for name, df in whole.tables().items():
        df.write.parquet(f"{root}/{name}")
    old = L.read_catalog(spark, root)
    assert old.titles is None and old.books.count() == whole.books.count()
    L.write_catalog(G.upsert(old, base), root)
    now = L.read_catalog(spark, root)
    assert now.books.count() == now.titles.count() == whole.books.count() and now.links.count() == whole.links.count()


def test_title_search_skips_files(spark, tmp_dir, cat):
    import pyarrow.parquet as pq
    _, whole = cat
    root = f"{tmp_dir}/c"
    with conf(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        L.write_catalog(whole, root, bulk=True)
    spans = sorted((t[0], t[-1]) for f in S.latest(spark, root)[1]["titles"]
                   if (t := pq.read_table(f"{root}/titles/{f}", columns=["title"])["title"].to_pylist()))
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    titles = L.read_catalog(spark, root).titles
    found = G.search_titles(titles, "Order bc")
    assert "StringStartsWith(title,Order bc)" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in G.search_titles(whole.books, "Order bc").collect())


def test_listing_in_tasks_equals_sparks_own(spark, tmp_dir):
    lib = f"{tmp_dir}/lib"
    for name in ("a.fb2", "x/b.fb2.zip", "x/y/z/c d.fb2", "x/C.FB2", "x/.hidden.fb2", "_skip/e.fb2", "k=_1/f.fb2", "_k=1/g.fb2", "x/n.txt"):
        write(f"{lib}/{name}", name.encode())
    os.makedirs(f"{lib}/empty.fb2")
    rows = lambda df: sorted((r.path, r.length, r.modificationTime) for r in df.collect())
    own = lambda path: (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                        .option("pathGlobFilter", L.BOOK_GLOB).load(path))
    for path in (lib, f"file:{lib}/", f"file://{lib}", f"{lib}/x", f"{lib}/a.fb2"):
        assert rows(L.scan_library(spark, path, with_content=False)) == rows(own(path)), path
    assert rows(L.scan_library(spark, f"{lib}/x*")) == rows(own(f"{lib}/x*"))
    assert {r.basename: bytes(r.content) for r in L.scan_library(spark, lib).collect()}["c d.fb2"] == b"x/y/z/c d.fb2"
    plan = L.scan_library(spark, lib, with_content=False)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex" not in plan or "listing" in plan
    with pytest.raises(Exception):
        L.scan_library(spark, f"{tmp_dir}/none").count()
    os.makedirs(f"{tmp_dir}/void")
    assert L.scan_library(spark, f"{tmp_dir}/void").count() == 0


def test_members_are_kept_as_far_as_needed(spark, monkeypatch):
    from shelfwright.sources import archives as A
    head = b"<FictionBook><description><title-info><book-title>T</book-title></title-info></description>"
    body = head + b"<body>" + b"x" * 5_000_000 + b"</body></FictionBook>"

    def squeezed(data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("b.fb2", data)
        return out.getvalue()

    good = squeezed(body)
    assert len(good) < 10_000 and A._unzip_one(good) == (body, None)
    assert A._unzip_one(good, b"</description>") == (head, None)
    hidden = b"<!-- </description> -->" + body
    assert A._unzip_one(squeezed(hidden), b"</description>") == (hidden, None)
    monkeypatch.setattr(A, "PIECE", 7)  # the marker lies across pieces
    assert A._unzip_one(squeezed(head * 2), b"</description>") == (head, None)
    monkeypatch.undo()
    broken = bytearray(good)
    broken[-80] ^= 1  # past the marker: the checksum is still checked
    assert A._unzip_one(bytes(broken), b"</description>")[1]
    monkeypatch.setattr(A, "LARGEST_MEMBER", 1000)
    assert "more than" in A._unzip_one(good)[1]
    monkeypatch.undo()
    # what a task hands over at once is bounded by inflated bytes
    monkeypatch.setattr(A, "BATCH_BYTES", 6_000_000)
    files = spark.createDataFrame([(f"{k}.fb2.zip", bytearray(good), k) for k in range(20)] + [("p.fb2", bytearray(b"<a/>"), 99), (None, None, 1)],
                                  "path string, content binary, n int").coalesce(1)
    opened = A.open_books(files)
    assert opened.columns == ["path", "content", "n", "error"]
    sizes = opened.select("path", "n", F.octet_length("content").alias("size"), "error").collect()
    assert sorted((r.n, r.size) for r in sizes if r.path) == [(k, len(body)) for k in range(20)] + [(99, 4)] and len(sizes) == 22
    short = A.open_books(files, until="</description>").filter("n < 20 AND path IS NOT NULL")
    assert {r.s for r in short.select(F.octet_length("content").alias("s")).collect()} == {len(head)}


def test_replayed_epoch_leaves_rejects_unchanged(spark, tmp_dir):
    from shelfwright.streaming.library_stream import _index_batch, stream_library
    lib, root, rejects = (f"{tmp_dir}/{n}" for n in ("lib", "cat", "rejects"))
    write(f"{lib}/a.fb2", BOOK.format(enc="utf-8", t="One", a="A").encode())
    write(f"{lib}/b.fb2", b"<FictionBook>")
    write(f"{lib}/c.fb2.zip", zip_bytes({"n.txt": b""}))
    batch = L.scan_library(spark, lib)
    for _ in range(2):
        for epoch in (0, 1):
            _index_batch(root, None, None, rejects)(batch, epoch)
    assert sorted((r.epoch, r.basename) for r in spark.read.parquet(rejects).collect()) == [
        (e, n) for e in (0, 1) for n in ("b.fb2", "c.fb2.zip")]
    assert L.read_catalog(spark, root).books.count() == 1
    stream_library(spark, lib, f"{tmp_dir}/cat2", f"{tmp_dir}/ckpt", rejects_root=f"{tmp_dir}/rejects2")
    assert sorted(r.basename for r in spark.read.parquet(f"{tmp_dir}/rejects2").collect()) == ["b.fb2", "c.fb2.zip"]


def test_stream_joins_names_before_it_reads_bytes(spark, tmp_dir, monkeypatch):
    from shelfwright.streaming import library_stream as M
    lib = f"{tmp_dir}/lib"
    for k in range(3):
        write(f"{lib}/{k}.fb2", BOOK.format(enc="utf-8", t=f"Title {'abc'[k]}", a="A").encode())
    plans, selected = [], M._selected

    def look(files, blacklist):
        out = selected(files, blacklist)
        plans.append((files.columns, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(M, "_selected", look)
    black = spark.createDataFrame([("0.fb2", "x")], "basename string, comment string")
    M.stream_library(spark, lib, f"{tmp_dir}/cat", f"{tmp_dir}/ckpt", blacklist=black)
    assert plans and all("content" not in columns and "content" not in plan for columns, plan in plans)
    assert L.read_catalog(spark, f"{tmp_dir}/cat").books.count() == 2


def test_batches_beyond_the_bound_shuffle_few_catalogue_keys(spark):
    table = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("digest"))
    batch = spark.range(39_000, 41_000).select(F.md5(F.col("id").cast("string")).alias("digest")).unionByName(
        spark.createDataFrame([(None,)], "digest string"))
    with conf(spark, **{"shelfwright.broadcast.maxRows": "10", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        from shelfwright.operators._joins import maybe_among
        from shelfwright.session import written
        left = G._not_in_catalog(batch, table, ["digest"])
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and plan.index("BroadcastHashJoin") < plan.index("bitmap_construct_agg")
        assert left.count() == 1001
        wanted = written(batch, "wanted")
        few = maybe_among(table, wanted, ["digest"], bits=1 << 22)
        assert 1000 <= few.count() < 1100 and few.join(wanted, "digest").count() == 1000


def test_summary_shuffles_no_path(spark):
    from shelfwright.plans.pipeline import summary
    files = spark.range(100).select(F.col("id").cast("string").alias("path"))
    totals = summary(files, files.filter("path >= '3'"), files.filter("path > '8'"))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    n, bad = sum(str(k) >= "3" for k in range(100)), sum(str(k) > "8" for k in range(100))
    assert totals.first().asDict() == {"total": 100, "blacklisted": 100 - n, "to_process": n, "failed": bad, "ok": n - bad}
    assert summary(files.limit(0), files.limit(0), files.limit(0)).first()["total"] == 0
