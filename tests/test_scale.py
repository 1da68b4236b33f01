"""Plans that must hold at scale: hot keys split, names joined before bytes
are read, nothing left cached, lookups that skip row groups."""

import contextlib
import os

import pytest
from pyspark.sql import functions as F

from shelfwright.operators.aliases import resolve_aliases
from shelfwright.operators.blacklist import exclude_blacklisted
from shelfwright.operators.identity import duplicate_groups
from shelfwright.plans.pipeline import extract, extracted, group, group_library, index, summary, validate, validate_library
from shelfwright.sources.library import (compact_catalog, read_blacklist, read_catalog, read_files, scan_library,
                                         write_by_author, write_catalog)
from test_sources import BOOK, write, zip_bytes


@contextlib.contextmanager
def conf(spark, **kv):
    kv = {k.replace("__", "."): v for k, v in kv.items()}
    old = {k: spark.conf.get(k, None) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def skewed(spark):
    """No broadcast, and thresholds under which a third of 60,000 rows is a skewed partition."""
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "shelfwright.broadcast.maxRows": "0",
                        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
                        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.shuffle.partitions": "12",
                        "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        yield spark


def split_joins(df):
    df.write.format("noop").mode("overwrite").save()  # adaptive plans are final after a run
    df = df.select("*")
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true"), rows


def test_duplicate_groups_split_a_hot_digest(skewed):
    books = skewed.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.md5(F.col("id").cast("string"))).alias("digest"),
                                        F.concat(F.lit("a/long/enough/path/"), F.col("id")).alias("path"))
    n, rows = split_joins(duplicate_groups(books))
    assert n > 0 and len(rows) == 20_000 and {r.n for r in rows} == {20_000}


def test_alias_join_splits_a_hot_author(skewed):
    person = "struct<id:string,first_name:string,middle_name:string,last_name:string>"
    name = F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("A"), F.col("id")))
    books = skewed.range(60_000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.array(F.struct(
        name.alias("id"), F.lit("f").alias("first_name"), F.lit(None).cast("string").alias("middle_name"),
        name.alias("last_name"))).cast(f"array<{person}>").alias("authors"))
    aliases = skewed.createDataFrame([("Hot", ("Canon", "c", None, "Canon"))], f"alias_key string, canonical {person}")
    out = resolve_aliases(books, aliases).select("path", F.col("authors")[0]["id"].alias("a"))
    n, rows = split_joins(out)
    assert n > 0 and sum(r.a == "Canon" for r in rows) == 20_000 and len(rows) == 60_000


def test_blacklist_is_joined_before_bytes_are_read(spark, tmp_dir):
    lib = os.path.join(tmp_dir, "lib")
    for k in range(6):
        write(f"{lib}/{k}.fb2", BOOK.format(enc="utf-8", t=f"T{k}", a="A").encode())
    names = scan_library(spark, lib, with_content=False)
    black = spark.createDataFrame([("1.fb2", "x"), ("2.fb2", None)], "basename string, comment string")
    for rows in ("0", "1000"):
        with conf(spark, **{"shelfwright.broadcast.maxRows": rows, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
            kept = exclude_blacklisted(names, black)
            plan = read_files(kept)._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("MapInArrow") + 200:]
            assert "content" not in below.split("MapInArrow")[-1] or "ReadSchema: struct<path" in plan
            assert not any("content" in line for line in plan.splitlines() if "Exchange" in line or "FileScan" in line)
            os.chmod(f"{lib}/1.fb2", 0o644)
            got = {r.basename: r.ok for r in validate(names, black).collect()}
            assert got == {f"{k}.fb2": True for k in (0, 3, 4, 5)}
    read = read_files(names).collect()
    assert all(len(r.content) == r.length and r.error is None for r in read)


def test_commands_end_to_end(spark, tmp_dir):
    archive = os.path.join(tmp_dir, "a.zip")
    write(archive, zip_bytes({"x/good.fb2": BOOK.format(enc="utf-8", t="Eins", a="Anna").encode(), "bad.fb2": b"<FictionBook>",
                              "listed.fb2": b"<broken"}))
    target = os.path.join(tmp_dir, "out")
    failures = extract(spark.createDataFrame([(archive,), (archive + "x",)], "path string"), target)
    assert [r.archive for r in failures.collect()] == [archive + "x"]
    files = extracted(spark, target)
    assert sorted(r.basename for r in files.collect()) == ["bad.fb2", "good.fb2", "listed.fb2"]
    black = os.path.join(tmp_dir, "black.txt")
    write(black, b"# mine\nlisted.fb2|known\n")
    results, totals = validate_library(files, black)
    assert {r.basename: r.ok for r in results.collect()} == {"good.fb2": True, "bad.fb2": False}
    assert totals.first().asDict() == {"total": 3, "blacklisted": 1, "to_process": 2, "failed": 1, "ok": 1}
    assert {r.basename: r.comment for r in read_blacklist(spark, black).collect()} == {"listed.fb2": "known", "bad.fb2": "malformed XML"}
    again, totals = validate_library(files, black)   # nothing is listed twice
    assert again.count() == 1 and read_blacklist(spark, black).count() == 2
    sorted_to = os.path.join(tmp_dir, "sorted")
    moves, rejects, totals = group_library(files, sorted_to, blacklist=read_blacklist(spark, black))
    assert [(r.action, r.destination) for r in moves.collect()] == [("move", f"{sorted_to}/Anna/Eins.fb2")]
    back = spark.read.schema("file_name string, source string, content binary, author_dir string").parquet(sorted_to).collect()
    assert [(r.author_dir, r.file_name) for r in back] == [("Anna", "Eins.fb2")] and bytes(back[0].content).startswith(b"<?xml")
    assert totals.first()["ok"] == 1 and rejects.count() == 0


def test_sorted_book_is_kept(spark, tmp_dir):
    lib = os.path.join(tmp_dir, "lib")
    write(f"{lib}/Anna/Eins.fb2", BOOK.format(enc="utf-8", t="Eins", a="Anna").encode())
    write(f"{lib}/x/zwei.fb2", BOOK.format(enc="utf-8", t="Zwei", a="Anna").encode())
    moves, _ = group(scan_library(spark, lib, with_content=False), lib)
    assert {os.path.basename(r.source): r.action for r in moves.collect()} == {"Eins.fb2": "keep", "zwei.fb2": "move"}


def test_by_author_writes_few_files(spark, tmp_dir, monkeypatch):
    from shelfwright.sources import library as L
    plan = spark.range(400).repartition(8).select(
        F.concat(F.lit("p"), F.col("id")).alias("path"), F.when(F.col("id") < 200, "Busy").otherwise(F.concat(F.lit("A"), F.col("id") % 5)).alias("author_dir"),
        F.concat(F.lit("t"), F.col("id")).alias("unique_name"), F.lit(".fb2").alias("suffix"), F.unhex(F.repeat(F.lit("00"), F.lit(1000))).alias("content"))
    write_by_author(plan, f"{tmp_dir}/one")
    files = [f for d, _, fs in os.walk(f"{tmp_dir}/one") for f in fs if f.endswith(".parquet")]
    assert len(files) == 6
    monkeypatch.setattr(L, "AUTHOR_FILE_BYTES", 50_000)
    write_by_author(plan, f"{tmp_dir}/many")
    busy = [f for f in os.listdir(f"{tmp_dir}/many/author_dir=Busy") if f.endswith(".parquet")]
    assert 2 <= len(busy) <= 4 and spark.read.parquet(f"{tmp_dir}/many").count() == 400


def test_many_authors_share_folders(spark, tmp_dir, monkeypatch):
    from shelfwright.sources import library as L
    monkeypatch.setattr(L, "AUTHOR_FOLDERS", 20)
    monkeypatch.setattr(L, "AUTHOR_BUCKETS", 4)
    plan = spark.range(400).repartition(8).select(
        F.concat(F.lit("p"), F.col("id")).alias("path"), F.when(F.col("id") < 200, "Busy").otherwise(F.concat(F.lit("A/ "), F.col("id"))).alias("author_dir"),
        F.concat(F.lit("t"), F.col("id")).alias("unique_name"), F.lit(".fb2").alias("suffix"), F.encode(F.repeat(F.col("id").cast("string"), F.lit(300)), "UTF-8").alias("content"))
    wanted = sorted((r.author_dir, f"{r.unique_name}.fb2", r.path, bytes(r.content)) for r in plan.collect())
    held = lambda root: sorted((r.author_dir, r.file_name, r.source, bytes(r.content))
                               for r in spark.read.schema(L.BY_AUTHOR_SCHEMA).parquet(root).collect())
    write_by_author(plan, f"{tmp_dir}/one")
    files = [f for d, _, fs in os.walk(f"{tmp_dir}/one") for f in fs if f.endswith(".parquet")]
    assert len(files) == 4 and held(f"{tmp_dir}/one") == wanted
    few = plan.filter("author_dir = 'Busy'")  # goes on as it was begun
    write_by_author(few, f"{tmp_dir}/one", mode="append")
    assert sum(f.startswith("author_bucket=") for f in os.listdir(f"{tmp_dir}/one")) == 4
    assert len(held(f"{tmp_dir}/one")) == 600
    monkeypatch.setattr(L, "AUTHOR_FILE_BYTES", 40_000)  # a prolific author still has several files
    write_by_author(plan, f"{tmp_dir}/many")
    busy = spark.read.schema(L.BY_AUTHOR_SCHEMA).parquet(f"{tmp_dir}/many").filter("author_dir = 'Busy'")
    assert busy.select(F.input_file_name()).distinct().count() >= 2 and held(f"{tmp_dir}/many") == wanted


def test_stream_leaves_nothing_cached(spark, tmp_dir):
    from shelfwright.streaming.library_stream import stream_library
    lib, root = os.path.join(tmp_dir, "lib"), os.path.join(tmp_dir, "cat")
    for k in range(4):
        write(f"{lib}/{k}.fb2", BOOK.format(enc="utf-8", t=f"Title {'abcd'[k]}", a="A").encode())
    spark.catalog.clearCache()
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    aliases = spark.createDataFrame([("A", ("B", None, None, "B"))], "alias_key string, canonical struct<id:string,first_name:string,middle_name:string,last_name:string>")
    black = spark.createDataFrame([("0.fb2", "x")], "basename string, comment string")
    from shelfwright.session import ensure_checkpoint_dir
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    stream_library(spark, lib, root, os.path.join(tmp_dir, "ckpt"), aliases=aliases, blacklist=black, max_files_per_trigger=1)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held
    assert not [x for x in set(os.listdir(shared)) - before if x.startswith("stream-batch")]
    cat = read_catalog(spark, root)
    assert cat.books.count() == 3 and [r.normalized_name for r in cat.persons.collect()] == ["B"]
    small = compact_catalog(spark, root, os.path.join(tmp_dir, "compact"))
    assert small.books.count() == 3 and small.links.count() == 3


def test_catalogue_files_are_sorted_with_bloom_filters(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq
    from shelfwright.operators.catalog import build_catalog
    from shelfwright.plans import fixtures as X
    cat = build_catalog(X.accepted_books(spark, "/root/testdata/sf0.001"))
    write_catalog(cat, f"{tmp_dir}/c", bulk=True)
    spans = []
    for f in glob.glob(f"{tmp_dir}/c/books/*.parquet"):
        keys = pq.read_table(f, columns=["digest"])["digest"].to_pylist()
        assert keys == sorted(keys)
        spans.append((keys[0], keys[-1]))
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_mistyped_table_is_not_empty(spark, tmp_dir):
    write(f"{tmp_dir}/cat/books", b"a file, not a table")
    with pytest.raises(Exception):
        read_catalog(spark, f"{tmp_dir}/cat").books.count()
