import os

from shelfwright.operators.catalog import build_catalog
from shelfwright.plans.pipeline import index
from shelfwright.sources.library import read_catalog, scan_library
from shelfwright.streaming.library_stream import stream_library

BOOK = '<FictionBook><description><title-info><book-title>{t}</book-title><author><last-name>{a}</last-name></author></title-info><document-info><id>{i}</id></document-info></description></FictionBook>'


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def snapshot(cat):
    return {n: sorted(tuple(r) for r in df.drop("created_at").collect()) if "created_at" in df.columns
            else sorted(tuple(r) for r in df.collect()) for n, df in cat.tables().items()}


def test_stream_equals_batch_and_is_incremental(spark, tmp_dir):
    lib, root, ckpt = (os.path.join(tmp_dir, x) for x in ("lib", "cat", "ckpt"))
    for i in range(6):
        write(f"{lib}/a/{i}.fb2", BOOK.format(t=f"Title {i % 4}", a=f"Author{i % 3}", i=i % 4))
    stream_library(spark, lib, root, ckpt)
    first = snapshot(read_catalog(spark, root))
    # new files arrive, one of them a copy of a known book, one broken
    write(f"{lib}/b/6.fb2", BOOK.format(t="Title 0", a="Author0", i=0))
    write(f"{lib}/b/7.fb2", BOOK.format(t="Fresh", a="Author9", i=7))
    write(f"{lib}/b/8.fb2", "<FictionBook><description>")
    stream_library(spark, lib, root, ckpt)
    after = snapshot(read_catalog(spark, root))
    batch, _ = index(scan_library(spark, lib))
    assert after == snapshot(batch)
    assert len(after["books"]) == len(first["books"]) + 1
    # a replay of the same files changes nothing
    stream_library(spark, lib, root, ckpt)
    assert snapshot(read_catalog(spark, root)) == after
