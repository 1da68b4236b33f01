import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from shelfwright.sources.archives import explode_archives, open_books
from shelfwright.sources.library import (append_blacklist, read_aliases, read_blacklist, read_catalog,
                                         scan_library, write_by_author, write_catalog)

BOOK = '<?xml version="1.0" encoding="{enc}"?><FictionBook><description><title-info><book-title>{t}</book-title><author><last-name>{a}</last-name></author></title-info></description></FictionBook>'


def zip_bytes(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buf.getvalue()


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_scan_and_open_zipped(spark, tmp_dir):
    lib = os.path.join(tmp_dir, "lib")
    write(f"{lib}/a/one.fb2", BOOK.format(enc="utf-8", t="Один", a="Автор").encode())
    write(f"{lib}/b/two.fb2", BOOK.format(enc="windows-1251", t="Два", a="Автор").encode("cp1251"))
    write(f"{lib}/c/three.fb2.zip", zip_bytes({"x/three.fb2": BOOK.format(enc="koi8-r", t="Три", a="Б").encode("koi8_r")}))
    write(f"{lib}/c/empty.fb2.zip", zip_bytes({"readme.txt": b"x"}))
    write(f"{lib}/c/two.fb2.zip", zip_bytes({"a.fb2": b"<a/>", "b.fb2": b"<b/>"}))
    write(f"{lib}/c/bad.fb2.zip", b"not a zip")
    write(f"{lib}/c/notes.txt", b"ignored")
    write(f"{lib}/c/UPPER.FB2", b"ignored: suffix test is case-sensitive")
    files = scan_library(spark, lib)
    assert sorted(r["basename"] for r in files.collect()) == [
        "bad.fb2.zip", "empty.fb2.zip", "one.fb2", "three.fb2.zip", "two.fb2", "two.fb2.zip"]
    assert scan_library(spark, f"{lib}/a/one.fb2").count() == 1
    opened = {r["basename"]: r for r in open_books(files).collect()}
    assert opened["three.fb2.zip"]["error"] is None
    assert opened["three.fb2.zip"]["content"].startswith(b"<?xml")
    assert opened["empty.fb2.zip"]["error"] == "no .fb2 member in archive"
    assert opened["two.fb2.zip"]["error"] == "more than one .fb2 member in archive"
    assert opened["bad.fb2.zip"]["error"].startswith("cannot unzip")

    from shelfwright.plans.pipeline import index
    cat, rejects = index(files)
    titles = sorted(r["title"] for r in cat.books.collect())
    assert titles == ["Два", "Один", "Три"]
    assert {r["basename"] for r in rejects.collect()} == {"bad.fb2.zip", "empty.fb2.zip", "two.fb2.zip"}
    enc = {r["title"]: r["encoding"] for r in cat.books.collect()}
    assert enc == {"Два": "windows-1251", "Один": "utf-8", "Три": "koi8-r"}


def test_explode_archives(spark, tmp_dir):
    a1 = os.path.join(tmp_dir, "a1.zip")
    a2 = os.path.join(tmp_dir, "a2.zip")
    write(a1, zip_bytes({"d/x.fb2": b"<x1/>", "d/y.fb2": b"<y/>", "d/": b"", "n.txt": b"t"}))
    write(a2, zip_bytes({"e/x.fb2": b"<x2/>", "z.fb2": b"<z/>"}))
    write(os.path.join(tmp_dir, "bad.zip"), b"nope")
    arch = spark.createDataFrame([(a1,), (a2,), (os.path.join(tmp_dir, "bad.zip"),)], "path string")
    got = {(r["basename"], r["error"] is None): r for r in explode_archives(arch).collect()}
    assert got[("x.fb2", True)]["content"] == b"<x1/>"      # first archive wins without overwrite
    assert {k[0] for k in got if k[1]} == {"x.fb2", "y.fb2", "z.fb2"}
    assert any(not ok for _, ok in got)                       # the unreadable archive is reported
    over = {r["basename"]: r["content"] for r in explode_archives(arch, overwrite=True).collect() if r["error"] is None}
    assert over["x.fb2"] == b"<x2/>"
    existing = spark.createDataFrame([("y.fb2",)], "basename string")
    kept = {r["basename"] for r in explode_archives(arch, existing=existing).collect() if r["error"] is None}
    assert kept == {"x.fb2", "z.fb2"}


def damaged(members, name):
    """An archive whose member ``name`` fails its checksum."""
    data = bytearray(zip_bytes(members))
    at = data.index(members[name])
    data[at] ^= 0xFF
    return bytes(data)


def test_damaged_winner_gives_way_to_a_good_copy(spark, tmp_dir):
    first, second = os.path.join(tmp_dir, "1.zip"), os.path.join(tmp_dir, "2.zip")
    write(first, damaged({"x.fb2": b"<bad-x/>", "y.fb2": b"<y/>", "only.fb2": b"<only/>"}, "x.fb2"))
    write(second, zip_bytes({"s/x.fb2": b"<good/>", "y.fb2": b"<y2/>"}))
    third = os.path.join(tmp_dir, "3.zip")
    write(third, damaged({"lone.fb2": b"<lone/>"}, "lone.fb2"))
    arch = spark.createDataFrame([(p,) for p in (first, second, third)], "path string")
    for overwrite, y in ((False, b"<y/>"), (True, b"<y2/>")):
        rows = explode_archives(arch, overwrite=overwrite).collect()
        assert {r.basename: bytes(r.content) for r in rows if r.error is None} == {
            "x.fb2": b"<good/>", "y.fb2": y, "only.fb2": b"<only/>"}
        assert sorted((r.archive, r.basename) for r in rows if r.error) == [(first, "x.fb2"), (third, "lone.fb2")]


def test_listing_and_reading_use_many_tasks_and_bounded_batches(spark, tmp_dir, monkeypatch):
    from shelfwright.sources import archives as A
    paths = spark.range(5000).select(F.format_string("/none/%05d.zip", "id").alias("path"))
    listed = A.list_archive_members(paths, partitions=16)
    assert listed.rdd.getNumPartitions() == 16
    assert listed.filter("error IS NOT NULL").count() == 5000
    import pandas as pd
    a = os.path.join(tmp_dir, "a.zip")
    write(a, zip_bytes({f"{k}.fb2": bytes(1000) for k in range(50)}))
    monkeypatch.setattr(A, "BATCH_BYTES", 5000)
    parts = list(A._read_members([pd.DataFrame({"archive": [a] * 50, "member_path": [f"{k}.fb2" for k in range(50)],
                                                "basename": [f"{k}.fb2" for k in range(50)]})]))
    assert max(map(len, parts)) == 5 and sum(map(len, parts)) == 50
    monkeypatch.setattr(A, "SLICE_BYTES", 10_000)
    pieces = pd.concat(A._list_members([pd.DataFrame({"archive": [a]})]))["slice"]
    assert pieces.nunique() >= 5


def test_store_schemes():
    import pytest
    from shelfwright.sources import archives as A
    with pytest.raises(A.UnsupportedStore):
        A._open("nosuch://bucket/a.zip")
    assert A.SCHEMES["s3a"] == "s3"


def test_blacklist_roundtrip(spark, tmp_dir):
    path = os.path.join(tmp_dir, "black")
    write(os.path.join(path, "part-0.txt"),
          "# own list\nSea Tales.fb2|second printing is better\ncut.fb2|stops early | line 9\n\nnocomment.fb2\n".encode())
    got = {r["basename"]: r["comment"] for r in read_blacklist(spark, path).collect()}
    assert got == {"Sea Tales.fb2": "second printing is better", "cut.fb2": "stops early | line 9", "nocomment.fb2": None}
    assert read_blacklist(spark, os.path.join(tmp_dir, "missing")).count() == 0
    append_blacklist(spark.createDataFrame([("new.fb2", "bad\nxml")], "basename string, comment string"), path)
    got = {r["basename"]: r["comment"] for r in read_blacklist(spark, path).collect()}
    assert got["new.fb2"] == "bad xml" and len(got) == 4


def test_read_aliases(spark, tmp_dir):
    path = os.path.join(tmp_dir, "aliases.json")
    doc = {"Ветров Олег Юрьевич": ["Ветров О. Ю.", "Ветров Олег", 7, None],
           "Лунина Анна": "not a list", "Берегов": ["Берег", "Ветров Олег"]}
    write(path, json.dumps(doc, ensure_ascii=False).encode())
    al = read_aliases(spark, path)
    rows = sorted((r["canonical"], r["alias"]) for r in al.collect())
    assert rows == [("Берегов", "Берег"), ("Берегов", "Ветров Олег"),
                    ("Ветров Олег Юрьевич", "Ветров О. Ю."), ("Ветров Олег Юрьевич", "Ветров Олег")]
    from shelfwright.operators.aliases import alias_table
    t = {r["alias_key"]: r["canonical"]["id"] for r in alias_table(al).collect()}
    assert t["Ветров Олег"] == "Берегов"            # the later entry wins
    assert t["Ветров О Ю"] == "Ветров Олег Юрьевич"
    bad = os.path.join(tmp_dir, "bad.json")
    write(bad, b"[1, 2]")
    import pytest
    with pytest.raises(ValueError):
        read_aliases(spark, bad)


def test_catalog_store_and_by_author(spark, tmp_dir):
    from shelfwright.operators.catalog import build_catalog
    from shelfwright.plans import fixtures as X
    d = "/root/testdata/sf0.001"
    cat = build_catalog(X.accepted_books(spark, d))
    root = os.path.join(tmp_dir, "cat")
    write_catalog(cat, root)
    back = read_catalog(spark, root)
    assert back.books.count() == cat.books.count() and back.links.count() == cat.links.count()
    assert read_catalog(spark, os.path.join(tmp_dir, "none")).books.count() == 0

    from shelfwright.operators.organize import destination, unique_destination
    files = X.render_library(spark, d)
    books = X.accepted_books(spark, d).join(files.select("doc_id", "content"), "doc_id")
    plan = unique_destination(destination(books, "lib"), "lib")
    out = os.path.join(tmp_dir, "by_author")
    write_by_author(plan, out)
    back = spark.read.parquet(out)
    assert back.count() == plan.count()
    assert back.select("author_dir", "file_name").distinct().count() == back.count()


def test_validate_and_group_commands(spark, tmp_dir):
    from shelfwright.plans.pipeline import group, validate
    lib = os.path.join(tmp_dir, "lib")
    write(f"{lib}/a/good.fb2", BOOK.format(enc="utf-8", t="Книга", a="Автор").encode())
    write(f"{lib}/a/copy.fb2", BOOK.format(enc="utf-8", t="Книга", a="Автор").encode())
    write(f"{lib}/b/bad.fb2", b"<FictionBook><description>")
    write(f"{lib}/b/listed.fb2", b"<broken")
    files = scan_library(spark, lib)
    black = spark.createDataFrame([("listed.fb2", "known")], "basename string, comment string")
    res = {r["basename"]: (r["ok"], r["reason"]) for r in validate(files, black).collect()}
    assert res == {"good.fb2": (True, None), "copy.fb2": (True, None), "bad.fb2": (False, "malformed XML")}
    rev = {r["basename"] for r in validate(files, black, reverse=True).collect()}
    assert rev == {"listed.fb2"}
    plan, rejects = group(files, "/sorted", blacklist=black)
    dest = sorted(r["destination"] for r in plan.collect())
    assert dest == ["/sorted/Автор/Книга(1).fb2", "/sorted/Автор/Книга.fb2"]
    assert [r["basename"] for r in rejects.collect()] == ["bad.fb2"]


def test_extract_keeps_what_other_runs_extracted(spark, tmp_dir, monkeypatch):
    from shelfwright.plans.pipeline import extract, extracted
    from shelfwright.sources import extract_target as T
    monkeypatch.setattr(T, "BUCKETS", 3)  # names of several runs share partitions
    one, two, bad = (os.path.join(tmp_dir, n) for n in ("one.zip", "two.zip", "bad.zip"))
    write(one, zip_bytes({"a.fb2": b"<a1/>", "b.fb2": b"<b1/>", "c.fb2": b"<c1/>"}))
    write(two, zip_bytes({"x/b.fb2": b"<b2/>", "d.fb2": b"<d2/>"}))
    members = {"a.fb2": b"<a3 damaged/>", "c.fb2": b"<c3/>"}
    write(bad, damaged(members, "a.fb2"))
    archives = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    run = lambda target, names, **kw: sorted(r.basename or "" for r in extract(archives(*names), f"{tmp_dir}/{target}", **kw).collect())
    held = lambda target: sorted((r.basename, bytes(r.content)) for r in extracted(spark, f"{tmp_dir}/{target}").collect())
    both = [("a.fb2", b"<a1/>"), ("b.fb2", b"<b1/>"), ("c.fb2", b"<c1/>"), ("d.fb2", b"<d2/>")]
    assert held("none") == []
    for k in range(3):  # reruns add nothing
        assert run("t", [one] if k == 0 else [one, two]) == []
        assert held("t") == (both if k else both[:3])
    # overwriting replaces the run's own names only, and never by a member that fails
    over = [("a.fb2", b"<a1/>"), ("b.fb2", b"<b2/>"), ("c.fb2", b"<c1/>"), ("d.fb2", b"<d2/>")]
    for _ in range(2):
        assert run("t", [two], overwrite=True) == [] and held("t") == over
    assert run("t", [bad], overwrite=True) == ["a.fb2"]
    assert held("t") == [("a.fb2", b"<a1/>"), ("b.fb2", b"<b2/>"), ("c.fb2", b"<c3/>"), ("d.fb2", b"<d2/>")]
    # failures are those of the run
    assert run("t", [one, one + "x"]) == [""] and run("t", [one]) == []
    # either order gives the same names; the last overwriting run wins
    for target, order in (("u", [one, two]), ("v", [two, one])):
        for archive in order:
            run(target, [archive], overwrite=True)
    assert held("u") == over and held("v") == both
    listed = spark.createDataFrame([("d.fb2",)], "basename string")
    run("w", [two], existing=listed)
    assert held("w") == [("b.fb2", b"<b2/>")]
