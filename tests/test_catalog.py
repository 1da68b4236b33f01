from pyspark.sql import functions as F

from shelfwright.operators import catalog as G
from shelfwright.plans import fixtures as X

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.drop("created_at").collect())


def test_upsert_twice_is_once(spark):
    books = X.accepted_books(spark, D)
    half = books.filter(F.col("doc_id") % 2 == 0)
    cat = G.build_catalog(half)
    once = G.union_catalog(cat, G.upsert(cat, books))
    twice = G.union_catalog(once, G.upsert(once, books))
    full = G.build_catalog(books)
    for a, b, c in zip(once.tables().values(), twice.tables().values(), full.tables().values()):
        assert rows(a) == rows(b)
        assert len(rows(a)) == len(rows(c))
    assert G.check_catalog(once).count() == 0


def test_digest_ignores_path_and_encoding(spark):
    books = X.accepted_books(spark, D)
    moved = books.withColumn("path", F.concat(F.lit("elsewhere/"), "path")).withColumn("encoding", F.lit("koi8-r"))
    a = {r["digest"] for r in G.build_books(books).collect()}
    b = {r["digest"] for r in G.build_books(moved).collect()}
    assert a == b


def test_delete_and_lookup(spark):
    cat = G.build_catalog(X.accepted_books(spark, D))
    some = cat.books.orderBy("digest").limit(3).select("digest")
    wanted = some.unionByName(spark.createDataFrame([("nope",)], "digest string"))
    after, status = G.delete_books(cat, wanted)
    st = {r["digest"]: r["status"] for r in status.collect()}
    assert st["nope"] == "not found" and list(st.values()).count("deleted") == 3
    assert after.books.count() == cat.books.count() - 3
    assert G.check_catalog(after).count() == 0        # links cascaded
    d0 = some.first()["digest"]
    assert G.single_id(G.find_book(cat.books, d0), "book") is not None
    assert G.single_id(G.find_book(after.books, d0), "book") is None
    name = cat.persons.first()["normalized_name"]
    assert G.single_id(G.find_person(cat.persons, name), "person") is not None
    assert G.search_titles(cat.books, "").count() == cat.books.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_push_down_to_the_parquet_scan(spark, tmp_dir):
    from shelfwright.sources.library import read_catalog, write_catalog
    root = tmp_dir + "/cat"
    write_catalog(G.build_catalog(X.accepted_books(spark, D)), root)
    cat = read_catalog(spark, root)
    p = _plan(G.search_titles(cat.books, "Th"))
    assert "StringStartsWith(title,Th)" in p
    assert "ReadSchema: struct<id:bigint,title:string,encoding:string,filename:string>" in p
    p = _plan(G.find_person(cat.persons, "Supplier Ab"))
    assert "EqualTo(normalized_name,Supplier Ab)" in p
    p = _plan(G.find_book(cat.books, "0" * 32).select("id"))
    assert "EqualTo(digest," in p and "ReadSchema: struct<id:bigint,digest:string>" in p


def test_alias_errors_and_failure_list(spark):
    from shelfwright.operators.aliases import alias_errors, alias_table
    from shelfwright.operators.report import failure_list
    raw = spark.createDataFrame([("Иванов Иван", "Ваня", 0), ("a b c d", "x", 1), ("123", "y", 2)],
                                "canonical string, alias string, position int")
    assert sorted(r["canonical"] for r in alias_errors(raw).collect()) == ["123", "a b c d"]
    assert [r["alias_key"] for r in alias_table(raw).collect()] == ["Ваня"]
    rej = spark.createDataFrame([("lib/x/bad.fb2.zip", "cannot unzip: bad")], "path string, reject_reason string")
    assert [tuple(r) for r in failure_list(rej).collect()] == [("bad.fb2.zip", "cannot unzip: bad")]
