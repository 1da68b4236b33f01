from shelfwright.operators._joins import bounded_broadcast
from shelfwright.operators.blacklist import exclude_blacklisted, only_blacklisted


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast_both_paths(spark):
    small = spark.createDataFrame([(i,) for i in range(10)], "k int")
    big = spark.range(100).withColumnRenamed("id", "k")
    assert "ResolvedHint" in small.hint("broadcast")._jdf.queryExecution().analyzed().toString()
    b = bounded_broadcast(small, max_rows=20)
    assert "broadcast" in b._jdf.queryExecution().analyzed().toString().lower()
    nb = bounded_broadcast(small, max_rows=2)          # too big: no hint, shuffle join
    assert "broadcast" not in nb._jdf.queryExecution().analyzed().toString().lower()
    assert big.join(b, "k").count() == big.join(nb, "k").count() == 10


def test_blacklist_joins_same_result_either_way(spark):
    files = spark.createDataFrame([(f"d/{i}.fb2", f"{i}.fb2") for i in range(50)], "path string, basename string")
    black = spark.createDataFrame([(f"{i}.fb2", "x") for i in range(0, 50, 3)], "basename string, comment string")
    spark.conf.set("shelfwright.broadcast.maxRows", "5")
    try:
        a = sorted(r["path"] for r in exclude_blacklisted(files, black).collect())
        b = sorted(r["path"] for r in only_blacklisted(files, black).collect())
    finally:
        spark.conf.unset("shelfwright.broadcast.maxRows")
    c = sorted(r["path"] for r in exclude_blacklisted(files, black).collect())
    assert a == c and len(a) == 33 and len(b) == 17


def test_alias_hits_of_repeated_paths_and_missing_authors(spark):
    from shelfwright.operators.aliases import resolve_aliases

    person = "struct<id:string,first_name:string,middle_name:string,last_name:string>"
    p = lambda i: (i, "f", None, i)
    books = spark.createDataFrame([
        ("a", 1, [p("x"), p("y"), p("z")]), ("a", 2, [p("y"), p("x")]), ("b", 3, []), ("c", 4, None), ("d", 5, [p("n"), p("n")])],
        f"path string, canonical int, authors array<{person}>")
    aliases = spark.createDataFrame([("x", p("C")), ("z", p("C")), ("C", p("D"))], f"alias_key string, canonical {person}")
    got = {r.canonical: r.authors and [a.id for a in r.authors] for r in resolve_aliases(books, aliases).collect()}
    assert got == {1: ["C", "y"], 2: ["y", "C"], 3: [], 4: None, 5: ["n"]}


def test_catalogue_tables_are_alike_written_once_or_lazily(spark):
    from shelfwright.operators.catalog import build_catalog
    from shelfwright.plans import fixtures as X

    books = X.accepted_books(spark, "/root/testdata/sf0.001")
    one, lazy = build_catalog(books), build_catalog(books, once=False)
    for name, table in one.tables().items():
        rows = [sorted(map(str, t.drop("created_at").collect())) for t in (table, lazy.tables()[name])]
        assert rows[0] == rows[1] and rows[0]
