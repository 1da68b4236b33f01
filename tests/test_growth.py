"""What must not grow with the input: batches handed to Python, micro-batches
of the stream, shuffles of the links."""

import pyarrow as pa
from pyspark.sql import functions as F

from shelfwright import session
from shelfwright.operators import catalog as G
from shelfwright.plans import queries as Q
from test_scale import conf

PERSON = "struct<id:string,first_name:string,middle_name:string,last_name:string>"


def test_python_gets_batches_bounded_by_bytes(spark):
    from shelfwright.sources.archives import open_books

    files = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("a"), F.col("id"), F.lit(".fb2")).alias("path"),
                                              F.encode(F.repeat(F.lit("x"), F.lit(10_000)), "UTF-8").alias("content"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    opened = open_books(files)   # 30 MB in one partition
    got = [r.n for r in opened.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 30_000_000 and max(got) < 2 * session.ARROW_BATCH_BYTES
    with conf(spark, **{session.BATCH_CONF: "1000000"}):   # a bound of the session's own stays
        open_books(files)
        assert spark.conf.get(session.BATCH_CONF) == "1000000"


def test_links_are_distinct_without_a_shuffle(spark):
    books = spark.createDataFrame([("d1", "p", [("A", None, None, "A"), ("B", None, None, "B"), ("A", "x", None, "A")]),
                                   ("d2", "q", [("A", None, None, "A")]), ("d3", "r", []), ("d4", "s", None)],
                                  f"digest string, path string, authors array<{PERSON}>")
    links = G.links_rows(books.withColumn("digest", F.md5("digest")))
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
    assert len(links.collect()) == 3 and links.distinct().count() == 3


def test_a_drop_of_many_files_is_one_batch(spark, monkeypatch):
    from shelfwright.plans import fixtures as X
    from shelfwright.streaming import library_stream as L

    render, seen = X.render_library, []
    monkeypatch.setattr(X, "render_library", lambda s, d: render(s, d).repartition(20))
    index = L._index_batch

    def counted(*a, **k):
        run = index(*a, **k)
        return lambda batch, epoch: (seen.append(epoch), run(batch, epoch))[1]

    monkeypatch.setattr(L, "_index_batch", counted)
    with conf(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        cat = L.stream_index_documents(spark, "/root/testdata/sf0.001", batches=2)
    assert len(seen) == 2 and cat.books.count() == Q.build_books(spark, "/root/testdata/sf0.001").count()
