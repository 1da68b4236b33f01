"""Incremental library feed.

New files are picked up by a file stream (``binaryFile`` for a folder of
books, or any stream of ``(path, content)`` rows), each micro-batch goes
through the index chain and is appended to the catalogue with the G4-G6
anti-joins.  The state lives in the catalogue tables, not in the state
store: an unbounded ``dropDuplicates("digest")`` would grow for ever, the
anti-join does not, and a replayed batch heals instead of duplicating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aliases import resolve_aliases
from ..operators.catalog import (Catalog, books_rows, first_seen_books, links_rows, persons_rows, upsert_books,
                                 upsert_links, upsert_persons)
from ..operators.metadata import split_accepted
from ..plans.pipeline import _selected, parse_library
from ..session import ensure_checkpoint_dir, scratch_path, scratch_scope, written
from ..sources.library import BOOK_GLOB, read_catalog, write_catalog
from ..sources.listing import tasks_can_open
from ..sources.snapshots import table_files


def _index_batch(catalog_root: str, aliases: DataFrame | None, blacklist: DataFrame | None,
                 rejects_root: str | None, names_first: bool = False):
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        # the bytes of a folder's files are read after the blacklist join, by the tasks that parse them
        files = batch.select("path", "length") if names_first else batch.select("path", "content")
        # what a batch writes on the way goes with the batch, and nothing is
        # cached: an endless stream fills neither executors nor the disk
        with scratch_scope(spark, f"stream-batch-{epoch_id}"):
            meta = written(parse_library(_selected(files, blacklist)), "parsed")
            ok, rejects = split_accepted(meta)
            # one alias join and one dedupe per batch feed all three tables
            books = written(first_seen_books(resolve_aliases(ok, aliases)), "first-seen")
            rows = Catalog(books_rows(books), persons_rows(books), links_rows(books))
            known = read_catalog(spark, catalog_root)
            new = Catalog(upsert_books(known.books, rows), upsert_persons(known.persons, rows),
                          upsert_links(known.links, rows))
            # Rejects of a query and epoch have a folder of their own, so a
            # replay replaces them.  The tables are committed together, and
            # each is guarded by its own anti-join, so a replay adds nothing.
            if rejects_root:
                query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
                (rejects.select("path", "basename", "reject_reason")
                 .write.mode("overwrite").parquet(f"{rejects_root.rstrip('/')}/query={query}/epoch={epoch_id}"))
            write_catalog(new, catalog_root, mode="append")
    return run


def stream_library(spark: SparkSession, source: str | DataFrame, catalog_root: str,
                   checkpoint: str, aliases: DataFrame | None = None,
                   blacklist: DataFrame | None = None, rejects_root: str | None = None,
                   available_now: bool = True, max_files_per_trigger: int | None = None):
    """Run the index over a growing library.

    ``source`` is a folder (read as a ``binaryFile`` stream of ``.fb2`` /
    ``.fb2.zip`` files) or a streaming DataFrame with ``path`` and
    ``content``.  With ``available_now`` the query processes what is there
    and stops (a re-run picks up only new files); otherwise it keeps
    running and the caller owns the returned query.
    """
    if isinstance(source, str):
        reader = (spark.readStream.format("binaryFile")
                  .schema("path string, modificationTime timestamp, length bigint, content binary")
                  .option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", BOOK_GLOB))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        stream = reader.load(source)
        # a store that tasks can't open is read by the stream itself
        names_first = tasks_can_open(spark, source)
        if names_first:
            stream = stream.drop("content")
    else:
        stream, names_first = source, False
    w = (stream.writeStream
         .foreachBatch(_index_batch(catalog_root, aliases, blacklist, rejects_root, names_first))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _most_files(spark: SparkSession, drops: str, batches: int) -> int:
    """Files of the drop that has most."""
    return max(len(table_files(spark, drops, f"drop={k:05d}")) for k in range(batches))


def stream_index_documents(spark: SparkSession, d: str, batches: int = 4) -> Catalog:
    """Driver check: the rendered documents arrive in ``batches`` drops of
    parquet files, are indexed by the stream, and the final catalogue is
    returned (it must equal the batch build on every digest-determined
    column)."""
    from ..plans.fixtures import render_library

    ensure_checkpoint_dir(spark)
    root = scratch_path(spark, "stream-index")
    drops, catalog_root, ckpt = f"{root}/drops", f"{root}/catalog", f"{root}/_checkpoint"
    files = render_library(spark, d)
    for k in range(batches):
        (files.filter(F.col("doc_id") % batches == k).select("path", "content")
         .write.parquet(f"{drops}/drop={k:05d}"))
    schema = "path string, content binary"
    # a drop has as many files as its documents had splits: one drop a trigger, however large
    # it is, as each batch joins the catalogue so far
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", str(max(16, _most_files(spark, drops, batches)))).parquet(drops))
    stream_library(spark, stream, catalog_root, ckpt)
    return read_catalog(spark, catalog_root)
