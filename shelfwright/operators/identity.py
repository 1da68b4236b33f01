"""Book identity: digest (F1), first-seen dedupe (F2), duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import book_digest
from ..session import written


def with_digest(books: DataFrame, authors: str = "authors") -> DataFrame:
    """Add ``digest`` (F1) from ``norm_title, ext_id, version`` and the
    ordered author ids."""
    ids = F.transform(F.col(authors), lambda a: a["id"])
    return books.withColumn("digest", book_digest("norm_title", "ext_id", "version", ids))


def dedupe_books(books: DataFrame, order: str = "path") -> DataFrame:
    """one row per digest, the row with the smallest ``order`` wins.

    ``min_by`` is a plain aggregate, so each task first keeps its own
    winner per digest (partial aggregation) and the shuffle carries at most
    one row per digest and task: a digest shared by a third of all files
    costs no more than any other.
    """
    cols = [c for c in books.columns if c != "digest"]
    row = F.struct(*[F.col(c) for c in cols])
    return (books.groupBy("digest")
            .agg(F.min_by(row, F.col(order)).alias("_r"))
            .select("digest", *[F.col("_r")[c].alias(c) for c in cols]))


def duplicate_groups(books: DataFrame, member: str = "path") -> DataFrame:
    """files whose digest is shared with another file.

    Long format ``(digest, n, member)``: one row per member file, ``n`` the
    group size.  Counting is a partially aggregated ``count``; the member
    list is never collected into one row, so a huge group stays spread
    over tasks (the join back to the counts is split by AQE when skewed).
    """
    counts = written(books.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
                     .filter(F.col("n") > 1), "duplicate-counts")
    return books.select("digest", F.col(member)).join(counts, "digest").select("digest", "n", member)
