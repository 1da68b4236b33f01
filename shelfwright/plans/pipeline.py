"""The four commands as DataFrame chains: index, validate, group, extract.

``scan -> exclude blacklisted -> open zipped -> declared encoding / recode
-> metadata -> aliases -> digest -> catalogue``: one narrow stage up to the
digest, then one shuffle on ``digest`` and one on ``normalized_name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import decode_books
from ..operators.aliases import resolve_aliases
from ..operators.blacklist import basename, exclude_blacklisted, new_blacklist_entries, only_blacklisted
from ..operators.catalog import Catalog, build_catalog, upsert
from ..operators.metadata import book_metadata, check_wellformed, split_accepted
from ..operators.organize import destination, move_plan, unique_destination
from ..operators.report import summary_of_counts
from ..sources.archives import open_books
from ..sources.extract_target import extract_into, extracted_books
from ..session import written
from ..sources.library import append_blacklist, read_blacklist, read_files, write_by_author


def decoded(files: DataFrame, path: str = "path", content: str = "content",
            until: str | None = None) -> DataFrame:
    """Bytes -> ``(path, basename, encoding, text, error)``; the binary
    column is dropped here, before anything shuffles.  ``until`` limits the
    decoding to the bytes up to a marker (see ``decode_books``)."""
    if content not in files.columns:
        files = read_files(files)
    opened = open_books(files, path, content, until)
    keep = [c for c in files.columns if c not in (path, content, "basename", "length",
                                                  "modificationTime", "encoding", "text", "error")]
    dec = decode_books(opened, content, until=until)
    return dec.select(F.col(path).alias("path"), basename(F.col(path)).alias("basename"), *keep,
                      "encoding", "text", "error")


def parse_library(files: DataFrame, author_scope: str = "all") -> DataFrame:
    """Metadata of every file with ``reject_reason`` (K2 threads through).

    Only the bytes up to ``</description>`` are decoded and parsed, as the
    metadata reader of the command-line tool stops there too."""
    return book_metadata(decoded(files, until="</description>"), author_scope=author_scope)


def _selected(files: DataFrame, blacklist: DataFrame | None, reverse: bool = False) -> DataFrame:
    """The files to process.  On a scan without content the blacklist join
    sees names only, and no byte of an excluded file is read."""
    if blacklist is None:
        return files
    if "basename" not in files.columns:
        files = files.withColumn("basename", basename(F.col("path")))
    return (only_blacklisted if reverse else exclude_blacklisted)(files, blacklist)


def summary(files: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """K1 of a command: counts of the scanned files, of those selected and of
    those that failed (each with a row per file)."""
    return summary_of_counts(files, selected, failed)


def extract(archives: DataFrame, target: str, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """``extract``: the books of all archives as a table under ``target`` with
    the columns of a scan (``path, basename, length, content``), which the
    other commands take as their files.  Names that the target has are skipped
    or, with ``overwrite``, replaced; all others stay.  Returns the failures
    ``(archive, member_path, basename, error)`` of this run."""
    return extract_into(archives, target, existing, overwrite)


def extracted(spark: SparkSession, target: str) -> DataFrame:
    """The files that :func:`extract` has written."""
    return extracted_books(spark, target)


def index(files: DataFrame, aliases: DataFrame | None = None, blacklist: DataFrame | None = None,
          catalog: Catalog | None = None, author_scope: str = "all",
          persist: bool = True) -> tuple[Catalog, DataFrame]:
    """``index``: rows to write to the catalogue and the rejected files.

    Without ``catalog`` the result is a complete catalogue; with one it is
    the rows to append (G4-G6).
    """
    # the parse feeds books, persons, links and the rejects: persist it so it
    # runs once (release with unpersist/clearCache after writing); a caller
    # that consumes a single output passes persist=False
    meta = parse_library(_selected(files, blacklist), author_scope)
    if persist:
        meta = meta.persist()
    ok, rejects = split_accepted(meta)
    books = resolve_aliases(ok, aliases)
    out = build_catalog(books, once=persist) if catalog is None else upsert(catalog, books)
    return out, rejects.select("path", "basename", "reject_reason")


def validate(files: DataFrame, blacklist: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """``validate``: ``(path, basename, ok, reason)`` per selected file."""
    d = decoded(_selected(files, blacklist, reverse))
    wf = check_wellformed(F.col("text"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(~wf, F.lit("malformed XML"))
    return d.select("path", "basename", reason.isNull().alias("ok"), reason.alias("reason"))


def validate_library(files: DataFrame, blacklist_path: str, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """``validate`` with its list: the results, whose failures are appended
    to the list at ``blacklist_path`` (a folder, or one plain file), and the
    run's summary."""
    spark = files.sparkSession
    black = read_blacklist(spark, blacklist_path)
    results = written(validate(files, black, reverse), "validated")
    totals = summary(files, results, results.filter(~F.col("ok")))
    totals = written(totals, "summary")
    append_blacklist(new_blacklist_entries(results, black), blacklist_path)
    return results, totals


def group(files: DataFrame, target: str, aliases: DataFrame | None = None,
          blacklist: DataFrame | None = None, max_len: int = 0) -> tuple[DataFrame, DataFrame]:
    """``group``: the move plan and the rejected files.  The plan's
    ``(source, destination, action)`` come with what ``write_by_author``
    needs; join the sizes or bytes of the files to it last."""
    meta = written(parse_library(_selected(files, blacklist)), "group-meta")   # plan + rejects
    ok, rejects = split_accepted(meta)
    books = resolve_aliases(ok, aliases)
    # names only from here on; the plan is read twice to rank the names
    named = written(destination(books, target, max_len).select(
        "path", "author_dir", "dest_name", "suffix", "dest"), "destinations")
    plan = unique_destination(named, target)
    moves = move_plan(plan, keep=("path", "author_dir", "unique_name", "suffix"))
    return moves, rejects.select("path", "basename", "reject_reason")


def group_library(files: DataFrame, target: str, aliases: DataFrame | None = None,
                  blacklist: DataFrame | None = None, max_len: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``group`` carried out: the plan, written by author under ``target``,
    the rejected files and the run's summary."""
    moves, rejects = group(files, target, aliases, blacklist, max_len)
    moves = written(moves, "moves")
    carry = [c for c in ("content", "length") if c in files.columns][:1]
    write_by_author(moves.join(files.select("path", *carry), "path"), target)
    return moves, rejects, summary(files, _selected(files, blacklist), rejects)
