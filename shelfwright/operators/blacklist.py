"""Blacklist joins: exclude (I1), only (I2), new entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._joins import bounded_broadcast


def basename(path) -> F.Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/]*)$", 1)


def _keys(black: DataFrame) -> DataFrame:
    return bounded_broadcast(black.select("basename").distinct())


def exclude_blacklisted(files: DataFrame, black: DataFrame, name: str = "basename") -> DataFrame:
    """Files whose base name is not listed (left anti join)."""
    k = _keys(black).withColumnRenamed("basename", "_bl")
    return files.join(k, files[name] == k["_bl"], "left_anti")


def only_blacklisted(files: DataFrame, black: DataFrame, name: str = "basename") -> DataFrame:
    """Files whose base name is listed (``--reverse``; left semi join)."""
    k = _keys(black).withColumnRenamed("basename", "_bl")
    return files.join(k, files[name] == k["_bl"], "left_semi")


def new_blacklist_entries(results: DataFrame, black: DataFrame, name: str = "basename",
                          ok: str = "ok", reason: str = "reason") -> DataFrame:
    """Failed files not listed yet, one ``(basename, comment)`` per name.

    Passing files are never removed from the list.  A name failing in
    several folders is listed once, with the reason of its smallest path
    when a ``path`` column is present.
    """
    failed = results.filter(~F.col(ok))
    order = F.col("path") if "path" in results.columns else F.col(reason)
    per_name = (failed.groupBy(F.col(name).alias("basename"))
                .agg(F.min_by(F.col(reason), order).alias("comment")))
    k = _keys(black).withColumnRenamed("basename", "_bl")
    return per_name.join(k, per_name["basename"] == k["_bl"], "left_anti")
