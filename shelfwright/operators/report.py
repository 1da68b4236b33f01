"""Run summary (K1) and the failure list (K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(files: DataFrame, blacklisted: str = "blacklisted", ok: str = "ok") -> DataFrame:
    """K1: one row ``total, blacklisted, to_process, failed, ok``.

    ``files`` has one row per scanned file with a boolean ``blacklisted``
    and a boolean ``ok`` (NULL for files that were not processed).  One
    global aggregate, combined per task before the final merge.
    """
    b = F.col(blacklisted)
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(b).alias("blacklisted"),
        F.count_if(~b).alias("to_process"),
        F.count_if(~b & ~F.col(ok)).alias("failed"),
        F.count_if(~b & F.col(ok)).alias("ok"),
    )


def summary_of_counts(files: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """K1 from the stages of a run: the scanned files, those selected and
    those that failed, a row each.  Rows are counted where they are; no path
    is shuffled."""
    part = lambda df, name: df.select(*(F.lit(int(n == name)).alias(n) for n in ("total", "to_process", "failed")))
    rows = part(files, "total").unionByName(part(selected, "to_process")).unionByName(part(failed, "failed"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(n("total").alias("total"), n("to_process").alias("to_process"), n("failed").alias("failed")).select(
        "total", (F.col("total") - F.col("to_process")).alias("blacklisted"), "to_process", "failed",
        (F.col("to_process") - F.col("failed")).alias("ok"))


def failure_list(rejects: DataFrame, path: str = "path", reason: str = "reject_reason") -> DataFrame:
    """K2: ``(basename, reason)`` of every file that failed a stage."""
    return rejects.select(F.regexp_extract(F.col(path), r"([^/]*)$", 1).alias("basename"),
                          F.col(reason).alias("reason"))
