"""The target of ``extract``: a table of books keyed by base name (A2).

A target folder of files can hold a name once; so can this table.  Its rows
lie in partitions by a hash of the name.  Names that are new are appended.
Names that are replaced have only the partitions rewritten that hold them, by
dynamic partition overwrite, so the books of other runs stay.  Files that
could not be extracted are rows of partition ``FAILED``, each with its run.

One run at a time may write to a target.  A run that stopped between its two
writes is mended by running it again: what was appended is replaced by itself.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._joins import bounded_broadcast
from ..session import scratch_scope, written
from .archives import explode_archives

#: Partitions of a new target, the partition of failures, bytes a file is meant to have.
BUCKETS, FAILED, FILE_BYTES = 256, -1, 128 << 20

SCHEMA = ("path string, basename string, length long, content binary, archive string, member_path string, "
          "error string, run string, bucket int")


def target_rows(spark: SparkSession, target: str) -> DataFrame:
    """All rows of the table, empty where there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{target.rstrip('/')}/books")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def extracted_books(spark: SparkSession, target: str) -> DataFrame:
    """The books of a target with the columns of a scan."""
    return target_rows(spark, target).filter(F.col("bucket") != FAILED).select("path", "basename", "length", "content")


def _write(rows: DataFrame, target: str, mode: str) -> None:
    """Rows dealt by partition, and a large partition's to as many tasks as
    its bytes fill files."""
    spark = rows.sparkSession
    size = rows.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-size // (BUCKETS * FILE_BYTES)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("basename", F.lit("file")), F.lit(files))
    (rows.repartition(n, F.col("bucket"), salt).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(f"{target.rstrip('/')}/books"))


def extract_into(archives: DataFrame, target: str, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Extracts the books of all archives into the target and returns the
    failures of this run ``(archive, member_path, basename, error)``.

    Without ``overwrite`` names that the target (or ``existing``) has are
    skipped before anything is inflated; with it they are replaced, but never
    by a member that fails."""
    spark, run = archives.sparkSession, uuid.uuid4().hex
    present = target_rows(spark, target).filter(F.col("bucket") != FAILED)
    names = present.select("basename")
    if existing is not None:
        names = names.unionByName(existing.select("basename"))
    with scratch_scope(spark, "extract"):
        good = F.col("error").isNull()
        out = written(explode_archives(archives, None if overwrite else names, overwrite).select(
            F.when(good, F.concat_ws("/", F.lit(target.rstrip("/")), "basename")).alias("path"), "basename",
            F.octet_length("content").cast("long").alias("length"), "content", "archive", "member_path", "error",
            F.lit(run).alias("run"),
            F.when(good, F.pmod(F.xxhash64("basename"), F.lit(BUCKETS)).cast("int")).otherwise(F.lit(FAILED)).alias("bucket")),
            "extracted")
        if not overwrite:
            _write(out, target, "append")
        else:
            fresh = bounded_broadcast(out.filter(good).select(F.col("basename").alias("_name")))
            clash = written(present.select("basename", "bucket").join(fresh, F.col("basename") == F.col("_name"), "left_semi"), "replaced")
            # at most as many as the table has partitions
            touched = [r["bucket"] for r in clash.select("bucket").distinct().collect()]
            _write(out.filter(~F.col("bucket").isin(touched)), target, "append")
            if touched:
                replaced = bounded_broadcast(clash.select(F.col("basename").alias("_name")).distinct())
                kept = present.filter(F.col("bucket").isin(touched)).join(replaced, F.col("basename") == F.col("_name"), "left_anti")
                anew = written(kept.unionByName(out.filter(F.col("bucket").isin(touched))), "rewritten")
                _write(anew, target, "overwrite")
    return target_rows(spark, target).filter((F.col("bucket") == FAILED) & (F.col("run") == run)).select(
        "archive", "member_path", "basename", "error")
