"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions with their code, so executors need no copy
    of the package on their Python path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it
    back.  A lost executor costs a reread, not a recomputation.  Both sides of
    a later join on a staged table get plain exchanges, so the adaptive
    skew-join rule may split a hot key."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_row(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` in one struct ``row`` beside ``more``, so that
    no column of the input can clash with ours; ``select("row.*")`` unpacks."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
                     *(c.alias(name) for name, c in more.items()))


def worker_store() -> dict:
    """A dict that lives as long as the Python worker: tasks that reuse the
    worker find what earlier ones loaded."""
    return sys.__dict__.setdefault("_llm_store", {})


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps now; it acts
    when the driver collects its garbage, which may be long after."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
