"""Session helpers: a sane local session for tests/bench, and the shared
checkpoint folder used to cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that Python gets at once.
ARROW_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows with whole texts or files go to Python in batches bounded by bytes
    too, not by 10,000 rows alone: a worker holds several copies of a batch.
    A bound that the session has already stays."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(ARROW_BATCH_BYTES))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shelfwright") -> SparkSession:
    """Local session for tests and the bench (the cluster brings its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHELFWRIGHT_DRIVER_MEM", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder (HDFS, object store);
    it is read from the session and used as is.  Only a local-mode session
    without the setting (tests, the bench) gets a fresh folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set: point it at a shared folder "
                "so that lineage can be cut reliably on the cluster")
        conf = tempfile.mkdtemp(prefix="shelfwright-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, conf)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_SCOPES = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables;
    inside :func:`scratch_scope` one that goes when the scope ends."""
    import uuid

    open_ = getattr(_SCOPES, "paths", [])
    base = open_[-1] if open_ else ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, name: str = "scope"):
    """Tables this thread writes inside go when the block ends; nothing lazy
    that reads them may outlive it."""
    path = scratch_path(spark, name)
    outer = getattr(_SCOPES, "paths", [])
    _SCOPES.paths = [*outer, path]
    try:
        yield path
    finally:
        _SCOPES.paths = outer
        remove_folder(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: it is computed once,
    survives lost executors, is never cached, and a shuffle join on it gets
    plain exchanges on both sides, which the adaptive skew-join rule can split
    (the exchange below an aggregate it cannot)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
