"""Listing of a folder tree in tasks (A1).

Each round lists the folders of one level, many a task, and writes what it
finds; its folders are the next round's.  The driver learns whether there are
any, never which.  One folder is listed by one task.  Times are whole milliseconds, as
Spark's own listing has them.
"""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .archives import SCHEMES, UnsupportedStore, _partitions

# Shipped by value, like the archive readers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Deepest tree; beyond it links that lead back are likely.
MAX_DEPTH = 128
FOUND = "path string, folder boolean, length long, modificationTime timestamp"
_BATCH = 1 << 14


def _store(path: str):
    """(file system, path in it, what precedes such paths in a full name)."""
    from pyarrow import ArrowInvalid, fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:") or "/", "file:"
    scheme, rest = path.split("://", 1)
    uri = f"{SCHEMES.get(scheme, scheme)}://{rest}"
    try:
        store, at = fs.FileSystem.from_uri(uri)
    except ArrowInvalid as e:
        raise UnsupportedStore(f"{scheme}:// can't be listed in tasks: {e}") from e
    if scheme == "file":
        return store, at, "file:"
    return store, at, path[:len(path.rstrip("/")) - len(at.rstrip("/"))]


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _list(batches):
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, at, prefix = _store(folder)
            found = store.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True))
            found = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory) and not _hidden(f.base_name)]
            for k in range(0, len(found), _BATCH):
                part = found[k:k + _BATCH]
                yield pa.RecordBatch.from_arrays([
                    pa.array([prefix + f.path for f in part], pa.string()),
                    pa.array([f.type == fs.FileType.Directory for f in part], pa.bool_()),
                    pa.array([f.size for f in part], pa.int64()),
                    pa.array([None if f.mtime_ns is None else f.mtime_ns // 10 ** 6 * 1000 for f in part], pa.timestamp("us", tz="UTC"))],
                    names=["path", "folder", "length", "modificationTime"])


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def tasks_can_open(spark: SparkSession, path: str) -> bool:
    """Whether files under ``path`` can be opened without Spark's readers."""
    try:
        _store(_qualified(spark, path))
    except UnsupportedStore:
        return False
    return True


def list_tree(spark: SparkSession, path: str) -> DataFrame | None:
    """``(path, length, modificationTime)`` of every file under ``path`` (or
    of the file that it is); None where tasks can't list it."""
    from pyarrow import fs

    if any(c in path for c in "*?[{"):
        return None
    root = _qualified(spark, path)
    try:
        store, at, prefix = _store(root)
    except UnsupportedStore:
        return None
    top = store.get_file_info(at)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.type == fs.FileType.File:
        when = top.mtime.replace(microsecond=top.mtime.microsecond // 1000 * 1000) if top.mtime else None
        return spark.createDataFrame([(prefix + top.path, top.size, when)], "path string, length long, modificationTime timestamp")
    n = _partitions(spark.range(0), None)
    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    for _ in range(MAX_DEPTH):
        level = written(folders.repartition(n).mapInArrow(_list, FOUND), "listing")
        levels.append(level.filter("NOT folder").select("path", "length", "modificationTime"))
        folders = level.filter("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
    raise RecursionError(f"folders lie more than {MAX_DEPTH} deep under {path}")
