"""ZIP handling, the one place Python runs per row: Spark has no ZIP codec.

* :func:`open_books` (A3) -- a ``.fb2.zip`` must hold exactly one ``.fb2``
  member.  Members are inflated piece by piece, all of them for the checksum,
  but kept only as far as they are needed; what a task holds is bounded by
  inflated bytes.  Batches without zipped rows pass through untouched.
* :func:`explode_archives` (A2) -- big archives of many books: the central
  directories are listed first, many archives a task, and the members are
  dealt in slices of an archive's bytes, so one huge archive spreads over
  many tasks and never sits in one binary cell.  Only bytes bounded by
  ``BATCH_BYTES`` are handed over at once.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, scratch_path

BOOK_SUFFIX = ".fb2"

# Ship this module's functions by value with the UDFs, so executors need no
# copy of the package on their Python path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass

#: Inflated at once; the longest member that a row may hold.
PIECE, LARGEST_MEMBER = 256 << 10, 1 << 30
#: Before a marker these may hide it, so all of such a text is kept.
_HIDING = (b"<!--", b"<![CDATA[", b"<!ENTITY")


def _inflated(f, until: bytes | None) -> bytes:
    """A member's bytes, or those up to its first ``until``.  All of it is
    read, for the checksum at its end."""
    kept, done, at = bytearray(), False, 0
    while piece := f.read(PIECE):
        if done:
            continue
        if len(kept) + len(piece) > LARGEST_MEMBER:
            raise ValueError(f"member of more than {LARGEST_MEMBER} bytes")
        kept += piece
        if until and (k := kept.find(until, max(0, at - len(until)))) >= 0:
            if any(0 <= kept.find(h, 0, k) for h in _HIDING):
                until = None
            else:
                del kept[k + len(until):]
                done = True
        at = len(kept)
    return bytes(kept)


def _unzip_one(data: bytes, until: bytes | None = None) -> tuple[bytes | None, str | None]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = [i for i in z.infolist() if not i.is_dir() and i.filename.endswith(BOOK_SUFFIX)]
            if not members:
                return None, "no .fb2 member in archive"
            if len(members) > 1:
                return None, "more than one .fb2 member in archive"
            with z.open(members[0]) as f:
                return _inflated(f, until), None
    except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, EOFError, ValueError,
            NotImplementedError, RuntimeError) as e:  # zlib.error is an Exception too
        return None, f"cannot unzip: {e}"
    except Exception as e:  # noqa: BLE001 - one bad file must never stop the run
        return None, f"cannot unzip: {e}"


@F.pandas_udf(T.BinaryType())
def _zip_udf(name: pd.Series, content: pd.Series) -> pd.Series:
    out = []
    for n, b in zip(name, content):
        if b is None:
            out.append(None)
            continue
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", compression=zipfile.ZIP_DEFLATED) as z:
            info = zipfile.ZipInfo(n, date_time=(2000, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, bytes(b))
        out.append(buf.getvalue())
    return pd.Series(out, dtype=object)


def zip_single(name, content) -> Column:
    """Wrap ``content`` as the single member ``name`` of a ZIP archive."""
    return _zip_udf(name, content)


def open_books(files: DataFrame, path: str = "path", content: str = "content", until: str | None = None) -> DataFrame:
    """A3 applied to a scan: ``.fb2.zip`` rows are replaced by their member,
    plain ``.fb2`` rows pass through; adds ``error`` (NULL when fine; one
    that is there already stays).  With ``until`` members are kept up to that
    marker only, unless something before it may hide it."""
    bound_batches(files.sparkSession)
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    names = files.columns
    at, where, noted = names.index(path), names.index(content), names.index("error")
    marker = until.encode() if until else None

    def run(batches):
        for batch in batches:
            zipped = [k for k, p in enumerate(batch.column(at).to_pylist()) if p is not None and p.endswith(".fb2.zip")]
            if not zipped:
                yield batch
                continue
            chosen = set(zipped)
            yield batch.take(pa.array([k for k in range(len(batch)) if k not in chosen], pa.int64()))
            rows, contents, errors, held = [], [], [], 0

            def flush():
                part = batch.take(pa.array(rows, pa.int64()))
                columns = list(part.columns)
                columns[where] = pa.array(contents, batch.schema.field(where).type)
                columns[noted] = pa.array(errors, batch.schema.field(noted).type)
                return pa.RecordBatch.from_arrays(columns, names=names)

            for k in zipped:
                data, error = batch.column(where)[k].as_py(), batch.column(noted)[k].as_py()
                book, failed = (None, None) if data is None else _unzip_one(data, marker)
                rows.append(k)
                contents.append(book)
                errors.append(error if error is not None else failed)
                held += len(book or b"")
                if held >= BATCH_BYTES:
                    yield flush()
                    rows, contents, errors, held = [], [], [], 0
            if rows:
                yield flush()

    return files.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in files.schema.fields]))


# ------------------------------------------------------------------ A2: extract

#: Bytes of an archive that one task slice covers, and inflated bytes that a
#: task hands over at once.
SLICE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20

MEMBERS = "archive string, member_path string, basename string, size long, slice long, error string"
MEMBER_BYTES = "archive string, member_path string, basename string, content binary, error string"

# The names other readers use for a store, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


class UnsupportedStore(Exception):
    """The archive's store can't be read at random places."""


def _open(path: str):
    """Random-access file for a local path or any URI pyarrow can open."""
    from pyarrow import ArrowInvalid, fs

    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    scheme, rest = path.split("://", 1)
    uri = f"{SCHEMES.get(scheme, scheme)}://{rest}"
    try:
        filesystem, p = fs.FileSystem.from_uri(uri)
    except ArrowInvalid as e:
        raise UnsupportedStore(f"no random access to {scheme}:// archives: {e}") from e
    return filesystem.open_input_file(p)


def _list_members(batches):
    for pdf in batches:
        rows = []
        for a in pdf["archive"]:
            try:
                with _open(a) as f, zipfile.ZipFile(f) as z:
                    for i in z.infolist():
                        if i.is_dir() or not i.filename.endswith(BOOK_SUFFIX):
                            continue
                        rows.append((a, i.filename, i.filename.rsplit("/", 1)[-1], i.file_size,
                                     i.header_offset // SLICE_BYTES, None))
            except UnsupportedStore:
                raise  # every archive of this store would fail: stop at once
            except Exception as e:  # noqa: BLE001 - an unreadable archive is reported
                rows.append((a, None, None, None, None, f"cannot read archive: {e}"))
        yield pd.DataFrame(rows, columns=["archive", "member_path", "basename", "size", "slice", "error"])


def _read_members(batches, keep_content: bool = True):
    columns = ["archive", "member_path", "basename", "content", "error"]
    for pdf in batches:
        rows, held = [], 0
        # members of one archive are adjacent after the sort: open it once
        current, handle, z = None, None, None
        try:
            for a, m, b in zip(pdf["archive"], pdf["member_path"], pdf["basename"]):
                try:
                    if a != current:
                        if handle is not None:
                            handle.close()
                        current, handle = a, _open(a)
                        z = zipfile.ZipFile(handle)
                    data = z.read(m)
                    held += len(data)
                    rows.append((a, m, b, data if keep_content else None, None))
                except Exception as e:  # noqa: BLE001 - a bad member is skipped, the rest go on
                    rows.append((a, m, b, None, f"cannot inflate: {e}"))
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        finally:
            if handle is not None:
                handle.close()
        yield pd.DataFrame(rows, columns=columns)


def _probe_members(batches):
    """Which members inflate; their bytes stay here."""
    return _read_members(batches, keep_content=False)


def read_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``content``, the bytes of each row's file (``error`` where it
    can't be read), in batches bounded by bytes."""
    fields = [f for f in files.schema.fields if f.name not in ("content", "error")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    where = names.index(path)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                data, error = None, None
                try:
                    with _open(row[where]) as f:
                        data = f.read()
                    held += len(data)
                except UnsupportedStore:
                    raise
                except Exception as e:  # noqa: BLE001 - an unreadable file is reported
                    error = f"cannot read: {e}"
                rows.append((*row, data, error))
                if held >= BATCH_BYTES:
                    yield _batch(rows, batch.schema)
                    rows, held = [], 0
            yield _batch(rows, batch.schema)

    return files.select(*names).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    types = [*(f.type for f in schema), pa.binary(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      names=[*schema.names, "content", "error"])


def _partitions(df: DataFrame, partitions: int | None) -> int:
    spark = df.sparkSession
    return partitions or max(spark.sparkContext.defaultParallelism,
                             int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def list_archive_members(archives: DataFrame, archive: str = "path", partitions: int | None = None) -> DataFrame:
    """Central directories of the archives: one row per ``.fb2`` member
    (directories skipped).  An unreadable archive yields one row with
    ``error`` set.

    The number of partitions is explicit: paths are so short that adaptive
    coalescing would put thousands of archives into one task."""
    paths = archives.select(F.col(archive).alias("archive")).distinct()
    return paths.repartition(_partitions(archives, partitions), "archive").mapInPandas(_list_members, MEMBERS)


def _dealt(members: DataFrame, partitions: int) -> DataFrame:
    """Members by slices of their archive's bytes, in archive order."""
    return (members.repartition(partitions, "archive", "slice").sortWithinPartitions("archive", "slice", "member_path")
            .select("archive", "member_path", "basename"))


def explode_archives(archives: DataFrame, existing: DataFrame | None = None, overwrite: bool = False,
                     archive: str = "path", partitions: int | None = None) -> DataFrame:
    """A2: every ``.fb2`` member of every archive, flattened to its base name.

    ``(archive, member_path, basename, content, error)``.  With
    ``overwrite=False`` base names present in ``existing`` (a DataFrame with
    ``basename``) are skipped and, among equal names, the first readable
    ``(archive, member_path)`` is kept; with ``overwrite=True`` the last
    readable one wins.  Members that fail to inflate keep a row with
    ``error`` set and never displace a good copy: names that occur more than
    once are inflated before their winner is chosen, the others once.
    """
    spark, n = archives.sparkSession, _partitions(archives, partitions)
    listing = scratch_path(spark, "members")
    list_archive_members(archives, archive, partitions).write.parquet(listing)
    members = spark.read.schema(MEMBERS).parquet(listing)
    bad_archives = members.filter(F.col("error").isNotNull())
    members = members.filter(F.col("error").isNull())
    if existing is not None and not overwrite:
        members = members.join(existing.select("basename").distinct(), "basename", "left_anti")
    names = scratch_path(spark, "clashing-names")
    members.groupBy("basename").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("basename").write.parquet(names)
    clashing = spark.read.schema("basename string").parquet(names)
    alone = members.join(clashing, "basename", "left_anti")
    probes = scratch_path(spark, "probes")
    twice = members.join(clashing, "basename", "left_semi")
    _dealt(twice, n).mapInPandas(_probe_members, MEMBER_BYTES).drop("content").join(
        twice.select("archive", "member_path", "slice"), ["archive", "member_path"]).write.parquet(probes)
    probed = spark.read.schema("archive string, member_path string, basename string, error string, slice long").parquet(probes)
    key = F.struct("archive", "member_path", "slice")
    pick = F.max_by(key, key) if overwrite else F.min_by(key, key)
    winners = (probed.filter(F.col("error").isNull()).groupBy("basename").agg(pick.alias("k")).select("basename", "k.*"))
    chosen = alone.select("basename", "archive", "member_path", "slice").unionByName(winners)
    data = _dealt(chosen, n).mapInPandas(_read_members, MEMBER_BYTES)
    failed = (bad_archives.select("archive", "member_path", "basename", "error")
              .unionByName(probed.filter(F.col("error").isNotNull()).select("archive", "member_path", "basename", "error")))
    return data.unionByName(failed.select("archive", "member_path", "basename", F.lit(None).cast("binary").alias("content"), "error"))
