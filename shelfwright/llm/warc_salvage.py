"""WARC archives with a salvage reader (13).

The writer puts one record per row into archives in a shared folder, gzipped
member by member or plain, cut at ``ARCHIVE_BYTES``.  Of rows with equal
payloads (by SHA-256 and length, if long enough) the one with the smallest id
is a ``response``, the others are ``revisit`` records that refer to it.  Each
attempt of a task writes files of its own; a written manifest names those of
the attempts that counted.

The reader streams each archive in a task.  Every record is checked: checksum
and length of its member, version line, header, length of its block, the end
of the record, and its digests.  Where a check fails the bytes from there are
quarantined and the reader searches for the next place where a whole valid
member (gzip) or record (plain: a version line) begins; later records are read
as usual, and the gap is a row of its own with place, length and reason.

Null payloads are empty; a null id is the largest; rows that share the
smallest id of equal payloads are all ``response``.  A null url has no target,
control characters in one are percent-encoded.  An empty table gives no
archive.  Extra columns are ignored.  An archive that can't be opened is a gap
without a length.  An archive is read by one task, within bounded memory
(payloads, when asked for, are as large as they are); the writer's are cut, so
there are many.  A record nested in the payload of a plain record is found only
if the outer one is broken and the nested one passes its checks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.archives import SCHEMES, UnsupportedStore, _open as open_archive
from ._common import ship_by_value, stage

ship_by_value(__name__)

#: An archive ends after this many bytes; what a task hands over or reads at once.
ARCHIVE_BYTES, BATCH_BYTES, WINDOW = 128 << 20, 8 << 20, 1 << 20
#: Bytes fed to or taken from the decompressor at once; longest header.
CHUNK, HEADER_BYTES = 16 << 10, 1 << 20
LEVEL = 6

# Fixed values of the format.
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, LINE = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r\n")

MANIFEST = "archive string, records long, bytes long"
READ = ("archive string, kind string, at long, length long, reason string, after_gap long, type string, record_id string, "
        "target string, refers_to string, payload_digest string, payload_bytes long, payload binary")


# ------------------------------------------------------------------ writer

def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _create(path: str):
    """Output stream in whichever store the path names."""
    from pyarrow import fs

    if "://" not in path:
        store, at = fs.LocalFileSystem(), path.removeprefix("file:")
    else:
        scheme, rest = path.split("://", 1)
        store, at = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(at, compression=None)  # members are gzipped one by one


def record_bytes(kind: str, record_id: str, block: bytes, content_type: str, more: list[tuple[str, str]]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
             *(f"{k}: {v}" for k, v in more), f"WARC-Block-Digest: sha1:{digest(block)}",
             f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None, repeat: bool) -> bytes:
    """The record of one page: whole, or a revisit with the HTTP head alone."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    more = [("WARC-Target-URI", _target(url))] if url else []
    more.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if repeat:
        more += [("WARC-Refers-To", f"<{_urn(first)}>"), ("WARC-Profile", PROFILE)]
    return record_bytes("revisit" if repeat else "response", _urn(page), head if repeat else head + payload,
                        "application/http; msgtype=response", more)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   compress: bool = True, least: int = 0, torn: Column | None = None) -> DataFrame:
    """Writes the archives and returns their manifest (a written table).
    Payloads under ``least`` bytes are never revisits.  Rows for which
    ``torn`` holds are first written in part, as by a writer that stopped
    there, came back and wrote the record anew."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"),
        F.coalesce(torn if torn is not None else F.lit(False), F.lit(False)).alias("torn"))
    key = F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload").cast("string"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= least, key))
    # a null id is the largest; minima combine before the shuffle, and the written table lets a hot payload be split
    firsts = stage(rows.filter("sha IS NOT NULL").groupBy(F.col("sha").alias("of")).agg(
        F.min(F.struct(F.col("page").isNull(), "page"))["page"].alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "firsts")
    marked = rows.join(firsts, F.col("sha") == F.col("of"), "left").select(
        "page", "url", "payload", "torn", "first",
        (F.col("of").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("repeat"))
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        pack = member if compress else bytes
        out, path, done, size, made = None, "", [], 0, 0
        for batch in batches:
            for page, link, data, tear, first, repeat in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, records = f"{name}-{made:05d}{suffix}", 0, 0
                    out, made = _create(path), made + 1
                    info = f"software: shelfwright\r\nformat: {VERSION}\r\n".encode()
                    size += out.write(pack(record_bytes("warcinfo", f"urn:uuid:{uuid.uuid4()}", info, "application/warc-fields", [])))
                written = pack(page_record(page, link, data, first, repeat))
                if tear:
                    size += out.write(written[:max(1, len(written) // 3)])
                size += out.write(written)
                records += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        columns = list(zip(*done)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                                         names=["archive", "records", "bytes"])

    return stage(marked.mapInArrow(run, MANIFEST), "manifest")


# ------------------------------------------------------------------ reader

class Broken(Exception):
    """A check failed."""


class _File:
    """An archive read through a window."""

    def __init__(self, f) -> None:
        self.f, self.size, self.at, self.window = f, f.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.window)):
            self.f.seek(at)
            self.at, self.window = at, self.f.read(max(n, WINDOW))
        return self.window[at - self.at:at - self.at + n]

    def find(self, at: int, gz: bool) -> int:
        """The next place that may begin a member or a record; the file's end
        if there is none."""
        while at < self.size:
            part = self.read(at, WINDOW)
            k = part.find(MAGIC) if gz else (m.start() if (m := LINE.search(part)) else -1)
            if k >= 0:
                return at + k
            if at + len(part) >= self.size:
                break
            at += len(part) - 16  # a mark may lie across
        return self.size


class _Plain:
    """Bytes of an archive from a place on."""

    def __init__(self, file: _File, at: int) -> None:
        self.file, self.at = file, at

    def read(self, n: int) -> bytes:
        out = self.file.read(self.at, min(n, WINDOW))
        self.at += len(out)
        return out

    def ends(self) -> bool:
        return True


class _Member:
    """Inflated bytes of the gzip member that begins at a place; the library
    checks the member's sum and length where it ends."""

    def __init__(self, file: _File, at: int) -> None:
        self.file, self.at, self.z, self.held = file, at, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        chunk = self.z.unconsumed_tail
        if not chunk:
            chunk = self.file.read(self.at, CHUNK)
            self.at += len(chunk)
            if not chunk:
                raise Broken("the member ends early")
        try:
            self.held += self.z.decompress(chunk, 4 * CHUNK)
        except zlib.error as e:
            raise Broken(f"the member doesn't inflate: {str(e)[:80]}") from e
        if self.z.eof:
            self.at -= len(self.z.unused_data)
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def ends(self) -> bool:
        """Whether nothing but the checked end of the member is left."""
        while not self.held and self._more():
            pass
        return not self.held


def _until(src, end: bytes, most: int, what: str) -> tuple[bytes, bytes]:
    """Bytes up to and with ``end``, and what was read beyond."""
    got = b""
    while (k := got.find(end, max(0, len(got) - 2048))) < 0:
        part = src.read(1024)
        got += part
        if not part or len(got) > most:
            raise Broken(f"no end of the {what}")
    return got[:k + len(end)], got[k + len(end):]


def _fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _same(stated: str | None, sha) -> bool:
    """Whether a stated SHA-1 (base 32 or 16) is right; others aren't judged."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return value.upper() == base64.b32encode(sha.digest()).decode() or value.lower() == sha.hexdigest()


def _record(src, keep: bool) -> dict:
    """The next record of a source; raises :class:`Broken`.  The bytes that
    were read beyond the header go first."""
    head, rest = _until(src, b"\r\n\r\n", HEADER_BYTES, "record's header")
    if not LINE.match(head):
        raise Broken("no version line")
    if LINE.search(head, 1):
        raise Broken("a version line within the header")
    fields = _fields(head.split(b"\r\n")[1:])
    if not fields.get("content-length", "").isdecimal():
        raise Broken("no length in the header")
    if not all(fields.get(f) for f in ("warc-type", "warc-record-id", "warc-date")):
        raise Broken("a field that every header has is missing")
    left = int(fields["content-length"])
    http = fields.get("content-type", "").startswith("application/http")
    whole, body, size, opening, kept = hashlib.sha1(), hashlib.sha1(), 0, b"" if http else None, []
    http_fields: dict[str, str] = {}
    while left:
        part = (rest or src.read(min(left, 64 << 10)))
        part, rest = part[:left], part[left:]
        if not part:
            raise Broken("the block ends early")
        left -= len(part)
        whole.update(part)
        if opening is not None:  # the HTTP head
            opening += part
            k = opening.find(b"\r\n\r\n")
            if k < 0:
                if len(opening) > HEADER_BYTES:
                    raise Broken("no end of the HTTP head")
                continue
            http_fields = _fields(opening[:k].split(b"\r\n")[1:])
            part, opening = opening[k + 4:], None
        body.update(part)
        size += len(part)
        if keep:
            kept.append(part)
    close = rest[:4]
    while len(close) < 4 and (part := src.read(4 - len(close))):
        close += part
    if close != b"\r\n\r\n":
        raise Broken("the record doesn't end after its block")
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest")
    if not _same(fields.get("warc-block-digest"), whole):
        raise Broken("the block's digest differs")
    repeat = kind == "revisit"
    if not repeat and not _same(stated, body):
        raise Broken("the payload's digest differs")
    length = http_fields.get("content-length", "")
    return {"type": kind, "record_id": (fields.get("warc-record-id") or "").strip("<>") or None, "target": fields.get("warc-target-uri"),
            "refers_to": (fields.get("warc-refers-to") or "").strip("<>") or None,
            "payload_digest": (stated or "").rpartition(":")[2] or None if repeat else base64.b32encode(body.digest()).decode(),
            "payload_bytes": (int(length) if length.isdecimal() else None) if repeat else size,
            "payload": None if repeat or not keep else b"".join(kept), "over": rest[4:]}


class _Ahead:
    """A source with bytes that were read too far put back."""

    def __init__(self, src) -> None:
        self.src, self.back = src, b""

    def read(self, n: int) -> bytes:
        if self.back:
            out, self.back = self.back[:n], self.back[n:]
            return out
        return self.src.read(n)


def _records_at(file: _File, at: int, gz: bool, keep: bool) -> Iterator[dict]:
    """Records of the member, or the one record, that begins at a place; the
    last row has ``end``, where the next begins."""
    src = _Member(file, at) if gz else _Plain(file, at)
    ahead = _Ahead(src)
    while True:
        found = _record(ahead, keep)
        ahead.back = found.pop("over") + ahead.back
        if not gz:
            yield found | {"end": src.at - len(ahead.back)}
            return
        done = not ahead.back and src.ends()
        yield found | {"end": src.at if done else None}
        if done:
            return


def scan(f, gz: bool, keep: bool = False) -> Iterator[dict]:
    """All records and gaps of an open archive, in order."""
    file, at, gap, reason = _File(f), 0, None, ""
    while at < file.size:
        try:
            # nothing of a member counts until all of it is checked
            held, size = [], 0
            for r in _records_at(file, at, gz, keep):
                size += len(r["payload"] or b"")
                if size > 4 * BATCH_BYTES and held:  # too much to hold: read again once checked
                    for h in held:
                        h["payload"] = None
                    r = r | {"payload": None, "again": True}
                held.append(r)
            end = held[-1]["end"]
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            at = file.find(at + 1, gz)
            continue
        before = 0
        if gap is not None:
            before = at - gap
            yield {"kind": "gap", "at": gap, "length": before, "reason": reason}
            gap = None
        rows = _records_at(file, at, gz, keep) if any("again" in h for h in held) else held
        for k, r in enumerate(rows):
            r = {c: v for c, v in r.items() if c not in ("end", "again")}
            yield r | {"kind": "record", "at": at, "length": end - at, "after_gap": 0 if k else before}
        at = end
    if gap is not None:
        yield {"kind": "gap", "at": gap, "length": file.size - gap, "reason": reason}


def read_archives(archives: DataFrame, archive: str = "archive", payloads: bool = False) -> DataFrame:
    """Rows of ``kind`` record (its digest and length; ``payload`` if asked
    for; ``after_gap``: quarantined bytes right before it) and gap (``at``,
    ``length``, ``reason``).  ``at`` is the place of the record's member."""
    n = max(archives.sparkSession.sparkContext.defaultParallelism,
            int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    columns = [c.split()[0] for c in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in READ.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(columns, types)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                rows, size = [], 0
                try:
                    f = open_archive(path)
                except UnsupportedStore:
                    raise  # every archive of this store would fail
                except OSError as e:
                    yield batch([{"archive": path, "kind": "gap", "at": 0, "reason": f"can't be opened: {e}"}])
                    continue
                with f:
                    for r in scan(f, path.endswith(".gz"), payloads):
                        rows.append(r | {"archive": path})
                        size += 500 + len(r.get("payload") or b"")
                        if size > BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    paths = archives.select(F.col(f"`{archive}`").alias("archive")).filter("archive IS NOT NULL").distinct()
    return paths.repartition(n, "archive").mapInArrow(run, READ)


def round_trip(pages: DataFrame, torn: Column | None = None, compress: bool = True) -> DataFrame:
    """Writes all pages, reads the archives back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, salvaged`` (the record follows a
    quarantined gap)."""
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"), compress=compress, torn=torn)
    records = read_archives(manifest).filter("kind = 'record' AND type IN ('response', 'revisit')")
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                          F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
                          (F.col("after_gap") > 0).alias("salvaged"))
