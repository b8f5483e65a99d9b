"""WARC archives as a chunked record table.

A record's payload comes as rows of (record id, chunk number), each with at most ``chunk_bytes`` bytes and the
SHA-256 of the payload so far, so that a record of any size goes through a task in constant memory and a reader
can check, resume or cut off a payload at any chunk. The last chunk says whether the digest in the record's
header holds. The writer streams likewise.

Plan: a file is a task (WARC can be read in order only); rows go out as they are read. Writers put a file under
its own name only when it is whole, so a task that runs twice does no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import col, file_system, shared_path

CHUNK = 16 << 10
LINE = 64 << 10  # bytes of a header line read at a time
CHUNKS = "path string, record_no long, record_id string, warc_type string, target_uri string, chunk_no int, offset long, length int, payload binary, digest string, is_last boolean, digest_ok boolean, error string"
WRITTEN = "path string, records long, bytes long"


def write_record(out, kind: str, record_id: str, uri: str | None, payload, size: int, digest: str | None, content_type: str = "text/html") -> None:
    """One record, compressed as a gzip member of its own; payload: an iterable of bytes, size in all."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _line(record_id), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + _line(uri))
    if digest:
        head.append(b"WARC-Block-Digest: sha256:" + digest.encode())
    head += [b"Content-Type: " + content_type.encode(), b"Content-Length: %d" % size]
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as z:
        z.write(b"\r\n".join(head) + b"\r\n\r\n")
        for part in payload:
            z.write(part)
        z.write(b"\r\n\r\n")


def _line(text: str) -> bytes:
    return text.replace("\r", "%0D").replace("\n", "%0A").encode()


def write_pages(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(path, records, bytes): each partition of pages as a file of ``resource`` records in folder.

    A record's id is <urn:page:ID> (of a null id: <urn:page:>). A null url has no target, a null html an empty
    payload. Other columns aren't written. The rows must be computed once only (write them out) to have the
    files written once.
    """
    pages = pages.select(col(page_id).cast("string").alias("id"), col(url).cast("string").alias("url"), col(html).cast("string").cast("binary").alias("html"))

    def run(batches):
        task = TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/part-{task.partitionId():06d}.warc.gz"
        temporary, records = f"{path}.{task.taskAttemptId()}.tmp", 0
        with system.open_output_stream(temporary, compression=None) as out:
            for b in batches:
                for i, u, h in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), b.column("html"), strict=True):
                    data = memoryview(h.as_buffer()) if h.is_valid else memoryview(b"")
                    write_record(out, "resource", f"<urn:page:{i or ''}>", u, (data[k : k + (1 << 16)] for k in range(0, len(data), 1 << 16)), len(data), hashlib.sha256(data).hexdigest())
                    records += 1
        size = system.get_file_info(temporary).size
        system.move(temporary, path)
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([folder.rstrip("/") + path[len(base) :]]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return pages.mapInArrow(run, WRITTEN)


def _read_line(stream) -> bytes:
    """A line of any length, read a piece at a time."""
    parts = [stream.readline(LINE)]
    while len(parts[-1]) == LINE and not parts[-1].endswith(b"\n"):
        parts.append(stream.readline(LINE))
    return b"".join(parts)


def read_records(stream, chunk_bytes: int = CHUNK):
    """Rows (as tuples without the path) of an open, decompressed WARC stream.

    What can't be read has a row whose error says so, and reading goes on with the next record that can be found:
    in compressed files at the next member, else at the next line that begins a record. A payload that the file's
    end, or damage, cuts off ends with that error. An empty payload has one row of length 0.
    """
    number, lost = 0, False
    empty = hashlib.sha256().hexdigest()
    none = (None, None, None)
    while True:
        own, k, at, digest = (number, *none), 0, 0, hashlib.sha256()
        try:
            line = stream.readline(LINE)
            while line in (b"\r\n", b"\n") or lost and line and not line.startswith(b"WARC/"):
                line = stream.readline(LINE)
            if not line:
                return
            if not line.startswith(b"WARC/"):
                lost = not stream.skip()
                yield *own, 0, 0, 0, b"", empty, True, None, "not a record"
                number += 1
                continue
            lost = False
            head: dict[str, str] = {}
            while (line := _read_line(stream)) not in (b"\r\n", b"\n", b""):
                name, _, value = line.partition(b":")
                head.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
            own = number, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri")
            length = head.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                lost = not stream.skip()
                yield *own, 0, 0, 0, b"", empty, True, None, "no length"
                number += 1
                continue
            left, expected = int(length[-18:]), head.get("warc-block-digest", "")
            while True:
                want, part = min(left, chunk_bytes), b""
                while len(part) < want and (more := stream.read(want - len(part))):
                    part = part + more if part else more
                digest.update(part)
                left -= len(part)
                cut = len(part) < want
                last = cut or not left
                ok = None
                if last and expected.startswith("sha256:"):
                    ok = expected[7:].lower() == digest.hexdigest() and not cut
                yield *own, k, at, len(part), part, digest.hexdigest(), last, ok, "truncated" if cut else None
                at += len(part)
                k += 1
                if cut:
                    return
                if last:
                    break
        except (zlib.error, EOFError) as e:  # of the compression
            yield *own, k, at, 0, b"", digest.hexdigest(), True, None, f"damaged: {e}"[:200]
            if not stream.skip():
                return
        number += 1


def read_chunks(files: DataFrame, *, path: str = "path", chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table of the files named in a column of files: (path, record_no, record_id, warc_type,
    target_uri, chunk_no, offset, length, payload, digest, is_last, digest_ok, error).

    Files ending in .gz are decompressed as they are read, member by member; after a damaged one reading goes on
    with the next. A null path is left out, a path that comes twice is read once, a file that can't be opened has
    one row with its error. Other columns, whatever their names, aren't read. digest is the SHA-256 of the payload
    up to the chunk's end; digest_ok is null but in the last chunk of a record with a sha256 block digest. An empty
    table gives no rows.
    """
    files = files.select(col(path).cast("string").alias("path")).where("path IS NOT NULL").distinct()
    parts = max(1, min(files.count(), 100_000))

    def run(batches):
        names = [x.strip().split(" ")[0] for x in CHUNKS.split(",")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for p in b.column("path").to_pylist():
                rows, size = [], 0
                try:
                    system, at = file_system(p)
                    with system.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
                        for r in read_records(_Lines(_Members(raw) if p.endswith(".gz") else raw), chunk_bytes):
                            rows.append((p, *r))
                            size += r[6] + 500
                            if size > 4 << 20:
                                yield batch(rows)
                                rows, size = [], 0
                except OSError as e:
                    rows.append((p, -1, None, None, None, 0, 0, 0, b"", None, True, None, f"{type(e).__name__}: {e}"[:200]))
                if rows:
                    yield batch(rows)

    return files.repartition(parts).mapInArrow(run, CHUNKS)


class _Members:
    """What gzip members hold; a read never goes beyond a member's end."""

    def __init__(self, raw):
        self.raw, self.data, self.z = raw, b"", None

    def _more(self) -> bool:
        more = self.raw.read(1 << 16)
        self.data += more
        return bool(more)

    def read(self, n: int) -> bytes:
        while True:
            if self.z is None:
                self.data = self.data.lstrip(b"\0")  # padding between members
                if not self.data:
                    if self._more():
                        continue
                    return b""
                self.z = zlib.decompressobj(31)
            if not self.data and not self._more():
                self.z = None
                raise EOFError("the file ends within a member")
            try:
                out = self.z.decompress(self.data, n)
            except zlib.error:
                self.data, self.z = self.data[1:], None
                raise
            self.data = self.z.unconsumed_tail
            if self.z.eof:
                self.data, self.z = self.z.unused_data, None
            if out:
                return out

    def skip(self) -> bool:
        """Goes to the next member that begins with a record; False if there is none."""
        self.z = None
        while True:
            at = self.data.find(b"\x1f\x8b\x08")
            if at < 0:
                self.data = self.data[-2:]
                if not self._more():
                    return False
                continue
            self.data = self.data[at:]
            while len(self.data) < 1 << 15 and self._more():
                pass
            try:
                if zlib.decompressobj(31).decompress(self.data, 5) == b"WARC/":
                    return True
            except zlib.error:
                pass
            self.data = self.data[1:]


class _Lines:
    """read and bounded readline over any stream with read."""

    def skip(self) -> bool:
        """After damage: whether the stream could go to where a record begins."""
        self.buffer, self.at = (b"", 0) if hasattr(self.raw, "skip") else (self.buffer, self.at)
        return hasattr(self.raw, "skip") and self.raw.skip()

    def __init__(self, raw):
        self.raw, self.buffer, self.at = raw, b"", 0

    def read(self, n: int) -> bytes:
        if self.at >= len(self.buffer):
            if n >= 1 << 16:
                return self.raw.read(n)
            self.buffer, self.at = self.raw.read(1 << 16), 0
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        return out

    def readline(self, limit: int) -> bytes:
        out = b""
        while len(out) < limit:
            if self.at >= len(self.buffer):
                if out and getattr(self.raw, "z", self) is None:
                    break  # a line doesn't go on in the next member
                self.buffer, self.at = self.raw.read(1 << 16), 0
                if not self.buffer:
                    break
            end = self.buffer.find(b"\n", self.at, self.at + limit - len(out))
            stop = end + 1 if end >= 0 else min(len(self.buffer), self.at + limit - len(out))
            out += self.buffer[self.at : stop]
            self.at = stop
            if end >= 0:
                break
        return out


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """(path, records, bytes): writes pages as WARC files in folder (default: a new one in the shared folder). Rules
    for nulls and so on as for ``write_pages``; an empty table gives no files."""
    folder = folder or shared_path(spark, "warc")
    listed = shared_path(spark, "warc-list")
    write_pages(pages, folder, **names).write.parquet(listed)
    return spark.read.parquet(listed)
