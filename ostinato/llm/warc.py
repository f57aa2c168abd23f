"""WARC archives as a table of chunks.

Writing: each task streams its records into archives of bounded size, every record a gzip member of its own,
and reports them only when they are closed and renamed; an archive of a lost or repeated task is never read.
Reading: an archive is inflated piece by piece; a record of any size leaves the reader as rows of record
number and chunk number, each with the running SHA-256, so no task ever holds a whole record.

Defined cases: a null payload is empty; equal payloads of at least `min_bytes` bytes have one response, the
smallest id, which the others revisit (rows that repeat this id are responses too, a null id is a revisit
unless all ids are null); a null url has no target header; control characters and spaces in a url are
percent-encoded in the header; an empty table gives no archive and no chunks; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.storage import step_path, written

ARCHIVE_BYTES = 64 << 20      # compressed bytes after which the next archive is begun
CHUNK_BYTES = 1 << 20
MIN_BYTES = 100
DATE = "1970-01-01T00:00:00Z"    # a fixed date keeps archives of equal pages equal
ARCHIVES = "archive string, records long, bytes long"
CHUNKS = ("archive string, record_no long, record_id string, record_type string, target_uri string, refers_to string, "
          "chunk_no long, chunk binary, chunk_bytes long, end_offset long, digest_so_far string, is_last boolean, "
          "payload_bytes long, payload_digest string")


def revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, digest, refers_to): records(id, digest, size) that repeat the payload of a smaller id.

    Only ids and digests are shuffled. The first ids of repeated digests are counted with partial sums and
    written, so the join back has a plain shuffle on both sides and a hot digest is split by Spark.
    """
    large = records.filter(F.col("size") >= min_bytes)
    first = (large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and refers_to is not null").select("digest", "refers_to"))
    return large.join(written(first), "digest").filter("id is null or id != refers_to").select("id", "digest", "refers_to")


def _members(handle):
    """Appends gzip members to a stream; write(parts) returns the compressed size."""
    def write(parts) -> int:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        size = 0
        for part in parts:
            for at in range(0, len(part), CHUNK_BYTES):
                size += handle.write(packer.compress(part[at:at + CHUNK_BYTES])) or 0
        handle.write(packer.flush())
        return size
    return write


def header_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_parts(row_id, url, digest: str, refers_to, revisit: bool, payload) -> list:
    """Header, HTTP head and payload of one record, the payload as it lies in memory."""
    size = len(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    name = "none" if row_id is None else str(row_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_url(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(head) + (0 if revisit else size)}", "", ""]
    return ["\r\n".join(lines).encode(), head, *([] if revisit else [payload]), b"\r\n\r\n"]


def open_folder(uri: str):
    """File system and path of a folder that all machines see."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + urlsplit(uri).path.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row; returns the written list of archives (archive, records, bytes)."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                         F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    again = revisits(written(keyed.select("id", "digest", "size")), min_bytes).select(
        "id", "digest", "refers_to").distinct().withColumnRenamed("digest", "again").withColumnRenamed("id", "again_id")
    rows = keyed.join(again, keyed["id"].eqNullSafe(again["again_id"]) & (keyed["digest"] == again["again"]), "left").select(
        "id", "url", F.when(F.col("again").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to",
        F.col("again").isNotNull().alias("revisit"))

    def run(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        handle, done = None, []

        def close():
            name = f"part-{context.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
            handle.close()
            system.move(temporary, f"{root}/{name}")
            done.append((name, records, system.get_file_info(f"{root}/{name}").size))

        for batch in batches:
            columns = [batch.column(n) for n in ("id", "url", "payload", "digest", "size", "refers_to", "revisit")]
            for k in range(batch.num_rows):
                row_id, url, body, digest, size, refers, revisit = (c[k] for c in columns)
                if handle is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    handle, records = system.open_output_stream(temporary, compression=None), 0
                    write = _members(handle)
                    write([b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                           % (str(uuid.uuid4()).encode(), DATE.encode())])
                data = Sized(size.as_py()) if revisit.as_py() else memoryview(body.as_buffer())
                write(record_parts(row_id.as_py(), url.as_py(), digest.as_py(), refers.as_py(), revisit.as_py(), data))
                records += 1
                if handle.tell() >= archive_bytes:
                    close()
                    handle = None
        if handle is not None:
            close()
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string()), "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    return written(rows.mapInArrow(run, ARCHIVES))


class Sized:
    """Stands for a payload that is not written, only its size."""

    def __init__(self, size: int):
        self.size = size

    def __len__(self) -> int:
        return self.size


class RecordReader:
    """Records of one archive stream, the payload in chunks of at most `chunk_bytes`."""

    def __init__(self, stream, chunk_bytes: int = CHUNK_BYTES):
        self.stream, self.chunk_bytes = stream, chunk_bytes
        self.inflate = zlib.decompressobj(31)
        self.raw, self.held, self.fresh = b"", bytearray(), True

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate, self.fresh = zlib.decompressobj(31), True
            if not self.raw:
                self.raw = self.stream.read(1 << 18)
                if not self.raw:
                    if not self.fresh:
                        raise ValueError("truncated archive")
                    return False
            self.fresh = False
            out = self.inflate.decompress(self.raw, self.chunk_bytes)
            self.raw = self.inflate.unconsumed_tail if not self.inflate.eof else b""
            if out:
                self.held += out
                return True

    def _until(self, mark: bytes) -> bytes | None:
        at, seen = self.held.find(mark), 0
        while at < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held:
                    raise ValueError("truncated archive")
                return None
            at = self.held.find(mark, seen)
        out = bytes(self.held[:at])
        del self.held[:at + len(mark)]
        return out

    def _take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("truncated archive")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out

    def __iter__(self):
        """(headers, iterator over payload chunks) of each record; the chunks must be used before the next record."""
        while (head := self._until(b"\r\n\r\n")) is not None:
            lines = head.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(headers["Content-Length"])
            if self.left:
                self.left -= len(self._until(b"\r\n\r\n")) + 4
            yield headers, self._chunks()
            for _ in self._chunks():
                pass
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("record does not end where its length says")

    def _chunks(self):
        while self.left:
            size = min(self.left, self.chunk_bytes)
            self.left -= size
            yield self._take(size)


def read_chunks(spark: SparkSession, archives: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunks of all records of the listed archives.

    The last chunk of a record (`is_last`, also there for an empty payload) carries the size and digest of the
    full payload, which for a revisit come from its header. `with_data=False` leaves out the bytes.
    """
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
             pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def chunk_rows(name, stream):
        for number, (headers, chunks) in enumerate(RecordReader(stream, chunk_bytes)):
            kind = headers["WARC-Type"]
            if kind == "warcinfo":
                continue
            def plain(key):
                return headers[key].removeprefix("<urn:page:").removesuffix(">") if key in headers else None
            base = (name, number, plain("WARC-Record-ID"), kind, headers.get("WARC-Target-URI"), plain("WARC-Refers-To"))
            digest, end, k, held = hashlib.sha256(), 0, 0, b""
            for chunk in chunks:
                if k:
                    yield (*base, k - 1, held if with_data else None, len(held), end, digest.hexdigest(), False, None, None)
                digest.update(chunk)
                end, k, held = end + len(chunk), k + 1, chunk
            stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and digest.hexdigest() != stated:
                raise ValueError(f"payload of {base[2]} does not match its digest")
            yield (*base, max(k - 1, 0), held if with_data else None, len(held), end, digest.hexdigest(), True,
                   end if kind == "response" else int(headers["X-Payload-Length"]), stated)

    def run(batches):
        system, root = open_folder(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in chunk_rows(name, stream):
                        rows.append(row)
                        size += 200 + (row[8] if with_data else 0)
                        if size >= 4 * chunk_bytes:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return archives.select("archive").repartition(tasks).mapInArrow(run, CHUNKS)


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or step_path(spark)
    archives = write_archives(pages, folder, min_bytes=min_bytes)
    last = read_chunks(spark, archives, folder, with_data=False).filter("is_last")
    return last.select(F.expr("cast(nullif(record_id, 'none') as long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"), (F.col("chunk_no") + 1).alias("n_chunks"))
