"""WARC archives: records in bounded chunks, out and back in.

Payloads travel as rows of a chunk table (record, chunk number, bytes), so neither the
writing nor the reading task holds a whole record in its Python memory: the writer gets one
chunk after the other, the reader streams a file and yields chunk rows.  Every chunk row
carries the digest of the payload up to its end, and the last one thereby that of the whole.

Records with equal payloads are stored once: the one with the largest id is a response, the
others are revisits that name it.  Payloads of fewer than ``least_bytes`` bytes are always
stored.

Archives are written through Arrow's file systems into a folder that all executors share.
A task writes a file of its own name, and only files named in the stored manifest (by tasks
that succeeded) are read, so lost executors and repeated tasks leave no double records.

Definitions: a null payload is the empty one; a record without an id is written, and read
with a null id; repeated rows are records of their own, and those with the largest id are all
responses; an empty table gives an empty archive.  Only the named columns are read, so
further columns can't clash with the results.
"""

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.sources.staging import materialize, new_path

CHUNK_BYTES = 1 << 18
END = b"\r\n"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record string, page long, url string, kind string, refers_to long, stated_digest string, stated_bytes long, chunk int, is_last boolean, bytes_so_far long, digest_so_far string, data binary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the place in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """One row for each record: id, url, payload, its size and digest, and the record it repeats."""
    data = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    rows = rows.select("page", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("same"))
    groups = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("same")
        .agg(F.max("page").alias("original"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("original").isNotNull())
        .select("same", "original")
    )
    groups = materialize(groups, "warc-groups")
    refers = F.when((F.col("page") != F.col("original")) | F.col("page").isNull(), F.col("original"))
    return rows.join(groups, "same", "left").select("page", "url", "payload", "size", "sha1", refers.alias("refers_to"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The records as chunk rows; a revisit has one empty chunk, as its payload isn't stored."""
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    parts = F.greatest(F.ceil(F.octet_length(stored) / chunk_bytes), F.lit(1)).cast("int")
    data = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(stored, i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("page", "url", "size", "sha1", "refers_to", F.posexplode(data).alias("chunk", "data"))


def _header(page, url, size: int, sha1: str, refers_to) -> tuple[bytes, bool]:
    """What stands before the payload of a record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = refers_to is not None
    length = len(http) if revisit else len(http) + size
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {''.join(url.split())}")
    if page is not None:
        fields.append(f"X-Page-ID: {page}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http, revisit


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, written, total = f"{folder}/{uuid.uuid4().hex}.warc", None, 0, 0
        for batch in batches:
            rows = zip(*(batch.column(i) for i in range(7)), strict=True)
            for page, url, size, sha1, refers_to, chunk, data in rows:
                if out is None:
                    system, place = opened(path)
                    out = system.open_output_stream(place, compression=None)
                if chunk.as_py() == 0:
                    if written:
                        out.write(END + END)
                    head, _ = _header(page.as_py(), url.as_py(), size.as_py(), sha1.as_py(), refers_to.as_py())
                    out.write(head)
                    written, total = written + 1, total + len(head)
                body = data.as_py()
                out.write(body)
                total += len(body)
        if out is not None:
            out.write(END + END)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([written], pa.int64()), pa.array([total], pa.int64())], ["path", "records", "bytes"])

    return run


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows, each record's in order, as one archive for each partition; gives the stored manifest."""
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    manifest = chunks.select("page", "url", "size", "sha1", "refers_to", "chunk", "data").mapInArrow(_writer(folder), MANIFEST)
    return materialize(manifest, "warc-manifest")


def _fields(stream, first: bytes) -> dict[str, str]:
    lines = [first]
    while (line := stream.readline()) not in (END, b""):
        lines.append(line)
    pairs = (line.decode().rstrip("\r\n").partition(": ") for line in lines[1:])
    return {name.lower(): value for name, _, value in pairs}


def read_file(stream, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of one archive, read front to back."""
    while first := stream.readline():
        if first == END:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {first[:40]!r}")
        fields = _fields(stream, first)
        left = int(fields["content-length"])
        before = stream.tell()
        _fields(stream, stream.readline())
        left -= stream.tell() - before
        digest, so_far, chunk = hashlib.sha1(), 0, 0
        page, refers_to = fields.get("x-page-id"), fields.get("x-refers-to-page")
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"{fields['warc-record-id']} ends early")
            left, so_far = left - len(data), so_far + len(data)
            digest.update(data)
            yield {
                "record": fields["warc-record-id"].strip("<>"),
                "page": None if page is None else int(page),
                "url": fields.get("warc-target-uri"),
                "kind": fields["warc-type"],
                "refers_to": None if refers_to is None else int(refers_to),
                "stated_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                "stated_bytes": int(fields["x-payload-length"]),
                "chunk": chunk,
                "is_last": left == 0,
                "bytes_so_far": so_far,
                "digest_so_far": base64.b32encode(digest.digest()).decode(),
                "data": data,
            }
            if not left:
                break
            chunk += 1


class _Lines:
    """A buffered stream with lines, places and bounded reads."""

    def __init__(self, raw, size: int = 1 << 20):
        self.raw, self.size, self.buffer, self.at, self.place = raw, size, b"", 0, 0

    def _more(self) -> bool:
        data = self.raw.read(self.size)
        self.buffer, self.at = self.buffer[self.at :] + data, 0
        return bool(data)

    def readline(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0 and self._more():
            pass
        return self.read(end + 1 - self.at) if end >= 0 else self.read(len(self.buffer) - self.at)

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        data = self.buffer[self.at : self.at + n]
        self.at, self.place = self.at + len(data), self.place + len(data)
        return data

    def tell(self) -> int:
        return self.place


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives in a manifest; ``with_data`` off leaves the bytes out of the rows."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                with system.open_input_stream(place, compression=None) as raw:
                    rows, held = [], 0
                    for row in read_file(_Lines(raw), chunk_bytes):
                        if not with_data:
                            row["data"] = None
                        rows.append(row)
                        held += len(row["data"] or b"") + 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").mapInArrow(run, CHUNKS)


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest with its archives dealt out to tasks."""
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(4 * cores)


def archive(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write every row as a record; gives the manifest."""
    return write_archives(chunked(records(df, key, url, payload, least_bytes), chunk_bytes), folder)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every record, from archives written and read back.

    A response's size and digest are those of the bytes that were read; a revisit has none,
    so its header tells.
    """
    manifest = archive(df, new_path(df.sparkSession, "warc"), key, url, payload, least_bytes, chunk_bytes)
    chunks = read_archives(spread(manifest), chunk_bytes, with_data=False).where("is_last")
    revisit = F.col("kind") == "revisit"
    return chunks.select(
        F.col("page").alias(key),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )
