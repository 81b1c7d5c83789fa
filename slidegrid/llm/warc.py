"""WARC archives: one gzip member per record, written in parallel and read back sequentially within each file.

`write` sends every page to a record; of records with equal payloads of at least MIN_REVISIT bytes that with the
smallest id is a `response` and the others are `revisit` records without a body that name it. Equal payloads meet
through an aggregate by digest (partial sums first) and a join on digests that occur more than once. Tasks write
files of bounded size straight to the shared folder under names of their own attempt and report them in a manifest;
only files of the manifest are read, so a task that is lost and run again leaves no double records, and each of them must be there.

`read_records` is the sequential reader: incremental zlib decompression member by member, header lines, then exactly
Content-Length bytes, then the two empty lines; block digests are verified and a mismatch raises.

Cases: a null payload is empty; a null id is written without an id and reads back as null, and is never the one
referred to unless all ids of its group are null (then every record is a response); rows with the same id and
payload are all responses if that id is the smallest; an empty table gives no file and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, stored

MIN_REVISIT, FILE_BYTES, READ_BYTES = 100, 32 << 20, 1 << 16
STAMP = "2000-01-01T00:00:00Z"  # a fixed date keeps the archives reproducible
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_text(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    name = f"{page_id}:{url}" if page_id is not None else f"null:{uuid.uuid4()}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One record as a gzip member."""
    body = payload if kind == "response" else b""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, url),
        "WARC-Date": STAMP,
        "WARC-Target-URI": "".join(c if c > " " else "%%%02X" % ord(c) for c in url or ""),
        "WARC-Payload-Digest": digest_text(payload),
        "WARC-Block-Digest": digest_text(body),
        "X-Payload-Length": str(len(payload)),
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, refers_url), "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "text/html", "Content-Length": str(len(body))}
    block = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(block.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 6, mtime=0)


class _Members:
    """Decompressed bytes of consecutive gzip members, in pieces; knows when a member has ended."""

    def __init__(self, file):
        self.file, self.raw, self.plain, self.unzip = file, b"", bytearray(), None

    def fill(self) -> bool:
        """More plain bytes of the current member; False at its end."""
        if self.unzip is None or self.unzip.eof:
            return False
        if not self.raw:
            self.raw = self.file.read(READ_BYTES)
            if not self.raw:
                raise ValueError("the archive ends inside a gzip member")
        self.plain += self.unzip.decompress(self.raw, READ_BYTES)
        self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True

    def next_member(self) -> bool:
        self.raw = self.raw or self.file.read(READ_BYTES)
        self.unzip, self.plain = zlib.decompressobj(31) if self.raw else None, bytearray()
        return self.unzip is not None

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark) + 1)
            if not self.fill():
                raise ValueError("a record without the end of its head")
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.fill():
                raise ValueError("a record shorter than its Content-Length")
            part = bytes(self.plain[:n])
            del self.plain[: len(part)]
            n -= len(part)
            yield part


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record of an open archive, in order."""
    members = _Members(file)
    while members.next_member():
        lines = members.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        body = b"".join(members.take(int(head["Content-Length"])))
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise ValueError("a record without its two empty lines")
        while members.fill():
            pass
        if members.plain:
            raise ValueError("a gzip member with more than one record")
        if head.get("WARC-Block-Digest", digest_text(body)) != digest_text(body):
            raise ValueError(f"block digest mismatch in {head.get('WARC-Record-ID')}")
        yield head, body


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html with kind, refers_to and refers_url.

    Repeated digests are written before the join, so that it sends them out if they are few, or splits a frequent one.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    long = F.length("html") >= min_revisit
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.where(long).groupBy("digest").agg(F.min(known).alias("x"), F.count("*").alias("n")).where("n > 1 and x is not null")
    joined = rows.join(stored(first.select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"))), "digest", "left")
    again = long & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def writer(folder: str, file_bytes: int) -> Callable:
    """A function for mapInArrow that writes records into files and yields their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        sink, size, names, counts = None, 0, [], []
        for batch in batches:
            for page_id, url, html, kind, refers_to, refers_url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if sink is None or size >= file_bytes:
                    if sink is not None:
                        sink.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    sink, size = store.open_output_stream(f"{base}/{name}", compression=None), 0
                    names.append(name)
                    counts.append(0)
                data = record_bytes(kind, page_id, url, html, refers_to, refers_url)
                sink.write(data)
                size += len(data)
                counts[-1] += 1
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "records"])

    return run


def whole_uri(spark: SparkSession, folder: str) -> str:
    """The folder with scheme and host, by the cluster's default file system; writers and readers then mean the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write(pages: DataFrame, folder: str, *, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (name, records) of the finished files."""
    spark = pages.sparkSession
    folder = whole_uri(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return stored(with_roles(pages, min_revisit).mapInArrow(writer(folder, file_bytes), "name string, records long"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """FOUND for each record of the manifest's files; a missing file raises, and so does another number of records."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(whole_uri(spark, folder))
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if lost := manifest.join(files.select("name"), "name", "left_anti").select("name").first():  # reads names only
        raise FileNotFoundError(f"missing archive {lost['name']}")
    files = files.join(manifest, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, records in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                out = []
                for head, body in read_records(io.BytesIO(memoryview(content.as_buffer()))):
                    kind, digest = head["WARC-Type"], base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload digest mismatch in {name}")
                    number = lambda key, head=head: int(head[key]) if head.get(key) else None
                    out.append((number("X-Page-ID"), len(body) if kind == "response" else number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-ID")))
                if len(out) != records:
                    raise ValueError(f"{name} holds {len(out)} records, not {records}")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = zip(*out, strict=True) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return files.mapInArrow(run, FOUND)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read these back."""
    folder = scratch(pages.sparkSession) + "-warc"
    return read(write(pages, folder), folder)
