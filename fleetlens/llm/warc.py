"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Files are written and read inside tasks through the URI of a shared folder; Spark carries the rows in,
a manifest between, and the records out."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, small_batches
from fleetlens.session import checkpoint_dir

ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 16
#: Payloads of at least so many bytes are told once; equal ones after that revisit.
MIN_REVISIT_BYTES = 0
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_RECORD = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("refers_to", pa.int64()), ("payload", pa.binary())]
_RECORD_DDL = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class CorruptRecord(ValueError):
    """A record whose framing or digest does not hold."""


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri) if uri.startswith("file:") or "://" in uri else f"file://{uri}")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "none").strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One record as its own gzip member. A revisit keeps the HTTP head, with the payload's length and
    digest, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
              ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Members:
    """The bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.out, self.z = stream, b"", bytearray(), None

    def open(self) -> bool:
        """Start at the next member; False at the end of the file."""
        self.out = bytearray()
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.z = zlib.decompressobj(31) if self.raw else None
        return self.z is not None

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.raw or self.stream.read(READ_BYTES)
        if not data:
            raise CorruptRecord("the file ends inside a member")
        self.raw = b""
        self.out += self.z.decompress(data, READ_BYTES)
        if self.z.eof:
            self.raw = self.z.unused_data
        return True

    def line(self) -> bytes:
        while (at := self.out.find(b"\r\n")) < 0:
            if not self._more():
                raise CorruptRecord("a record's head does not end")
        got = bytes(self.out[:at])
        del self.out[: at + 2]
        return got

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self._more():
                raise CorruptRecord("a record is shorter than its Content-Length")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def close(self) -> None:
        while self._more():
            pass
        if self.out:
            raise CorruptRecord("bytes follow a record in its member")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head fields in lower case, block) of every record, in file order, with its block digest verified."""
    m = Members(stream)
    while m.open():
        if m.line() != VERSION:
            raise CorruptRecord("not a WARC/1.1 record")
        head: dict[str, str] = {}
        while line := m.line():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = m.take(int(head["content-length"]))
        if m.take(4) != b"\r\n\r\n":
            raise CorruptRecord("a record's end is missing")
        m.close()
        if (said := head.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
            raise CorruptRecord(f"block digest of {head.get('warc-record-id')}")
        yield head, block


def parsed(head: dict[str, str], block: bytes) -> tuple:
    """A record's row, with the payload digest verified where the payload is there."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise CorruptRecord(f"payload of {head['warc-record-id']}")
    return (_page(head["warc-record-id"]), head["warc-target-uri"], kind, size, said, _page(head.get("warc-refers-to")), payload if kind == "response" else None)


def _writer(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = store(base)
        where.create_dir(folder, recursive=True)
        part, out, done, size, count, path = TaskContext.get().partitionId(), None, [], 0, 0, ""
        for b in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    # An attempt never shares a name with another; the manifest names the files that count.
                    path = f"{folder}/pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = where.open_output_stream(path), 0, 0
                member = record(page_id, url, payload, revisit, refers_to)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def write(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write one record per row under ``base`` and return the manifest (path, records, bytes).

    Of rows with equal payloads of at least ``min_bytes``, those with the largest key are responses and
    the others revisit it; only (digest, largest key) of payloads that repeat are joined back. Null html
    is an empty payload; a null key never is the largest, and where a group has no key all are responses."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
                     F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    big = F.octet_length("payload") >= min_bytes
    told = p.where(big).groupBy(F.sha1("payload").alias("sha")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = p.withColumn("sha", F.when(big, F.sha1("payload"))).join(told, "sha", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    rows = rows.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    return materialize(small_batches(rows).mapInArrow(_writer(base), "path string, records long, bytes long"))


def _reader(base: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = store(base)

        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(_RECORD)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _RECORD, strict=True)], names=[n for n, _ in _RECORD])

        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list = []
                with where.open_input_stream(path) as stream:
                    for head, block in records(stream):
                        row = parsed(head, block)
                        rows.append(row if with_payload else (*row[:-1], None))
                        if len(rows) == 512:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    return run


def scan(manifest: DataFrame, base: str, with_payload: bool = True) -> DataFrame:
    """Rows of all records of the manifest's files; each file is read from front to back by a task of its own."""
    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(_reader(base, with_payload), _RECORD_DDL)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    base = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return scan(write(pages, base), base, with_payload)
