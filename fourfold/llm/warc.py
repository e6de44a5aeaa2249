"""WARC archives: a writer, a normaliser of monolithic gzip files, and an indexed reader.

A crawler that pipes its output through gzip leaves one gzip stream per file, in which no record can be reached without inflating
all before it. The normaliser inflates such a file once, in pieces, and writes every record as a gzip member of its own, with a sidecar
index of offsets and lengths; the reader then opens single members. Files are reached by pyarrow.fs under the folder that
the cluster shares, so any store that pyarrow knows will do.

Lost executors: each task writes under a name of its own (partition and a random part), and only files that a finished task reported are
listed in the kept manifests; leftovers of failed attempts are never read. The monolithic files are deleted once the normalised manifest is
kept.

Records: of payloads of at least ``revisit_bytes`` bytes that are equal (SHA-1), the one with the largest page_id is a response and the others
revisit it; smaller ones are always responses. Rows that repeat the largest page_id are all responses. A null id ranks below all others. A null payload
is empty, a null url is the empty string. A revisit has no payload, but its HTTP header keeps the full length, and both kinds
carry the digest of the full payload.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch
from .common import cut

REVISIT_BYTES = 1000
#: Uncompressed bytes after which the writer starts another file; a record is never split.
ARCHIVE_BYTES = 64 << 20
#: Repeated payloads whose table (about 100 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
_PIECE = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def record(page_id, url: str, payload: bytes, kind: str, refers_to, digest: bytes) -> bytes:
    """One WARC/1.1 record with its closing blank lines."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The named fields of a record, and its HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields | {"http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _writer(root: str, most: int):
    """(page_id, url, html, record_type, refers_to) to one row per monolithic file: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _store(root)
        out, path, n, size, gz = None, "", 0, 0, None

        def close():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, html, kind, refers in zip(*(batch.column(i) for i in range(5))):
                payload = (html.as_py() or "").encode()
                raw = record(page_id.as_py(), url.as_py(), payload, kind.as_py(), refers.as_py(), hashlib.sha1(payload).digest())
                if out is None:
                    path, n, size, gz = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    out = fs.open_output_stream(path, compression=None)
                out.write(gz.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of one gzip stream (or several, one after another), inflated piece by piece."""
    held, gz, need = bytearray(), zlib.decompressobj(31), 0

    def whole():
        nonlocal held, need
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    return
                length = next(int(x.split(b":", 1)[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                return
            yield bytes(held[:need])
            del held[:need]
            need = 0

    for piece in pieces:
        while piece:
            held += gz.decompress(piece, _PIECE)  # at most as much at once, however well it was packed
            piece = gz.unconsumed_tail
            if gz.eof:
                piece, gz = gz.unused_data, zlib.decompressobj(31)
            yield from whole()
    while more := gz.decompress(gz.unconsumed_tail, _PIECE):
        held += more
        yield from whole()
    if held:
        raise ValueError("the archive ends inside a record")


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(_PIECE):
        yield piece


def _normaliser(root: str):
    """Monolithic paths to one row per normalised archive: path, index, records. Inflates each file once, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _store(root)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"{at}/{uuid.uuid4().hex}"
                offset, n = 0, 0
                with fs.open_input_stream(source, compression=None) as src, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as idx:
                    for raw in records_of(_pieces(src)):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        out.write(member)
                        kind, _, key = raw[:400].partition(b"WARC-Type: ")[2].partition(b"\r\n")[0], 0, raw[:400].partition(b"WARC-Record-ID: <")[2].partition(b">")[0]
                        idx.write((json.dumps([offset, len(member), kind.decode(), key.decode()]) + "\n").encode())
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.idx"]), pa.array([n], pa.int64())], ["path", "index", "records"])

    return run


def _reader(root: str):
    """Normalised archives to their records' fields, each member opened at its offset and its payload checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(root)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with fs.open_input_file(path) as src, fs.open_input_stream(index, compression=None) as idx:
                    for line in idx.read().splitlines():
                        offset, length, kind, key = json.loads(line)
                        src.seek(offset)
                        r = parse(zlib.decompress(src.read(length), 31))
                        digest = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:"))
                        size = int(r["http"]["Content-Length"])
                        if kind == "response" and (hashlib.sha1(r["payload"]).digest() != digest or len(r["payload"]) != size):
                            raise ValueError(f"{key}: the payload does not match its digest or length")
                        refers = r.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                        page = key.removeprefix("urn:page:")
                        rows.append((None if page == "None" else page, r["WARC-Target-URI"], size, digest.hex(), r["WARC-Type"], refers or None))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def typed(pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, record_type, refers_to): only digests and ids are shuffled unless repeats are very many."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("d", F.when(F.octet_length("html") >= revisit_bytes, F.sha1("html")))
    first = cut(pages.where("d IS NOT NULL").groupBy("d").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1").select("d", "of"))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    both = pages.join(first, "d", "left")
    again = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    return both.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("of").cast("string")).alias("refers_to"))


def write_monolithic(records: DataFrame, root: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Manifest (path, records) of whole-file gzip archives under ``root``."""
    fs, at = _store(root)
    fs.create_dir(at, recursive=True)
    return cut(records.mapInArrow(_writer(root, archive_bytes), "path string, records long"))


def normalise(manifest: DataFrame, root: str) -> DataFrame:
    """Manifest (path, index, records) of archives with a member per record."""
    fs, at = _store(root)
    fs.create_dir(at, recursive=True)
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return cut(files.mapInArrow(_normaliser(root), "path string, index string, records long"))


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """page_id (string), url, payload_bytes, payload_digest, record_type, refers_to (string) of every record."""
    files = manifest.select("path", "index").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_reader(root), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(spark: SparkSession, pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages written, normalised and read back; page_id and refers_to have the type they had."""
    kind = pages.schema["page_id"].dataType.simpleString()
    root = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    written = write_monolithic(typed(pages, revisit_bytes=revisit_bytes), f"{root}/monolithic", archive_bytes=archive_bytes)
    normal = normalise(written, f"{root}/members")
    fs, at = _store(f"{root}/monolithic")
    fs.delete_dir(at)
    back = cut(read_archives(normal, f"{root}/members"))
    fs, at = _store(root)
    fs.delete_dir(at)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
