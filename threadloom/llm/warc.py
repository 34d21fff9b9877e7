"""WARC archives: written with one gzip member a record, read back sequentially.

The writer puts records of one task into archives of at most ``ROLL_BYTES`` under the shared folder and returns their
paths; only the paths of tasks that succeeded are kept, so a retried task leaves at worst a file that nothing reads.
The reader takes archives as streams: zlib inflates one member at a time, Content-Length frames its block, and block
and payload digests are checked. Neither side holds more than one record and one read buffer.

Cases: null html is an empty payload; equal payloads share one response, the row of smallest page_id, and rows that
repeat this page_id are responses as well; a null page_id is always a response, and never what others refer to; a null
url is left out of the record; other columns are not read; an empty table gives no archives and no rows. A record's id
is made of page_id and payload digest, so that a revisit can name its response; rows that repeat both repeat the id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, mapped, written

ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: Repeated payloads of a broadcast at most (some 60 bytes each); beyond, pages are joined with them by a shuffle.
BROADCAST_DIGESTS = 500_000
LEVEL = 3
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def b32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record's bytes, not compressed. A revisit keeps the HTTP head and drops the body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.encode("unicode_escape").decode())
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{b32(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records): archives of the rows (page_id, url, payload, payload_digest, refers_to), written when it is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path, out, size, n = "", None, 0, 0
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                member = _gzip(record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"]))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return mapped(pages.select("page_id", "url", "payload", "payload_digest", "refers_to"), run, "path string, records long")


def members(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated on its own."""
    rest = stream.read(size)
    while rest:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := stream.read(size)):
                raise ValueError("archive ends inside a member")
            parts.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
        yield b"".join(parts)
        rest = rest or stream.read(size)


def parse(raw: bytes) -> dict:
    """A record's fields and block; ValueError where framing or a digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if not first.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"bad framing of {fields.get('WARC-Record-ID')}")
    block = rest[:n]
    if fields["WARC-Block-Digest"] != "sha1:" + b32(block):
        raise ValueError(f"bad block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or b32(payload) != digest):
        raise ValueError(f"bad payload digest of {fields['WARC-Record-ID']}")
    return fields | {"payload": payload, "payload_bytes": size, "payload_digest": digest}


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """A row a record of the archives in column path (payloads stay in the archive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        x = parse(raw)
                        ident, url, refers = x.get("X-Page-ID"), x.get("WARC-Target-URI"), x.get("X-Refers-To-Page-ID")
                        rows.append((None if ident is None else int(ident), None if url is None else url.encode().decode("unicode_escape"), x["payload_bytes"], x["payload_digest"], x["WARC-Type"], None if refers is None else int(refers)))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return mapped(paths.select("path"), run, RECORDS)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): which record each page's payload revisits, if any.

    Digests are SHA-1, as the format has them, joined with the payload's size. Digests are counted without payloads, and those that
    occur twice are broadcast while they are few, so payloads stay in the task that read them.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.unhex(F.sha1(payload))
    size = F.octet_length(payload)
    first = pages.select("page_id", sha.alias("sha"), size.alias("size")).where(F.col("size") >= min_bytes)
    first = first.groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    first = written(first.drop("n"), "repeated")
    rows = pages.select("page_id", "url", payload.alias("payload"), sha.alias("sha"), size.alias("size"))
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
    joined = rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", base32_of_hex(F.hex("sha")).alias("payload_digest"), refers.alias("refers_to"))


def base32_of_hex(hexed):
    """Base32 of 20 bytes in hex: eight groups of 20 bits, four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for g in range(8):
        bits = F.conv(F.substring(hexed, g * 5 + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages (page_id, url, html) to archives and returns what a reader finds in them."""
    folder = fresh_path(pages.sparkSession, "warc")
    paths = written(write_archives(with_revisits(pages, min_bytes), folder), "warc-paths")
    return read_archives(paths.repartition(paths.sparkSession.sparkContext.defaultParallelism), folder)
