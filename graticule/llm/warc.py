"""WARC archives: written with one gzip member per record, read back sequentially.

Records with equal payloads of at least min_bytes bytes are stored once: the one with the largest page_id
is a response, each other a revisit that refers to it. The reader takes a file in chunks, inflates member
by member with bounded output, frames records by their Content-Length and verifies digests; it never
holds more than one record.

Archives are rolled at ROLL bytes. Each is written under a name of its own and listed only by the task
that succeeds, so tasks can be repeated.

Defined results: a null html is an empty payload; repeated rows of one page_id and payload all are
responses if that page_id is the largest; a null page_id is written as a response unless an equal payload
has an id, and read back as null; an empty table gives no archive and an empty result; only page_id, url
and html are read; line breaks in a url are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_evenly, file_system, map_arrow

ROLL, CHUNK, LEVEL = 64 << 20, 1 << 18, 6
FILES = "path string, n_records long, n_bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
_DATE = "2024-01-01T00:00:00Z"
_NO_ID = uuid.uuid5(uuid.NAMESPACE_URL, "record without an id")


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{_NO_ID if page_id is None else uuid.UUID(int=page_id & (1 << 64) - 1)}>"


def page_of(urn: str) -> int | None:
    """The page_id of a record_id."""
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:"))
    if value == _NO_ID:
        return None
    return value.int - (1 << 64) if value.int >> 63 else value.int


def member(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _inflated(stream, chunk: int) -> Iterator[bytes | None]:
    """Pieces of inflated bytes, none above chunk; None after each gzip member."""
    raw, machine, begun = b"", zlib.decompressobj(31), False
    while True:
        if not raw and not (raw := bytes(stream.read(chunk))):
            if begun:
                raise ValueError("the archive ends within a record")
            return
        begun = True
        data = machine.decompress(raw, chunk)
        raw = machine.unconsumed_tail or machine.unused_data if not machine.eof else machine.unused_data
        if data:
            yield data
        while not machine.eof and (not raw) and (data := machine.decompress(b"", chunk)):
            yield data
        if machine.eof:
            yield None
            machine, begun = zlib.decompressobj(31), False


def read(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, one after another; raises ValueError if framing or a digest is wrong."""
    held = bytearray()
    headers: dict[str, str] | None = None
    for data in _inflated(stream, chunk):
        if data is not None:
            held += data
            continue
        end = held.find(b"\r\n\r\n")
        if not held.startswith(b"WARC/") or end < 0:
            raise ValueError("a record has no WARC header")
        headers = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        if len(held) != end + 4 + size + 4 or held[-4:] != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        block = bytes(held[end + 4 : end + 4 + size])
        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError("a block does not have its digest")
        yield headers, block
        held.clear()
    if held:
        raise ValueError("the archive ends within a record")


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """The payload's size and, for a response, the payload itself, verified against its digest."""
    end = block.index(b"\r\n\r\n")
    size = int(next(x for x in block[:end].split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    if headers["WARC-Type"] == "revisit":
        return size, None
    payload = block[end + 4 :]
    if len(payload) != size or headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError("a payload does not have its length or digest")
    return size, payload


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for a response) of each page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.unhex(F.sha1(F.col("html").cast("binary")))
    # Only payloads that occur twice or more come back from the aggregation; a hot one is a single row there, and the large side of the join can be split.
    copies = own.where(F.octet_length("html") >= min_bytes).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    joined = own.withColumn("_sha", sha).join(copies, F.col("_sha") == F.col("sha"), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(planned: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write the records of plan() to archives in folder; returns the list of archives (see FILES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        done: list[dict] = []
        out = None
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}")
                    done.append({"path": f"{folder}/{name}", "n_records": 0, "n_bytes": 0})
                payload, first = html.as_py().encode(), refers_to.as_py()
                data = member(page_id.as_py(), url.as_py(), payload, digest(payload), first, first is not None)
                out.write(data)
                done[-1]["n_records"] += 1
                done[-1]["n_bytes"] += len(data)
                if done[-1]["n_bytes"] >= roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return map_arrow(planned, run, FILES)


def scan(archives: DataFrame, n_tasks: int) -> DataFrame:
    """Records of the archives that write() listed (see ROWS)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = file_system(path)
                rows: list[dict] = []
                with fs.open_input_stream(name) as stream:
                    for headers, block in read(stream):
                        size, _ = payload_of(headers, block)
                        refers = headers.get("WARC-Refers-To")
                        uri = headers["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append({"page_id": page_of(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": headers["WARC-Type"], "refers_to": page_of(refers) if refers else None, "target_uri": uri})
                        if len(rows) == 2048:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(dealt_evenly(archives.select("path"), n_tasks), run, ROWS)
