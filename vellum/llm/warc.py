"""WARC archives: written record by record, read back, and assembled into one nested row per capture.

A capture is three records: a response (or a revisit of an equal payload), its request and its
metadata; request and metadata name the first in WARC-Concurrent-To. Reading parses every record
by its Content-Length, checks the payload digest, and joins the three through that identifier.

Files are written by Spark's text sink, so they may lie in any store that Spark can write: each
row is one gzip member holding one record, and the separator between rows is an empty gzip
member, which makes every file a gzip stream of one member per record. Files hold about
`FILE_BYTES` of payload, as their number follows the sum of payload sizes.

Cases: a null payload counts as empty; null urls become an empty target URI and read back as
null. Null page ids come after all others in the choice of the response. Rows equal in page id
and payload are a tie: one of them is the response. Payloads may hold any text, record
separators included; a very long one is a record like others, read by steps. Columns other than
id, url and payload are never read, whatever their names. An empty table gives archives without
captures and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions

FILE_BYTES = 32 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member.
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"

_RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, page_id long, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str, copy: int) -> str:
    """The same for the same capture in every attempt of a task."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind}|{page_id}|{digest}|{copy}'.encode()).digest())}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))] if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("thash"), pa.array([payload_digest(x) for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64())], names=["page_id", "thash", "digest", "bytes"])


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, copy: int, refers_copy: int = 0) -> list[bytes]:
    """The three records of one capture. copy: which of the rows with this page id and payload it is."""
    own = record_id("response", page_id, digest, copy)
    uri = _clean(url)
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    first: list[tuple[str, str | None]] = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        first += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id("response", refers_to, digest, refers_copy))]
    beside = [("WARC-Concurrent-To", own), *common]
    request = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    return [
        record("revisit" if revisit else "response", first, status + (b"" if revisit else payload)),
        record("request", [("WARC-Record-ID", record_id("request", page_id, digest, copy)), *beside, ("Content-Type", "application/http; msgtype=request")], request),
        record("metadata", [("WARC-Record-ID", record_id("metadata", page_id, digest, copy)), *beside, ("Content-Type", "application/warc-fields")], fields.encode()),
    ]


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", None, "", 0)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    yield pa.RecordBatch.from_arrays([pa.array([_member(info)], pa.binary())], names=["value"])
    last, copy = None, 0
    for batch in batches:
        members: list[bytes] = []
        size = 0
        for page_id, url, payload, digest, refers_to, shared in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("payload"), batch.column("digest").to_pylist(), batch.column("first_id").to_pylist(), batch.column("shared").to_pylist(), strict=True):
            copy = copy + 1 if (page_id, digest) == last else 0
            last = (page_id, digest)
            raw = payload.as_buffer().to_pybytes() if payload.is_valid else b""
            revisit = bool(shared) and (page_id != refers_to or copy > 0)
            members += map(_member, capture_records(page_id, url, raw, digest, refers_to, revisit, copy))
            size += len(raw)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])
                members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a capture per row of pages under path; equal payloads of least_bytes or more are stored once."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.xxhash64(payload).alias("thash"))
    digests = scratch.cut(rows.select("page_id", "thash", "payload").mapInArrow(_digest, "page_id long, thash long, digest string, bytes long"), "digests")
    total = digests.agg(F.sum("bytes")).first()[0] or 0
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = (F.col("n") > 1) & (F.col("bytes") >= least_bytes)
    known = digests.join(firsts, "digest").select(F.col("page_id").alias("known_id"), F.col("thash").alias("known_hash"), "digest", "first_id", shared.alias("shared")).distinct()
    # One shuffle of payloads, by row identity, gives both the join and the files.
    parts = max(shuffle_partitions(spark), -(-total // FILE_BYTES))
    identity = rows.withColumn("k", F.xxhash64("page_id", "thash")).repartition(parts, "k")
    known = known.withColumn("known_k", F.xxhash64("known_id", "known_hash")).repartition(parts, "known_k")
    meet = (F.col("k") == F.col("known_k")) & F.col("page_id").eqNullSafe(F.col("known_id")) & (F.col("thash") == F.col("known_hash"))
    joined = identity.join(known.hint("merge"), meet).select("page_id", "url", "payload", "digest", "first_id", "shared")
    files = joined.mapInArrow(_write, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).text(path)
    scratch.drop("digests")


def members(raw: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member, empty ones left out. Input goes in by steps, as what follows a member is copied."""
    at = 0
    while at < len(raw):
        open_ = zlib.decompressobj(31)
        parts = []
        while not open_.eof:
            piece = raw[at : at + step]
            if not piece:
                raise ValueError("archive ends inside a gzip member")
            parts.append(open_.decompress(piece))
            at += len(piece) - len(open_.unused_data)
        if content := b"".join(parts):
            yield content


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the block that Content-Length spans."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    size = int(headers["content-length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("Content-Length and record end disagree")
    return headers, rest[:size]


def _parsed(raw: bytes, with_payload: bool) -> tuple | None:
    headers, block = parse_record(raw)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit", "request", "metadata"):
        return None
    digest = page_id = size = payload = None
    if kind in ("response", "revisit"):
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if payload_digest(payload) != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    if kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)
        page_id = int(fields["page-id"]) if "page-id" in fields else None
    return (kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri") or None, digest, page_id, size, payload if with_payload else None)


def _read(with_payload: bool):
    kinds = (pa.string(),) * 6 + (pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for raw in members(content.as_buffer().to_pybytes()):
                    if row := _parsed(raw, with_payload):
                        rows.append(row)
                        size += len(raw) if with_payload else 0
                    if size > 8 << 20 or len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under path but warcinfo, parsed and checked."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(with_payload), _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: capture (its response or revisit), request and metadata as structs.

    Requests and metadata meet their capture where WARC-Concurrent-To equals its record id;
    identifiers are unique, so no key is hot.
    """
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("id"), F.struct("type", "record_id", "refers_to", "target_uri", "digest", "payload_bytes", "payload").alias("capture"))
    request = records.where(F.col("type") == "request").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "target_uri").alias("request"))
    metadata = records.where(F.col("type") == "metadata").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "page_id").alias("metadata"))
    return main.join(request, "id", "left").join(metadata, "id", "left").select("capture", "request", "metadata")


def resolve_revisits(found: DataFrame) -> DataFrame:
    """found with the size and page id of the response that each revisit refers to, itself for a response.

    A payload that a third of all captures share makes one hot identifier on the revisits'
    side only; Spark splits it, as the other side has one row for it.
    """
    responses = found.where(F.col("capture.type") == "response").select(F.col("capture.record_id").alias("response_id"), F.col("capture.payload_bytes").alias("full_bytes"), F.col("metadata.page_id").alias("response_page"))
    named = found.withColumn("wants", F.coalesce("capture.refers_to", "capture.record_id"))
    return named.join(responses, F.col("wants") == F.col("response_id"), "left").drop("wants", "response_id")
