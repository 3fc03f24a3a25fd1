"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The writer makes a ``response`` record for a payload and a ``revisit`` record, without the body, for each other record of
an equal payload; of equal payloads the record with the largest id is the response, and payloads under ``MIN_SHARED``
bytes are always responses. A revisit keeps the HTTP header of its response, so that the length of the full payload
stays known. Every task rolls its own files at ``FILE_BYTES`` under a name made of partition and number, written aside
and renamed, so that a task that runs again replaces its files by equal ones.

The reader goes through a file once: it inflates member by member as the bytes come, frames each record by its
Content-Length, checks that nothing follows the record in its member, and verifies the digests that are given (SHA-1,
SHA-256 or MD5, in base 32 or hex). It takes archives of other writers: any record type, records without digests, page ids
or HTTP lengths, and chunked bodies. What isn't framed or digested as it says raises ``BrokenRecord``; a file never ends
early in silence. ``indexed`` holds the digest of each revisit against the response that it names.

Defined results: a null html is an empty payload; rows with a null id are written without a page id and come last among
equal payloads (if all are null, each is a response); rows that repeat the largest id are all responses; an empty table
gives an empty archive; a payload of any length is one record, held by one task as it is a single value; columns beyond
the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, written

MIN_SHARED, FILE_BYTES = 1000, 32 << 20
#: Digests of shared payloads up to which the table of them is broadcast: about 100 bytes each.
MAX_BROADCAST = 50_000
VERSIONS = (b"WARC/0.17", b"WARC/0.18", b"WARC/1.0", b"WARC/1.1")
VERSION, DATE = b"WARC/1.1", "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def digest_of(value: str) -> tuple[str, str] | None:
    """(algorithm, hex) of a digest field in base 32 or hex; None for an algorithm that isn't known here."""
    name, _, text = value.partition(":")
    name, text = name.lower().replace("-", ""), text.strip()
    if name not in ("sha1", "sha256", "md5"):
        return None
    size = hashlib.new(name).digest_size
    if len(text) == 2 * size:
        return name, text.lower()
    try:
        return name, base64.b32decode(text.upper() + "=" * (-len(text) % 8)).hex()
    except ValueError as e:
        raise BrokenRecord(f"digest {value}") from e


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: str | None, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response, or a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": _base32(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": _base32(hashlib.sha1(block).digest()),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = page_id
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": refers_to}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items())]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class BrokenRecord(ValueError):
    """A record that isn't framed or digested as it says."""


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of the gzip members of a file that comes in chunks."""
    unpacker, parts, began = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            began = True
            parts.append(unpacker.decompress(chunk))
            if not unpacker.eof:
                break
            chunk = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts, began = zlib.decompressobj(31), [], False
    if began:
        raise BrokenRecord("the last gzip member is cut off")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise BrokenRecord(f"header line {line[:40]!r}")
        name = key.strip().lower().decode("utf-8", "replace")
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def _number(value: str | None, what: str) -> int:
    if value is None or not (value.isascii() and value.isdigit()):
        raise BrokenRecord(f"{what}: no length but {value}")
    return int(value)


def _unchunked(body: bytes) -> bytes:
    """The body behind a chunked transfer coding."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError as e:
            raise BrokenRecord(f"chunk size {size[:20]!r}") from e
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise BrokenRecord("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _same(value: str | None, *contents: bytes) -> bool:
    """Whether a digest field, if it is there and known, is that of one of the contents."""
    said = digest_of(value) if value else None
    return said is None or any(hashlib.new(said[0], c).hexdigest() == said[1] for c in contents)


def parse(member: bytes) -> dict:
    """The record of a member, with its frame and the digests that it gives verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in VERSIONS:
        raise BrokenRecord("not a WARC record")
    fields = _fields(lines[1:])
    name, kind = fields.get("warc-record-id"), fields.get("warc-type")
    if not kind:
        raise BrokenRecord(f"no type: {name}")
    n = _number(fields.get("content-length"), f"record {name}")
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise BrokenRecord(f"content length {n} does not frame {name}")
    if not _same(fields.get("warc-block-digest"), block):
        raise BrokenRecord(f"block digest of {name}")
    said, length, payload = fields.get("warc-payload-digest"), n, block
    if kind in ("response", "revisit", "request") and fields.get("content-type", "").lower().startswith("application/http"):
        http, end, body = block.partition(b"\r\n\r\n")
        if not end and kind == "response":
            raise BrokenRecord(f"no HTTP header in {name}")
        own = _fields(http.split(b"\r\n")[1:])
        chunked = own.get("transfer-encoding", "").lower().endswith("chunked") and kind != "revisit"
        payload = _unchunked(body) if chunked else body
        # a chunked body has no length of its own; one without either ends with the record
        length = len(payload) if chunked or "content-length" not in own else _number(own["content-length"], f"HTTP of {name}")
        if kind == "revisit" and "content-length" not in own:
            length = None
        if kind == "response" and length != len(payload) and "warc-truncated" not in fields:
            raise BrokenRecord(f"HTTP length {length} does not frame {name}")
        if kind != "revisit" and not _same(said, payload, body):
            raise BrokenRecord(f"payload digest of {name}")
    elif kind != "revisit" and not _same(said, block):
        raise BrokenRecord(f"payload digest of {name}")
    known = digest_of(said) if said else None
    if kind == "revisit":
        hexed = known[1] if known else None
    else:
        hexed = known[1] if known and known[0] == "sha1" else hashlib.sha1(payload).hexdigest()
    return {
        "record_id": name, "page_id": fields.get("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": length,
        "payload": None if kind == "revisit" else payload, "payload_digest": hexed, "refers_to": fields.get("x-refers-to-page-id"), "refers_to_record": fields.get("warc-refers-to"),
    }


def records(chunks: Iterator[bytes]) -> Iterator[dict]:
    return map(parse, members(chunks))


def roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``shared``, and for payloads that are shared the page whose record is the response."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")).where(f"n >= {MIN_SHARED}")
    groups = digests.groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("response_id")).where("copies > 1").select("digest", "response_id")
    groups = written(groups, "payloads")
    if groups.count() <= MAX_BROADCAST:
        groups = F.broadcast(groups)
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(html) >= MIN_SHARED, F.sha1(html.cast("binary"))).alias("digest"))
    joined = rows.join(groups, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return joined.select(F.col("page_id").cast("string"), F.coalesce("url", F.lit("")).alias("url"), "html", refers.cast("string").alias("refers_to"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, parts, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{number:05d}.warc.gz"
            with open(aside := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
                f.writelines(parts)
            os.replace(aside, path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                page_id, html = page_id.as_py(), html.as_py()
                made = record(page_id, url.as_py(), (html or "").encode(), refers_to.as_py())
                parts.append(made)
                size, count = size + len(made), count + 1
                if size >= FILE_BYTES:
                    yield close()
                    number, parts, size, count = number + 1, [], 0, 0
        if parts:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``, which executors see as a path: path, records, bytes of each file."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"archives need a folder that executors mount as a path, not {folder}")
    local = unquote(url.path)
    os.makedirs(local, exist_ok=True)
    return written(roles(pages).mapInArrow(_writer(local), "path string, records long, bytes long"), "archives")


NAMES = ("record_id", "page_id", "url", "record_type", "payload_bytes", "payload", "payload_digest", "refers_to", "refers_to_record")


def _reader(with_payload: bool):
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [c for c in NAMES if with_payload or c != "payload"]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                with open(path, "rb") as f:
                    for r in records(iter(lambda: f.read(1 << 16), b"")):  # noqa: B023
                        rows.append(r)
                        held += 500 + len(r["payload"] or b"") * with_payload
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the files named by ``archives`` (path), each file read in one go by one task."""
    n = max(1, archives.count())
    files = archives.select("path").repartitionByRange(min(n, 10_000), "path")
    schema = ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'binary' if c == 'payload' else 'string'}" for c in NAMES if with_payload or c != "payload")
    return files.mapInArrow(_reader(with_payload), schema)


def indexed(archives: DataFrame) -> DataFrame:
    """One row a record, without payloads; raises if a revisit's digest isn't that of the response it names.

    A revisit whose response is in none of these archives can't be held against it and is returned as it is.
    """
    index = written(read_archives(archives, with_payload=False), "index")
    named = index.where("record_type = 'revisit' and refers_to_record is not null").select(F.col("refers_to_record").alias("record_id"), F.col("payload_digest").alias("said"))
    own = index.where("record_type <> 'revisit'").select("record_id", "payload_digest")
    wrong = named.distinct().join(own.groupBy("record_id").agg(F.collect_set("payload_digest").alias("own")), "record_id").where(~F.array_contains("own", F.col("said"))).take(1)
    if wrong:
        raise BrokenRecord(f"a revisit names {wrong[0].record_id}, whose payload has another digest than {wrong[0].said}")
    return index


def archive(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives under the shared folder: path, records, bytes of each file."""
    return write_archives(pages, f"{shared_folder(pages.sparkSession)}/lumenark-warc-{uuid.uuid4().hex}")


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives and reads the records back."""
    return read_archives(archive(pages))
