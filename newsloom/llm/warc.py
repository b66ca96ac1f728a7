"""WARC archives: a writer that records repeated payloads as revisits, and a sequential reader.

Each writer task streams its rows to archives of its own in the target folder, one gzip member per record, and rolls to a new one
at ``ROLL_BYTES``. Files have unique names and only those in the manifest of tasks that succeeded are read, so a task that
is lost and run again leaves no double records. The reader takes whole archives, one at a time, and walks them: bytes
are read in pieces, each member is inflated incrementally, its header is framed by the blank line and its block by
Content-Length, and the digests of block and payload are verified.

Defined cases: null html is an empty payload, a null url an empty target; payloads under ``LEAST_REVISITED`` bytes are always responses; of rows
with equal payload and the same smallest id each is a response; repeated rows of an id share its record id; a null id is left out of its record, is never the original, and
has a record id of its own; ids may be of any type with an order, and as text hold any character: headers have them percent-encoded; an empty table gives no rows; a record that is cut short or fails a digest raises.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import store

LEAST_REVISITED = 100
ROLL_BYTES = 64 << 20
PIECE = 256 << 10
#: Most reading tasks; with more archives a task reads several, one after another.
READERS = 4096
#: Payloads that repeat, digest and id of each, that are sent to all writers, which then read pages where they lie; with more, pages meet them by digest.
SMALL_REPEATED = 100_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: str | None) -> str:
    """The same for the same page; without one, one of its own."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(_NAMESPACE, page_id)}>"


def _record(page_id: str | None, url: str, payload: bytes, digest: str, original: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id, safe='')}")
    if original is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(original)}", f"X-Refers-To-Page-ID: {quote(original, safe='')}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, records, done = None, None, 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, original in zip(batch.id, batch.url, batch.html, batch.digest, batch.original, strict=True):
                if out is None:
                    path, size, records = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = _gzip(_record(None if pd.isna(page_id) else page_id, " ".join((url or "").split()), html.encode(), digest, None if pd.isna(original) else original))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    done.append((path, records, size))
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return run


class Corrupt(ValueError):
    """An archive that is cut short, or whose record fails its digest."""


def _members(stream) -> Iterator[bytes]:
    """The inflated bytes of each gzip member, from a stream read in pieces."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    started = False
    while True:
        piece = rest or stream.read(PIECE)
        if not piece:
            if started:
                raise Corrupt("the archive ends inside a gzip member")
            return
        started = True
        parts.append(unpacker.decompress(piece))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts, started = zlib.decompressobj(31), [], False


def parse_record(data: bytes) -> dict:
    """Header fields (lower-case names), block and payload of one record; verifies framing and digests."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not blank or not lines[0].startswith("WARC/"):
        raise Corrupt("no WARC header")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise Corrupt(f"Content-Length of {fields.get('warc-record-id')} does not frame its block")
    if fields.get("warc-block-digest", "").removeprefix("sha256:") != hashlib.sha256(block).hexdigest():
        raise Corrupt(f"block digest of {fields.get('warc-record-id')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    stated = int(sent["content-length"])
    if fields["warc-type"] == "response":
        if len(payload) != stated or fields["warc-payload-digest"].removeprefix("sha256:") != hashlib.sha256(payload).hexdigest():
            raise Corrupt(f"payload of {fields.get('warc-record-id')}")
    return {"fields": fields, "payload_bytes": stated, "payload": payload}


_READ = "id string, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, refers_to_record string"


def _plain(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def _reader(folder: str, payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        columns = [*(c.split()[0] for c in _READ.split(", ")), *(["payload"] if payload else [])]
        for batch in batches:
            for path in batch.path:
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=0) as stream:
                    for data in _members(stream):
                        r = parse_record(data)
                        f = r["fields"]
                        rows.append((_plain(f.get("x-page-id")), f["warc-target-uri"], f["warc-record-id"], f["warc-type"], f["warc-payload-digest"].removeprefix("sha256:"), r["payload_bytes"], _plain(f.get("x-refers-to-page-id")), f.get("warc-refers-to"), *([r["payload"]] if payload else [])))
                        held += len(r["payload"]) if payload else 200
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record; the manifest (path, records, bytes) of what was written, already computed."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    long_enough = F.octet_length("html") >= LEAST_REVISITED
    first = rows.where(long_enough).groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = store.durable(first, "repeated")
    if first.limit(SMALL_REPEATED + 1).count() <= SMALL_REPEATED:
        first = F.broadcast(first)
    placed = rows.join(first, "digest", "left").select(
        F.col("_id").cast("string").alias("id"), "url", "html", "digest",
        F.when(long_enough & (F.col("_id").isNull() | (F.col("first") != F.col("_id"))), F.col("first")).cast("string").alias("original"),
    )
    return store.durable(placed.mapInPandas(_writer(folder), "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """All records of the archives in the manifest, with the payload (binary) if asked for."""
    paths = manifest.select("path").repartition(max(1, min(READERS, manifest.count())))  # a number of ours: the engine would pack the short rows into one task
    return paths.mapInPandas(_reader(folder, payload), _READ + (", payload binary" if payload else ""))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    pages = store.table(spark, sf_dir, "pages")
    folder = store.new_path(spark, "warc")
    found = read_archives(write_archives(pages, folder), folder)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
