"""WARC archives: written by tasks, read back in byte ranges.

Writing: every record is a gzip member of its own. Of records with equal payloads the one
with the smallest id is a response, the others are revisits that name it and carry no
payload. A task writes its archives under names of its own and reports them in a manifest,
so an attempt that is lost or repeated leaves at most files that no manifest names.

Reading: archives are cut into ranges of bytes, whatever lies at the cuts. A task looks for
the gzip magic from its range's start on, takes a place for a member only if it decodes to
a WARC header, and owns the records that start inside; it reads past its end to finish the
last one. After a record the next one is expected where its member ends.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.common import broadcastable, saved
from loomgraph.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"


@dataclass(frozen=True)
class WarcSettings:
    min_revisit_bytes: int = 0  # smaller payloads are always stored
    archive_bytes: int = 1 << 30  # an archive is closed once it is this long
    split_bytes: int = 16 << 20
    read_bytes: int = 1 << 16
    header_bytes: int = 1 << 20  # a longer header is no header
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"
    broadcast_digests: int = 200_000


PRODUCTION = WarcSettings()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or URI, as tasks open it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# Writing


def _line(name: str, value: str) -> bytes:
    """A header field; control characters in the value are percent-encoded."""
    return f"{name}: {''.join(c if c >= ' ' and c != chr(127) else f'%{ord(c):02X}' for c in value)}\r\n".encode("utf-8", "surrogatepass")


def record(kind: str, fields: list[tuple[str, str]], block: bytes, settings: WarcSettings) -> bytes:
    head = b"WARC/1.0\r\n" + b"".join(_line(n, v) for n, v in [("WARC-Type", kind), ("WARC-Date", settings.date), *fields, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(settings.level, zlib.DEFLATED, 31)
    return press.compress(head + CRLF + block + CRLF + CRLF) + press.flush()


def _record_id(page: int | None, digest: str, copy: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{copy}').urn}>"


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, copy: int, settings: WarcSettings) -> bytes:
    digest = base32_sha1(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _record_id(page, digest, copy)), ("WARC-Target-URI", url if url else f"urn:page:{page}"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if not revisit:
        return record("response", fields, http + payload, settings)
    fields += [("WARC-Refers-To", _record_id(first, digest, 0)), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    if first is not None:
        fields.append(("X-Refers-To-Page-Id", str(first)))
    return record("revisit", fields, http, settings)


def _write(batches: Iterator[pa.RecordBatch], folder: str, settings: WarcSettings) -> Iterator[pa.RecordBatch]:
    out, path, size, records = None, "", 0, 0

    def manifest():
        out.close()
        return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": records}], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    where, inner = filesystem(folder)
    for batch in batches:
        pages, urls, firsts, revisits, copies = (batch.column(c).to_pylist() for c in ("page_id", "url", "first", "revisit", "copy"))
        for i, payload in enumerate(batch.column("payload")):
            if out is None:
                where.create_dir(inner, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                path, size, records = f"{folder}/{name}", 0, 0
                out = where.open_output_stream(f"{inner}/{name}", compression=None)
                info = record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n", settings)
                out.write(info)
                size += len(info)
            one = page_record(pages[i], urls[i], payload.as_py(), firsts[i], revisits[i], copies[i], settings)
            out.write(one)
            size, records = size + len(one), records + 1
            if size >= settings.archive_bytes:
                yield manifest()
                out = None
    if out is not None:
        yield manifest()


def records_of(pages: DataFrame, settings: WarcSettings = PRODUCTION) -> DataFrame:
    """(page_id, url, payload, first, revisit, copy): what to write for every row of ``pages``.

    Only digests that occur twice or more meet the pages again; payloads stay where they
    are while those are few. Rows equal in id, url and payload are told apart by ``copy``.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    same = F.struct("page_id", "url")
    narrow = rows.where(F.octet_length("payload") >= settings.min_revisit_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("equal"))
    firsts = narrow.groupBy("digest").agg(F.sum("equal").alias("n"), F.min(F.struct(order.alias("order"), "equal")).alias("least")).where("n > 1")
    firsts = saved(firsts.select("digest", F.col("least.order.page_id").alias("first"), F.col("least.order.url").alias("first_url"), F.col("least.equal").alias("equal")))
    joined = rows.join(broadcastable(firsts, settings.broadcast_digests), "digest", "left")
    is_first = same.eqNullSafe(F.struct(F.col("first").alias("page_id"), F.col("first_url").alias("url")))
    single = joined.where("equal is null or equal = 1 or not coalesce(page_id <=> first and url <=> first_url, false)")
    out = single.select("page_id", "url", "payload", "first", (F.col("equal").isNotNull() & ~is_first).alias("revisit"), F.when(F.col("equal").isNull() | is_first, 0).otherwise(1).alias("copy"))
    repeated = firsts.where("equal > 1")
    if repeated.isEmpty():
        return out
    copies = rows.join(broadcastable(repeated, settings.broadcast_digests), "digest").where("page_id <=> first and url <=> first_url").dropDuplicates(["digest"])
    copies = copies.select("page_id", "url", "payload", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1)).alias("copy"))
    return out.unionByName(copies.select("page_id", "url", "payload", "first", (F.col("copy") > 0).alias("revisit"), F.col("copy").cast("int").alias("copy")))


def write_warc(pages: DataFrame, folder: str, settings: WarcSettings = PRODUCTION) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) below ``folder``; returns their manifest
    (path, bytes, records), which alone says what belongs to the result."""
    return saved(records_of(pages, settings).mapInArrow(lambda batches: _write(batches, folder, settings), "path string, bytes long, records long"))


# Reading


class _Bytes:
    """A file read forward in blocks, from any offset."""

    def __init__(self, file, size: int, block: int):
        self.file, self.size, self.block = file, size, block
        self.at, self.data = 0, b""

    def get(self, offset: int) -> bytes:
        """Some bytes at ``offset``, at least MAGIC's length where the file has them."""
        if not (self.at <= offset and offset + len(MAGIC) <= self.at + len(self.data)):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(self.block)
        return self.data[offset - self.at :]


def member(source: _Bytes, offset: int, settings: WarcSettings) -> tuple[dict[str, str], Iterator[bytes], list[int]] | None:
    """(fields, block in chunks, [end of the member once read]) of the record at ``offset``, or
    None where no member begins that decodes to a WARC header."""
    unpack, at, head = zlib.decompressobj(31), offset, b""
    try:
        while b"\r\n\r\n" not in head:
            if at >= source.size or len(head) > settings.header_bytes or unpack.eof:
                return None
            raw = source.get(at)
            head += unpack.decompress(raw)
            at += len(raw)
            if head[:7] != b"WARC/1."[: len(head)]:
                return None
    except zlib.error:
        return None
    text, rest = head.split(b"\r\n\r\n", 1)
    lines = text.decode("utf-8", "replace").split("\r\n")
    fields = {n.strip().lower(): v.strip() for n, colon, v in (s.partition(":") for s in lines[1:]) if colon}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    end = [-1]

    def chunks() -> Iterator[bytes]:
        place, left, part = at, int(fields["content-length"]), rest
        while True:
            if left and part:
                yield part[:left]
                left -= min(left, len(part))
            if unpack.eof:
                break
            if place >= source.size:
                return  # cut off: the end stays -1
            raw = source.get(place)
            part = unpack.decompress(raw)
            place += len(raw)
        if not left:
            end[0] = place - len(unpack.unused_data)

    return fields, chunks(), end


_FOUND = "path string, offset long, length long, type string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, problem string, payload binary"


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def _row(path: str, offset: int, found, payloads: bool) -> tuple[dict, int]:
    fields, chunks, end = found
    http, body, size, sha, problem = b"", [], 0, hashlib.sha1(), None
    try:
        inside = not fields.get("content-type", "").startswith("application/http")
        for chunk in chunks:
            if not inside:
                http += chunk
                inside = b"\r\n\r\n" in http
                if not inside:
                    continue
                http, chunk = http.split(b"\r\n\r\n", 1)
            size += len(chunk)
            sha.update(chunk)
            if payloads:
                body.append(chunk)
    except zlib.error:
        pass
    if end[0] < 0:
        problem = "cut off or damaged"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest = base32_sha1(sha.digest())
    if fields["warc-type"] == "revisit":
        lengths = [h.split(b":")[1].strip().decode() for h in http.split(CRLF) if h.lower().startswith(b"content-length:")]
        size, digest = _number(lengths[0]) if lengths else None, stated
    elif stated not in (None, digest):
        problem = problem or "digest differs"
    row = {"path": path, "offset": offset, "length": end[0] - offset if end[0] >= 0 else None, "type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
           "page_id": _number(fields.get("x-page-id")), "payload_bytes": size, "payload_digest": digest, "refers_to": _number(fields.get("x-refers-to-page-id")),
           "problem": problem, "payload": b"".join(body) if payloads and fields["warc-type"] != "revisit" else None}
    return row, end[0]


def read_range(path: str, start: int, stop: int, settings: WarcSettings = PRODUCTION, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive that start in [start, stop)."""
    where, inner = filesystem(path)
    with where.open_input_file(inner) as file:
        source = _Bytes(file, file.size(), settings.read_bytes)
        at = start
        while at < stop:
            data = source.get(at)
            if not data:
                return
            hit = data.find(MAGIC)
            if hit < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
                continue
            at += hit
            if at >= stop:
                return
            found = member(source, at, settings)
            if found is None:
                at += 1
                continue
            row, end = _row(path, at, found, payloads)
            yield row
            at = end if end > at else at + 1


def _read(batches: Iterator[pa.RecordBatch], settings: WarcSettings, payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _FOUND.split(", "))])
    for batch in batches:
        for split in batch.to_pylist():
            rows, held = [], 0
            for row in read_range(split["path"], split["start"], split["stop"], settings, payloads):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= 1000 or held >= settings.split_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder, listed by Spark without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))


def read_warc(files: DataFrame, settings: WarcSettings = PRODUCTION, payloads: bool = False) -> DataFrame:
    """One row per record of the archives (path, bytes): path, offset, length, type, uri, page_id,
    payload_bytes, payload_digest, refers_to, problem, and the payload if wanted.

    The payload is the body of an HTTP block, else the block. Records that end too early or
    fail their digest come with their problem named. Bytes between members are passed over.
    """
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(settings.split_bytes).cast("long")))
    ranges = files.select("path", "bytes", begin.alias("start"))
    ranges = saved(ranges.select("path", "start", F.least(F.col("start") + settings.split_bytes, "bytes").alias("stop")))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(lambda batches: _read(batches, settings, payloads), _FOUND)


def archived_pages(pages: DataFrame, settings: WarcSettings = PRODUCTION) -> DataFrame:
    """One row per row of ``pages``, as read back from archives written for them: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; payloads of any length are written and hashed whole.
    Null page_ids come last and are read back as null; of repeated ids the smaller url comes
    first, of repeated rows one is the response. A null url is written as a urn. Other columns
    are ignored. An empty table gives no rows.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = read_warc(write_warc(pages, folder, settings), settings).where("type in ('response', 'revisit')")
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def archived_sql() -> str:
    """The same rows as SQL over pages (of which no two may be equal in id and html)."""
    four = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
        with p as (select page_id, coalesce(html, '') h from pages),
        g as (select page_id, h, sha1(h) x, row_number() over (partition by h order by page_id) i, min(page_id) over (partition by h) f from p),
        d as (select x, string_agg({four}, '' order by q) payload_digest
              from (select distinct x, q, ('0x' || substr(x, 5 * q + 1, 5))::int v from g, range(8) r(q)) group by x)
        select page_id, strlen(h) payload_bytes, payload_digest, case when i = 1 then 'response' else 'revisit' end record_type,
               case when i > 1 then f end refers_to
        from g join d using (x)
    """
