"""WARC archives: segmented records written by Spark, read back, reassembled and decoded."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, scratch_path, table

#: Bytes of content in a segment, and of a chunk of the chunked transfer coding.
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
#: Up to so many revisits are broadcast to the writing tasks; more are joined, which shuffles the pages.
BROADCAST_ROWS = 1 << 17
#: Equal payloads of at least so many bytes are stored once.
MIN_DEDUP_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
#: Bytes of a header line at most.
MAX_LINE = 1 << 20
#: Records that are read; others (warcinfo, request, metadata and so on) are passed over.
READ = ("response", "revisit", "continuation")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """An archive doesn't hold what its headers say."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, rid: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{rid}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in the chunked transfer coding of HTTP/1.1."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, anything else out of place raises."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        head = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            raise WarcError(f"no chunk size at byte {at}")
        size, at = int(head, 16), end + 2
        if not size:
            if not body.endswith(b"\r\n"):
                raise WarcError("the last chunk isn't closed")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError(f"chunk at byte {at} isn't {size} bytes")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last line break (the writer ends each row with one)."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n%sContent-Length: %d\r\n\r\n%s\r\n" % (head.encode(), len(block), block)


def header_value(text: str | None) -> str | None:
    """A header can't hold line breaks; they are percent-encoded, as in URIs."""
    return None if text is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in text) or None


def records_of(page, rid: str, url: str | None, payload: bytes, first: tuple[object, str] | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit that refers to ``first``, or a response in one or more segments."""
    own = record_id(page, rid)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("X-Page-Id", page), ("X-Row", rid)]
    if first:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*first)), ("X-Refers-To-Page", first[0]), ("X-Payload-Bytes", len(payload))]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *more, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http; msgtype=response")], block)]
    out = []
    for n, part in enumerate(parts, 1):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", own)] if n == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{page}#{n}", rid)), ("WARC-Segment-Origin-ID", own)]
        out.append(record([*kind, *common, ("WARC-Segment-Number", n), *last, ("Content-Type", "application/http; msgtype=response")], part))
    return out


class Headers(dict):
    """Named fields; names don't differ by case."""

    def __getitem__(self, name: str) -> str:
        if (value := self.get(name)) is None:
            raise WarcError(f"no {name} in record {self.get('WARC-Record-ID')}")
        return value

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)

    def number(self, name: str) -> int | None:
        if (value := self.get(name)) is None:
            return None
        if not re.fullmatch(r"-?[0-9]{1,18}", value):
            raise WarcError(f"{name} is no number in record {self.get('WARC-Record-ID')}")
        return int(value)


def _fields(stream) -> Headers:
    """Header lines up to the empty one; a line that begins with a blank goes on with the one before."""
    out, last = Headers(), None
    while (line := stream.readline(MAX_LINE)) != b"\r\n":
        if not line.endswith(b"\r\n"):
            raise WarcError("headers without an end")
        name, found, value = line.partition(b":")
        if line[:1] in b" \t" and last:
            out[last] += " " + line.strip().decode(errors="replace")
        elif found:
            last = name.strip().lower().decode(errors="replace")
            out[last] = value.strip().decode(errors="replace")
        else:
            raise WarcError("a header without a colon")
    return out


def parse(source):
    """(headers, block) of each record of an archive, bytes or a stream of them; raises WarcError where its framing is broken.

    One record is held at a time. Broken compression is broken framing.
    """
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    try:
        while line := stream.readline(MAX_LINE):
            if not line.startswith(b"WARC/") or not line.endswith(b"\r\n"):
                raise WarcError(f"no record at byte {stream.tell() - len(line)}")
            headers = _fields(stream)
            if (size := headers.number("Content-Length")) is None or size < 0:
                raise WarcError(f"no length in record {headers.get('WARC-Record-ID')}")
            block = stream.read(size)
            if len(block) != size or stream.read(4) != b"\r\n\r\n":
                raise WarcError(f"record {headers.get('WARC-Record-ID')} isn't {size} bytes")
            yield headers, block
    except (EOFError, OSError, zlib.error) as e:
        raise WarcError(f"broken compression: {e}") from e


def opened(content: bytes):
    """A stream of an archive's bytes, which may be gzipped in any number of members."""
    stream = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream)) if content[:2] == b"\x1f\x8b" else stream


def payload_of(block: bytes) -> bytes:
    """The decoded payload of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no end of the HTTP headers")
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:\s*chunked", head, re.I) else body


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record: every number once from 1 on, and the total length that the last one states."""
    ordered = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in ordered)
    if [s[0] for s in ordered] != list(range(1, len(ordered) + 1)) or ordered[-1][1] is None:
        raise WarcError("a segment is missing or comes twice")
    if ordered[-1][1] != len(block):
        raise WarcError(f"segments hold {len(block)} bytes, not {ordered[-1][1]}")
    return block


def _headers(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            data = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest_of(x) for x in data]), pa.array([len(x) for x in data], pa.int64())], ["rid", "page_id", "digest", "len"])

    return pages.select("rid", "page_id", "html").mapInArrow(run, "rid string, page_id bigint, digest string, len bigint")


def write_archives(pages: DataFrame, path: str, row_id: str | None = None, min_dedup: int = MIN_DEDUP_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files into the folder path, by Spark's own writer.

    Of equal payloads of min_dedup bytes or more, the one with the smallest page_id (nulls last, then the smallest
    row id) is stored and the others become revisits of it. A block longer than segment_bytes is cut into continuation
    records. Null html is an empty payload. row_id names a string column that tells rows apart and stays the same when
    pages is read again; without one, pages is written once with numbers. The few rows that become revisits are
    broadcast if they are BROADCAST_ROWS at most, so that no html is shuffled; else they are joined. A file holds what one task has, so its size
    is that of a scan or shuffle partition. Other columns aren't read; empty pages make empty archives.
    """
    if row_id is None:
        numbered = pages.select("page_id", "url", "html").withColumn("rid", F.monotonically_increasing_id().cast("string"))
        pages, row_id = materialise(numbered, "warc-pages"), "rid"
    rows = pages.select(F.col(row_id).alias("rid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    heads = materialise(_headers(rows), "warc-heads")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("rid").alias("row"))
    groups = heads.filter(F.col("len") >= min_dedup).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    totals = heads.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    # Rows that are stored alone need no look-up; what is left is joined by digest, hot payloads by broadcast.
    again = groups.filter("n > 1").select("digest", "n", F.col("first.page").alias("first_page"), F.col("first.row").alias("first_rid"))
    linked = lookup(heads, again, "digest", "n", "rid", totals[0])
    linked = linked.filter(F.col("first_rid").isNotNull() & (F.col("first_rid") != F.col("rid")) & (F.col("len") >= min_dedup)).select("rid", "first_page", "first_rid")
    linked = materialise(linked, "warc-revisits")
    joined = rows.join(F.broadcast(linked) if linked.count() <= BROADCAST_ROWS else linked, "rid", "left")

    def run(batches):
        for b in batches:
            out, size = [], 0
            for rid, page, url, html, first_page, first_rid in zip(*(b.column(i).cast(pa.binary()).to_pylist() if i == 3 else b.column(i).to_pylist() for i in range(6)), strict=True):
                found = records_of(page, rid, url, html or b"", None if first_rid is None else (first_page, first_rid), segment_bytes)
                out += found
                size += sum(map(len, found))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = joined.select("rid", "page_id", "url", "html", "first_page", "first_rid").mapInArrow(run, "record binary")
    # The text writer puts a row's bytes as they are, then the line end, which closes the record.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """(page_id, rid, record_type, digest, len, payload, refers_to, error) of the archives in path: payloads in full, null for revisits.

    Archives of others can be read as well, gzipped or not: names of headers in any case, record types other than
    responses, revisits and continuations passed over; page_id, rid, refers_to and a revisit's len are null where an
    archive doesn't say them, and a digest of another kind than SHA-1 isn't checked.
    Each archive is read and decoded once, record by record, into a table of whole records and segments. Segments are grouped by their
    origin, ordered by number, checked against the total length and decoded; a group is one record's payload. Broken
    framing or compression, a missing segment, a wrong length or a digest that doesn't match raise WarcError; with errors="keep", such
    a record is a row of type ``damaged`` with the error, and what follows broken framing in its file is given up.
    """
    schema = "origin string, page_id bigint, rid string, record_type string, digest string, len bigint, refers_to bigint, segment int, total bigint, data binary, error string"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def damaged(e: WarcError, origin=None, page=None, rid=None):
        if errors == "raise":
            raise e
        return (origin, page, rid, "damaged", None, None, None, None, None, None, str(e))

    def stated(h: Headers) -> str | None:
        value = h.get("WARC-Payload-Digest") or ""
        return value[5:].upper() if value.lower().startswith("sha1:") else None

    def checked(name: str, payload: bytes, digest: str | None) -> str:
        if (own := digest_of(payload)) != (digest or own):
            raise WarcError(f"{name}: its payload has another digest")
        return own

    def row_of(h: Headers, block: bytes) -> tuple:
        kind, n, total, page, refers = h["WARC-Type"], *(h.number(k) for k in ("WARC-Segment-Number", "WARC-Segment-Total-Length", "X-Page-Id", "X-Refers-To-Page"))
        digest, length, name = stated(h), None, h["WARC-Record-ID"]
        if kind == "revisit":
            block, length = None, h.number("X-Payload-Bytes")
        elif n is None:
            block = payload_of(block)
            length, digest = len(block), checked(name, block, digest)
        return (h.get("WARC-Segment-Origin-ID", name), page, h.get("X-Row"), "response" if kind == "continuation" else kind, digest, length, refers, n, total, block, None)

    def known(h: Headers, name: str) -> int | None:
        try:
            return h.number(name)
        except WarcError:
            return None

    def rows(path_batches):
        for b in path_batches:
            for content in b.column(0):
                out, size, records = [], 0, parse(opened(content.as_py()))
                while True:
                    try:
                        if (found := next(records, None)) is None:
                            break
                    except WarcError as e:
                        out.append(damaged(e))
                        break
                    h, block = found
                    if h.get("WARC-Type") not in (*READ, None):
                        continue
                    try:
                        out.append(row_of(h, block))
                    except WarcError as e:
                        out.append(damaged(e, h.get("WARC-Record-ID"), known(h, "X-Page-Id"), h.get("X-Row")))
                    size += len(block)
                    if size > 8 << 20:
                        yield batch(out)
                        out, size = [], 0
                yield batch(out)

    def whole(group: pa.Table) -> pa.Table:
        rest = group.drop_columns(["data"]).to_pylist()
        r = min(rest, key=lambda r: (r["segment"], r["digest"] or ""))
        try:
            payload = payload_of(reassemble(list(zip(group["segment"].to_pylist(), group["total"].to_pylist(), group["data"].to_pylist(), strict=True))))
            digest = checked(r["origin"], payload, r["digest"])
        except WarcError as e:
            return pa.Table.from_batches([batch([damaged(e, r["origin"], r["page_id"], r["rid"])])])
        return pa.Table.from_batches([batch([(r["origin"], r["page_id"], r["rid"], r["record_type"], digest, len(payload), r["refers_to"], None, None, payload, None)])])

    found = materialise(spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema), "warc-records")
    parts = found.filter("segment is not null").groupBy("origin").applyInArrow(whole, schema)
    out = found.filter("segment is null").unionByName(parts)
    return out.select("page_id", "rid", "record_type", "digest", "len", F.col("data").alias("payload"), "refers_to", "error")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    # A row's name is its file and its place in it, not one hash of both.
    row = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    write_archives(table(spark, sf_dir, "pages").withColumn("_row", row), path, "_row")
    found = read_archives(spark, path)
    return found.select("page_id", F.col("len").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
