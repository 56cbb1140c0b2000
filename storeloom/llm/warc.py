"""WARC archives: writing segmented records and putting them together again."""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.llm.common import saved

SEGMENT_BYTES = 65_536  # block of a record; the rest goes on in continuation records
CHUNK_BYTES = 8_192  # of the chunked transfer coding
FILE_RECORDS = 2_000  # so a file has 128 MiB at most
DATE = "2000-01-01T00:00:00Z"

# The end of a record, of a header and of a line.
RECORD_END, HEADER_END, LINE_END = "\r\n\r\n", b"\r\n\r\n", b"\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """What chunked transfer coding holds, and whether it came to its end."""
    parts, at = [], 0
    while True:
        end = body.find(LINE_END, at)
        if end < 0:
            return b"".join(parts), False
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(parts), False
        if not size:
            return b"".join(parts), True
        part = body[end + 2 : end + 2 + size]
        parts.append(part)
        at = end + 2 + size
        if len(part) < size or body[at : at + 2] != LINE_END:
            return b"".join(parts), False
        at += 2


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + HEADER_END


def _records(
    page_id: int | None, url: str | None, payload: bytes, record_id: str, refers: tuple | None,
    segment_bytes: int,
) -> Iterator[bytes]:
    """The records of one page; ``refers``: id of page and record that have the payload."""
    digest = "sha1:" + b32encode(sha1(payload).digest()).decode()
    about = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest),
        ("X-Page-ID", None if page_id is None else str(page_id)),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _head(
            [
                ("WARC-Type", "revisit"),
                ("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
                *about,
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", f"<urn:uuid:{refers[1]}>"),
                ("X-Refers-To-Page-ID", str(refers[0])),
                kind,
                ("Content-Length", str(len(block))),
            ]
        ) + block
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    count = -(-len(block) // segment_bytes)
    for n in range(count):
        part = block[n * segment_bytes : (n + 1) * segment_bytes]
        segment = [("WARC-Segment-Number", str(n + 1))] if count > 1 else []
        if n:
            segment.append(("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"))
            own = f"{record_id[:-8]}{zlib.crc32(f'{record_id}/{n}'.encode()):08x}"
        else:
            own = record_id
        if n and n == count - 1:
            segment.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _head(
            [
                ("WARC-Type", "continuation" if n else "response"),
                ("WARC-Record-ID", f"<urn:uuid:{own}>"),
                *about,
                *segment,
                kind,
                ("Content-Length", str(len(part))),
            ]
        ) + part


def _build(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        columns = [batch.column(c) for c in ("_page", "_url", "_html", "_record", "_last", "_last_record")]
        for page, url, html, record, last, last_record in zip(*columns):
            page, last = page.as_py(), last.as_py()
            refers = (last, last_record.as_py()) if last is not None and page != last else None
            payload = html.as_buffer().to_pybytes()
            for data in _records(page, url.as_py(), payload, record.as_py(), refers, segment_bytes):
                out.append(data)
                size += len(data)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["_record"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["_record"])


def _uuid(page: str) -> Column:
    """Name of the record of a page and a payload."""
    seed = F.concat_ws("/", F.coalesce(F.col(page).cast("string"), F.lit("-")), "_digest")
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(F.md5(seed), at, n) for at, n in cuts])


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write a record per row, gzipped WARC files, below ``path``.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes the one with the largest
    id is a response with the payload, the others are revisits that refer to it; several
    rows with that same id are all responses, and so are rows of a payload that has no id.
    A null payload is an empty one, a null url is left out.

    Only payloads that occur twice are kept as a list, by digest and counted map-side; where
    it is short Spark sends it to the pages, else it splits the digests that are hot.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("_page"),
        F.col(url_col).alias("_url"),
        F.coalesce(payload_col, F.lit("")).alias("_html"),
    ).withColumn("_digest", F.sha1("_html"))
    repeated = saved(
        rows.filter(F.octet_length("_html") >= revisit_bytes)
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_page").alias("_last"))
        .filter(F.col("_n") > 1)
        .select("_digest", "_last"),
        "warc-repeated",
    )
    records = rows.join(repeated, "_digest", "left").select(
        "_page", "_url", "_html", _uuid("_page").alias("_record"), "_last",
        _uuid("_last").alias("_last_record"),
    ).mapInArrow(lambda batches: _build(batches, segment_bytes), "_record binary")
    # A record and its end, byte for byte, is what the text writer puts down per row.
    records.select(F.col("_record").cast("string")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:  # one member after the other
            unzip = zlib.decompressobj(31)
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(HEADER_END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        yield head, data[start:stop]
        at = stop + 4


_ROW = (
    "_origin string, _segment int, _total long, record_type string, page_id long, url string, "
    "refers_to long, payload_digest string, _block binary"
)
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _parsed(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Records of archives: those that stand alone, or the segments of the others."""
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for head, block in parse(content.as_py()):
                segment = head.get("warc-segment-number")
                if whole != (segment is None) or head["warc-type"] not in (
                    "response", "revisit", "continuation",
                ):
                    continue
                number = lambda name, head=head: int(head[name]) if name in head else None
                rows.append(
                    (
                        head.get("warc-segment-origin-id", head["warc-record-id"]),
                        None if segment is None else int(segment),
                        number("warc-segment-total-length"),
                        head["warc-type"],
                        number("x-page-id"),
                        head.get("warc-target-uri"),
                        number("x-refers-to-page-id"),
                        head.get("warc-payload-digest", "").removeprefix("sha1:"),
                        block,
                    )
                )
                size += len(block)
                if size > 1 << 22:
                    yield _row_batch(rows)
                    rows, size = [], 0
            yield _row_batch(rows)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by origin and number to whole records; one record in memory.

    A record written twice has every segment twice and is given back twice.  One that lacks
    a segment, or whose length is not the stated one, has a null block.
    """
    head, parts, copies, last, total = None, [], 0, 0, None

    def close() -> Iterator[pa.RecordBatch]:
        if head is not None:
            block = b"".join(parts)
            good = last == len(parts) and total == len(block)
            yield _row_batch([(*head, block if good else None)] * max(copies, 1))

    for batch in batches:
        for row in zip(*[batch.column(n) for n in _NAMES]):
            origin, segment, stated = (row[i].as_py() for i in range(3))
            if head is None or origin != head[0]:
                yield from close()
                head, parts, copies, last, total = None, [], 0, 0, None
                head = tuple(x.as_py() for x in row[:-1])
            if segment == 1:
                head = tuple(x.as_py() for x in row[:-1])
                copies += 1
            if segment != last:
                parts.append(row[-1].as_py())
                last = segment
            total = stated if stated is not None else total
    yield from close()


def _payload(block: bytes | None, revisit: bool) -> tuple[bytes | None, int | None, bool]:
    """Payload (null for a revisit), its length, and whether the message is whole."""
    if block is None:
        return None, None, False
    top, _, body = block.partition(HEADER_END)
    fields = {
        k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in top.split(LINE_END)[1:])
    }
    length = int(fields[b"content-length"]) if b"content-length" in fields else None
    if revisit:
        return None, length, length is not None
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        payload, good = unchunked(body)
        return payload, len(payload), good
    return body, len(body), length is None or length == len(body)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    for batch in batches:
        kinds = batch.column("record_type").to_pylist()
        found = [_payload(b.as_py(), k == "revisit") for b, k in zip(batch.column("_block"), kinds)]
        complete = []
        for (payload, _, good), digest in zip(found, batch.column("payload_digest").to_pylist()):
            if good and payload is not None:
                good = b32encode(sha1(payload).digest()).decode() == digest
            complete.append(good)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in keep],
                pa.array([n for _, n, _ in found], pa.int64()),
                pa.array([p for p, _, _ in found], pa.binary()),
                pa.array(complete, pa.bool_()),
            ],
            names=[*keep, "payload_bytes", "payload", "complete"],
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit record below ``path``.

    ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest`` (base32 SHA-1),
    ``payload_bytes``, ``payload`` (null for revisits) and ``complete``: all segments are
    there, their total length, the transfer coding's end and the digest are right.

    Segments are grouped by their origin and ordered by number, one record in memory at a
    time; records that stand alone, which are most, are not shuffled.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select("content")
    whole = files.mapInArrow(lambda batches: _parsed(batches, True), _ROW)
    segments = files.mapInArrow(lambda batches: _parsed(batches, False), _ROW)
    joined = (
        segments.repartition("_origin")
        .sortWithinPartitions("_origin", "_segment")
        .mapInArrow(_joined, _ROW)
    )
    return whole.union(joined).mapInArrow(
        _decoded,
        "page_id long, url string, record_type string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary, complete boolean",
    )
