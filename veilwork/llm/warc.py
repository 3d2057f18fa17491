"""WARC archives: writing pages, reading records, putting segments together.

Writing is one projection: header, block and chunk framing are text, and the two
line breaks after a record are the line separator of Spark's text writer, so the
archives are ordinary files of the sink, committed with its guarantees.  A payload
seen before becomes a ``revisit`` of the page with the smallest id.  A block longer
than ``segment_chars`` is cut into ``continuation`` records.

Reading takes whole files (their size is bounded by ``records_per_file``), splits
them into records, groups continuation records by the id of their origin, orders
them by segment number, verifies the total length, and decodes the HTTP message
with its chunked framing.  A damaged record gives a row with ``intact`` false: one whose header
lacks its length, whose block is cut off or does not end where it says, or whose
payload has another digest.  Reading goes on with the next record header, and bytes between
records that are no header are passed over.  Records of other kinds (``warcinfo``, ``request``,
``metadata``) are no pages.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.text import whole
from veilwork.llm.work import written

# Archive format (fixed values).
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"

SEGMENT_CHARS = 32_768
CHUNK_CHARS = 8_192
RECORDS_PER_FILE = 2_000
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text in UTF-8: five hex digits are four of base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", " ")


def _pieces(text: Column, size: int) -> Column:
    """``text`` in pieces of ``size`` characters; the empty text has none."""
    last = F.ceil(F.length(text) / F.lit(size)).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def _chunked(text: Column) -> Column:
    framed = F.transform(
        _pieces(text, CHUNK_CHARS),
        lambda piece: F.concat(F.lower(F.hex(F.octet_length(piece))), F.lit(END), piece, F.lit(END)),
    )
    return F.concat(F.array_join(framed, ""), F.lit(f"0{END}{END}"))


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``body``, ``payload_bytes``, ``digest``, ``first`` (null: a response).

    Of pages with equal payloads of at least ``min_bytes`` bytes all but those with
    the smallest id are revisits of ``first``.  A page without an id is a revisit if
    its group has an id, and a response otherwise.  Rows that repeat the smallest id
    are all responses.
    """
    rows = pages.select("page_id", "url", whole("html").alias("body"))
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("body").cast("long"), "digest": base32_sha1(F.col("body"))}
    )
    seen = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
    seen = seen.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # Stored, so that the join carries bodies but once and can split a payload that very many pages have.
    marked = rows.join(written(seen.drop("n"), "seen"), ["digest", "payload_bytes"], "left")
    return marked.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, segment_chars: int = SEGMENT_CHARS, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write every row of ``pages`` as a WARC record below ``path`` (gzip files).

    A null payload is the empty one; a null url or id leaves its header out.  Other
    columns are not read.  An empty table writes archives without records.
    """
    columns = {"page_id": F.col(f"`{page_id}`").cast("long"), "url": F.col(f"`{url}`"), "html": F.col(f"`{html}`")}
    rows = with_record_types(pages.select(*[c.alias(n) for n, c in columns.items()]), min_bytes)
    revisit = F.col("first").isNotNull()
    status = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    block = F.when(
        revisit, F.concat(F.lit(f"{status}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END * 2))
    ).otherwise(F.concat(F.lit(f"{status}Transfer-Encoding: chunked{END * 2}"), _chunked(F.col("body"))))
    rows = rows.select(
        "page_id", "url", "first", "digest", block.alias("block"),
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("id"),
    )
    cut = rows.select(
        "page_id", "url", "first", "digest", "id",
        F.octet_length("block").alias("total"),
        F.ceil(F.length("block") / F.lit(segment_chars)).cast("int").alias("segments"),
        F.posexplode(_pieces(F.col("block"), segment_chars)).alias("place", "part"),
    )
    head, many = F.col("place") == 0, F.col("segments") > 1
    kind = F.when(~head, "continuation").when(F.col("first").isNotNull(), "revisit").otherwise("response")
    at_end = many & (F.col("place") == F.col("segments") - 1)
    record = F.concat(
        F.lit(VERSION + END),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.when(head, F.col("id")).otherwise(
            F.concat(F.rtrim(F.col("id"), F.lit(">")), F.lit("."), F.col("place").cast("string"), F.lit(">")))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", _one_line(F.col("url"))),
        _field("WARC-Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.when(head, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Profile", F.when(head & F.col("first").isNotNull(), F.lit(REVISIT_PROFILE))),
        _field("WARC-Refers-To-Page-ID", F.when(head, F.col("first"))),
        _field("WARC-Segment-Number", F.when(many, F.col("place") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~head, F.col("id"))),
        _field("WARC-Segment-Total-Length", F.when(at_end, F.col("total"))),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _field("Content-Length", F.octet_length("part")),
        F.lit(END),
        F.col("part"),
    )
    writer = cut.select(record.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


_RECORD = pa.schema(
    [
        ("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("digest", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()),
        ("total", pa.int64()), ("whole", pa.bool_()), ("block", pa.binary()),
    ]
)
_RECORD_DDL = (
    "record_id string, kind string, page_id bigint, url string, digest string, refers_to bigint,"
    " origin string, segment int, total bigint, whole boolean, block binary"
)
_BATCH_BYTES = 8_000_000
_READ_BYTES = 1 << 14


def _unpacked(data: bytes) -> bytes:
    """The content of a file that may be gzip, in one member or in many; of a damaged member what can be read."""
    view, at, parts = memoryview(data), 0, []
    while data[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        try:
            while not stream.eof and at < len(data):
                piece = view[at : at + _READ_BYTES]
                parts.append(stream.decompress(piece))
                at += len(piece) - len(stream.unused_data)
        except zlib.error:
            return b"".join(parts)
    return b"".join([*parts, view[at:]])


_HEADER = re.compile(rb"(?:^|(?<=\n))WARC/[0-9]")


def _records(data: bytes) -> Iterator[tuple]:
    """The records of an archive; ``whole`` is false where the length and the place of the next record disagree."""
    found = _HEADER.search(data)
    while found:
        at = found.start()
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        fields = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip().decode(errors="replace")

        def number(name: bytes) -> int | None:
            digits = fields.get(name, "")  # noqa: B023
            return int(digits) if re.fullmatch("-?[0-9]{1,18}", digits) else None

        begin, length = stop + 4, number(b"content-length")
        end = begin + length if length is not None and length >= 0 else None
        whole_block = end is not None and data[end : end + 4] == b"\r\n\r\n"
        found = _HEADER.search(data, end + 4 if whole_block else begin)
        if not whole_block:
            end = found.start() if found else len(data)
        digest = fields.get(b"warc-payload-digest", "")
        yield (
            fields.get(b"warc-record-id"), fields.get(b"warc-type"), number(b"warc-page-id"), fields.get(b"warc-target-uri"),
            digest.removeprefix("sha1:") if digest.startswith("sha1:") else None, number(b"warc-refers-to-page-id"),
            fields.get(b"warc-segment-origin-id"), number(b"warc-segment-number"),
            number(b"warc-segment-total-length"), whole_block, data[begin:end],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows):
        columns = [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), _RECORD, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_RECORD)

    for batch in batches:
        for value in batch.column(0):
            rows, held = [], 0
            for record in _records(_unpacked(value.as_py())):
                rows.append(record)
                held += len(record[-1])
                if held > _BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


# Records that are pages or parts of one.
_PAGE_KINDS = ("response", "revisit", "continuation")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, continuation records as they are."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_split, _RECORD_DDL)


def _message(parts: list[tuple[int, bytes]], total: int | None) -> tuple[dict[bytes, bytes], bytes]:
    """Headers and decoded payload of an HTTP message in numbered segments."""
    parts = sorted(parts)
    if [n for n, _ in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing")
    block = b"".join(data for _, data in parts)
    if total is not None and len(block) != total:
        raise ValueError("the segments have another total length")
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower()] = value.strip().lower()
    if headers.get(b"transfer-encoding") == b"chunked":
        body = _without_chunks(body)
    return headers, body


def _without_chunks(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].partition(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = stop + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk has another length")
        parts.append(body[stop + 2 : at])
        at += 2


_PAGE = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_()),
    ]
)
_PAGE_DDL = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint,"
    " payload_digest string, payload binary, intact boolean"
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            payload, size, digest, intact = None, None, row["digest"], True
            try:
                if not row["whole"]:
                    raise ValueError("the record is damaged")
                headers, body = _message([(p["segment"], p["block"]) for p in row["parts"]], row["total"])
                if row["kind"] == "revisit":
                    size = int(headers[b"content-length"])
                else:
                    payload, size = body, len(body)
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    intact = row["digest"] in (None, digest)  # an archive need not give one
            except (ValueError, KeyError):
                intact = False
            rows.append((row["page_id"], row["url"], row["kind"], row["refers_to"], size, digest, payload, intact))
        if rows:
            columns = [pa.array(v, field.type) for v, field in zip(zip(*rows, strict=True), _PAGE, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_PAGE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: ids, type, digest and size of the payload, and the payload.

    The payload of a revisit is null; its size and digest are those of the full
    payload.  Only the segments of cut records are shuffled.
    """
    found = records(spark, path).filter(F.col("kind").isin(*_PAGE_KINDS))
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "block")
    head = ["kind", "page_id", "url", "digest", "refers_to"]
    # A segment that names no origin cannot be put together with others.
    lone = F.col("segment").isNull() | F.coalesce("origin", "record_id").isNull()
    single = found.filter(lone).select(*head, "total", "whole", F.array(part).alias("parts"))
    first = F.col("kind") != "continuation"
    joined = (
        found.filter(~lone)
        .groupBy(F.coalesce("origin", "record_id").alias("origin"))
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in head],
            F.max("total").alias("total"),
            F.bool_and("whole").alias("whole"),
            F.collect_list(part).alias("parts"),
        )
    )
    return single.unionByName(joined.drop("origin")).mapInArrow(_decode, _PAGE_DDL)
