"""WARC archives: writing with segmented records and revisits, reading back with reassembly.

Spark's text writer writes the files: a row is a record, and the line separator is the
two line ends that close a WARC record.  A file holds a bounded number of records of
bounded size, longer blocks being cut into continuation records, so that a reader can
take a file as one row.  Continuations meet again by their origin's identifier.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.shared import settle, stage

END = b"\r\n\r\n"
CHUNK = 8192
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked"
#: Bytes given to the decompressor at a time.
FEED = 1 << 16
OUT_BYTES = 8 << 20

# ------------------------------------------------------------------ writing


def record_id(page, digest: str) -> str:
    """Rows that share a page and a payload share an identifier."""
    return f"<urn:page:{'null' if page is None else page}:{digest[:32]}>"


def chunked(body: bytes) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(body), CHUNK):
        piece = body[at : at + CHUNK]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(uri: str | None) -> str | None:
    """A header value is one line."""
    return uri and "".join(c if c >= " " else f"%{ord(c):02X}" for c in uri)


def page_records(page, uri, payload: bytes, digest: str, first, date: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response and its continuations, or a revisit of page ``first``."""
    name = record_id(page, digest)
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _clean(uri)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if first is not None:
        fields += [
            ("WARC-Refers-To", record_id(first, digest)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        yield _record(fields, HTTP_HEAD + END)
        return
    block = HTTP_HEAD + END + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    cuts = range(0, len(block), segment_bytes)
    yield _record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    for number, at in enumerate(cuts[1:], 2):
        total = str(len(block)) if number == len(cuts) else None
        yield _record(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"), ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)),
                ("WARC-Segment-Total-Length", total),
            ],
            block[at : at + segment_bytes],
        )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 100,
    segment_bytes: int = 64 << 10,
    records_per_file: int = 512,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write every row as a WARC record under ``path``, gzip-compressed.

    The payload (text in UTF-8, null as empty) is the body of an HTTP response in
    chunked framing.  Of equal payloads of at least ``min_revisit_bytes`` the smallest
    id is a response and the others revisit it.  Blocks over ``segment_bytes`` are
    segmented.  A null id is never the smallest of a group that has another id; rows
    that share the smallest id are all responses.  An empty table writes no record.
    """
    spark = settle(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{uri_col}`").cast("string").alias("uri"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
    )
    firsts = stage(
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    )
    # Only payloads that occur twice are in the table; a small one is broadcast by its size.
    typed = rows.join(firsts, "digest", "left").select(
        "page", "uri", "payload", "digest",
        F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("first"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in page_records(*row, date, segment_bytes):
                    out.append(record)
                    size += len(record)
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (
        typed.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
        .write.option("lineSep", END.decode()).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


# ------------------------------------------------------------------ reading


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a file's bytes."""
    at = 0
    while at < len(data):
        head = data.find(END, at)
        lines = data[at:head].decode().split("\r\n")
        if head < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = head + len(END)
        end = start + int(fields["content-length"])
        if data[end : end + len(END)] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start:end]
        at = end + len(END)


def dechunk(body: bytes) -> bytes | None:
    """The content of a chunked body; None if its framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if len(parts[-1]) < size or body[at + size : at + size + 2] != b"\r\n":
            return None
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body


RAW = pa.schema([
    ("origin", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
    ("refers_to", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
])
RAW_DDL = "origin string, type string, uri string, digest string, refers_to string, segment long, total long, block binary"


def members(packed: bytes) -> Iterator[bytes]:
    """Each member of a gzip or zlib file; what is cut off or follows the last one is an error."""
    at = 0
    while at < len(packed):
        inflate, out = zlib.decompressobj(wbits=47), []  # gzip or zlib by its head
        while not inflate.eof:
            part = packed[at : at + FEED]
            if not part:
                raise ValueError("an archive that ends inside a member")
            out.append(inflate.decompress(part))
            at += len(part)
        at -= len(inflate.unused_data)
        yield b"".join(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    for batch in batches:
        for packed in batch.column(0):
            # Whole files or single records may be members.
            for f, block in itertools.chain.from_iterable(map(parse_records, members(packed.as_py()))):
                out.append((
                    f.get("warc-segment-origin-id", f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri"),
                    f.get("warc-payload-digest"), f.get("warc-refers-to"), number(f.get("warc-segment-number")),
                    number(f.get("warc-segment-total-length")), block,
                ))
                size += len(block) + 300
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), RAW)], schema=RAW)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), RAW)], schema=RAW)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [
            None if kind == "revisit" or block is None else http_payload(block)
            for kind, block in zip(batch.column("type").to_pylist(), batch.column("block").to_pylist())
        ]
        keep = ["record_id", "type", "uri", "digest", "refers_to"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(payloads, pa.binary())], [*keep, "payload"]
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, segments put together again.

    Columns ``record_id, type, uri, digest, refers_to, payload``.  The payload is null
    for revisits, and where segments are missing, their total length is not the stated
    one, or the framing is broken.  A record that was written twice comes back twice.
    """
    settle(spark)
    raw = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
        .select("content").mapInArrow(_parse, RAW_DDL)
    )
    whole = raw.where("segment IS NULL").select(
        F.col("origin").alias("record_id"), "type", "uri", "digest", "refers_to", "block"
    )
    # A group is one record, cut into bounded pieces: nothing else shares its identifier.
    segments = raw.where("segment IS NOT NULL").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "total", "block"))).alias("parts"),
        F.count(F.when(F.col("segment") == 1, 1)).cast("int").alias("copies"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("type", "uri", "digest", "refers_to")],
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    complete = (
        (F.element_at("parts", -1)["segment"] == F.size("parts"))
        & (F.element_at("parts", -1)["total"] == size)
    )
    joined = segments.select(
        F.col("origin").alias("record_id"),
        "type", "uri", "digest", "refers_to",
        # Concatenation of bytes by way of hexadecimal digits keeps them as they are.
        F.when(complete, F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))).alias("block"),
        F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))).alias("copy"),
    ).drop("copy")
    return whole.unionByName(joined).mapInArrow(
        _decode, "record_id string, type string, uri string, digest string, refers_to string, payload binary"
    )


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` under ``path``, read them back, and describe what was read.

    Per page: the id, ``payload_bytes`` and ``payload_digest`` of the full payload (for
    a revisit that of the response it refers to), ``record_type``, ``refers_to`` (the
    response's id).
    """
    write_warc(pages, path, id_col=id_col, **options)
    page_of = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+|null):", 1).try_cast("long")
    read = stage(
        read_warc(pages.sparkSession, path).select(
            "record_id", "type", "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        )
    )
    named = lambda df: df.select(
        page_of("record_id").alias(id_col), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"),
    )
    targets = (
        read.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to"))
        .agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    )
    revisits = read.where("type = 'revisit'").select("record_id", "type", "refers_to").join(targets, "refers_to", "left")
    return named(read.where("type = 'response'")).unionByName(named(revisits))
