"""WARC archives: written in segments with chunked payloads, read back, reassembled and decoded.

Writing: a page becomes a response record (HTTP headers and the payload in
chunked transfer coding) or a revisit record that refers to the page whose
response has the same payload. A block longer than ``segment_bytes`` is cut
into segments: the first in the record itself, the others in continuation
records that name its id as their origin and are numbered; the last tells the
total length. Files hold ``file_records`` records at most, so a file has a size bound
however long a page is, and the segments of a page may lie in several files.

The files are plain WARC/1.1, or the same through gzip. Spark's text writer makes them: the
line separator is the two line ends that close a record. Reading takes whole
files (bounded as said; archives from elsewhere up to what the binary file reader allows).

Reading: records without segments pass as they are; only segmented ones are
grouped by origin, put in order, and checked (numbers without a gap, total
length). Blocks are decoded from the chunked coding, and the payload's SHA-1 is checked
against the record. A record that fails a check has ``complete`` false and no payload.

Edge cases: null payloads count as empty; null page ids are kept (the null id
is below all others and never referred to; if all ids of a payload are null, all are
responses); rows that repeat the largest page id of their payload are all responses;
null urls and control characters in urls are written as other text; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import materialize, new_path

CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 16_384, 4_096, 2_000
LEAST_REVISIT = 1000
PARSED = ("record_id string, record_type string, page string, uri string, digest string, refers_to string, "
          "origin string, segment int, total long, block binary")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer coding."""
    out = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer coding (extensions and trailers are passed over); None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out) if body.endswith(CRLF) else None
        if body[at + n:at + n + 2] != CRLF:
            return None
        out.append(body[at:at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response, out of its transfer coding."""
    head, mark, body = block.partition(CRLF + CRLF)
    if not mark:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked\s*$", head) else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block


def _field(text: str | None) -> str:
    return "urn:none" if text is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "%%%02X" % ord(m[0]), text)


def page_records(uuid: str, page: str | None, url: str | None, payload: bytes, digest: str, lead: str | None, date: str,
                 segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """The records of a page: one, or the first and its continuations. ``lead``: the page that a revisit refers to."""
    origin = f"<urn:uuid:{uuid}>"
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    own = [("WARC-Target-URI", _field(url)), ("WARC-Payload-Digest", sha), *([("Page-ID", quote(page, safe=""))] if page is not None else [])]
    kind = [("WARC-Type", "response")] if lead is None else [
        ("WARC-Type", "revisit"), ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{quote(lead, safe='')}>")]
    first = [*kind, ("WARC-Record-ID", origin), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"), *own]
    block = HTTP_HEAD + chunked(payload, chunk_bytes) if lead is None else REVISIT_HEAD
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    out = []
    for number, i in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[i:i + segment_bytes]
        fields = [*first, ("WARC-Segment-Number", "1")]
        if i:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid}-{number}>"), ("WARC-Date", date),
                      ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(number))]
        if i + segment_bytes >= len(block):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(fields, part))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z", least_revisit: int = LEAST_REVISIT, segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES, file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Writes a record for each row of ``pages`` (and its continuations) to new files in the folder ``path``."""
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    slim = pages.select(pages[id_col].alias("page"), pages[url_col].cast("string").alias("url"), payload.alias("payload")) \
        .withColumn("digest", F.sha1("payload"))
    # a row for each repeated payload: the page that holds its response
    leads = (slim.where(F.octet_length("payload") >= least_revisit).groupBy("digest")
             .agg(F.max("page").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    own = F.when(F.col("page").eqNullSafe(F.col("lead")), F.lit(None)).otherwise(F.col("lead"))
    tagged = slim.join(leads, "digest", "left").select(
        F.expr("uuid()").alias("uuid"), F.col("page").cast("string"), "url",
        F.when(own.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", own.cast("string").alias("lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                rows = zip(*(c.to_pylist() for c in b.slice(start, 500).columns))
                out = [r for row in rows for r in page_records(*row, date, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (tagged.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", file_records).text(path))


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive file."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:  # one member or one for each record
            z = zlib.decompressobj(31)
            out.append(z.decompress(data))
            data = z.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        n = int(fields["content-length"])
        block = data[end + 4:end + 4 + n]
        if len(block) != n:
            raise ValueError(f"the record at byte {at} is cut off")
        at = end + 4 + n
        if data[at:at + 4] == CRLF + CRLF:
            at += 4
        sha = fields.get("warc-payload-digest", "")
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "page": fields.get("page-id"),
               "uri": fields.get("warc-target-uri"), "digest": base64.b32decode(sha[5:]).hex() if sha.startswith("sha1:") else None,
               "refers_to": fields.get("warc-refers-to"), "origin": fields.get("warc-segment-origin-id"),
               "segment": number and int(number), "total": total and int(total), "block": block}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in the folder ``path``, segments by themselves."""
    names = [f.split()[0] for f in PARSED.split(", ")]
    kinds = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string()))
                       for n, f in zip(names, PARSED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held, size = [], 0
                for r in parse(content.as_py()):
                    held.append(r)
                    size += len(r["block"])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARSED)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per whole record: its fields, ``payload`` and ``complete``. ``records`` is read twice: parsing
    archives again costs less than a copy of all blocks."""
    keep = ["record_id", "record_type", "page", "uri", "digest", "refers_to"]
    whole = records.where("segment IS NULL").select(*keep, F.array("block").alias("parts"), F.lit(True).alias("joined"))
    own = records.where("segment IS NOT NULL").withColumn("key", F.coalesce("origin", "record_id"))
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in keep]
    groups = own.groupBy("key").agg(*first, F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"))
    numbered = F.expr("s.segment = sequence(1, size(s)) AND record_id IS NOT NULL")
    length = F.expr("aggregate(s, 0L, (n, x) -> n + octet_length(x.block))")
    cut = groups.select(*keep, F.col("s.block").alias("parts"), F.coalesce(numbered & (length == F.col("total")), F.lit(False)).alias("joined"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                payloads, good = [], []
                for kind, digest, blocks, joined in zip(*(part.column(c).to_pylist() for c in ("record_type", "digest", "parts", "joined"))):
                    p = payload_of(b"".join(blocks)) if joined and kind == "response" else None
                    if p is not None and digest is not None and hashlib.sha1(p).hexdigest() != digest:
                        p = None
                    payloads.append(p)
                    good.append(joined and (kind != "response" or p is not None))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(payloads, pa.binary()), pa.array(good, pa.bool_())],
                                                 [*keep, "payload", "complete"])

    fields = ", ".join(f"{c} string" for c in keep)
    return whole.unionByName(cut).mapInArrow(run, f"{fields}, payload binary, complete boolean")


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per response and revisit: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, ``payload`` (null for revisits) and ``complete``; a revisit has the length of the response it refers to."""
    whole = reassemble(read_records(spark, path)).where("record_type IN ('response', 'revisit')")
    rows = whole.select(
        F.url_decode("page").cast(id_type).alias("page_id"), F.octet_length("payload").cast("long").alias("own_bytes"),
        F.coalesce(F.sha1("payload"), "digest").alias("payload_digest"), "record_type",
        F.url_decode(F.nullif(F.regexp_extract("refers_to", "^<urn:page:(.*)>$", 1), F.lit(""))).cast(id_type).alias("refers_to"), "payload", "complete")
    return rows


def with_lengths(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_pages`, without the payloads, ``payload_bytes`` filled in for revisits."""
    slim = rows.drop("payload")
    lengths = slim.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("bytes"))
    told = slim.where("record_type = 'revisit'").join(lengths, "payload_digest", "left")
    both = slim.where("record_type = 'response'").withColumn("bytes", F.col("own_bytes")).unionByName(told)
    return both.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "complete")


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` to archives (a new folder under the checkpoint folder by default), reads them back: a row for each page."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **options)
    id_type = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    return with_lengths(materialize(read_pages(spark, path, id_type).drop("payload"), "warc-pages"))
