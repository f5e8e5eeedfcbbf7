"""WARC archives: writing with payload dedup and segmentation, and reading with segment reassembly.

Archives are written by Spark's text writer (a record a row, ``CRLF CRLF`` between records, which is the
record end of the format) and read as binary files, so any store that Spark reaches will do. A file holds
at most ``FILE_RECORDS`` records of at most ``SEGMENT_CHARS`` characters of block, which bounds its size. Longer
blocks are cut into ``continuation`` records; reading groups them by origin id, orders them by segment
number, checks the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

SEGMENT_CHARS, CHUNK_CHARS, FILE_RECORDS = 16_384, 8_192, 2_048
#: Groups of equal payloads are broadcast up to this many; more are joined by shuffle.
BROADCAST_GROUPS, SALTS = 200_000, 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """``keep`` columns with _bytes and _digest of the payload."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", _bytes long, _digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(x.as_py() or "").encode() for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(map(len, payloads), pa.int64()), pa.array(map(digest, payloads), pa.string())], [*keep, "_bytes", "_digest"])

    return pages.mapInArrow(run, schema)


def _record(kind: str, block: str, *fields: tuple[str, object]) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def _records(row_id: str, page_id: object, url: str | None, html: str, size: int, sha: str, first: object) -> Iterator[str]:
    target = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    common = (("WARC-Target-URI", target), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", size), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"))
    if first is not None:
        yield _record("revisit", f"{HTTP}\r\n", ("WARC-Record-ID", f"<urn:page:{row_id}>"), ("WARC-Profile", REVISIT), ("X-Refers-To-Page", first), *common)
        return
    chunks = (html[i : i + CHUNK_CHARS] for i in range(0, len(html), CHUNK_CHARS))
    block = f"{HTTP}Transfer-Encoding: chunked\r\n\r\n" + "".join(f"{len(c.encode()):x}\r\n{c}\r\n" for c in chunks) + "0\r\n\r\n"
    if len(block) <= SEGMENT_CHARS:
        yield _record("response", block, ("WARC-Record-ID", f"<urn:page:{row_id}>"), *common)
        return
    total = len(block.encode())
    for number, at in enumerate(range(0, len(block), SEGMENT_CHARS), 1):
        part, last = block[at : at + SEGMENT_CHARS], at + SEGMENT_CHARS >= len(block)
        if number == 1:
            yield _record("response", part, ("WARC-Record-ID", f"<urn:page:{row_id}>"), ("WARC-Segment-Number", 1), *common)
        else:
            yield _record("continuation", part, ("WARC-Record-ID", f"<urn:page:{row_id}:{number}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{row_id}>"), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total if last else None), ("WARC-Date", "1970-01-01T00:00:00Z"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of ``pages`` to archives in ``path``.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response, the others
    revisit it. A null payload is empty; rows of a null id, or that repeat the smallest id, are responses.
    """
    narrow = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    id_type = narrow.schema["_id"].dataType.simpleString()
    groups = _digests(narrow, ["_id"], "_html").filter(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n").cache()
    rows = _digests(narrow, ["_id", "_url", "_html"], "_html")
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(groups), "_digest", "left")
    else:  # a payload may hold a third of all rows: deal each group over SALTS keys
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)).cast("int")).join(salted, ["_digest", "_salt"], "left")
    joined = joined.select(F.concat_ws("-", "_id", F.monotonically_increasing_id()).alias("_row"), "_id", "_url", "_html", "_bytes", "_digest", F.when((F.col("_first") < F.col("_id")) & (F.col("_bytes") >= min_bytes), F.col("_first")).cast(id_type).alias("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            size = 0
            for row in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
                row_id, page_id, url, html, n, sha, first = (x.as_py() for x in row)
                for record in _records(row_id, page_id, url, html or "", n, sha, first):
                    out.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    groups.unpersist()


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin = end + 4
        at = begin + int(fields["Content-Length"])
        if at > len(content) or content[at : at + 4] not in (b"\r\n\r\n", b""):
            raise ValueError(f"record at byte {begin} has a wrong length")
        yield fields, content[begin:at]
        at += 4


def decode_block(block: bytes) -> bytes:
    """Payload of an HTTP response: the body, with chunked framing undone."""
    end = block.index(b"\r\n\r\n")
    head, body = block[:end].lower(), block[end + 4 :]
    if b"transfer-encoding: chunked" not in head:
        return body
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += 2


def _result(fields: dict[str, str], block: bytes) -> tuple:
    kind, sha, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    payload = None
    if kind == "response":
        payload = decode_block(block)
        if len(payload) != size or digest(payload) != sha:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return fields.get("X-Page-ID"), size, sha, kind, fields.get("X-Refers-To-Page"), payload


_RESULT = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
_SEGMENT = "origin string, number long, total long, fields map<string,string>, block binary"


def read_archives(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record but continuations.

    Lengths, digests, segment numbers and total lengths are checked; a mismatch raises an error. Revisits
    have a null payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    result = [x.split(" ")[0] for x in _RESULT.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = [_result(f, b) for f, b in parse_records(content.as_py()) if "WARC-Segment-Number" not in f]
                if not with_payload:
                    rows = [(*r[:5], None) for r in rows]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], result)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = [(f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(f["WARC-Segment-Number"]), int(f["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in f else None, list(f.items()) if f["WARC-Segment-Number"] == "1" else None, b) for f, b in parse_records(content.as_py()) if "WARC-Segment-Number" in f]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["origin", "number", "total", "fields", "block"])

    def reassemble(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        block = b"".join(rows["block"])
        total = rows["total"].dropna()
        if rows["number"].tolist() != list(range(1, len(rows) + 1)) or total.tolist() != [len(block)]:
            raise ValueError(f"segments of {rows['origin'].iloc[0]} are incomplete")
        done = _result(dict(rows["fields"].iloc[0]), block)
        return pd.DataFrame([done if with_payload else (*done[:5], None)], columns=result)

    # one group is the segments of one page, so it is as large as that page
    joined = files.mapInArrow(segments, _SEGMENT).groupBy("origin").applyInPandas(reassemble, _RESULT)
    both = files.mapInArrow(whole, _RESULT).unionByName(joined)
    return both.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back (without payloads)."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString(), with_payload=False).drop("payload")
