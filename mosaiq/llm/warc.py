"""WARC archives with segmented and revisit records: written through Spark's text sink, read back and reassembled.

Writing: the payload goes into an HTTP response in chunked transfer framing. A record whose block is longer than
`segment_bytes` is cut: the first segment keeps the record's type, later ones are `continuation` records that name the
first one as their origin, and the last gives the total length. Of pages with equal payloads the one with the largest
page_id is a response; the others are revisit records that refer to it and carry no payload. Each file has at most
`records_per_file` records of at most `segment_bytes` (plus headers): 128 MB at most, so a reader's memory is bounded.

Reading: each archive file, plain or of any number of gzip members, is parsed by its Content-Length fields; records of several segments are grouped by origin,
ordered by segment number, joined and held against the total length; then the chunked framing is decoded.

Cases: null html is the empty payload; a null page_id is written without a page header and comes back null; a null url
is written as about:blank; repeated rows give a record each, with an id of its own (rows of one page_id and payload
are responses, revisits refer to one of them); payloads of any
length and with any bytes, WARC headers included, come back whole; a missing segment or a wrong length raises an
error; an empty table gives no records; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 16_384) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing (extensions and trailers are passed over)."""
    out, at = [], 0
    while True:
        line = body.index(END, at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != END:
            raise ValueError("chunk framing is broken")
        out.append(body[at : at + n])
        at += n + 2


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the page_id of the response for revisits, else null; serial: what tells
    the records of one page_id and payload apart, 0 for the one response that others can refer to. Groups are
    pre-aggregated by digest and length, and only groups of several pages are joined."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", html.alias("payload")).withColumns({"_sha": F.sha2("payload", 256), "_n": F.length("payload")})
    ids = base.groupBy("_sha", "_n", "page_id").agg(F.count("*").alias("_c"))
    groups = ids.groupBy("_sha", "_n").agg(F.max(F.struct("page_id", "_c")).alias("_l"), F.sum("_c").alias("_c")).where(f"_c > 1 and _n >= {int(least)}")
    groups = groups.select("_sha", "_n", F.col("_l.page_id").alias("_top"), (F.col("_l._c") > 1).alias("_again"))
    groups = materialize(spark, groups, "payloads")  # so that the join's hot payloads can be split
    rows = base.join(groups, ["_sha", "_n"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top")))
    repeated = F.coalesce(F.col("_again"), F.lit(False)) & F.col("page_id").isNotNull() & F.col("refers_to").isNull()
    serial = F.when(F.col("page_id").isNull() | F.col("refers_to").isNotNull() | (F.col("_n") < least), F.expr("uuid()")).otherwise("0")
    names = ["page_id", "url", "payload", "refers_to", "serial"]
    if groups.where("_again and _top is not null").isEmpty():
        return rows.withColumn("serial", serial).select(names)
    # repeated responses: their serials are written before the least of each group becomes 0
    again = materialize(spark, rows.where(repeated).withColumn("serial", F.expr("uuid()")).select("_sha", "_n", *names), "again")
    lead = again.groupBy("_sha", "_n").agg(F.min("serial").alias("_lead"))
    again = again.join(lead, ["_sha", "_n"]).withColumn("serial", F.when(F.col("serial") == F.col("_lead"), "0").otherwise(F.col("serial")))
    return rows.where(~repeated).withColumn("serial", serial).select(names).unionByName(again.select(names))


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last line end, which the sink adds."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + END


def records(page_id: int | None, serial: str, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The record, or the segments, of one page."""
    digest = payload_digest(payload)
    name = f"urn:page:{page_id}:{digest}:{serial}" if page_id is not None else f"urn:row:{serial}"
    url = re.sub(r"[\x00-\x20]+", "%20", url or "about:blank")
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}:0>"), ("Content-Type", "application/http;msgtype=response")]
        yield _record("revisit", name, fields + more, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields.append(("Content-Type", "application/http;msgtype=response"))
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts):
        part = block[at : at + segment_bytes]
        if len(cuts) == 1:
            yield _record("response", name, fields, part)
        elif k == 0:
            yield _record("response", name, [*fields, ("WARC-Segment-Number", "1")], part)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(cuts) - 1)
            yield _record("continuation", f"{name}:{k + 1}", [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k + 1)), *total], part)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 1 << 16, records_per_file: int = 2048, least: int = 0) -> None:
    """Write the pages as gzip-compressed archive files under `path`, by Spark's own committer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = zip(*(batch.column(c)[i : i + 64].to_pylist() for c in range(batch.num_columns)), strict=True)
                made = [r for page, url, payload, refers, serial in rows for r in records(page, str(serial), url, payload, refers, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    lines = with_types(pages, least).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file, one after the other; other data as it is. A broken end is an error."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data.strip(b"\0"):
        member = zlib.decompressobj(47)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("the archive ends within a gzip member")
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == END:
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        head = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        if len(data) < head + 4 + n:
            raise ValueError("the archive ends within a record")
        yield fields, data[head + 4 : head + 4 + n]
        at = head + 4 + n


def opened(kind: str, page: int | None, block: bytes, digest: str | None) -> tuple[bytes, int, str | None]:
    """Payload, its full length and its digest, of a whole record's block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(END)[1:])}
    if kind == "revisit":
        return b"", int(fields.get(b"content-length", b"0")), digest
    body = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    found = payload_digest(body)
    if digest and digest != found:
        raise ValueError(f"the payload of page {page} doesn't have its digest")
    return body, len(body), found


_ROW = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_PART = pa.schema([*_ROW, ("origin", pa.string()), ("seg", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
_SQL = {"int64": "long", "binary": "binary", "string": "string", "int32": "int"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[str(f.type)]}" for f in schema)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload (empty unless asked for), payload_bytes, payload_digest, record_type, refers_to of every page in
    the archives. Records of one segment are opened where their file is parsed; only segments of longer ones move."""

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for f, block in parse(unzipped(batch.column(0)[i].as_py())):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    page, digest = int(f["page-id"]) if "page-id" in f else None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    refers, seg = f.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:").partition(":")[0], int(f.get("warc-segment-number", 0))
                    total = f.get("warc-segment-total-length")
                    payload, n = b"", None
                    if seg == 0:
                        payload, n, digest = opened(kind, page, block, digest)
                    rows.append((page, payload if with_payload else b"", n, digest, kind, int(refers) if refers else None, f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>"), seg, int(total) if total else None, block if seg else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PART.types, strict=True)], schema=_PART)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    parts = materialize(spark, files.mapInArrow(segments, _sql(_PART)), "records")
    first = lambda c: F.max(F.when(F.col("seg") == 1, F.col(c))).alias(c)
    several = parts.where("seg > 0").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("seg", "block"))).alias("parts"), *map(first, ("page_id", "payload_digest", "record_type", "refers_to")), F.max("total").alias("total"))  # one record's segments: one cell of the source
    whole = "total is not null and record_type is not null and size(parts) = element_at(parts, -1).seg and aggregate(parts, 0L, (a, p) -> a + length(p.block)) = total"
    several = several.select("page_id", "record_type", "payload_digest", "refers_to", F.expr("transform(parts, p -> p.block)").alias("blocks"), F.expr(whole).alias("whole"))

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["whole"]:
                    raise ValueError(f"segments of page {row['page_id']} are missing or don't have the total length")
                payload, n, digest = opened(row["record_type"], row["page_id"], b"".join(row["blocks"]), row["payload_digest"])
                yield pa.RecordBatch.from_pylist([{"page_id": row["page_id"], "payload": payload if with_payload else b"", "payload_bytes": n, "payload_digest": digest, "record_type": row["record_type"], "refers_to": row["refers_to"]}], schema=_ROW)

    return parts.where("seg = 0").select(_ROW.names).unionByName(several.mapInArrow(joined, _sql(_ROW)))
