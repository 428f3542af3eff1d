"""WARC archives: writing with segmentation and chunked transfer framing, reading with reassembly.

Writing: each page becomes a ``response`` (HTTP head and chunked body) or, if its payload of at least
MIN_REVISIT bytes equals that of a page with a smaller id, a ``revisit`` that refers to the smallest. A block
over SEGMENT bytes is cut: the first record carries segment number 1, ``continuation`` records carry the
origin's id and further numbers, the last the total length. Records go through Spark's text writer with the
record end as line separator, so any file system that Spark knows can hold the archives.

Reading: whole files are split by Content-Length; complete records are decoded where they are read, only
pieces of segmented ones are shuffled: grouped by origin id, ordered by number, checked against the total
length (and for gaps and doubles), joined, and freed of the chunk framing.

A revisit's size, digest and check come from the response that it refers to, as read.

Defined cases: a null html is an empty payload; a null url is written as an empty header; rows that repeat an
id get records of their own and are no revisits of each other; a null id comes back null, and revisits an equal payload
that has an id; empty tables give empty archives; columns other than page_id, url and html are ignored, whatever their
names. Records that fail a check come back with ``verified`` false, never dropped: wrong digests, lengths or framing,
missing, doubled or unnumbered segments, continuations without origin, revisits without their response, records whose
Content-Length is absent, no number or does not lead to the next record (reading goes on at the next record's
first line), and headers cut by the end of the file.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

MIN_REVISIT, SEGMENT, CHUNK = 100, 16_384, 8192
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = "\r\n\r\n"
HEX, NEXT = re.compile(rb"[0-9A-Fa-f]{1,15}"), re.compile(rb"\r\n\r\n(?=WARC/\d)")
#: Records to a file.
FILE_RECORDS = 2000


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) for c in (payload[i : i + size],)]
    return b"".join([*out, b"0\r\n\r\n"])


def unframe(body: bytes) -> tuple[bytes, bool]:
    """Payload of chunked framing, and whether the framing was whole."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not HEX.fullmatch(size):
            return b"".join(out), False
        n = int(size, 16)
        if n == 0:
            return b"".join(out), True
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n" or len(out[-1]) < n:
            return b"".join(out), False
        at += 2


def record(kind: str, ident: str, block: bytes, **fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(ident: str, url: str, payload: bytes, digest: str, refers: str | None, segment: int = SEGMENT):
    """The records of one page."""
    shared = {"WARC_Target_URI": re.sub(r"[\r\n]", " ", url), "WARC_Payload_Digest": f"sha256:{digest}"}
    if refers is not None:
        yield record("revisit", ident, HEAD, **shared, WARC_Profile=PROFILE, WARC_Refers_To=f"<{refers}>", WARC_Payload_Length=len(payload), Content_Type="application/http; msgtype=response")
        return
    block = HEAD + frame(payload)
    if len(block) <= segment:
        yield record("response", ident, block, **shared, Content_Type="application/http; msgtype=response")
        return
    n = -(-len(block) // segment)
    for k in range(n):
        part = block[k * segment : (k + 1) * segment]
        if k == 0:
            yield record("response", ident, part, **shared, WARC_Segment_Number=1, Content_Type="application/http; msgtype=response")
        else:
            yield record("continuation", f"{ident}:segment:{k + 1}", part, WARC_Segment_Origin_ID=f"<{ident}>", WARC_Segment_Number=k + 1, WARC_Segment_Total_Length=len(block) if k == n - 1 else None)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """``page_id, url, html`` -> gzip-compressed archives under ``path``."""
    spark = pages.sparkSession
    common.ship(spark)
    p = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    keys = p.select("page_id", "digest", (F.octet_length("payload") >= MIN_REVISIT).alias("long")).where("page_id is not null")
    first = keys.where("long").groupBy("digest").agg(F.min("page_id").alias("first"))
    first = common.materialize(first, "first")
    about = keys.join(first, "digest", "left").groupBy("page_id").agg(F.count("*").alias("copies"), F.map_from_entries(F.collect_set(F.when(F.col("long") & (F.col("page_id") > F.col("first")), F.struct("digest", "first")))).alias("firsts"))
    # the payloads move once, by id
    rows = p.join(about, "page_id").select("page_id", "url", "payload", "digest", F.expr("try_element_at(firsts, digest)").alias("first"), (F.col("copies") > 1).alias("repeated"))
    unnamed = p.where("page_id is null").join(first, "digest", "left").select("page_id", "url", "payload", "digest", "first", F.lit(True).alias("repeated"))
    rows = rows.unionByName(unnamed)

    def run(batches):
        made = 0
        for b in batches:
            out = []
            for page, url, payload, digest, first, repeated in zip(*[c.to_pylist() for c in b.columns], strict=True):
                made += 1
                name = f"urn:page:{'' if page is None else page}"
                ident = f"{name}:copy:{TaskContext.get().partitionId()}-{made}" if repeated else name
                out += page_records(ident, url, payload, digest, None if first is None else f"urn:page:{first}", segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def number(text: str | None) -> int | None:
    """A decimal number of a header; null if it is absent or none."""
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,18}", text) else None


def split_records(data: bytes):
    """(header fields, block, sound) of each record of an archive; an unsound one ends where the next seems to begin."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        stop = len(data) if end < 0 else end
        head = {k.strip().lower(): v.strip() for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:] for k, _, v in [line.partition(":")]}
        if end < 0:
            yield head, b"", False
            return
        n, after = number(head.get("content-length")), end + 4
        to = after + (n or 0)
        sound = n is not None and data[at : at + 5] == b"WARC/" and to <= len(data) and (to == len(data) or data[to : to + 4] == END.encode() and (to + 4 == len(data) or data[to + 4 : to + 9] == b"WARC/"))
        if not sound:
            found = NEXT.search(data, end)
            to = found.start() if found else len(data)
        yield head, data[after : max(after, to)], sound
        at = max(to, end) + 4


def decode_block(block: bytes) -> tuple[bytes, bool]:
    """Payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
        return unframe(body)
    return body, bool(sep)


def _row(head: dict, payload: bytes | None, whole: bool, keep: bool) -> dict:
    want = head.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = head.get("warc-type")
    if kind == "revisit":
        size, digest, ok = number(head.get("warc-payload-length")), want, whole
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        ok = whole and digest == want
    return {"record_id": head.get("warc-record-id", "").strip("<>"), "target_uri": head.get("warc-target-uri"), "record_type": kind, "refers_to_record": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "payload_bytes": size, "payload_digest": digest, "verified": ok, "payload": payload if keep else None}


_OUT = "record_id string, target_uri string, record_type string, refers_to_record string, payload_bytes long, payload_digest string, verified boolean, payload binary"
_OUT_ARROW = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary())])
_PARTS = ", origin string, number int, total long, part binary"
_PARTS_ARROW = pa.schema([*_OUT_ARROW, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("part", pa.binary())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per logical record of the archives under ``path``; ``payload`` is null unless asked for."""
    common.ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        for b in batches:
            for data in map(pa.BinaryScalar.as_py, b.column(0)):
                if data[:2] == b"\x1f\x8b":
                    data = _gunzip(data)
                rows = []
                for head, block, sound in split_records(data):
                    kind = head.get("warc-type")
                    origin = head.get("warc-segment-origin-id" if kind == "continuation" else "warc-record-id", "").strip("<>")
                    if sound and origin and (kind == "continuation" or "warc-segment-number" in head):
                        about = {} if kind == "continuation" else {"target_uri": head.get("warc-target-uri"), "record_type": kind, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:")}
                        rows.append(about | {"origin": origin, "number": number(head.get("warc-segment-number")), "total": number(head.get("warc-segment-total-length")), "part": block})
                    elif kind == "revisit":
                        rows.append(_row(head, None, sound, False))
                    elif kind in ("response", "resource"):
                        payload, whole = decode_block(block) if kind == "response" else (block, True)
                        rows.append(_row(head, payload, whole and sound, payloads))
                    elif not sound or kind == "continuation":
                        rows.append(_row(head, block, False, payloads))
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 500], schema=_PARTS_ARROW)

    def join(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                parts, total = r["parts"], r["total"]
                block = b"".join(p["part"] for p in parts)
                whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and total == len(block)
                payload, framed = decode_block(block)
                head = {"warc-record-id": r["origin"], "warc-type": r["record_type"], "warc-target-uri": r["target_uri"], "warc-payload-digest": r["payload_digest"] or ""}
                rows.append(_row(head, payload, whole and framed, payloads))
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT_ARROW)

    got = common.materialize(files.mapInArrow(parse, _OUT + _PARTS), "records")
    pieces = got.where("origin is not null").groupBy("origin").agg(F.max("record_type").alias("record_type"), F.max("target_uri").alias("target_uri"), F.max("payload_digest").alias("payload_digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "part"))).alias("parts"))  # one record's pieces
    joined = common.materialize(pieces.mapInArrow(join, _OUT), "joined")
    rows = got.where("origin is null").select(*_OUT_ARROW.names).unionByName(joined)
    # what revisits refer to: ids, sizes and digests only
    full = rows.where("record_type in ('response', 'resource')").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max(F.struct("verified", "payload_digest", "payload_bytes")).alias("_r"))
    revisits = rows.where("record_type = 'revisit'").withColumnRenamed("payload_digest", "_want").withColumnRenamed("payload_bytes", "_size").withColumnRenamed("verified", "_sound").drop("payload").join(full, "refers_to_record", "left")
    sound = F.col("_sound") & F.col("_r.verified") & (F.col("_r.payload_digest") == F.col("_want")) & (F.coalesce("_size", "_r.payload_bytes") == F.col("_r.payload_bytes"))
    revisits = revisits.select("record_id", "target_uri", "record_type", "refers_to_record", F.coalesce("_r.payload_bytes", "_size", F.lit(-1)).cast("long").alias("payload_bytes"), F.coalesce("_r.payload_digest", "_want").alias("payload_digest"), F.coalesce(sound, F.lit(False)).alias("verified"), F.lit(None).cast("binary").alias("payload"))
    return rows.where("record_type is distinct from 'revisit'").unionByName(revisits)


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            out += [d.decompress(data), d.flush()]
        except zlib.error:  # a damaged member ends the file; what was cut shows as a record that is not whole
            break
        data = d.unused_data
    return b"".join(out)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, verified``."""
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write_archives(pages, path)
    got = read_archives(spark, path, payloads=False)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d*)", 1), F.lit("")).cast("long")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_record").alias("refers_to"), "verified")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
first AS (SELECT payload_digest, min(page_id) AS f FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f IS NOT NULL AND coalesce(page_id > f, true) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS NOT NULL AND coalesce(page_id > f, true) THEN f END AS refers_to, true AS verified
FROM p LEFT JOIN first USING (payload_digest)
"""
