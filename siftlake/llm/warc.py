"""Operator 8: WARC archives with segmented records, written and read back.

Writing: a page becomes a response record whose HTTP body has chunked transfer framing; of pages with equal payloads
only one is a response, the others are revisit records that refer to it. A block over SEGMENT bytes is cut: the first segment is the response,
the others are continuation records with the origin's id and their number; the last one says the total length. Spark's text
writer puts the records into gzip files in any store it can reach, with the end of record as its line separator, so a file is a valid archive.

Reading: each file is parsed by the records' own lengths. Segments are grouped by origin identifier, ordered by number, checked
for gaps and against the total length, joined, and freed of the chunked framing; a record that fails a check is reported as not intact.

Defined cases: a null payload is empty; a null page id stays null; repeated rows (same id and payload) carry the same record id and come
back as often as they went in, all as responses if theirs is the largest id. Line ends in urls are dropped. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shared_path

#: Bytes of a record's block; longer ones are segmented. Bytes of a chunk of a body. Records in a file, at most.
SEGMENT, CHUNK, RECORDS_PER_FILE = 16_384, 4096, 2000
#: Bytes of an archive that are inflated at a time.
INFLATED = 1 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes | None:
    """The body in chunked framing (extensions and trailers are skipped); None if the framing is damaged."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        try:
            n = int(framed[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0:
            return None
        if n == 0:
            return b"".join(out)
        at = end + 2
        if framed[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(framed[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its end, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    rid = record_id(page_id, digest)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url) if url else None), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    http = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, profile, ("WARC-Refers-To", record_id(refers_to, digest)), http], head)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, http], block)
        return
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, ("WARC-Segment-Number", 1), http], cuts[0])
    for n, part in enumerate(cuts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{rid}:{n}')}>"
        total = len(block) if n == len(cuts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", segment: int = SEGMENT, least: int = LEAST_REVISIT) -> str:
    """Writes gzip WARC files under path. Payloads move once, by their digest; groups of equal payloads are joined as a
    table of their own, so the engine may split a large group."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url") if url_col else F.lit(None).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    groups = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    groups = materialize(groups, "warc-groups").withColumnsRenamed({"sha": "g_sha", "n": "g_n"})
    roles = rows.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("n") == F.col("g_n")), "left")
    revisit = F.col("pages").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for i, url, body, sha, first, again in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(page_records(i, url, body, base32_digest(sha), first, again, segment))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = roles.select("id", "url", "payload", "sha", "first", revisit.alias("again")).mapInArrow(build, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def _members(archive: bytes) -> Iterator[bytes]:
    """The plain bytes of an archive, a bounded part at a time."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    while archive[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and archive:
            yield z.decompress(archive, INFLATED)
            archive = z.unconsumed_tail
        archive = z.unused_data


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with names in lower case, block) of each record of a plain or gzip archive, of any number of members. Beside the
    archive as it is, one record and one inflated part are held."""
    held, at, parts = bytearray(), 0, _members(archive)

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del held[:at]
        at = 0
        held.extend(part)
        return True

    while True:
        while (start := held.find(b"WARC/1.", at)) < 0:
            at = max(at, len(held) - 6)
            if not more():
                return
        at = start
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        try:
            n = int(fields.get("content-length", ""))
        except ValueError:
            at = end  # a damaged head: the next record is looked for
            continue
        at = end + 4
        while len(held) - at < n and more():
            pass
        yield fields, bytes(held[at : at + n])
        at = min(at + n, len(held))


def _payload(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _measured(payload: bytes | None) -> tuple[int | None, str | None]:
    return (None, None) if payload is None else (len(payload), base32_digest(hashlib.sha1(payload).hexdigest()))


_PARSED = "origin string, number int, type string, page_id bigint, refers_to string, digest string, total bigint, payload_bytes bigint, payload_digest string, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for b in batches:
        for content in b.column(0):
            out: list[list] = [[] for _ in kinds]
            for f, block in parse(content.as_py()):
                kind = f.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                number = int(f.get("warc-segment-number", 0)) or None
                size = digest = None
                if number is None and kind == "response":
                    size, digest = _measured(_payload(block))
                page, total = f.get("x-page-id"), f.get("warc-segment-total-length")
                row = (
                    f.get("warc-segment-origin-id") or f.get("warc-record-id"), number, kind, int(page) if page not in (None, "None") else None, f.get("warc-refers-to"),
                    (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, int(total) if total else None, size, digest, block if number else None,
                )
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[str(i) for i in range(len(kinds))])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = dict(zip(b.schema.names, b.columns))
        sizes, digests = columns["payload_bytes"].to_pylist(), columns["payload_digest"].to_pylist()
        for i, blocks in enumerate(columns["blocks"]):
            if blocks.is_valid:
                sizes[i], digests[i] = _measured(_payload(b"".join(blocks.as_py())))
        keep = [columns[c] for c in ("origin", "type", "page_id", "refers_to", "digest", "copies")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["origin", "type", "page_id", "refers_to", "digest", "copies", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact): one row per response or revisit record.
    A revisit's size and its response's page come from the record it refers to. Only segments of long records move with their bytes."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(_parsed, _PARSED)
    columns = [c.split()[0] for c in _PARSED.split(", ")]
    parts = parts.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))  # equal segments of repeated rows fold first
    item = F.struct("number", "copies", *[c for c in columns if c not in ("origin", "number")])
    whole = parts.groupBy("origin").agg(F.array_sort(F.collect_list(item)).alias("s"))
    first = F.col("s")[0]
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x["block"]), F.lit(0)))
    complete = F.transform("s", lambda x: x["number"]).eqNullSafe(F.sequence(F.lit(1), F.size("s"))) & F.element_at("s", -1)["total"].eqNullSafe(length)
    blocks = F.when(first["number"].isNotNull() & complete & (first["type"] == "response"), F.transform("s", lambda x: x["block"]))
    whole = whole.select("origin", *[first[c].alias(c) for c in ("type", "page_id", "refers_to", "digest", "copies", "payload_bytes", "payload_digest")], blocks.alias("blocks"))
    schema = "origin string, type string, page_id bigint, refers_to string, digest string, copies bigint, payload_bytes bigint, payload_digest string"
    records = materialize(whole.mapInArrow(_assembled, schema), "warc-records")
    responses = records.where("type <> 'revisit'")
    done = responses.select("page_id", "payload_bytes", "payload_digest", "type", F.lit(None).cast("bigint").alias("refers_to"), F.col("payload_digest").eqNullSafe(F.col("digest")).alias("intact"), "copies")
    targets = responses.select(F.col("origin").alias("r_origin"), F.col("page_id").alias("r_page"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest"))
    again = records.where("type = 'revisit'").join(targets, F.col("refers_to") == F.col("r_origin"), "left")
    again = again.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "type", F.col("r_page").alias("refers_to"), F.col("r_digest").eqNullSafe(F.col("digest")).alias("intact"), "copies")
    rows = done.unionByName(again).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact")


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    return read_archives(spark, write_archives(pages, shared_path(spark, "warc"), **options))
