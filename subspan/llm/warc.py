"""WARC archives: deduplicated writing, and reading with segments and chunked framing put together."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subspan.llm.common import scratch, table, text_or_empty

DATE = "1970-01-01T00:00:00Z"  # archives of equal pages are equal


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in HTTP/1.1 chunks of at most size bytes."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are skipped. Raises ValueError on a broken frame."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : at])
        at += 2


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records_of(page_id, url, payload: bytes, digest: str, copy: int, refers_to, revisit: bool, segment: int, chunk: int) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations if its block exceeds segment bytes."""

    def name(page, n, part=""):
        return f"<urn:x-page:{'' if page is None else page}:{digest}:{n}{part}>"

    uri = "".join((url or "about:blank").split())
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id, copy), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        fields |= {"WARC-Refers-To": name(refers_to, 0), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [record(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        return [record(fields, block)]
    out, last = [], -(-len(block) // segment)
    for n in range(1, last + 1):
        own = fields | {"WARC-Segment-Number": "1"} if n == 1 else {"WARC-Type": "continuation", "WARC-Record-ID": name(page_id, copy, f":{n}"), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": name(page_id, copy), "WARC-Segment-Number": str(n)}
        if n == last:
            own["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record(own, block[(n - 1) * segment : n * segment]))
    return out


def inflate(archive: bytes) -> bytes:
    """The archive's text: all members if it is gzipped, as far as they can be read."""
    if archive[:2] != b"\x1f\x8b":
        return archive
    out: list[bytes] = []
    while archive:
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(archive))
        except zlib.error:
            break
        archive = z.unused_data
    return b"".join(out)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, gzipped or plain; field names in lower case.

    A record without a readable length ends where the next one begins. One that is cut off keeps
    what is there and has the field x-cut.
    """
    data = inflate(archive)
    begin = re.compile(rb"(?:\r\n|\n)*WARC/[0-9.]+\r?\n")
    at = 0
    while found := begin.match(data, at) or begin.search(data, at):
        head = re.compile(rb"\r?\n\r?\n").search(data, found.end() - 1)
        end = head.start() if head else len(data)
        lines = data[found.end() : end].decode("utf-8", "replace").splitlines()
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = (head.end() if head else end), fields.get("content-length", "")
        if size.isdigit():
            stop = start + int(size)
        else:
            later = re.compile(rb"\r?\n\r?\nWARC/[0-9.]+\r?\n").search(data, start)
            stop = later.start() if later else len(data.rstrip(b"\r\n"))
        if stop > len(data) or not head:
            fields["x-cut"] = "1"
        yield fields, data[start:stop]
        at = max(stop, found.end())


def write_archives(pages: DataFrame, path: str, segment: int = 16_384, chunk: int = 4_096, archive_bytes: int = 1 << 20) -> None:
    """Write one WARC record a row of pages (page_id, url, html), and continuations, into the table at path.

    Each row of that table is an archive of about archive_bytes, in the .warc.gz layout. Rows with
    equal html are settled by payload digest: that with the largest page_id becomes the response,
    the others revisit it. Equal digests meet in a map-side combined maximum, never in one task's
    memory; the html moves once, by page_id and digest. Null html is empty, a null page_id is
    smaller than any other, a null url is about:blank, and repeated rows get numbered records of
    the same kind. Other columns are ignored.
    """
    body = text_or_empty("html").cast("binary")
    page = F.col("page_id").cast("long")
    key = F.coalesce(page.cast("string"), F.lit(""))  # never null, so that join and window share one exchange
    rows = pages.select(page.alias("page_id"), key.alias("page"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body).alias("sha"))
    largest = rows.groupBy("sha").agg(F.max("page_id").alias("largest"))
    roles = rows.select("page", "sha").distinct().join(largest, "sha")
    dealt = rows.join(roles, ["page", "sha"])
    dealt = dealt.withColumn("copy", F.row_number().over(W.partitionBy("page", "sha").orderBy(F.col("url").asc_nulls_first())) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                for x in records_of(r["page_id"], r["url"], r["html"], digest, r["copy"], r["largest"], r["page_id"] != r["largest"], segment, chunk):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    held.append(z.compress(x) + z.flush())
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["warc"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["warc"])

    dealt.mapInArrow(run, "warc binary").write.option("compression", "none").parquet(path)


FOUND = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, complete boolean, record_id string, refers_to_id string"
KINDS = ("response", "revisit", "resource", "continuation")


def _page_of(name: str | None) -> int | None:
    """The page_id in a record ID that `records_of` made; null for any other."""
    part = re.fullmatch(r"<urn:x-page:(-?[0-9]+):.*>", name or "")
    return int(part[1]) if part else None


def _settle(fields: dict[str, str], block: bytes, whole: bool, keep: bool) -> dict:
    """The outcome for one record whose block is put together: the payload is decoded and held against its digest."""
    kind, stated = fields["warc-type"], fields.get("warc-payload-digest", "")
    head, _, rest = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    digest = stated.removeprefix("sha1:") if re.fullmatch("sha1:[A-Z2-7]{32}", stated) else ""
    payload, size, whole = None, None, whole and "x-cut" not in fields
    if kind == "revisit":
        length = http.get(b"content-length", b"")
        size = int(length) if length.isdigit() else None
    elif whole:
        try:
            payload = unchunk(rest) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else rest
            size, found = len(payload), base32_sha1(payload)
            whole, digest = found == digest or not digest, found
        except ValueError:
            whole = False
    name, other = fields.get("warc-record-id"), fields.get("warc-refers-to") if kind == "revisit" else None
    out = {"page_id": _page_of(name), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page_of(other), "payload_digest": digest or stated, "payload_bytes": size, "complete": whole, "record_id": name, "refers_to_id": other}
    return out | ({"payload": payload} if keep else {})


def _rejoined(origin: str, pieces: list[dict], keep: bool) -> list[dict]:
    """The outcomes for the segments under one origin: one, or several if all segments were written several times over."""
    by: dict[int, list[dict]] = {}
    for x in sorted(pieces, key=lambda x: x["number"]):
        by.setdefault(x["number"], []).append(x)
    times = {len(own) for own in by.values()}
    same = len(times) == 1 and all(x["block"] == own[0]["block"] for own in by.values() for x in own)
    chosen = [own[0] for own in by.values()] if same else sorted(pieces, key=lambda x: x["number"])
    first = dict(chosen[0]["fields"]) if chosen[0]["number"] == 1 else {"warc-type": "response", "warc-record-id": origin}
    block = b"".join(x["block"] for x in chosen)
    whole = [x["number"] for x in chosen] == list(range(1, len(chosen) + 1)) and chosen[-1]["total"] == len(block)
    whole = whole and not any("x-cut" in dict(x["fields"]) for x in chosen)
    return [_settle(first, block, whole, keep)] * (times.pop() if same else 1)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row a page from archives (warc binary), of any writer: page_id, url, record_type, refers_to, payload_digest, payload_bytes, complete, record_id, refers_to_id.

    Archives are gzipped or plain, of version 1.0 or 1.1. page_id and refers_to are read from record
    IDs that `write_archives` gave and are null for others. Records of other types than response,
    revisit, resource and continuation hold no page. Records in one piece are settled where they are
    read, and each is a row, whatever its ID. Pieces of segmented ones meet by the record ID of their
    first segment, which the continuations name as origin; they are ordered by segment number, and
    must number 1 to n without gaps and have the total length that the last one states; several equal
    sets of pieces are several records. A record that fails this, its framing or its digest, or that
    is cut off, has complete false and, unless only the digest fails, null payload_bytes. Only SHA-1
    digests in base 32 are verified. payloads adds the decoded payload. Pieces without a first
    segment are reported under their origin as incomplete responses. An empty table gives an empty
    result, and null archives none.
    """
    columns = FOUND + ", payload binary" * payloads
    shape = ",".join(x.strip().replace(" ", ":", 1) for x in columns.split(","))
    schema = f"origin string, done struct<{shape}>, number int, total long, fields map<string,string>, block binary"
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    found = pa.struct([(x.split()[0], kinds[x.split()[1]]) for x in columns.split(", ")])
    types = [pa.string(), found, pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["origin", "done", "number", "total", "fields", "block"]
    whole = lambda text: int(text) if (text or "").isdigit() else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("warc"):
                rows = []
                for f, block in parse(archive.as_py()):
                    f["warc-type"] = f.get("warc-type", "").lower()
                    if f["warc-type"] not in KINDS:
                        continue
                    number = whole(f.get("warc-segment-number"))
                    if number is None:
                        rows.append((f.get("warc-record-id"), _settle(f, block, True, payloads), None, None, None, None))
                    else:
                        origin = f.get("warc-segment-origin-id", f.get("warc-record-id", ""))
                        rows.append((origin, None, number, whole(f.get("warc-segment-total-length")), list(f.items()), block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += _rejoined(r["origin"], r["pieces"], payloads) if r["pieces"] else [r["done"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in out], f.type) for f in found], [f.name for f in found])

    rows = archives.select("warc").where("warc IS NOT NULL").mapInArrow(split, schema)
    alone = F.when(F.col("number").isNull(), F.monotonically_increasing_id())  # a record in one piece is never grouped with another
    grouped = rows.withColumn("alone", alone).groupBy("origin", "alone").agg(F.first("done", ignorenulls=True).alias("done"), F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "total", "fields", "block"))).alias("pieces"))
    return grouped.mapInArrow(join, columns)


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark.read.parquet(path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "complete")


_DIGITS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {1 + 5 * g}, 5) AS INTEGER) >> {15 - 5 * i}) & 31), 1)" for g in range(8) for i in range(4)
)
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, concat({_DIGITS}) AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, url, true AS complete
FROM m"""
