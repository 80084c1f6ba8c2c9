"""WARC archives: writing with segments and revisits, and reading back with segment reassembly.

A payload is carried as an HTTP message in chunked transfer framing. A message longer than
`segment_bytes` is split: the first record has segment number 1, the others are continuation
records that name it as their origin, and the last states the total length. The reader groups
records by origin, orders them by segment number, verifies the total length and decodes the
chunks. Archives are written and read through Spark only: one record is one row of the text
writer (a record ends in CRLF CRLF, whose last byte is the writer's separator). Archives of any
number of gzip members, as others write them, are read too. A revisit names the record of its
response, and counts as valid if that record was read and has its length and digest.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, n_partitions, scratch, table, written

SEGMENT_BYTES, CHUNK_BYTES, MIN_REVISIT = 32 << 10, 8 << 10, 100
#: Records of one archive file, so that a file of segments is at most RECORDS * SEGMENT_BYTES.
RECORDS = 2000
_EPOCH = "1970-01-01T00:00:00Z"
_PARSED = "origin string, type string, page_id long, row long, url string, refers string, digest string, payload_bytes long, segment int, total long, block binary"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
_CRLF = b"\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError if the framing is broken. Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        if end < 0:
            raise ValueError("chunk size line is not closed")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != _CRLF:
            raise ValueError("chunk is not closed")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, rid: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", _EPOCH), *((k, v) for k, v in headers if v is not None), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + lines + _CRLF + block + _CRLF + _CRLF


def _one_line(s: str | None) -> str | None:
    return None if s is None else re.sub(r"[\r\n]+", " ", s)


def record_id(page_id: int | None, digest: str, row: int) -> str:
    """The id of a page's record: pages of one id and payload are told apart by row, the first of them being 0."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}:{row}"


def _ids(uri: str) -> tuple[int | None, int | None]:
    """Page id and row of a record id; null where it isn't one of record_id()."""
    m = re.fullmatch(r"<?urn:page:(-?\d*):[0-9a-f]*:(\d+)>?", uri)
    return (int(m[1]) if m[1] else None, int(m[2])) if m else (None, None)


def records(page_id: int | None, row: int, url: str | None, html: str | None, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit of the first record that refers_to has of this payload, or a response with its continuations."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = hashlib.sha256(payload).hexdigest()
    rid, own = record_id(page_id, digest, row), [("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record("revisit", rid, [*own, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{record_id(refers_to, digest, 0)}>"), ("X-Payload-Length", len(payload))], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    own = [*own, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        return [_record("response", rid, own, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", rid, [*own, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(_record("continuation", f"{rid}:{n}", [("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def inflated(data, step: int = 1 << 20):
    """The bytes of an archive, a step at a time: of all its gzip members, or as they are. ValueError if a member is cut off."""
    at = memoryview(data)
    if bytes(at[:2]) != b"\x1f\x8b":
        yield bytes(at)
        return
    while len(at):
        z, rest = zlib.decompressobj(47), at
        while not z.eof:
            out = z.decompress(rest, step)
            rest = z.unconsumed_tail
            if out:
                yield out
            elif not rest and not z.eof:
                raise ValueError("archive is cut off")
        at = memoryview(z.unused_data)


def parse(data):
    """(headers, block) of each record of an uncompressed archive, given as bytes or as an iterable of them. ValueError if a record is broken or cut off."""
    chunks, buffer = iter([data] if isinstance(data, bytes) else data), bytearray()

    def filled(n: int) -> bool:
        while len(buffer) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while filled(1):
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(len(buffer) - 3, 0)
            if not filled(len(buffer) + 1):
                raise ValueError("record without an end of its headers")
        if not buffer.startswith(b"WARC/1."):
            raise ValueError("no record where one should start")
        lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
        if not filled(end + 8 + n):
            raise ValueError("record is cut off")
        block = bytes(buffer[end + 4 : end + 4 + n])
        del buffer[: end + 8 + n]
        yield head, block


def fields(head: dict, block: bytes) -> dict:
    """What a record says, by the columns of read_records()."""
    kind, own = head["warc-type"], head["warc-record-id"].strip("<>")
    origin = head.get("warc-segment-origin-id", own).strip("<>")
    page_id, nth = _ids(origin)
    number, refers = head.get("warc-segment-number"), head.get("warc-refers-to")
    return {
        "origin": origin, "type": kind, "page_id": page_id, "row": nth, "url": head.get("warc-target-uri"), "refers": refers.strip("<>") if refers else None,
        "digest": head.get("warc-payload-digest", "").partition(":")[2] or None, "payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None,
        "segment": int(number) if number else None, "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, "block": block,
    }


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages(page_id, row, url, html, refers_to) as gzipped WARC files under path. row tells rows of equal page_id apart."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                got = records(*(b.column(c)[r].as_py() for c in ("page_id", "row", "url", "html", "refers_to")), segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in got], pa.binary())], names=["record"])

    rows = map_arrow(pages.select("page_id", "row", "url", "html", "refers_to"), run, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS).text(path)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives (*.gz, *.warc) under path, parsed as they are inflated."""
    schema = _schema(_PARSED)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for head, block in parse(inflated(content.as_buffer())):
                    rows.append(fields(head, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content"), run, _PARSED)


_OUT = "origin string, page_id long, row long, url string, payload_bytes long, payload_digest string, record_type string, refers string, valid boolean"


def _decoded(block: bytes, total: int | None) -> tuple[bytes, bool]:
    """The payload of a whole HTTP message, and whether its length and framing are right."""
    if total is not None and len(block) != total:
        return b"", False
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        return (dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body), True
    except ValueError:
        return b"", False


def payloads(found: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit of read_records(): sizes and digests of the decoded payloads, verified against the records.

    Only records with a segment number are shuffled, by origin. valid is false where a segment
    is missing or there twice, the total length differs or is missing, the framing is broken or
    the digest doesn't match. A revisit has the length and digest that it states; see verified().
    """
    out = _OUT + (", payload binary" if with_payload else "")
    schema = _schema(out)

    def result(r: dict, block: bytes, total: int | None) -> dict:
        x = {c: r[c] for c in ("origin", "page_id", "row", "url", "refers")} | {"record_type": r["type"]}
        if r["type"] == "revisit":
            return x | {"payload_bytes": r["payload_bytes"], "payload_digest": r["digest"], "valid": None, "payload": None}
        payload, ok = _decoded(block, total)
        digest = hashlib.sha256(payload).hexdigest()
        return x | {"payload_bytes": len(payload), "payload_digest": digest, "valid": ok and digest == r["digest"], "payload": payload}

    def whole(batches):
        for b in batches:
            rows = [result(r, r["block"], None) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

    def joined(batches):
        # Rows come sorted by origin and segment: one message is held at a time.
        first, parts, total, right = None, [], None, True

        def flush():
            if first is not None:
                r = result(first | {"type": "response"}, b"".join(parts), total if total is not None and right else -1)
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names}], schema)

        for b in batches:
            for r in b.to_pylist():
                if first is None or r["origin"] != first["origin"]:
                    yield from flush()
                    first, parts, total, right = r, [], None, r["segment"] == 1
                right &= r["segment"] == len(parts) + 1
                parts.append(r["block"])
                total = r["total"] if r["total"] is not None else total
        yield from flush()

    segments = found.where("segment is not null").repartition(n_partitions(found.sparkSession), "origin").sortWithinPartitions("origin", "segment")
    return map_arrow(found.where("segment is null"), whole, out).unionByName(map_arrow(segments, joined, out))


def verified(results: DataFrame) -> DataFrame:
    """page_id, row, url, payload_bytes, payload_digest, record_type, refers_to, valid of payloads(): a revisit is valid if the response that it names is, and has the length and digest that it states."""
    revisits = results.where("record_type = 'revisit'")
    named = results.where("record_type = 'response'").join(revisits.select(F.col("refers").alias("origin")).distinct(), "origin", "left_semi")
    named = named.groupBy(F.col("origin").alias("refers")).agg(F.min("valid").alias("_ok"), F.min("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_digest"))
    same = F.col("_ok") & (F.col("_bytes") == F.col("payload_bytes")) & (F.col("_digest") == F.col("payload_digest"))
    valid = F.when(F.col("record_type") == "revisit", F.coalesce(same, F.lit(False))).otherwise(F.col("valid"))
    refers_to = F.nullif(F.regexp_extract("refers", "^urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")
    return results.join(named, "refers", "left").select("page_id", "row", "url", "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"), valid.alias("valid"))


def with_references(pages: DataFrame, least_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html) with row (0, but for all except one of several rows of one page_id and payload) and refers_to.

    refers_to is the smallest page_id of the records with the same payload of at least
    least_bytes bytes, for those that don't have it themselves. Rows that repeat that page_id
    are responses too; a null page_id refers to the smallest that isn't null.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), (F.octet_length(html) >= least_bytes).alias("long"))
    counted = written(rows.groupBy("digest", "page_id", "long").count(), "payload-counts")
    firsts = counted.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("count").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = counted.where("count > 1").select(F.col("digest").alias("_digest"), F.col("page_id").alias("_page"))
    if again.isEmpty():
        numbered = rows.withColumn("row", F.lit(0).cast("long"))
    else:
        same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
        # written, so that the numbers stay what they are
        more = written(rows.join(again, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-pages")
        least = more.groupBy(F.col("digest").alias("_digest"), F.col("page_id").alias("_page")).agg(F.min("row").alias("_least"))
        more = more.join(least, same).select(*rows.columns, (F.col("row") - F.col("_least")).alias("row"))
        numbered = rows.join(again, same, "left_anti").withColumn("row", F.lit(0).cast("long")).unionByName(more)
    found = numbered.join(written(firsts, "payload-firsts").withColumn("long", F.lit(True)), ["digest", "long"], "left")
    return found.select("page_id", "row", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives of pages(page_id, url, html) under path, read back and verified: see verified()."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(with_references(pages), path)
    return verified(written(payloads(read_records(spark, path)), "payloads"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """One row per row of pages, read back from the archives.

    Null html is an empty payload, which is always a response; a null page_id is kept and is
    never referred to. Repeated rows have a record each. Very long pages go through segments;
    an empty table gives no rows, and columns other than page_id, url and html are not read.
    """
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


#: The rows of op3_warc.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, true AS valid
FROM f
"""
