"""Web archives: pages to WARC records in segments, and back by segment reassembly (operator 11).

Writing. A page is a response record whose block is an HTTP message in chunked transfer framing. A block of more than
SEGMENT bytes is cut: the first segment keeps the record's type, the others are continuation records, which name the
first one's id as their origin, their number, and in the last the length of all. Of equal payloads of at least `least`
bytes the one with the smallest id is a response; the others are revisit records that refer to it and hold no body.
Files are written by Spark's text writer: a record ends with two line ends, of which the writer adds the second, so each
part is a plain gzipped archive of at most PER_FILE records (1 GB before compression), wherever Spark can write.

Reading. Each file is inflated and parsed as a stream, by the lengths that its records declare. Whole records are decoded
at once. Segments are grouped by origin, wherever they stand, put in order of their numbers, checked against the total
length, and decoded then; so a group is never more than one page. Copies of a segment are counted before they are
grouped, since a repeated row repeats its records.

Nulls, ties, odd rows: a null payload is empty; a null id is written as `none` and read as null, and it is no candidate
for a response where others have ids; rows that repeat the smallest id are responses all; a null url has no target; an
empty table gives no records. What is damaged in an archive gives a row with a problem: badHeader, truncated, badHttp,
badChunk, lengthMismatch, digestMismatch, missingSegment, conflictingSegments, unresolvedRevisit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, bits_for, lean, small_batches, stored

SEGMENT, PER_FILE, CHUNK, LONGEST_HEADER, MOST_HOT = 32_768, 32_768, 8_192, 1 << 20, 4_096
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_type string"
RECORD = f"{FIELDS}, segment_number int, origin_id string, total_length long, block binary, payload binary, problem string"
# The fields of a record's head that are read, by the columns that hold them.
HEAD = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
    "content_type": "content-type", "segment_number": "warc-segment-number", "origin_id": "warc-segment-origin-id", "total_length": "warc-segment-total-length",
}
NUMBERS = ("segment_number", "total_length")
BATCH = 4_000_000  # bytes of records handed on at once


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds, or None where it is damaged. Extensions of a chunk and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        at = end + 2
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts) if body[at : at + 2] == b"\r\n" or body.find(b"\r\n\r\n", at) >= 0 else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def decoded(block: bytes, content_type: str | None, digest: str | None) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a whole block: the body of an HTTP message, else the block itself."""
    payload = block
    if (content_type or "").replace(" ", "").lower().startswith("application/http"):
        head, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            return None, "badHttp"
        fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
        if b"chunked" in fields.get(b"transfer-encoding", b""):
            payload = unchunked(payload)
            if payload is None:
                return None, "badChunk"
        elif (n := fields.get(b"content-length", b"").strip()).isdigit() and int(n) != len(payload):
            return None, "lengthMismatch"
    kind, _, want = (digest or "").partition(":")
    if kind == "sha256" and want and hashlib.sha256(payload).hexdigest() != want:
        return None, "digestMismatch"
    return payload, None


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes without the last line end, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    return b"WARC/1.1\r\n%b\r\n%b\r\n" % (f"{head}Content-Length: {len(block)}\r\n".encode(), block)


def segments(name: str, kind: str, date: str, url: str | None, digest: str, refers_to: str | None, payload: bytes, size: int) -> Iterator[bytes]:
    """The records of one page."""
    target = "".join(chr(c) if 32 < c < 127 else f"%{c:02X}" for c in (url or "").encode())
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    first = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), *common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([*first, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>")], HTTP_HEAD + b"\r\n")
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= size:
        yield record(first, block)
        return
    last = -(-len(block) // size)
    for n in range(1, last + 1):
        fields = first if n == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{n}>"), *common, ("WARC-Segment-Origin-ID", f"<{name}>")]
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == last else []
        yield record([*fields, ("WARC-Segment-Number", str(n)), *total], block[(n - 1) * size : n * size])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, segment: int = SEGMENT, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row below path. The MOST_HOT digests that most rows share are looked up in a broadcast table,
    and rows outside a bitmap of the other repeated digests stay where they are; only the rest is joined by digest."""
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "long": F.octet_length("payload") >= least})
    counted = rows.where("long").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    repeated = stored(counted.where("copies > 1"))
    hot = repeated.orderBy(F.desc("copies"), "digest").limit(MOST_HOT).select("digest", F.struct("least").alias("hot"))
    bits = spark.sparkContext.broadcast(bitmap_of(repeated, F.xxhash64("digest"), bits_for(repeated.count())))

    @F.pandas_udf("boolean")
    def may_repeat(digest: pd.Series) -> pd.Series:
        return pd.Series(bits.value.test(digest.to_numpy()))

    marked = rows.join(F.broadcast(hot), "digest", "left")
    marked = marked.withColumn("unsure", F.when(F.col("long") & F.col("hot").isNull(), may_repeat(F.xxhash64("digest"))).otherwise(False))
    response = lambda known: F.when(F.col("long") & ~F.col("id").eqNullSafe(known), known)
    columns = ["id", "url", "digest", "payload", "refers_to"]
    sure = marked.where("not unsure").withColumn("refers_to", response(F.col("hot.least")))
    unsure = marked.where("unsure").join(repeated.select("digest", "least"), "digest", "left").withColumn("refers_to", response(F.col("least")))
    every = sure.select(columns).unionByName(unsure.select(columns)).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    @lean
    def run(batches):
        import pyarrow as pa

        out, size = [], 0
        for b in batches:
            for i, url, digest, body, first in zip(*(c.to_pylist() for c in b.columns)):
                name = lambda x: f"urn:page:{'none' if x is None else x}:{digest[:32]}"  # noqa: B023, E731
                for r in segments(name(i), "response" if first is None else "revisit", date, url, digest, None if first is None else name(first), body, segment):
                    out.append(r)
                    size += len(r)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = every.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = records.write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("maxRecordsPerFile", PER_FILE).text(path)


def inflated(content, size: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a file by and by; gzip members follow one another. A member that breaks off ends the file."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + size]) for i in range(0, len(view), size))
        return
    z = zlib.decompressobj(31)
    for i in range(0, len(view), size):
        rest = view[i : i + size]
        while len(rest):
            try:
                yield z.decompress(rest)
            except zlib.error:
                return
            rest = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)


def parsed(content) -> Iterator[tuple[dict, bytes, str | None]]:
    """(fields, block, problem) of each record of a file. What can't be parsed ends it with a problem."""
    source, buffer, at = inflated(content), b"", 0

    def more() -> bool:
        nonlocal buffer, at
        got = next(source, None)
        if got is None:
            return False
        buffer, at = buffer[at:] + got, 0
        return True

    while True:
        while buffer[at : at + 2] == b"\r\n" or len(buffer) - at < 2:
            if len(buffer) - at < 2:
                if not more():
                    if len(buffer) > at:
                        yield {}, b"", "truncated"
                    return
            else:
                at += 2
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if len(buffer) - at > LONGEST_HEADER or not more():
                yield {}, b"", "badHeader"
                return
        version, *lines = buffer[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = fields.get("content-length", "")
        if not version.startswith("WARC/") or not (length.isascii() and length.isdigit()):
            yield fields, b"", "badHeader"
            return
        at, length = end + 4, int(length)
        pieces, have = [buffer[at : at + length]], min(length, len(buffer) - at)
        at += have
        while have < length and more():
            pieces.append(buffer[at : at + length - have])
            at += len(pieces[-1])
            have += len(pieces[-1])
        yield fields, b"".join(pieces), None if have == length else "truncated"
        if have < length:
            return


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below path, as RECORD has them: segments with their block, whole ones with their payload."""

    def row(fields: dict, block: bytes, problem: str | None) -> dict:
        out = {k: fields.get(v) for k, v in HEAD.items()}
        out |= {k: int(out[k]) if (out[k] or "").isdigit() else None for k in NUMBERS}
        out |= {k: out[k].strip("<>") for k in ("record_id", "refers_to", "origin_id", "target_uri") if out[k]}
        cut = out["segment_number"] is not None
        payload = None
        if not problem and not cut:
            payload, problem = decoded(block, out["content_type"], None if out["record_type"] == "revisit" else out["payload_digest"])
        return out | {"block": block if cut else None, "payload": payload, "problem": problem}

    @lean
    def run(batches):
        import pyarrow as pa

        kinds = {"segment_number": pa.int32(), "total_length": pa.int64(), "block": pa.binary(), "payload": pa.binary()}
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for b in batches:
            for cell in b.column(0):
                out, size = [], 0
                for fields, block, problem in parsed(cell.as_buffer()):
                    out.append(row(fields, block, problem))
                    size += len(block) + 500
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_digest, content_type, payload, problem) of whole records:
    those that were never cut, and those put together from their segments."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    out = [*names, "payload", "problem"]
    whole = records.where("segment_number is null").select(out)
    key = F.coalesce("origin_id", "record_id")
    cut = records.where("segment_number is not null").select(key.alias("key"), *names, "segment_number", "total_length", "block", "problem")
    first = F.struct(*names)
    same = cut.withColumn("head", F.when(F.col("segment_number") == 1, first)).groupBy("key", "head", "segment_number", "total_length", "block", "problem").agg(F.count("*").alias("copies"))
    part = F.struct("segment_number", "total_length", "block", "problem")
    groups = same.groupBy("key").agg(F.first("head", ignorenulls=True).alias("head"), F.max(F.when(F.col("segment_number") == 1, F.col("copies"))).alias("copies"), F.array_sort(F.collect_list(part)).alias("parts"))

    @lean
    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            payloads, problems = [], []
            for kind, digest, parts in zip(cols["content_type"].to_pylist(), cols["payload_digest"].to_pylist(), cols["parts"].to_pylist()):
                payload, why = None, next((p["problem"] for p in parts if p["problem"]), None)
                numbers, total = [p["segment_number"] for p in parts], parts[-1]["total_length"]
                if not why and len(set(numbers)) < len(numbers):
                    why = "conflictingSegments"
                elif not why and (numbers != list(range(1, len(numbers) + 1)) or total is None):
                    why = "missingSegment"
                elif not why and sum(len(p["block"]) for p in parts) != total:
                    why = "lengthMismatch"
                if not why:
                    payload, why = decoded(b"".join(p["block"] for p in parts), kind, digest)
                payloads.append(payload)
                problems.append(why)
            new = [*(cols[n] for n in names), pa.array(payloads, pa.binary()), pa.array(problems, pa.string()), cols["copies"]]
            yield pa.RecordBatch.from_arrays(new, names=[*out, "copies"])

    rows = groups.select(F.coalesce("head.record_id", "key").alias("record_id"), *[F.col(f"head.{n}").alias(n) for n in names[1:]], F.coalesce("copies", F.lit(1)).alias("copies"), "parts")
    joined = rows.mapInArrow(run, f"{FIELDS}, payload binary, problem string, copies long")
    again = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(out)
    return whole.unionByName(again)


def resolved(records: DataFrame) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, problem) of whole records; those of
    a revisit are the ones of the response that it refers to. Responses are looked up by narrow rows."""
    digest = F.when(F.col("record_type") == "revisit", F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256))
    narrow = stored(records.select("record_id", "record_type", "target_uri", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "problem"))
    found = narrow.where("record_type = 'response' and problem is null").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    again = narrow.where("record_type = 'revisit'").join(found, "refers_to", "left")
    sound = F.col("digest") == F.col("payload_digest")
    again = again.withColumns({"payload_bytes": F.when(sound, F.col("bytes")), "problem": F.coalesce("problem", F.when(sound, F.lit(None)).otherwise("unresolvedRevisit"))}).select(narrow.columns)
    return narrow.where("record_type is null or record_type <> 'revisit'").unionByName(again)


def page_number(name: Column) -> Column:
    """The page's id in the name of its record; null for `none`."""
    return F.regexp_extract(name, "^urn:page:(-?[0-9]*)", 1).try_cast("long")
