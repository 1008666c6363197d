"""WARC archives: one capture is a request, a response (or revisit) and a metadata record, tied by concurrent-to ids.

Writing: the records are strings whose line separator is the blank line that ends a WARC record, so Spark's own text writer
makes compressed archives of a bounded number of records, with its commit protocol and on any file system it knows. Of
equal payloads one is a response and the others revisit it; payloads with no equal, which are most, and those of revisits
are never shuffled. Reading: archives are inflated and parsed by content length piece by piece, and each capture is put
together by joins over the record ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.common import BATCH_ROWS, cut, in_batches, scratch, sieve, stored

#: Shorter payloads are never revisits.
MIN_BYTES = 100
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Records of an archive, and bytes that are inflated at a time.
RECORDS_PER_FILE = 6000
INFLATED = 1 << 20


def _id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + " "), key).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[Column], content: str, block: Column) -> Column:
    """Headers may be null, and are then left out. The writer adds the closing blank line."""
    named = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), *headers, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws(CRLF, *named), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes three records for every row of ``pages`` (page_id, url, html) below ``path``."""
    html = F.coalesce("html", F.lit(""))
    last = F.lit((1 << 63) - 1)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("bigint").alias("bytes"))
    prints = stored(rows.select("page_id", "digest", "bytes"), "payloads")
    firsts = prints.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    same = stored(firsts.select("digest", "first"), "copied")
    # of the payloads that may be copied only the first is written again, and those that are not copied after all
    other = sieve(prints.select("digest", "page_id"), ["digest"], same).join(same, "digest", "left_anti")
    full = stored(same.select("digest", F.col("first").alias("page_id")).unionByName(other), "full")
    single = sieve(rows, ["digest"], same, inside=False).withColumn("first", F.lit(None).cast("bigint"))
    copied = sieve(rows, ["digest"], same)
    held = sieve(copied, ["digest", "page_id"], full).join(same, "digest", "left")
    bare = sieve(copied, ["digest", "page_id"], full, inside=False).withColumn("html", F.lit("")).join(same, "digest")
    joined = single.unionByName(held).unionByName(bare)
    key = lambda page: F.concat(F.coalesce(page.cast("string"), F.lit("null")), F.lit(" "), F.col("digest"))
    own = key(F.col("page_id"))
    revisit = F.coalesce(F.col("first") < F.coalesce("page_id", last), F.lit(False))
    response_id = _id("response", F.concat(own, F.lit(" "), F.col("url")))
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), response_id,
        [target, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id("payload", key(F.col("first")))))],
        "application/http; msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
    )
    request = _record(F.lit("request"), _id("request", F.concat(own, F.lit(" "), F.col("url"))), [target, concurrent], "application/http; msgtype=request", F.concat(F.lit("GET "), F.regexp_replace("url", " ", "%20"), F.lit(" HTTP/1.1" + CRLF + CRLF)))
    about = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-id: "), _id("payload", own)), F.lit(""))
    metadata = _record(F.lit("metadata"), _id("metadata", F.concat(own, F.lit(" "), F.col("url"))), [target, concurrent], "application/warc-fields", about)
    joined.select(F.explode(F.array(metadata, request, response)).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORDS = "type string, record_id string, concurrent_to string, refers_to string, url string, digest string, page_id bigint, payload_id string, http_bytes bigint, payload_bytes bigint, payload_sha256 string, bad boolean"


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of all members of a gzip file, in parts."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.decompress(data, INFLATED)
            data = member.unconsumed_tail
            if not part and not data and not member.eof:
                raise ValueError("an archive ends within a member")
            yield part
        data = member.unused_data


def _blocks(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a compressed archive; one record is held at a time."""
    parts, held = _inflated(data), bytearray()

    def filled(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while filled(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not filled(len(held) + 1):
                raise ValueError("an archive ends within a record's headers")
        first, *lines = held[:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:80]}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if ": " in x)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if not filled(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the length of {headers.get('warc-record-id')} is wrong")
        yield headers, bytes(held[start:stop])
        del held[: stop + 4]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in RECORDS.split(", "))])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for h, block in _blocks(content.as_py()):
                row = dict.fromkeys(schema.names) | {"type": h["warc-type"], "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "url": h.get("warc-target-uri"), "bad": False}
                if row["type"] in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
                    row |= {"digest": h["warc-payload-digest"].removeprefix("sha256:"), "http_bytes": int(fields["Content-Length"])}
                    if row["type"] == "response":
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
                        row["bad"] = row["payload_sha256"] != row["digest"] or len(payload) != row["http_bytes"]
                elif row["type"] == "metadata":
                    fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
                    row |= {"page_id": int(fields["page-id"]) if "page-id" in fields else None, "payload_id": fields["payload-id"]}
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``, one row each; ``bad`` marks payloads that differ from their digest or length."""
    return in_batches(spark.read.format("binaryFile").load(path).select("content"), _parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response (a struct, revisits too), request, metadata, refers_to.

    Requests and metadata are joined through their concurrent-to ids; of several for one response the smallest record id is
    taken. A revisit is joined to the page of the response it refers to.
    """
    kept = stored(records, "records")
    side = lambda kind, *cols: cut(kept.where(F.col("type") == kind).groupBy("concurrent_to").agg(F.min(F.struct("record_id", *cols)).alias(kind)))
    answers = kept.where("type in ('response', 'revisit')").select(F.col("record_id").alias("concurrent_to"), F.struct("type", "record_id", "url", "digest", "http_bytes", "payload_bytes", "payload_sha256", "refers_to", "bad").alias("response"))
    captures = stored(answers.join(side("metadata", "page_id", "payload_id"), "concurrent_to", "left").join(side("request", "url"), "concurrent_to", "left").drop("concurrent_to"), "captures")
    originals = cut(captures.where("response.type = 'response'").groupBy(F.col("metadata.payload_id").alias("payload_id")).agg(F.min("metadata.page_id").alias("refers_to")))
    joined = captures.withColumn("payload_id", F.coalesce("response.refers_to", F.concat(F.lit("none "), F.col("response.record_id"))))
    return joined.join(originals, "payload_id", "left").select("response", "request", "metadata", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every row, from archives written and read back.

    A null html is an empty payload, a null url an empty one. Rows that share the smallest page_id of a payload are responses
    each. A null page_id is greater than all others. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    found = assemble(read_records(spark, path))
    r = "response."
    return found.select(
        "metadata.page_id", F.coalesce(r + "payload_bytes", r + "http_bytes").alias("payload_bytes"), F.coalesce(r + "payload_sha256", r + "digest").alias("payload_digest"),
        F.col(r + "type").alias("record_type"), F.when(F.col(r + "type") == "revisit", F.col("refers_to")).alias("refers_to"), F.col(r + "url").alias("url"),
    )
