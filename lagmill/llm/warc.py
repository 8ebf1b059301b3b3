"""WARC: write a capture as request, response or revisit, and metadata records; read archives; assemble transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lagmill.llm.common import materialize

#: Fixed values of the WARC 1.1 format.
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads of at least so many bytes are written once; records per archive file at most, and bytes of payloads per file, about.
LEAST_REVISIT, FILE_RECORDS, FILE_BYTES = 0, 6000, 64_000_000
#: Bytes of payloads and records that the reader hands on at a time; parts into which the pages of one payload are dealt.
FRAME_BYTES, FRAME_RECORDS, SALTS = 4_000_000, 2_000, 16


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1: every five digits hold four characters."""
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column, date: str) -> Column:
    """Text of one record without the last CRLF, which the writer adds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + "WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}")]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    lines += [F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF)]
    return F.concat(*lines)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as gzipped archive files under path, three records a page: request, response or revisit,
    metadata; request and metadata name the capture in WARC-Concurrent-To.

    Of pages with equal payloads (html in UTF-8, null as empty) of at least `least` bytes the one with the smallest page_id is a
    response, null last; the others are revisits that refer to it. Rows with equal page_id, url and html are numbered, the first counting as
    smaller. Line breaks in a url are percent-encoded. Files hold FILE_RECORDS records at most, and fewer if pages are larger than
    FILE_BYTES allows on average.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"))
    rows = rows.select("*", F.sha1(F.col("body").cast("binary")).alias("sha"), F.octet_length("body").cast("long").alias("n_bytes"))
    keys = ("page_id", "url", "sha")
    names = materialize(rows.select(*keys, "n_bytes"), "warc-names")
    same = names.where(F.col("n_bytes") >= least).groupBy("sha", "n_bytes").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    leaders = materialize(same.where("n > 1").select(F.col("sha").alias("l_sha"), F.col("n_bytes").alias("l_bytes"), "first.page_id", "first.url")
                          .toDF("l_sha", "l_bytes", "l_page", "l_url"), "warc-leaders")
    # Only rows that are equal in all keys need numbers, so only they are shuffled with their bodies for them.
    repeated = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(c).alias(f"r_{c}") for c in keys))
    on = F.col("page_id").eqNullSafe(F.col("r_page_id")) & (F.col("url") == F.col("r_url")) & (F.col("sha") == F.col("r_sha"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("n_bytes"))
    rows = rows.join(repeated, on, "left_anti").withColumn("copy", F.lit(1)).unionByName(rows.join(repeated, on, "left_semi").withColumn("copy", number))
    # A payload may be that of a third of all pages: its rows are dealt to SALTS parts, each of which gets the leader.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    leaders = leaders.withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(leaders, (F.col("sha") == F.col("l_sha")) & (F.col("n_bytes") == F.col("l_bytes")) & (F.col("salt") == F.col("l_salt")), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("l_page")) & (F.col("url") == F.col("l_url")) & (F.col("copy") == 1)
    rows = rows.withColumn("revisit", F.col("l_sha").isNotNull() & ~is_first)

    me = [F.col("page_id"), F.col("url"), F.col("sha"), F.col("copy")]
    main_id = _urn(F.lit("capture"), *me)
    leader_id = _urn(F.lit("capture"), F.col("l_page"), F.col("l_url"), F.col("sha"), F.lit(1))
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1), F.lit("")), F.lit("unknown"))
    target = F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "")
    ask = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    fields = F.concat(
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF))).otherwise(F.lit("")),
        F.lit("copy: "), F.col("copy").cast("string"), F.lit(CRLF),
    )
    uri = ("WARC-Target-URI", F.nullif(F.col("url"), F.lit("")))
    records = F.array(
        _record("request", _urn(F.lit("request"), *me), [uri, ("WARC-Concurrent-To", main_id)], "application/http; msgtype=request", ask, date),
        _record(
            F.when(F.col("revisit"), "revisit").otherwise("response"), main_id,
            [uri, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(F.col("revisit"), leader_id)), ("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE)))],
            "application/http; msgtype=response", F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("body"))), date),
        _record("metadata", _urn(F.lit("metadata"), *me), [uri, ("WARC-Concurrent-To", main_id)], "application/warc-fields", fields, date),
    )
    out = rows.select(F.explode(records).alias("value"))
    mean = names.agg(F.avg("n_bytes")).first()[0] or 0
    per_file = 3 * max(1, min(FILE_RECORDS // 3, int(FILE_BYTES / (mean + 1000))))
    out.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed archive stream; blocks are cut by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers = {}
        while h := stream.readline().rstrip(b"\r\n"):
            name, _, value = h.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        block = stream.read(n := int(headers["content-length"]))
        if len(block) < n:
            raise ValueError("the last record is cut off")
        yield headers, block


RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, computed_digest string, payload_bytes long, head string, payload binary"
)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archive files under path, gzipped or not. head holds an HTTP head or metadata fields, payload what follows the
    HTTP head; payload_digest is the header's, computed_digest that of a response's payload as it was read.

    A file is unpacked record by record and handed on FRAME_BYTES at a time, so a task holds a packed file, a frame and one record.
    """
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def rows(content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        for h, block in parse_records(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw):
            http = h.get("content-type", "").startswith("application/http")
            head, _, payload = block.partition(b"\r\n\r\n") if http else (block, b"", b"")
            computed = base64.b32encode(hashlib.sha1(payload).digest()).decode() if h["warc-type"] == "response" else None
            yield (
                h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                h.get("content-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, computed,
                len(payload), head.decode("utf-8", "replace"), payload if with_payload else None,
            )

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                out, held = [], 0
                for row in rows(content):
                    out.append(row)
                    held += row[9] if with_payload else 0
                    if held >= FRAME_BYTES or len(out) >= FRAME_RECORDS:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit record): record_id, capture, request, metadata, n_requests, n_metadata.

    Requests and metadata join the capture that they name in WARC-Concurrent-To; metadata may also name the capture's request. Of several
    the first by record id is nested, the counts tell of the others. Captures without either keep nulls; requests and metadata of no
    capture don't appear. Repeated record ids count once.
    """
    main = records.where("type in ('response', 'revisit')").dropDuplicates(["record_id"])
    main = main.select("record_id", F.struct("type", "refers_to", "target_uri", "date", "payload_digest", "computed_digest", "payload_bytes", "head", "payload").alias("capture"))

    def attached(kind: str) -> DataFrame:
        return records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("to"), F.struct("record_id", "target_uri", "date", "head").alias("r")).distinct()

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("to").agg(F.min("r").alias(name), F.count(F.lit(1)).alias(f"n_{name}")).withColumnRenamed("to", "record_id")

    requests = attached("request")
    through = requests.select(F.col("r.record_id").alias("request_id"), F.col("to").alias("capture_id"))
    meta = attached("metadata").join(through, F.col("to") == F.col("request_id"), "left").select(F.coalesce("capture_id", "to").alias("to"), "r")
    out = main.join(first(requests, "request"), "record_id", "left").join(first(meta, "metadata"), "record_id", "left")
    return out.select(
        "record_id", "capture", "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata")
    )


def capture_pages(captures: DataFrame, page_type: str = "bigint") -> DataFrame:
    """Per capture: page_id (from its metadata), payload_bytes and payload_digest of the full payload as it was read, record_type, refers_to
    (page_id of the response that a revisit refers to) and digest_ok (the capture's header gives that digest). A revisit whose response
    is missing keeps its header's digest and null bytes; its digest_ok is null.

    Only revisits are joined, each to its response; a response that very many refer to is spread over SALTS parts.
    """
    rows = captures.select(
        F.nullif(F.regexp_extract("metadata.head", "(?m)^page-id: ([^\r\n]*)", 1), F.lit("")).cast(page_type).alias("page_id"), "record_id",
        F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to"), F.col("capture.payload_digest").alias("said"),
        F.col("capture.computed_digest").alias("payload_digest"), F.col("capture.payload_bytes").alias("payload_bytes"),
    )
    rows = materialize(rows, "warc-captures")
    full, revisits = rows.where("record_type = 'response'"), rows.where("record_type = 'revisit'")
    target = full.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("full_digest"))
    wanted = revisits.select("to").distinct()
    target = target.join(wanted, "to", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = revisits.drop("payload_bytes", "payload_digest").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    pointed = salted.join(target, ["to", "salt"], "left")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
    own = full.withColumn("refers_to", F.lit(None).cast(page_type)).withColumn("digest_ok", F.col("said") == F.col("payload_digest"))
    other = pointed.withColumn("payload_digest", F.coalesce("full_digest", "said")).withColumn("digest_ok", F.col("said") == F.col("full_digest"))
    return own.select(*names).unionByName(other.select(*names))
