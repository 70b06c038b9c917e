"""Content-addressed WARC archive.

An archive has two tables below one folder.  ``payloads`` holds the bytes of each distinct
payload once, under its SHA-256 digest.  ``records`` holds the exact header block of each
record and that digest.  Joined by digest they give back each record byte for byte.

* Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id
  is a ``response``; the others are ``revisit`` records, which carry no payload and name
  that record.  Smaller payloads are all in responses.
* Which record is first is decided on digests alone, grouped with pre-aggregation, so a
  payload that a third of all pages share moves as one row per task.  Payload bytes are
  shuffled once, when records are put together again; records of a payload that more than ``PART_RECORDS`` of them
  share are dealt into parts, each of which gets a copy of the payload then.
* Reading back computes both digests of each stored payload again and fails if one differs.

A null html is an empty payload, a null url an empty target; rows without page_id are archived
with the id ``null`` and are never referred to unless no other row has the payload.
Rows that repeat the page_id and payload of a response are responses too, whose payload is
still stored once.  Texts of any length are kept whole.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import bounded, stored
from bazaar.session import shared_path

LEAST_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
#: A list of revisits of so many rows at most (five short columns) is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Records of one payload that are put together in one place, on average, at most.
PART_RECORDS = 1000
_END = "\r\n"
_RECORD_END = _END * 2


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five bytes of the digest at a time make eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    """A name-based UUID of the page id."""
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"),
                    F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _headers() -> Column:
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    plain = F.regexp_replace(F.col("url"), r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(plain, F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
        .otherwise(""),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.coalesce(F.col("refers_to").cast("string"), F.lit("null")))))
        .otherwise(""),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, line("X-Refers-To-Page-Id", F.coalesce(F.col("refers_to").cast("string"), F.lit("")))).otherwise(""),
        F.lit("Content-Type: text/html;charset=utf-8" + _END),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(_END))


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> str:
    """Archive ``pages`` (page_id, url, html); returns the folder (a new shared one if none is given)."""
    path = path or shared_path(pages.sparkSession, "warc", uuid.uuid4().hex)
    rows = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
            .select("*", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes")))
    repeated = stored(rows.groupBy("sha256").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                      .where("n > 1").select("sha256", "first", F.lit(True).alias("shared"),
                                              F.ceil(F.col("n") / PART_RECORDS).cast("int").alias("n_parts")), "shared-payloads")
    repeated = F.broadcast(repeated) if bounded(repeated, BROADCAST_ROWS) else repeated
    rows = rows.join(repeated, "sha256", "left")
    is_first = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    response = is_first | (F.col("bytes") < least_bytes)
    typed = (rows.withColumn("record_type", F.when(response, "response").otherwise("revisit"))
             .withColumn("refers_to", F.when(~response, F.col("first"))).withColumn("sha1", base32_sha1(F.col("payload"))))
    parts = F.coalesce("n_parts", F.lit(1)).alias("parts")
    part = F.pmod(F.xxhash64("page_id", "url"), parts).cast("int").alias("part")
    typed.select("sha256", part, _headers().alias("header")).write.parquet(f"{path}/records")
    alone = rows.where("shared is null").select("sha256", parts, "payload")
    once = rows.where(F.col("shared") & is_first).select("sha256", parts, "payload").dropDuplicates(["sha256"])
    alone.unionByName(once).write.parquet(f"{path}/payloads")
    return path


def field(name: str) -> Column:
    """The value of a header field, or an empty string.  Lines end with CRLF and nothing else: a url may hold other line separators."""
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of each archived record; the payload of a revisit is that of the record it refers to.

    A stored payload whose SHA-256 differs from its key, or whose SHA-1 from a header that names it, stops the job.
    """
    payloads = spark.read.schema("sha256 string, parts int, payload binary").parquet(f"{path}/payloads")
    sound = F.assert_true(F.sha2("payload", 256) == F.col("sha256"), "a stored payload does not have its digest")
    payloads = payloads.where(F.coalesce(sound.cast("boolean"), F.lit(True)))
    payloads = payloads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    records = spark.read.schema("sha256 string, part int, header string").parquet(f"{path}/records")
    named = F.assert_true(F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))) == field("WARC-Payload-Digest"),
                          "a payload does not have its digest in the header")
    return records.join(payloads, ["sha256", "part"]).where(F.coalesce(named.cast("boolean"), F.lit(True))).select("header", "payload")


def record_bytes() -> Column:
    """The record as it stands in a WARC file, from the columns of ``read_archive``."""
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header").cast("binary"), body, F.lit(_RECORD_END.encode()))


def export_warc(spark: SparkSession, path: str, out: str, records_per_file: int = 2000) -> None:
    """Write an archive as .warc files: the end of a record is the line separator of Spark's text writer."""
    record = F.concat("header", F.when(field("WARC-Type") == "response", F.decode("payload", "UTF-8")).otherwise(""))
    (read_archive(spark, path).select(record.alias("value")).write.option("lineSep", _RECORD_END)
     .option("maxRecordsPerFile", records_per_file).text(out))


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """(header, payload) of each record of exported files; the payload of a revisit is empty."""
    def each(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                headers, payloads, at = [], [], 0
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", content[at:end])[1])
                    headers.append(content[at:end].decode())
                    payloads.append(content[end:end + size])
                    at = end + size + 4
                yield pa.RecordBatch.from_pydict({"header": headers, "payload": payloads},
                                                 schema=pa.schema([("header", pa.string()), ("payload", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out).select("content")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return files.mapInArrow(each, "header string, payload binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archive back: what each record and its payload say."""
    back = read_archive(pages.sparkSession, write_archive(pages))
    number = lambda name: F.when(field(name) != "", field(name).cast("long"))
    return back.select(
        number("X-Page-Id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), field("WARC-Type").alias("record_type"),
        number("X-Refers-To-Page-Id").alias("refers_to"),
        field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
