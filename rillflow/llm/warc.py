"""A content-addressed WARC archive: payload bytes once, exact record headers apart, records put together again by joins.

An archive is a folder of two Parquet tables. payloads has a row per strong digest (SHA-256), with the bytes; headers has
a row per record: its header block as written, and the digest of its payload. The WARC digest, base-32 SHA-1, stands in
the header block. A payload is checked against its digest when it is read. DataFrame functions only, so that records
stay in the JVM; a digest that many records share is joined as a skewed key, which Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Upper-case base-32 of 40 hex digits: four groups of 40 bits, each 8 digits to base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, header (string), sha256, payload (binary): a WARC record for each row of pages.

    The payload is html in UTF-8; null counts as empty. Of equal payloads of at least `least` bytes, the record with the
    smallest page_id (nulls last) is a response and the others revisit it; shorter ones are all responses. Rows that
    repeat a page_id and payload repeat its record; line breaks in a url are percent-encoded, a null url is left out.
    A payload of any length is one value, which is copied and hashed whole.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", base32(F.sha1("payload")))
    first = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    slim = rows.select("page_id", "url", "sha256", "bytes", "sha1")
    slim = join_groups(slim, first, ["sha256"], F.xxhash64("page_id", "url"))
    again = (F.col("bytes") >= least) & (F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull()))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))

    def urn(page: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", DATE),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn("first_id")), line("WARC-Profile", REVISIT))).otherwise(""),
        line("Content-Type", "text/html; charset=utf-8"),
        # a revisit has no block of its own; the bytes that it stands for are those of its digest
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return slim.select("page_id", head.alias("header"), "sha256")


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes path/headers and path/payloads. Payloads combine before the shuffle, so a hot one is sent once a task."""
    records(pages, least).write.parquet(f"{path}/headers")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    kept = pages.select(payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    kept.groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header and the full payload of each record, and record: the WARC record's bytes, as a file would hold them.

    A payload that isn't what its digest says fails the job.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    met = headers.join(payloads, "sha256", "left")
    sound = F.coalesce(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.lit(False))
    payload = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("an archive payload is missing or damaged")))
    met = met.select("header", payload.alias("payload"))
    block = F.when(F.col("header").contains("\r\nWARC-Type: revisit\r\n"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return met.withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8")))


def field(name: str, column: str = "header") -> Column:
    found = F.regexp_extract(column, f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def describe(records: DataFrame, key: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the rebuilt records.

    A response's payload is cut out of its record by Content-Length; a revisit has none, and stands for the payload that
    its digest led to. The digest is computed from those bytes, and one that isn't the header's fails the job.
    """
    page = lambda name: F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1)
    block = F.substring(F.col("record"), F.octet_length("header") + 1, field("Content-Length").cast("int"))
    read = records.select("header", F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(block).alias("payload"))
    digest = base32(F.sha1("payload"))
    sound = F.concat(F.lit("sha1:"), digest) == field("WARC-Payload-Digest")
    return read.select(
        F.when(page("WARC-Record-ID") != "", page("WARC-Record-ID")).cast(key).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.coalesce(sound, F.lit(False)), digest).otherwise(F.raise_error(F.lit("a record's payload isn't that of its digest"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(page("WARC-Refers-To") != "", page("WARC-Refers-To")).cast(key).alias("refers_to"),
    )
