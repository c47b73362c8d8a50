"""WARC (operator 1): a content-addressed archive.

``write_archive`` keeps two tables: every distinct payload once, under its
SHA-256 digest, and the exact header bytes of every record with that digest.
Equal digests are verified (one SHA-1 and one length each) when payloads are
merged.  ``read_archive`` joins the two, parses the headers, checks payloads
against them and rebuilds the original records byte by byte.

Which record is the response of a payload is decided on (digest, id) rows with
map-side maxima; payload bytes move once to be stored and once to be read.

Defined cases: a null payload is empty; a null url has no target line and is read
back as null, an empty one as empty; control characters of a url are percent-encoded
in its target line, and such a url stands in full, as hex, in a line of its own, from
which it is read back; records whose payload is
shorter than ``min_bytes`` are all responses; of repeated rows with the largest
id each is a response; a null id is a revisit unless all ids are null; an empty
table gives an archive without records; extra columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtq.llm.queries import register, table
from rtq.session import scratch_path

CRLF = "\r\n"
VERSION = "WARC/1.1"
CONTROL = r"[\x00-\x1F\x7F]"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_text: Column, digits: int = 40) -> Column:
    """Upper-case base32 of bytes given as hex (a multiple of 10 digits: 5 bytes to 8 letters)."""
    parts = [F.lpad(F.conv(F.substring(hex_text, i, 10), 16, 32), 8, "0") for i in range(1, digits, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def write_archive(records: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, date: Column | None = None) -> None:
    """Store ``records`` under ``path``: tables ``payloads`` and ``headers``.  ``date``
    is the WARC-Date of the records, the time of writing unless given."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = records.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"key": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload").cast("long")})
    # Payload bytes once per digest; a digest with two lengths or two SHA-1s is no address.
    one = rows.withColumn("sha1", F.sha1("payload")).groupBy("key").agg(
        F.first("payload").alias("payload"), F.min("sha1").alias("sha1"), F.max("sha1").alias("_sha1"),
        F.min("bytes").alias("bytes"), F.max("bytes").alias("_bytes"))
    checked = F.when((F.col("sha1") == F.col("_sha1")) & (F.col("bytes") == F.col("_bytes")), F.col("payload")).otherwise(
        F.raise_error(F.lit("different payloads share a digest")).cast("binary"))
    one.select("key", checked.alias("payload")).write.option("compression", "zstd").parquet(path + "/payloads")
    keys = rows.select("id", "url", "key", "bytes", F.sha1("payload").alias("sha1"))
    response = keys.groupBy("key").agg(F.max("id").alias("response"))
    heads = keys.join(response, "key")
    first = (F.col("bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("response"))
    odd = F.col("url").rlike(CONTROL)
    encoded = F.array_join(F.transform(F.split("url", ""), lambda c: F.when(
        c.rlike(CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(F.encode(c, "UTF-8")), 2, "0"))).otherwise(c)), "")
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp() if date is None else date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", F.when(odd, encoded).otherwise(F.col("url"))),
        _line("Target-Hex", F.when(odd, F.hex(F.encode("url", "UTF-8")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _line("WARC-Profile", F.when(~first, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(~first, F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(first, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF))
    heads.select("id", header.cast("binary").alias("header"), "key").write.option("compression", "zstd").parquet(path + "/headers")


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\r\n){name}: {pattern}\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: id, url, record_type, refers_to, payload (in full, also of
    a revisit), payload_digest, the stored ``header`` and the exact ``record`` bytes."""
    heads, payloads = spark.read.parquet(path + "/headers"), spark.read.parquet(path + "/payloads")
    kind = dict(heads.dtypes)["id"]
    rows = heads.join(payloads, "key")
    rows = rows.withColumns({
        "record_type": _field("WARC-Type", "([a-z]+)"), "stated": _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)"),
        "_target": _field("WARC-Target-URI", r"([^\r\n]*)"), "_hex": _field("Target-Hex", "([0-9A-F]+)"),
        "_has": F.col("header").cast("string").contains(CRLF + "WARC-Target-URI: "), "_ref": _field("WARC-Refers-To", "<urn:page:([^>]*)>"),
        "_id": _field("WARC-Record-ID", "<urn:page:([^>]*)>"), "digest": base32(F.sha1("payload"))})
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return rows.select(
        F.nullif("_id", F.lit("")).cast(kind).alias("id"),
        F.when(F.col("_hex") != "", F.decode(F.unhex("_hex"), "UTF-8")).when(F.col("_has"), F.col("_target")).alias("url"), "record_type", F.nullif("_ref", F.lit("")).cast(kind).alias("refers_to"),
        "payload", F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(
            F.raise_error(F.lit("a payload differs from its record's digest"))).alias("payload_digest"),
        "header", F.concat(F.col("header"), body, F.lit(CRLF * 2).cast("binary")).alias("record"))


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(html), {g}, 10))::BIGINT >> {s}) & 31) + 1)::INT, 1)"
                   for g in range(1, 40, 10) for s in range(35, -1, -5))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM r
"""


@register("op1_warc", ORACLE)
def op1_warc(spark, sf_dir):
    path = scratch_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    back = read_archive(spark, path)
    return back.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                       "payload_digest", "record_type", "refers_to")
