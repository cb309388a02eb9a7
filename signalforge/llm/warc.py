"""WARC derivative builder: a metadata and a plain-text conversion record for every response record.

Both refer to the response by its record id and keep its target URI and date; the metadata
record carries the response's HTTP headers and digests, and names the conversion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps from HTML to text (fixed values): pattern and replacement, in this order.
TEXT_STEPS = (
    (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<head\b.*?</head\s*>", " "),
    (r"(?i)<br\s*/?>|</(p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer)\s*>", "\n"),
    (r"(?s)<[^>]*>", " "),
    (r"&(nbsp|#160);", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;|&apos;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
)
#: Date of records whose source has none.
DATE = "1970-01-01T00:00:00Z"


def plain_text(html: Column) -> Column:
    for pattern, to in TEXT_STEPS:
        html = F.regexp_replace(html, pattern, to)
    return F.btrim(html, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """The same id for the same parts, in the form of a UUID."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of page_id, url, html; null url and html count as empty."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    rows = pages.select("page_id", url.alias("target_uri"), html.alias("payload"), headers.alias("http_headers"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return rows.select(
        "page_id",
        record_id(F.lit("response"), key, F.col("target_uri"), F.sha2("payload", 256)).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        "http_headers",
        "payload",
        digest(F.col("payload")).alias("payload_digest"),
        digest(F.concat("http_headers", "payload")).alias("block_digest"),
    )


def one_line(value: Column) -> Column:
    """Line ends as blanks, so that a value can't begin a header of its own."""
    return F.translate(value, "\r\n", "  ")


def derivatives(sources: DataFrame) -> DataFrame:
    """Two records for each response, linked to it and to each other.

    Input: page_id, record_id, target_uri, date, http_headers, payload, payload_digest,
    block_digest (other columns are ignored). Output: page_id, warc_type, record_id, refers_to,
    concurrent_to, target_uri, date, content_type, source_payload_digest, source_block_digest,
    block, block_digest, content_length, and record, the record as it is written. A payload
    without text gives an empty conversion block. Null texts count as empty. Line ends inside a
    header's value are written as blanks. Repeated responses give repeated records. An
    empty table gives an empty result.
    """
    texts = ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest")
    sources = sources.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])
    rows = sources.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "http_headers",
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"),
        plain_text(F.col("payload")).alias("text"),
        F.btrim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " ")).alias("title"),
        one_line(F.regexp_extract("payload", r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1)).alias("lang"),
        F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a\s[^>]*href="), 0)).alias("links"),
    )
    rows = rows.withColumns(
        {
            "conversion_id": record_id(F.lit("conversion"), F.col("refers_to"), F.sha2("text", 256)),
            "metadata_id": record_id(F.lit("metadata"), F.col("refers_to"), F.sha2("text", 256)),
        }
    )
    fields = F.concat(
        F.lit("source-headers: "),
        one_line(F.replace(F.btrim(F.col("http_headers"), F.lit("\r\n")), F.lit("\r\n"), F.lit(" | "))),
        F.lit("\r\nsource-payload-digest: "),
        F.col("source_payload_digest"),
        F.lit("\r\nsource-block-digest: "),
        F.col("source_block_digest"),
        F.lit("\r\nconversion: "),
        F.col("conversion_id"),
        F.lit("\r\ntitle: "),
        F.col("title"),
        F.lit("\r\nlanguage: "),
        F.col("lang"),
        F.lit("\r\noutlinks: "),
        F.col("links").cast("string"),
        F.lit("\r\ntext-chars: "),
        F.length("text").cast("string"),
        F.lit("\r\n"),
    )

    def made(kind: str, own: str, other: str, content: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            F.col(own).alias("record_id"),
            F.col(other).alias("concurrent_to"),
            F.lit(content).alias("content_type"),
            block.alias("block"),
        )

    both = F.array(
        made("metadata", "metadata_id", "conversion_id", "application/warc-fields", fields),
        made("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", F.col("text")),
    )
    rows = rows.withColumn("made", F.explode(both)).select("*", "made.*")
    rows = rows.withColumns(
        {"block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")}
    )
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        *[
            F.concat(F.lit(f"{name}: "), one_line(F.col(c).cast("string")) if c in ("target_uri", "date") else F.col(c).cast("string"))
            for name, c in (
                ("WARC-Type", "warc_type"),
                ("WARC-Record-ID", "record_id"),
                ("WARC-Refers-To", "refers_to"),
                ("WARC-Concurrent-To", "concurrent_to"),
                ("WARC-Target-URI", "target_uri"),
                ("WARC-Date", "date"),
                ("WARC-Source-Payload-Digest", "source_payload_digest"),
                ("WARC-Block-Digest", "block_digest"),
                ("Content-Type", "content_type"),
                ("Content-Length", "content_length"),
            )
        ],
    )
    return rows.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "concurrent_to",
        "target_uri",
        "date",
        "content_type",
        "source_payload_digest",
        "source_block_digest",
        "block",
        "block_digest",
        "content_length",
        F.concat(header, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"),
    )
