"""WARC derivatives: a metadata record and a plain-text conversion record for each response record.

Both refer to the response by its record id (WARC-Refers-To) and to each other
(WARC-Concurrent-To), carry its target URI and date, and keep the digest of its
payload and its HTTP headers.  Record ids of derivatives are made from the
response's id and the type, so a rerun writes the same records; digests are
labelled SHA-256 in hexadecimal digits.

All steps work on a row by itself: nothing is shuffled.  Markup is taken away by
regular expressions on the JVM that never look past the next ``<``, so broken
markup costs no more than sound markup; character references are decoded in
Arrow batches.

Special cases: a null or empty payload gives a conversion with an empty block;
null URIs, dates and headers are left out of a record; a null record id is made
from the empty string; equal rows give equal records; an empty table gives
none.  An element that is never closed ends with the text.
"""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from escalade.llm.frames import read

# Elements whose content is no text, and elements that begin a new line.
HIDDEN = "script style noscript template title"
BLOCKS = (
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol option p pre section table tbody td tfoot th thead tr ul"
)
CRLF = "\r\n"


@F.pandas_udf(StringType())
def _references(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: entities.unescape(x) if x and "&" in x else x)


def plain_text(html: Column) -> Column:
    """The text that a page shows: block elements on lines of their own, runs of white space as one space."""
    bare = F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<({HIDDEN.replace(' ', '|')})\b[^<>]*>.*?(?:</\1\s*>|\z)", " ")
    lines = F.regexp_replace(bare, rf"(?i)\s*</?(?:{BLOCKS.replace(' ', '|')})\b[^<>]*>\s*", "\n")
    flat = F.regexp_replace(lines, "<[a-zA-Z/!?][^<>]*>", "")
    decoded = _references(flat)
    return F.btrim(F.regexp_replace(F.regexp_replace(decoded, "[ \\t\\f\\r\\x0b\\u00a0]+", " "), " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def record_id(*parts: Column) -> Column:
    """A record id from the digest of ``parts``, in the form of a version 8 UUID."""
    x = F.md5(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(x, 1, 8), F.substring(x, 9, 4), F.concat(F.lit("8"), F.substring(x, 14, 3)), F.concat(F.lit("8"), F.substring(x, 18, 3)), F.substring(x, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def page_responses(pages: DataFrame) -> DataFrame:
    """The response records of raw pages (page_id, url, html); the table has no capture date."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"))
    return pages.select(
        "page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("warc_date"), headers.alias("http_headers"), F.col("html").alias("payload"),
    )


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response (record_id, target_uri, warc_date, http_headers, payload), with the columns ``keep`` in front.

    warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date, content_type, content_length, block_digest,
    source_digest, source_headers and block.
    """
    page = F.coalesce("payload", F.lit(""))
    made = responses.select(
        *keep, F.coalesce("record_id", F.lit("")).alias("refers_to"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"),
        digest(page).alias("source_digest"), F.octet_length(page).alias("source_length"),
        F.regexp_extract(page, "(?is)<title[^<>]*>([^<]*)", 1).alias("title"), F.regexp_extract(page, "(?i)<html\\b[^<>]*\\blang\\s*=\\s*[\"']?([a-zA-Z-]+)", 1).alias("language"),
        plain_text(page).alias("text"),
    )
    made = made.withColumn("title", F.btrim(F.regexp_replace(_references("title"), "\\s+", " ")))
    fields = F.concat(
        F.concat(F.lit("source-payload-digest: "), F.col("source_digest"), F.lit(CRLF), F.lit("source-payload-length: "), F.col("source_length").cast("string"), F.lit(CRLF)),
        F.when(F.col("title") != "", F.concat(F.lit("title: "), F.col("title"), F.lit(CRLF))).otherwise(""),
        F.when(F.col("language") != "", F.concat(F.lit("languages-html: "), F.col("language"), F.lit(CRLF))).otherwise(""),
        F.coalesce(F.concat(F.lit("source-http-headers: "), F.regexp_replace("source_headers", "\r?\n", "\r\n "), F.lit(CRLF)), F.lit("")),
    )
    metadata, conversion = record_id(F.lit("metadata"), F.col("refers_to")), record_id(F.lit("conversion"), F.col("refers_to"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), metadata.alias("record_id"), conversion.alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), conversion.alias("record_id"), metadata.alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = made.select(*keep, "refers_to", "target_uri", "warc_date", "source_digest", "source_headers", F.explode(kinds).alias("r"))
    return rows.select(
        *keep, "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_digest", "source_headers", "r.block",
    )


def record_text(records: DataFrame) -> Column:
    """A record as it stands in a WARC file, but for the last newline."""
    def line(name: str, column: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(column).cast("string"), "[\\r\\n]+", " "), F.lit(CRLF)), F.lit(""))

    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"),
        line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"),
        F.lit(CRLF), F.col("block"), F.lit("\r\n\r"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """Write the records as compressed WARC files, one per partition."""
    records.select(record_text(records).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def op2_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """page_id and the metadata and conversion record of every page."""
    responses = page_responses(read(spark, sf_dir, "pages"))
    return derivatives(responses, keep=("page_id",))
