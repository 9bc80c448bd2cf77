"""A content-addressed web archive: payload bytes once by digest, exact record headers apart, records by joins.

`write` makes two tables below one folder: `headers` (a WARC header block for every page) and `payloads` (bytes by
SHA-256). The first record of a payload, by page_id, is a response; the others are revisits that refer to it. Digests
are computed where the pages are read; the html itself is written straight from that scan unless revisits are too many
to broadcast, when it is shuffled once. `records` joins both tables to the records as they stand in a WARC file (header,
HTTP head, payload); stored bytes are hashed again, and one that does not have the digest that addresses it fails. `read`
takes everything from these rebuilt records: it parses their headers, cuts the payload out of their blocks and hashes it;
a revisit takes its payload from the response that it refers to.

Defined results: a null html is the empty payload; a null url gives no WARC-Target-URI; line ends in urls and page ids are
percent encoded; page ids of any type come back in their type; rows without page_id are responses only if no other row has
their payload; repeated rows are each a record, with the payload stored once; extra columns are ignored. Pages hold no time
of capture, so WARC-Date is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoweave.llm.rows import salted_join, small_or_shuffled
from convoweave.session import cut, new_path, table

#: Digits of Spark's conv to base 32, and the alphabet of RFC 4648.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
HEAD = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END * 2}"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The bare base32 SHA-1, from 5 hexadecimal digits to 4 of base 32 at a time."""
    digest = F.sha1(data)
    parts = (F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def urn(page_id: Column) -> Column:
    """A record's identifier: a UUID (of version 8) that the page id fixes."""
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 13, 3), F.lit("-a"), F.substring(h, 16, 3), F.lit("-"), F.substring(h, 19, 12), F.lit(">"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A")


def escaped(page_id: Column) -> Column:
    return one_line(F.regexp_replace(page_id.cast("string"), "%", "%25"))


def restored(text: Column) -> Column:
    for code, char in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def header_block(date: str) -> Column:
    """The header of a row with page_id, url, record_type, refers_to, payload_digest and payload_bytes."""
    response = F.col("record_type") == "response"
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws(
        END, F.lit("WARC/1.1"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", urn(F.col("page_id"))), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", one_line(F.col("url"))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(~response, field("WARC-Refers-To", urn(F.col("refers_to")))), F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        field("Page-Id", escaped(F.col("page_id"))), F.when(~response, field("Refers-To-Page-Id", escaped(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", (F.when(response, F.col("payload_bytes")).otherwise(0) + len(HEAD)).cast("string")), F.lit(""), F.lit(""),
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Archives page_id, url and html of `pages` below `path`; payloads of under `least_bytes` are never revisited."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    slim = cut(rows.select("page_id", "url", "address", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")))
    first = slim.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("address").alias("_address")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.drop("n"))
    found = salted_join(slim, first, F.col("address") == F.col("_address"), F.xxhash64("page_id", "url"), first.count(), 128)
    revisits = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    found = found.withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("first_id")))
    shared = F.col("first_id").isNotNull().alias("shared")
    found.select("page_id", "record_type", "address", shared, header_block(date).alias("header")).write.parquet(f"{path}/headers")
    headers = pages.sparkSession.read.parquet(f"{path}/headers")
    count, stored = headers.agg(F.count(F.when(F.col("record_type") == "revisit", 1)), F.count(F.when(F.col("record_type") == "response", 1))).first()
    again = headers.where("record_type = 'revisit'").select(F.col("page_id").alias("_id"), F.col("address").alias("_address"))
    kept = rows.join(small_or_shuffled(again, count, 96), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("address") == F.col("_address")), "left_anti")
    kept = kept.select("address", "payload")
    if slim.select("address").distinct().count() < stored:  # repeated rows, or small payloads that are not revisited
        kept = kept.dropDuplicates(["address"])
    kept.write.parquet(f"{path}/payloads")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """address and payload of the stored bytes; reading fails where they do not have their address."""
    sound = F.sha2("payload", 256) == F.col("address")
    right = F.when(sound, F.col("address")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
    return spark.read.parquet(f"{path}/payloads").select(right.alias("address"), "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, shared and record (binary): every record as in a WARC file, header, block and two line ends."""
    headers, end = spark.read.parquet(f"{path}/headers"), F.lit(END * 2).cast("binary")
    head = F.concat(F.col("header").cast("binary"), F.lit(HEAD).cast("binary"))
    responses = headers.where("record_type = 'response'").join(verified(spark, path), "address").select("page_id", "shared", F.concat(head, "payload", end).alias("record"))
    return responses.union(headers.where("record_type = 'revisit'").select("page_id", "shared", F.concat(head, end).alias("record")))


def parsed(rows: DataFrame) -> DataFrame:
    """`rows` (record and others) with record_type, told (the digest in the header), id and refers_id as in the header, and payload."""
    # Cut out on bytes, since payloads need be no text: in ISO-8859-1 every byte is one character.
    size = F.char_length(F.substring_index(F.decode("record", "ISO-8859-1"), END * 2, 1))
    split = rows.withColumn("header", F.substring("record", F.lit(1), size).cast("string"))
    value = lambda name: F.nullif(F.regexp_extract("header", f"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    start = F.octet_length("header") + 2 * len(END) + len(HEAD) + 1
    length = value("Content-Length").cast("long") - len(HEAD)
    return split.select(
        "*", value("WARC-Type").alias("record_type"), F.substring(value("WARC-Payload-Digest"), 6, 32).alias("told"), restored(value("Page-Id")).alias("id"),
        restored(value("Refers-To-Page-Id")).alias("refers_id"), F.substring("record", start, length.cast("int")).alias("payload"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from the rebuilt records alone."""
    rows = records(spark, path)
    kind = rows.schema["page_id"].dataType
    found = parsed(rows).select("shared", "record_type", "told", F.col("id").cast(kind).alias("page_id"), F.col("refers_id").cast(kind).alias("refers_to"), "payload")
    right = F.col("told") == F.col("payload_digest")
    digest = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another payload")))
    hashed = found.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    sound = F.when(F.col("record_type") == "response", digest).alias("payload_digest")
    parts = cut(hashed.select("page_id", "payload_bytes", sound, "record_type", "refers_to", "shared", "told"))  # records are rebuilt once
    responses = parts.where("record_type = 'response'").drop("told")
    # A revisit's payload is that of the response it refers to, whose digest must be the one that its own header tells.
    named = (F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"))
    first = cut(responses.where("shared").groupBy(*named).agg(F.min("payload_bytes").alias("_bytes")))
    same = (F.col("refers_to") == F.col("_id")) & (F.col("told") == F.col("_digest"))
    revisits = salted_join(parts.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "told"), first, same, F.xxhash64("page_id"), first.count(), 128)
    lost = F.coalesce("_bytes", F.raise_error(F.lit("a revisit refers to no record with its payload")).cast("long"))
    told = revisits.select("page_id", lost.alias("payload_bytes"), F.col("told").alias("payload_digest"), "record_type", "refers_to")
    return responses.drop("shared").union(told)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` archived and read back."""
    path = new_path(spark, "archive")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id,
      list_transform(range(0, 32), lambda i: (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS v FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""
}
