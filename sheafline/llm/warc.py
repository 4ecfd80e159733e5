"""WARC archives with revisit resolution.

Headers (not payloads) are shuffled by payload digest to find each payload's first
record; the others become revisit records that refer to it. What the headers say comes
back to the payloads by a broadcast of bounded size; only where there are more repeated
digests than that, payloads that may be repeated are shuffled, and no others. Archives
are written by Spark's own text writer: a record is text, and the two line ends after
it are the line separator, so the files are valid WARC and the commit protocol covers
them. Reading goes by Content-Length and joins revisits to their originals.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm.common import discard, marked, materialize, ship
from sheafline.scratch import delete, scratch_path

ship(__name__)

CRLF = "\r\n"
#: Payload bytes from which on records have archives of their own, and how many rows such an archive is taken from:
#: a file is read as one row, and has some 64 MB at most or a single record.
ARCHIVES = ((0, 1000), (1 << 16, 64), (1 << 20, 4), (1 << 24, 1))
#: Digests that are broadcast at most (some 20 MB).
BROADCAST_DIGESTS = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 column in hex: five hex digits are four letters."""
    letters = []
    for k in range(1, 41, 5):
        part = F.conv(F.substring(hex_digest, k, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(part, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, first) of every payload of least_bytes or more that several records have."""
    of = pages.where(F.col("payload_bytes") >= least_bytes).groupBy("digest")
    return of.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def with_first(rows: DataFrame, firsts: DataFrame, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """rows with `first`, looked up in firsts (digest, first), a scratch table, by digest; null where it lacks it."""
    if firsts.count() <= most:
        return rows.join(F.broadcast(firsts), "digest", "left")
    looked = marked(rows, F.xxhash64("digest"), firsts.select(F.xxhash64("digest")))
    unclear = looked.where("__maybe").drop("__maybe").join(firsts, "digest", "left")
    return unclear.unionByName(looked.where("NOT __maybe").drop("__maybe").withColumn("first", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> None:
    """One WARC record for each row of pages (page_id, url, html), at path, in folders by payload size and stretches of rows.

    Pages are read twice: for their headers, and to be written in one job. An archive holds
    what a stretch of a task's rows has of one class of payload size.

    Of records with equal payloads of least_bytes or more the one with the smallest
    page_id is a response, others are revisits of it. Rows repeated with that id are
    responses too; a null id counts as larger than any other, and a payload that null
    ids alone have is written out each time. A null html is an empty payload; a null
    url is the page's URN; other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("digest"))
    headers = materialize(rows.select("page_id", "payload_bytes", "digest"))
    firsts = materialize(resolve(headers, least_bytes))
    large = F.coalesce(*(F.when(F.col("payload_bytes") >= least, k) for k, (least, _) in reversed([*enumerate(ARCHIVES)])))
    held = F.get(F.array(*(F.lit(n) for _, n in ARCHIVES)), F.col("class"))
    placed = with_first(rows, firsts).select(large.alias("class"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), record_of(date).alias("value"))
    # The writer puts the separator behind every record, also the last.
    out = placed.select("class", F.floor(F.col("row") / held).alias("stretch"), "value").write.partitionBy("class", "stretch")
    out.option("lineSep", CRLF * 2).option("compression", "none").text(path)
    discard(headers)
    discard(firsts)


def record_of(date: str) -> Column:
    """A record over page_id, url, html, payload_bytes, digest and first."""
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    # A line end inside a url would start a header line of its own.
    url = F.coalesce(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), record_id(F.col("first")), F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit(f"{CRLF}WARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32(F.col("digest")), F.lit(CRLF),
        F.when(again, refers).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def parse(data: bytes):
    """(headers, payload) of every record of an archive; headers' names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = memoryview(data)[end + 4 : end + 4 + int(headers["content-length"])]
        at = end + 4 + len(block)
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')} does not end where its Content-Length says")
        at += 4
        cut = bytes(block[:4096]).index(b"\r\n\r\n") + 4
        headers["http-length"] = re.search(rb"Content-Length: (\d+)", bytes(block[:cut]))[1].decode()
        yield headers, bytes(block[cut:])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, html.

    Revisits have no payload of their own; length and digest are of the full payload.
    Every payload is held against its digest; without payloads, html is null.
    """

    def number(urn):
        text = urn.strip("<>").rpartition(":")[2] if urn else "-"
        return None if text == "-" else int(text)

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for h, payload in parse(content):
                    first = h["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if first else h["warc-payload-digest"].partition(":")[2]
                    if digest != h["warc-payload-digest"].partition(":")[2]:
                        raise ValueError(f"{h['warc-record-id']}: its payload does not match its digest")
                    rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], number(h.get("warc-refers-to")), len(payload) if first else int(h["http-length"]), digest, payload.decode() if first and payloads else None))
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def resolved(records: DataFrame) -> DataFrame:
    """records with what each revisit's original says of the payload: original_bytes, original_digest.

    Both are null where the archives lack the original or its digest is another.
    """
    first = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("original_digest"), F.col("payload_bytes").alias("original_bytes"))
    first = first.where("refers_to IS NOT NULL").dropDuplicates(["refers_to", "original_digest"])
    own = records.withColumn("original_digest", F.col("payload_digest"))
    return own.join(first, ["refers_to", "original_digest"], "left")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back, without payloads.

    Returns page_id, payload_bytes long, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, ".warc")
    write_archives(pages, path, least_bytes)
    records = materialize(read_archives(spark, path, payloads=False).drop("html", "url"))
    delete(spark, path)
    whole = resolved(records)
    bytes_ = F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("payload_bytes"))
    return whole.select("page_id", bytes_.alias("payload_bytes"), F.col("original_digest").alias("payload_digest"), "record_type", "refers_to")
