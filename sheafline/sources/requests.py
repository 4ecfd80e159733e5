"""Request payloads: validation, base64 and size checks, reference ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import strip

MAX_IMAGES, MAX_BYTES = 1, 50_000_000


def violations(urls: Column, base64s: Column) -> Column:
    """What is wrong with a request's sources: neither, both, or not exactly one image."""
    size = F.coalesce(F.size(F.coalesce(urls, base64s)), F.lit(0))
    checks = {"no_source": urls.isNull() & base64s.isNull(), "two_sources": urls.isNotNull() & base64s.isNotNull(), "wrong_count": (urls.isNull() != base64s.isNull()) & (size != MAX_IMAGES)}
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def decode_base64(text: Column) -> Column:
    """The bytes of base64 text, with or without a data URI in front; null if it is none.

    Characters outside the alphabet are passed over, as lenient decoders do.
    """
    s = strip(text)
    body = F.when(s.startswith("data:"), F.regexp_extract(s, "(?s)^[^,]*,(.*)$", 1)).otherwise(s)
    return F.try_to_binary(F.regexp_replace(body, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))


def payload_error(content: Column, most: int = MAX_BYTES) -> Column:
    """bad_payload for missing, empty or too large payloads; null for good ones."""
    return F.when(content.isNull() | (F.length(content) == 0) | (F.length(content) > most), F.lit("bad_payload"))


def data_uri(content: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(content), "\r\n", ""))


def reference_id(ref: Column, content: Column) -> Column:
    """The given id, or one derived from the payload, so that a rerun gives the same."""
    return F.coalesce(F.nullif(F.nullif(ref, F.lit("N/A")), F.lit("")), F.concat(F.lit("auto-"), F.substring(F.sha2(content, 256), 1, 8)))


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be served, and dead letters with their violations."""
    checked = requests.withColumn("violations", violations(F.col("images_url"), F.col("images_base64")))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
