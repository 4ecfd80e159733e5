"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source; a row's fractional rank is
its rank, moved on by a seeded part of one that each source has for its own, over the
source's row count. Sorted by fractional rank, every stretch of the table has the
sources in the table's own proportions, so cutting it into equal stretches gives shards
that match the mixture: of a source with n rows, a shard gets n / shards, give or take
a row or two, and sources with fewer rows than shards are spread over all shards.

Both rankings are made from counts of narrow hash buckets and positions inside a
bucket, so no source and no shard passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheafline.llm.common import discard, keyed, materialize, numbered

#: Rows that a bucket has about, and the most hex digits of a bucket's key.
BUCKET_ROWS, MAX_DIGITS = 1 << 10, 5


def positions(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """df with the 0-based position of each row in its group, ordered by bucket and then by order.

    Positions in a bucket are added to the sizes of the buckets before it; only those
    sizes, one row for each bucket, are ordered by group.
    """
    sizes = df.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    over = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1) if group else over
    sizes = sizes.select(*group, bucket, F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)) - 1
    return df.withColumn("__in", inside).join(sizes, [*group, bucket]).withColumn(name, F.col("__before") + F.col("__in")).drop("__in", "__before")


def offset(seed: int) -> Column:
    """Where in (0, 1) the ranks of a stratum begin: so that small strata do not all start alike."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "stratum")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source", row_col: str | None = None) -> DataFrame:
    """A shard and a slot for every row of docs, under the law ``rows``: shard counts differ by one at most.

    The shuffle is by md5 of seed and id, so it does not depend on partitions. A null
    stratum is a stratum of its own; null texts have size 1 and checksum 0; rows
    repeated with one id are ordered by checksum and size and are alike beyond that.
    Other columns are not read; row_col, a key of rows, is passed on. An empty table gives an empty result.

    The law is one of counts: equal texts are rows like any other and may fall into
    different shards, as a shard that had to hold all copies could not keep its count.

    Returns doc_id, size long, text_crc32 long, law, shard int, slot long from 0
    without gaps, grown_shard int (null: this law moves rows when shards are added).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [row_col] if row_col else []
    rows = materialize(docs.select(
        *row, F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        keyed(stratum).alias("stratum"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")))).alias("mix"),
    ))
    total = rows.count()
    digits = 1
    while digits < MAX_DIGITS and total >> (4 * digits) > BUCKET_ROWS:
        digits += 1
    ties = [F.col("mix"), F.col("doc_id"), F.col("text_crc32"), F.col("size"), *row]
    ranked = positions(rows.withColumn("bucket", F.substring("mix", 1, digits)), ["stratum"], "bucket", ties, "rank")
    size = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    cells = 16**digits
    ranked = ranked.join(size, "stratum").withColumn("fraction", (F.col("rank") + offset(seed)) / F.col("n"))
    ranked = materialize(ranked.withColumn("stretch", F.floor(F.col("fraction") * cells)).drop("bucket", "rank", "n"), total)
    discard(rows)
    placed = positions(ranked, [], "stretch", [F.col("fraction"), F.col("stratum"), *ties], "place")
    shard = F.floor(F.col("place") * shards / max(total, 1)) if total < 1 << 49 else None
    start = F.ceil(shard * F.lit(total) / shards)
    return placed.select(
        *row, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("place") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """docs as Parquet, a folder for each shard, in slot order. Ids may be null and repeat: rows go by a number of their own."""
    rows = numbered(docs)
    placed = materialize(interleave(rows, shards, row_col="__row", **options).select("__row", "shard", "slot"))
    joined = rows.join(placed, "__row").drop("__row")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    discard(placed)
    discard(rows)
