"""Shared helpers: small Arrow batches, lookups that do not shuffle texts, components of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.scratch import discard, materialize, settled, shared_dir
from sheafline.shipping import ship

__all__ = ["among", "components", "discard", "keyed", "marked", "numbered", "materialize", "settled", "shared_dir", "ship", "small_batches", "table", "without"]


ship(__name__)

#: Keys (longs) that are broadcast at most, and 64-bit words of the bit table that stands in for more of them.
BROADCAST_KEYS, BIT_WORDS = 1 << 20, 1 << 20


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after its session's Arrow batches are held to `rows` rows.

    Batches are counted in rows, not bytes, and texts may be long: the default of 10,000
    rows takes hundreds of MB in the JVM and again in Python. A smaller setting stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(*columns: str) -> Column:
    """A non-null string key of nullable columns; null and '' stay different."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))


def bit_table(keys: DataFrame) -> DataFrame:
    """(__slot, __bits): one bit for each key of keys (one long column), in BIT_WORDS words at most."""
    word, bit = place_of(F.col(keys.columns[0]))
    return keys.select(word.alias("__slot"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("__slot").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("__bits"))


def place_of(key: Column) -> tuple[Column, Column]:
    """The word of the bit table that a key falls into, and its bit there."""
    mixed = F.xxhash64(key, F.lit(17))
    return F.pmod(mixed, F.lit(BIT_WORDS)).cast("int"), F.shiftrightunsigned(mixed, 58).cast("int")


def marked(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows with `__maybe`: false where key is certainly not among keys. A broadcast of bounded size, no shuffle."""
    word, bit = place_of(key)
    rows = rows.withColumns({"__slot": word, "__bit": bit}).join(F.broadcast(bit_table(keys)), "__slot", "left")
    return rows.withColumn("__maybe", F.coalesce(F.expr("shiftright(__bits, __bit) & 1L") == 1, F.lit(False))).drop("__slot", "__bit", "__bits")


def among(rows: DataFrame, keys: DataFrame, n: int, on: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows whose `on` (long) is in keys (one column `on`, n rows at most, no repeats).

    Up to `most` keys are broadcast. Beyond that, rows that the keys' bit table rules out
    are gone before the others are shuffled.
    """
    if n <= most:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return marked(rows, F.col(on), keys).where("__maybe").drop("__maybe").join(keys, on, "left_semi")


def without(rows: DataFrame, dropped: DataFrame, on: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows whose `on` (long, not null) is not in dropped (one column), all columns unchanged.

    Up to `most` keys are broadcast. Beyond that, only rows that the bit table of dropped
    cannot clear are shuffled to be looked up.
    """
    dropped = materialize(dropped.toDF(on).distinct())
    if dropped.count() <= most:
        return rows.join(F.broadcast(dropped), on, "left_anti")
    looked = marked(rows, F.col(on), dropped)
    unclear = looked.where("__maybe").drop("__maybe").join(dropped, on, "left_anti")
    return looked.where("NOT __maybe").drop("__maybe").unionByName(unclear).select(rows.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a `__row` long of its own for each row, written once so that it stays the same."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: component is the smallest node reachable.

    edges: a long, b long, in either direction, repeats and loops allowed.
    Alternates large-star and small-star steps until every link leads to a node that no
    link leaves; every step is two shuffles of the links. A count and a checksum reach
    the driver; where they stand still, the end is looked at link by link.
    """
    def canonical(df: DataFrame) -> DataFrame:
        lo, hi = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
        return df.where("a <> b").select(hi, lo).distinct()

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    def settled(df: DataFrame) -> bool:
        """Whether the links are stars: each node has one link, and none to a node that has one."""
        ends = df.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).union(df.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return ends.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()

    now = materialize(canonical(edges), edges.count())
    state = signature(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = canonical(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = materialize(canonical(small), 2 * state[0])
        discard(now)
        now, before, state = after, state, signature(after)
        if state == before and settled(now):
            break
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
