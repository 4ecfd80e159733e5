"""User-maintained pattern lists as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import normalize_for_match, strip
from sheafline.operators.postprocess import parse_entry


def split_lines(lines: DataFrame, order: str = "line_no", text: str = "value") -> DataFrame:
    """(ord, pattern) of a list's lines: blank and ``#`` lines are skipped, commas split."""
    kept = lines.withColumn("__t", strip(F.col(text))).where((F.col("__t") != "") & ~F.col("__t").startswith("#"))
    parts = kept.select(order, F.posexplode(F.split("__t", ",")).alias("__k", "__p")).withColumn("pattern", strip(F.col("__p"))).where("pattern <> ''")
    return parts.select(F.struct(order, "__k").alias("ord"), "pattern")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(ord, pattern, pattern_norm) of a pattern file; a missing file is an empty list.

    The whole file is one row, so that lines keep their numbers; lists are small.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as error:  # an absent list is allowed, anything else is not
        if "PATH_NOT_FOUND" not in str(error):
            raise
        whole = spark.createDataFrame([], "value string")
    lines = whole.select(F.posexplode(F.split("value", "\\r\\n|[\\r\\n]")).alias("line_no", "value"))
    return split_lines(lines).withColumn("pattern_norm", normalize_for_match(F.col("pattern")))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """(ord, alias_norm, canonical) of a file of canonical names."""
    entries = read_patterns(spark, path).withColumn("e", parse_entry(F.col("pattern"))).where("e IS NOT NULL")
    return entries.select("ord", "e.alias_norm", "e.canonical")
