"""Shared inputs of the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL for Python's white space, which DuckDB's own class does not cover.
SQL_WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_fold(text: str) -> str:
    return f"lower(strip_accents(translate(coalesce({text}, ''), 'đĐ', 'dD')))"


def sql_norm(text: str) -> str:
    return f"trim(regexp_replace({sql_fold(text)}, '{SQL_WS}+', ' ', 'g'))"


def per_order(lines: DataFrame, *columns: Column) -> DataFrame:
    """(l_orderkey, rows): an order's lines, in line order, as structs of columns."""
    packed = F.collect_list(F.struct("l_linenumber", *columns))
    return lines.groupBy("l_orderkey").agg(F.array_sort(packed).alias("rows"))
