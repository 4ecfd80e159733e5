"""Named queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import has_loop, normalize_for_match
from sheafline.plans import page_queries, receipt_queries, text_queries
from sheafline.plans.base import sql_norm, table

MODULES = (text_queries, receipt_queries, page_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources carry degenerate text: documents by language and source, normalised and checked for loops."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    norm = normalize_for_match(F.col("text"))
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.count_if(has_loop(F.col("text"))).alias("n_looped"), F.sum(F.length(norm)).alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


FLAGSHIP_SQL = text_queries.SQL_LOOPS + f"""
    SELECT lang, source, count(*) AS n_docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM b)) AS n_looped, sum(length({sql_norm('text')}))::BIGINT AS n_chars FROM documents GROUP BY lang, source"""


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | {name: sql for m in MODULES for name, sql in m.SQL.items()}
