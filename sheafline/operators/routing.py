"""Which result a request gets: the primary model's, or the text-only fallback's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.loops import dedup_consecutive
from sheafline.scratch import materialize


def trigger(failed: Column, finish_reason: Column, loop_reason: Column, has_data: Column) -> Column:
    """Why a request needs the fallback, the first reason that holds; null if none does."""
    return (
        F.when(failed, F.lit("vlm_upstream_error")).when(finish_reason == "hallu_abort", F.lit("hallu:stream_abort")).when(finish_reason == "length", F.lit("vlm_truncated"))
        .when(loop_reason.isNotNull(), F.concat(F.lit("hallu:"), loop_reason)).when(~has_data, F.lit("empty_response"))
    )


def engine(trigger_: Column, primary_items: Column, primary_has_data: Column, fallback_items: Column, fallback_has_data: Column) -> Column:
    """vllm or paddle: the primary result is kept where the fallback has less to offer."""
    salvage = (trigger_ != "empty_response") & ~fallback_has_data & primary_has_data
    items = trigger_.startswith("hallu:") & (fallback_items == 0) & (primary_items > 0)
    return F.when(trigger_.isNull() | salvage | items, F.lit("vllm")).otherwise(F.lit("paddle"))


def with_fallback(primary: DataFrame, fallback: Callable[[DataFrame], DataFrame], ref: str = "ref", columns: tuple[str, ...] = ("items", "merchant_name", "merchant_address", "transaction_date", "transaction_time", "total_amount"), more: tuple[str, ...] = ()) -> DataFrame:
    """Results of primary, or of the fallback where it is triggered and has more; one for each row of primary.

    primary: ref, columns, `trigger`, `has_data`; more: columns that are passed on. The
    fallback is called with the triggered rows alone and returns `row_id`, columns and
    `has_data`; what it leaves out has no data. Rows are told apart by row_id, so refs may
    be null and repeat. Items of looping results lose their repeats first. The primary
    results are read twice, so they are written to a scratch table: models are called once.
    """
    primary = materialize(primary.withColumn("row_id", F.monotonically_increasing_id()))
    calm = primary.where("trigger IS NULL").select(ref, *columns, *more, F.lit("vllm").alias("engine"), "trigger")
    hit = primary.where("trigger IS NOT NULL").withColumn("items", F.when(F.col("trigger").startswith("hallu:"), dedup_consecutive(F.col("items"))).otherwise(F.col("items")))
    other = fallback(hit)
    other = other.select("row_id", *(F.col(c).alias(f"f_{c}") for c in columns), F.col("has_data").alias("f_has"))
    both = hit.select("row_id", ref, *columns, *more, "trigger", "has_data").join(other, "row_id", "left")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    both = both.withColumn("engine", engine(F.col("trigger"), size("items"), F.col("has_data"), size("f_items"), F.coalesce("f_has", F.lit(False))))
    chosen = [F.when(F.col("engine") == "vllm", F.col(c)).otherwise(F.col(f"f_{c}")).alias(c) for c in columns]
    return calm.unionByName(both.select(ref, *chosen, *more, "engine", "trigger"))


def status_of(error: Column) -> Column:
    """The HTTP status of an error kind; 200 for none."""
    return F.when(error.isNull(), F.lit(200)).when(error.isin("invalid_request", "bad_payload"), F.lit(422)).when(error == "timeout", F.lit(408)).when(
        error == "upstream", F.lit(503)).otherwise(F.lit(500))
