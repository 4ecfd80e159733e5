"""Ablation roll-ups over images and pipeline variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Variants by what they change (fixed values); v2_no_zoom turns zoom off.
VARIANTS = {
    "raw": {}, "v2_full": {}, "v2_no_orient": {"orient.enabled": "false"}, "v2_no_localize": {"localize.enabled": "false"}, "v2_no_zoom": {"fit.zoom_target_text_h": "0"},
    "v2_no_reflow": {"fit.reflow_enabled": "false"}, "v2_no_gate": {"gate.enabled": "false"}, "v2_photometric_on": {"photometric.enabled": "true"},
}


def runs(files: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Each file with each variant and the settings it changes: a constant list, so no join."""
    chosen = {k: v for k, v in VARIANTS.items() if only is None or k in only}
    pairs = [F.struct(F.lit(k).alias("variant"), (F.create_map(*(F.lit(x) for kv in v.items() for x in kv)) if v else F.create_map().cast("map<string,string>")).alias("settings")) for k, v in chosen.items()]
    return files.withColumn("__v", F.explode(F.array(*pairs))).select(*files.columns, "__v.variant", "__v.settings")


def proxy_metrics(boxes: DataFrame, image: list[str], most: int = 150, least_side: int = 8) -> DataFrame:
    """Reading quality of each image by its boxes (pos, x1, y1, x2, y2, score, n_chars).

    Box counts and heights are of all boxes; scores and characters of the first `most`
    that are large enough to be read.
    """
    ranked = boxes.withColumn("__r", F.row_number().over(W.partitionBy(*image).orderBy("pos")))
    read = (F.col("__r") <= most) & (F.col("x2") - F.col("x1") >= least_side) & (F.col("y2") - F.col("y1") >= least_side)
    return ranked.groupBy(*image).agg(
        F.count("*").cast("int").alias("n_boxes"), F.bround(F.avg(F.when(read, F.col("score"))), 4).alias("rec_conf_mean"), F.bround(F.median(F.when(read, F.col("score"))), 4).alias("rec_conf_median"),
        F.coalesce(F.sum(F.when(read, F.col("n_chars"))), F.lit(0)).alias("n_chars"), F.bround(F.median(F.col("y2") - F.col("y1")), 1).alias("text_h_at_model_px"))


def summary(rows: DataFrame) -> DataFrame:
    """One row for each variant over rows without an error; a confidence or height of 0 or null does not count."""
    good = rows.where("error IS NULL")
    known = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return good.groupBy("variant").agg(
        F.count("*").alias("n"), F.bround(F.avg(known("rec_conf_mean")), 4).alias("rec_conf_mean"), F.bround(F.avg("n_boxes"), 1).alias("n_boxes_mean"),
        F.bround(F.avg("n_chars"), 1).alias("n_chars_mean"), F.bround(F.median(known("text_h_at_model_px")), 1).alias("text_h_median"),
        F.bround(F.avg("pixels"), 0).alias("pixels_mean"), F.bround(F.avg("latency_ms"), 0).alias("latency_ms_mean"), F.count_if(F.col("resample_by_vllm")).alias("resampled_by_vllm"))
