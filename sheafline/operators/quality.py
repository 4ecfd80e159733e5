"""Image quality and the decisions made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.geometry import aspect, union_box
from sheafline.sources.config import Gate

MIN_SHORT_SIDE, MIN_TEXT_HEIGHT = 1200, 16.0


def worst_of(metas: DataFrame, ref: str = "ref", min_short: int = MIN_SHORT_SIDE, min_height: float = MIN_TEXT_HEIGHT) -> DataFrame:
    """Each request's quality, by its worst image.

    Sides of 0 or null are unknown; low_legibility is null where no height is known. A
    threshold of 0 turns its flag off.
    """
    side = lambda c: F.min(F.nullif(F.col(c), F.lit(0)))
    out = metas.groupBy(ref).agg(
        side("input_long_side").alias("input_long_side"), side("input_short_side").alias("input_short_side"),
        F.min("median_text_height_px").alias("h"), F.coalesce(F.max(F.coalesce(F.nullif("legibility_zoom_ratio", F.lit(0.0)), F.lit(1.0))), F.lit(1.0)).alias("legibility_zoom_ratio"))
    low_res = F.lit(min_short > 0) & F.coalesce(F.col("input_short_side") < min_short, F.lit(False))
    return out.select(
        ref, "input_long_side", "input_short_side", low_res.alias("low_res_input"), F.bround("h", 1).alias("median_text_height_px"),
        (F.when(F.lit(min_height > 0), F.col("h") < min_height)).alias("low_legibility"), "legibility_zoom_ratio")


def of_image(long_side: Column, short_side: Column, text_height: Column, zoom: Column, min_short: int = MIN_SHORT_SIDE, min_height: float = MIN_TEXT_HEIGHT) -> Column:
    """What worst_of() says of a request with one image, as a struct."""
    return F.struct(
        long_side.alias("input_long_side"), short_side.alias("input_short_side"), (F.lit(min_short > 0) & (short_side < min_short)).alias("low_res_input"),
        F.bround(text_height, 1).alias("median_text_height_px"), F.when(F.lit(min_height > 0), text_height < min_height).alias("low_legibility"), zoom.alias("legibility_zoom_ratio"))


def gate(polys: Column, text_height: Column, blur: Column, settings: Gate = Gate(), digital: Column | None = None) -> Column:
    """readable, marginal or unreadable, by the thresholds of the gate settings; digital pages always are readable."""
    bad = (polys < settings.unreadable_min_polys) | F.coalesce((text_height < settings.unreadable_text_h) & (blur < settings.unreadable_blur), F.lit(False))
    poor = F.coalesce(text_height < settings.marginal_text_h, F.lit(False)) | (blur < settings.marginal_blur)
    verdict = F.when(bad, F.lit("unreadable" if settings.reject_enabled else "marginal")).when(poor, F.lit("marginal")).otherwise(F.lit("readable"))
    return verdict if digital is None else F.when(digital, F.lit("readable")).otherwise(verdict)


def reject_reason(polys: Column, text_height: Column, blur: Column, settings: Gate = Gate()) -> Column:
    """Why a page is unreadable, in the words that callers read (fixed values); null for other pages."""
    few = F.format_string(f"no_text_detected(n_polys=%d<{settings.unreadable_min_polys})", polys)
    lost = F.format_string(f"text_unrecoverable(text_h=%.1fpx<{settings.unreadable_text_h}, blur=%.0f<{settings.unreadable_blur})", F.bround(text_height, 1), F.bround(blur, 0))
    return F.when(polys < settings.unreadable_min_polys, few).when((text_height < settings.unreadable_text_h) & (blur < settings.unreadable_blur), lost)


def route(flat_frac: Column, bg_peak: Column, flat_min: float = 0.40, peak_min: float = 0.20) -> Column:
    return F.when((flat_frac >= flat_min) & (bg_peak >= peak_min), F.lit("digital")).otherwise(F.lit("photo"))


def votes(df: DataFrame, group: list[str], upside: str, top: int = 5, order: str = "area") -> DataFrame:
    """(group, upside, total) of the largest `top` crops; crops without a verdict do not count."""
    from pyspark.sql import Window as W

    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(order), "pos"))).where(F.col("__r") <= top)
    return ranked.groupBy(*group).agg(F.count_if(F.col(upside)).alias("upside"), F.count(upside).alias("total"))


def variant_choice(base: Column, other: Column, least: float = 0.02) -> Column:
    """photometric where its mean score is enough better."""
    return F.when(other - base >= least, F.lit("photometric")).otherwise(F.lit("minimal"))


def cardinal(ratio: Column, label: Column, vote: dict[int, tuple[Column, Column]] | None, trigger: float = 0.6, sure: float = 0.9) -> Column:
    """Quarter turns counter-clockwise that set a page upright.

    ratio: share of standing polygons. label: the page model's turn in degrees as text,
    or null. vote: (upside, total) of the line model at 0, 1 and 3 quarters; None without it.
    """
    doc = F.coalesce(F.when(label == "90", F.lit(1)).when(label == "180", F.lit(2)).when(label == "270", F.lit(3)), F.lit(0))
    odd = doc.isin(1, 3)
    most = lambda q: (vote[q][1] > 0) & (vote[q][0] > vote[q][1] / 2)
    if vote is None:
        sideways, upright = F.when(odd, doc).otherwise(F.lit(1)), F.when(doc == 2, F.lit(2)).otherwise(F.lit(0))
    else:
        seen = F.when(doc == 1, most(1)).otherwise(most(3))
        one, three = vote[1][1] - vote[1][0], vote[3][1] - vote[3][0]
        brute = F.when(one > three, F.lit(1)).when(three > one, F.lit(3)).when(odd, doc).otherwise(F.lit(1))
        sideways = F.when((ratio >= sure) & odd, F.when(seen, F.lit(4) - doc).otherwise(doc)).otherwise(brute)
        upright = F.when(((doc == 2) | label.isNull()) & most(0), F.lit(2)).otherwise(F.lit(0))
    return F.when(ratio >= trigger, sideways).otherwise(upright)


def turns_to_ask(ratio: Column, label: Column, trigger: float = 0.6, sure: float = 0.9) -> Column:
    """The quarter turns at which cardinal() needs the line model's vote, as an array; null where it needs none."""
    doc = F.when(label == "90", F.lit(1)).when(label == "270", F.lit(3))
    sideways = F.when((ratio >= sure) & doc.isNotNull(), F.array(doc)).otherwise(F.array(F.lit(1), F.lit(3)))
    return F.when(ratio >= trigger, sideways).when((label == "180") | label.isNull(), F.array(F.lit(0)))


def deskew(tilt: Column, least: float = 0.5, most: float = 45.0) -> Column:
    """struct(degrees, decision): the turn to make, or why there is none."""
    why = F.when(tilt.isNull(), F.lit("insufficient_samples")).when(F.abs(tilt) > most, F.lit("capped")).when(F.abs(tilt) < least, F.lit("below_min")).otherwise(F.lit("applied"))
    return F.struct(F.when(why == "applied", tilt).otherwise(F.lit(0.0)).alias("degrees"), why.alias("decision"))


def localize(polys: Column, width: Column, height: Column, padding: int = 20, min_polys: int = 7, min_coverage: float = 0.12, most_inflation: float = 1.5, many: int = 50) -> Column:
    """struct(box, decision): the crop around a page's text, or null where it cannot be trusted.

    A crop that would distort the page's shape too much, without many polygons to show
    for it, is made along the longer side only.
    """
    tight, box, n = union_box(polys, width, height), union_box(polys, width, height, padding), F.size(polys)
    covered = ((tight["x2"] - tight["x1"]) * (tight["y2"] - tight["y1"])) / F.greatest(F.lit(1), width * height)
    trusted = (n >= min_polys) & (covered >= min_coverage)
    grown = aspect(box["x2"] - box["x1"], box["y2"] - box["y1"]) / F.greatest(F.lit(1e-6), aspect(width, height))
    long = (grown > most_inflation) & (n < many)
    tall = height >= width
    pick = lambda name, across, full: F.when(long & across, full).otherwise(box[name]).alias(name)
    crop = F.struct(pick("x1", tall, F.lit(0)), pick("y1", ~tall, F.lit(0)), pick("x2", tall, width), pick("y2", ~tall, height))
    return F.struct(F.when(trusted, crop).alias("box"), F.when(~trusted, F.lit("low_trust")).when(long, F.lit("long_axis_only")).otherwise(F.lit("crop")).alias("decision"))


def journal(stages: Column) -> Column:
    """(name -> struct(ms, ...)) stage map as struct(total_ms, stages with ms to one decimal)."""
    total = F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, s: a + s["elapsed_ms"])
    return F.struct(F.bround(total, 1).alias("total_ms"), F.transform_values(stages, lambda k, s: F.bround(s["elapsed_ms"], 1)).alias("stages"))


#: Keys of an image's meta that results carry (fixed values).
META_KEYS = (
    "reflow_applied", "n_columns", "input_long_side", "input_short_side", "median_text_height_px", "legibility_zoom_ratio", "legibility_capped",
    "text_h_at_output_px", "verdict", "reject_reason", "route", "quality", "stages", "total_ms",
)


def whitelist(meta: Column) -> Column:
    """A string map's known keys that have a value."""
    return F.map_filter(meta, lambda k, v: k.isin(*META_KEYS) & v.isNotNull())
