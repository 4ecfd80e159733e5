"""Image stages of a page: ingest, quality, detect, orient, localize, gate, photometric, fit.

Pixels are touched by Arrow UDFs: one measures a page, one renders it; between them, one
asks the text-line model about pages that may lie, one detects again on pages that were
turned, one scores both lights of marginal pages. They are declared nondeterministic, so
that no plan asks a model twice. Everything that is decided in between is a Column. An
error in a stage is kept in its row; only a page that cannot be ingested stays as it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import budget, geometry
from sheafline.functions.text import let
from sheafline.operators import images, quality
from sheafline.shipping import ship
from sheafline.sources.config import Settings

ship(__name__)

STAGE = "struct<elapsed_ms:double,error:string>"
PAGE = f"struct<width:int,height:int,exif_orientation:int,quality:{images.STATS},polys:{geometry.POLYS},label:string,stages:map<string,{STAGE}>>"
BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
#: The text-line model's answers by quarter turns, and a scorer's means; with what went wrong.
VOTES = "struct<by_quarters:map<int,struct<upside:int,total:int>>,stage:map<string,STAGE>>".replace("STAGE", STAGE)
SCORES = "struct<minimal:double,photometric:double,stage:map<string,STAGE>>".replace("STAGE", STAGE)
#: Pixels that a side of a crop for the scorer has at least.
SCORED_SIDE = 8
#: Pages in an Arrow batch at most.
BATCH = 64
RENDERED = f"struct<content:binary,width:int,height:int,stages:map<string,{STAGE}>>"


def small_batches(pages: DataFrame) -> None:
    """Hold the session to BATCH rows in an Arrow batch: a worker keeps the images, polygons and results of a whole batch."""
    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))


class Journal:
    """Times stages by name and keeps their errors."""

    def __init__(self):
        self.stages: dict[str, dict] = {}

    def run(self, name: str, work: Callable, otherwise=None):
        start, error, out = time.perf_counter(), None, otherwise
        try:
            out = work()
        except Exception as found:
            error = f"{type(found).__name__}: {found}"
        self.stages[name] = {"elapsed_ms": (time.perf_counter() - start) * 1000, "error": error}
        return out


def measured(content: Column, decode: Callable[[], Callable], find: Callable[[], Callable], norm_width: int, digital: Callable[[dict], bool] = lambda quality: False) -> Column:
    """What a payload shows, as PAGE: null sides where it is no image, null quality or polygons where that stage failed.

    decode makes a decoder: bytes -> pixels or None. find makes a detector: pixels -> dict
    of polys (lists of (x, y) pairs) and label (the page model's turn, or None). Pages that
    digital() tells from their quality are no photographs and are not shown to the detector.
    """

    @F.pandas_udf(PAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader, finder = decode(), find()
        for payloads in batches:
            rows = []
            for data in payloads:
                log, row = Journal(), dict.fromkeys(("width", "height", "quality", "polys", "label"))
                row["exif_orientation"] = images.exif_orientation(data)
                image = log.run("ingest", lambda data=data: images.ingest(reader(bytes(data or b"")))[0])
                if image is not None:
                    row["height"], row["width"] = image.shape[:2]
                    row["quality"] = log.run("quality", lambda image=image: images.probe(image, norm_width))
                    found = {} if digital(row["quality"] or {}) else log.run("detect", lambda image=image: finder(image), {})
                    row["polys"], row["label"] = points(found.get("polys")), found.get("label")
                rows.append(row | {"stages": log.stages})
            out = pd.DataFrame(rows, columns=["width", "height", "exif_orientation", "quality", "polys", "label", "stages"])
            yield out.astype({"width": "Int32", "height": "Int32", "exif_orientation": "Int32"})

    return run.asNondeterministic()(content)


def points(polys) -> list | None:
    return None if polys is None else [[{"x": float(x), "y": float(y)} for x, y in p] for p in polys]


def detected_again(content: Column, quarters: Column, decode: Callable[[], Callable], find: Callable[[], Callable]) -> Column:
    """Polygons of a page after its quarter turns; null content is passed over, and so is a page that fails."""

    @F.pandas_udf(geometry.POLYS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        reader, finder = decode(), find()
        for payloads, turns in batches:
            yield pd.Series([
                None if data is None else Journal().run("detect", lambda data=data, q=q: points(finder(images.rotate_quarters(images.ingest(reader(bytes(data)))[0], int(q))).get("polys")))
                for data, q in zip(payloads, turns)
            ], dtype=object)

    return run.asNondeterministic()(content, quarters)


def pixels_of(crops: np.ndarray, box: dict) -> np.ndarray:
    return crops[int(box["y1"]) : int(box["y2"]), int(box["x1"]) : int(box["x2"])]


def line_votes(content: Column, boxes: Column, quarters: Column, decode: Callable[[], Callable], lines: Callable[[], Callable]) -> Column:
    """What the text-line model says of a page's crops, turned by each of quarters, as VOTES; null quarters are passed over.

    lines makes a model: list of crops -> for each whether it stands on its head, or None.
    It is asked once for a page, with the crops of all turns in one batch.
    """

    @F.pandas_udf(VOTES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader, model = decode(), lines()

        def asked(data: bytes, cut: list, turns: list[int]) -> dict:
            image = images.ingest(reader(bytes(data)))[0]
            crops = [images.rotate_quarters(pixels_of(image, box), q) for q in turns for box in cut]
            said = list(model(crops)) if crops else []
            if len(said) != len(crops):
                raise ValueError(f"{len(said)} answers to {len(crops)} crops")
            parts = {q: [x for x in said[k * len(cut) : (k + 1) * len(cut)] if x is not None] for k, q in enumerate(turns)}
            return {q: {"upside": sum(map(bool, of)), "total": len(of)} for q, of in parts.items()}

        for payloads, cuts, turns in batches:
            rows = []
            for data, cut, of in zip(payloads, cuts, turns):
                log = Journal()
                made = None if data is None or of is None else log.run("textline", lambda data=data, cut=cut, of=of: asked(data, list(cut), [int(q) for q in of]))
                rows.append((made, log.stages))
            yield pd.DataFrame(rows, columns=["by_quarters", "stage"])

    return run.asNondeterministic()(content, boxes, quarters)


def light_scores(content: Column, turn: Column, boxes: Column, decode: Callable[[], Callable], score: Callable[[], Callable], settings: Settings) -> Column:
    """How well a page's crops are read as they are and in even light, as SCORES; null content is passed over.

    turn: struct of quarters, degrees and box, as rendered() makes them; boxes lie in what
    that gives. score makes a model: list of crops -> a score for each, or an empty list. It
    is asked once for a page, with the crops of both in one batch.
    """
    light = settings.photometric

    @F.pandas_udf(SCORES)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader, model = decode(), score()

        def means(data: bytes, t: dict, cut: list) -> tuple:
            image = upright(images.ingest(reader(bytes(data)))[0], t)
            crops = [pixels_of(image, box) for box in cut]
            both = crops + [images.even_light(c, light.bg_kernel_frac, light.clahe_clip, light.clahe_grid) for c in crops]
            scores = list(model(both)) if both else []
            return (float(np.mean(scores[: len(crops)])), float(np.mean(scores[len(crops) :]))) if scores and len(scores) == len(both) else (None, None)

        for payloads, turns, cuts in batches:
            rows = []
            for data, t, cut in zip(payloads, turns.to_dict("records"), cuts):
                log = Journal()
                made = (None, None) if data is None or cut is None else log.run("gate", lambda data=data, t=t, cut=cut: means(data, t, list(cut)), (None, None))
                rows.append((*made, log.stages))
            yield pd.DataFrame(rows, columns=["minimal", "photometric", "stage"])

    return run.asNondeterministic()(content, turn, boxes)


def upright(image: np.ndarray, p: dict) -> np.ndarray:
    """A page turned by quarters and degrees and cut to its box."""
    image = images.rotate_quarters(image, int(p["quarters"]))
    image = images.rotate_free(image, float(p["degrees"])) if p["degrees"] else image
    return images.crop(image, *(int(p["box"][k]) for k in ("x1", "y1", "x2", "y2"))) if p["box"] else image


def rendered(content: Column, plan: Column, decode: Callable[[], Callable], encode: Callable[[], Callable], settings: Settings) -> Column:
    """A page turned, cut, evened out and scaled as its plan says, and encoded again, as RENDERED.

    plan: struct of quarters, degrees, box, cuts, even, width, height, pad. A step that
    fails is left out. encode makes an encoder: pixels -> bytes.
    """
    fit, light = settings.fit, settings.photometric

    def steps(image: np.ndarray, p: dict, log: Journal) -> np.ndarray:
        image = log.run("orient", lambda: images.rotate_free(images.rotate_quarters(image, int(p["quarters"])), float(p["degrees"])) if p["degrees"] else images.rotate_quarters(image, int(p["quarters"])), image)
        if p["box"]:
            image = log.run("localize", lambda: images.crop(image, *(int(p["box"][k]) for k in ("x1", "y1", "x2", "y2"))), image)
        if p["even"]:
            image = log.run("photometric", lambda: images.even_light(image, light.bg_kernel_frac, light.clahe_clip, light.clahe_grid), image)

        def scale() -> np.ndarray:
            out = image if p["cuts"] is None else images.compose_columns(image, [int(c) for c in p["cuts"]], fit.reflow_separator_px, fit.pad_color)
            return images.pad(images.resize_cubic(out, int(p["width"]), int(p["height"])), int(p["pad"]), fit.pad_color)

        return log.run("fit", scale, image) if p["width"] else image

    @F.pandas_udf(RENDERED)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        reader, writer = decode(), encode()
        for payloads, plans in batches:
            rows = []
            for data, p in zip(payloads, plans.to_dict("records")):
                log = Journal()
                image = None if data is None else log.run("ingest", lambda data=data: images.ingest(reader(bytes(data)))[0])
                if image is None:
                    rows.append((None, None, None, {}))
                    continue
                image = steps(image, p, log)
                rows.append((log.run("encode", lambda image=image: writer(image)), image.shape[1], image.shape[0], {k: v for k, v in log.stages.items() if k != "ingest"}))
            out = pd.DataFrame(rows, columns=["content", "width", "height", "stages"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return run.asNondeterministic()(content, plan)


def prepare(pages: DataFrame, decode: Callable[[], Callable], find: Callable[[], Callable], encode: Callable[[], Callable], settings: Settings = Settings(),
            lines: Callable[[], Callable] | None = None, score: Callable[[], Callable] | None = None) -> DataFrame:
    """pages (content, and what else they have) with content ready for the model, and what was seen.

    Adds verdict, reject_reason, route and light (minimal or photometric; null where the gate
    did not compare them), image_quality (what answers carry), stages (name -> elapsed_ms,
    error) and total_ms. A payload that is no image keeps its content and has a null
    image_quality; its error stands in stages["ingest"]. Digital pages are neither shown to the
    detector nor turned, cut or rejected.

    lines: a text-line model (see line_votes), asked about pages whose polygons stand or that
    may lie on their head. score: a scorer (see light_scores), asked about marginal photographs
    if gate.variants_enabled; even light is taken where it gains gate.variant_min_gain.
    """
    s, none = settings, F.array().cast(geometry.POLYS)
    small_batches(pages)
    bypass = s.quality.enabled and s.quality.digital_bypass
    flat, peak = s.quality.digital_flat_min, s.quality.digital_bg_peak_min
    told = (lambda q: q.get("flat_frac", 0) >= flat and q.get("bg_peak", 0) >= peak) if bypass else (lambda q: False)
    df = pages.withColumn("__page", measured(F.col("content"), decode, find, s.quality.norm_width, told))
    w, h, stats = F.col("__page.width"), F.col("__page.height"), F.col("__page.quality")
    seen = w.isNotNull()
    route = F.coalesce(quality.route(stats["flat_frac"], stats["bg_peak"], flat, peak), F.lit("photo")) if bypass else F.lit("photo")
    df = df.withColumn("route", F.when(seen, route))
    evidence = F.coalesce(geometry.enough(F.col("__page.polys"), s.detect.min_polys), none) if s.detect.enabled else none
    given = F.struct(evidence.alias("polys"), w.alias("w"), h.alias("h"), F.col("__page.label").alias("label"))
    df = df.withColumn("__given", F.when(seen, given))

    votes, turning = None, s.orient.enabled and s.orient.cardinal_enabled
    df = df.withColumn("__votes", F.lit(None).cast(VOTES))
    if lines and turning:
        df = df.withColumn("__ask", F.when(seen, let(F.col("__given"), lambda g: line_questions(g, s))))
        asked = F.col("__ask.quarters").isNotNull() & (F.size("__ask.boxes") > 0)
        df = df.withColumn("__votes", line_votes(F.when(asked, F.col("content")), F.col("__ask.boxes"), F.when(asked, F.col("__ask.quarters")), decode, lines))
        votes = F.col("__votes.by_quarters")
    df = df.withColumn("__turn", F.when(seen, let(F.struct(*(F.col("__given")[n].alias(n) for n in ("polys", "w", "h", "label")), *([votes.alias("votes")] if votes is not None else [])), lambda g: quarter_turns(g, s, votes is not None))))
    again = F.lit(None).cast(geometry.POLYS)
    if turning and s.orient.redetect_after_cardinal:
        again = detected_again(F.when(F.col("__turn.quarters") > 0, F.col("content")), F.col("__turn.quarters"), decode, find)
    df = df.withColumn("__again", geometry.enough(again, s.detect.min_polys))
    upright_ = F.struct(F.coalesce("__again", "__turn.polys").alias("polys"), F.col("__turn.w").alias("w"), F.col("__turn.h").alias("h"))
    df = df.withColumn("__plan", F.when(seen, decided(upright_, s)))

    plan, digital = F.col("__plan"), F.col("route") == "digital"
    judged = (F.size(plan["polys"]), plan["text_height_out"], stats["blur_lapvar"], s.gate, digital)
    df = df.withColumn("verdict", F.when(seen, quality.gate(*judged) if s.gate.enabled else F.lit("readable")))
    df = df.withColumn("reject_reason", F.when(F.col("verdict") == "unreadable", quality.reject_reason(*judged[:4])))

    turn = F.struct(F.coalesce("__turn.quarters", F.lit(0)).alias("quarters"), *(plan[n].alias(n) for n in ("degrees", "box")))
    df = df.withColumn("__scores", F.lit(None).cast(SCORES))
    if score and s.gate.enabled and s.gate.variants_enabled:
        compared = seen & ~digital & (F.col("verdict") == "marginal") & (F.size(plan["samples"]) > 0)
        df = df.withColumn("__scores", light_scores(F.when(compared, F.col("content")), turn, plan["samples"], decode, score, s))
    both = F.col("__scores.minimal").isNotNull() & F.col("__scores.photometric").isNotNull()
    df = df.withColumn("light", F.when(both, quality.variant_choice(F.col("__scores.minimal"), F.col("__scores.photometric"), s.gate.variant_min_gain)))

    even = ~F.coalesce(digital, F.lit(False)) & (F.lit(s.photometric.enabled) | F.coalesce(F.col("light") == "photometric", F.lit(False)))
    steps = F.struct(turn["quarters"].alias("quarters"), *(plan[n].alias(n) for n in ("degrees", "box", "cuts", "width", "height", "pad")), even.alias("even"))
    df = df.withColumn("__out", rendered(F.when(seen, F.col("content")), steps, decode, encode, s))
    extra = [F.coalesce(F.col(f"{c}.stage"), F.create_map().cast(f"map<string,{STAGE}>")) for c in ("__votes", "__scores")]
    df = df.withColumn("stages", F.map_concat("__page.stages", *extra, "__out.stages"))
    df = df.withColumn("image_quality", F.when(seen, quality.of_image(F.greatest(w, h), F.least(w, h), plan["text_height"], plan["zoom"])))
    df = df.withColumn("total_ms", quality.journal(F.col("stages"))["total_ms"]).withColumn("content", F.coalesce("__out.content", "content"))
    return df.select(*pages.columns, "verdict", "reject_reason", "route", "light", "image_quality", "stages", "total_ms")


def line_questions(g: Column, s: Settings) -> Column:
    """struct(quarters, boxes): the turns that the text-line model is asked about (null: none), and the crops to show."""
    c = s.orient
    boxes = F.filter(F.transform(geometry.top_by_area(g["polys"], c.textline_sample), lambda p: geometry.crop_box(p, g["w"], g["h"], c.textline_min_side_px)), lambda b: b.isNotNull())
    ratio = geometry.vertical_ratio(g["polys"], c.ratio_min_elongation)
    return F.struct(let(ratio, lambda r: quality.turns_to_ask(r, g["label"], c.vert_ratio_trigger, c.vert_ratio_confident)).alias("quarters"), boxes.alias("boxes"))


def quarter_turns(g: Column, s: Settings, voted: bool = False) -> Column:
    """struct(quarters, polys, w, h) of a page after its quarter turns, from struct(polys, w, h, label and, if voted, votes)."""
    def turned(q: Column) -> Column:
        odd = q % 2 == 1
        return F.struct(q.alias("quarters"), geometry.rotate_quarters(g["polys"], q, g["w"], g["h"]).alias("polys"), F.when(odd, g["h"]).otherwise(g["w"]).alias("w"), F.when(odd, g["w"]).otherwise(g["h"]).alias("h"))

    if not (s.orient.enabled and s.orient.cardinal_enabled):
        return turned(F.lit(0))
    ratio = geometry.vertical_ratio(g["polys"], s.orient.ratio_min_elongation)
    count = lambda q, name: F.coalesce(g["votes"][q][name], F.lit(0))
    votes = {q: (count(q, "upside"), count(q, "total")) for q in (0, 1, 3)} if voted else None
    return let(let(ratio, lambda r: quality.cardinal(r, g["label"], votes, s.orient.vert_ratio_trigger, s.orient.vert_ratio_confident).cast("int")), turned)


def decided(page: Column, s: Settings) -> Column:
    """What is to be done with an upright page, struct(polys, w, h), step by step: each step's values are computed once."""
    c = s.localize

    def tilted(g: Column) -> Column:
        if not (s.orient.enabled and s.orient.deskew_enabled):
            return F.struct(*(g[n].alias(n) for n in ("polys", "w", "h")), F.lit(0.0).alias("degrees"))
        tilt = geometry.tilt(g["polys"], s.orient.deskew_min_elongation, s.orient.deskew_min_samples)
        turn = let(tilt, lambda t: quality.deskew(t, s.orient.deskew_min_deg, s.orient.deskew_max_deg)["degrees"])
        return F.struct(*(g[n].alias(n) for n in ("polys", "w", "h")), turn.alias("degrees"))

    def level(g: Column) -> Column:
        sin, cos, on = F.abs(F.sin(F.radians(g["degrees"]))), F.abs(F.cos(F.radians(g["degrees"]))), g["degrees"] != 0
        side = lambda a, b: F.when(on, F.floor(g[b] * sin + g[a] * cos).cast("int")).otherwise(g[a])
        polys = F.when(on, geometry.rotate_free(g["polys"], g["degrees"], g["w"], g["h"])).otherwise(g["polys"])
        return F.struct(polys.alias("polys"), side("w", "h").alias("w"), side("h", "w").alias("h"), g["degrees"].alias("degrees"))

    def cut(g: Column) -> Column:
        box = quality.localize(g["polys"], g["w"], g["h"], c.padding_px, c.trust_min_polys, c.trust_min_coverage, c.aspect_inflation_max, c.high_poly_min)["box"]
        return F.struct(g.alias("g"), F.when(F.lit(c.enabled) & (F.size(g["polys"]) > 0), box).alias("box"))

    def sized(x: Column) -> Column:
        g, box = x["g"], x["box"]
        return F.struct(
            g["polys"].alias("polys"), g["degrees"].alias("degrees"), box.alias("box"), F.coalesce(box["x2"] - box["x1"], g["w"]).alias("w"), F.coalesce(box["y2"] - box["y1"], g["h"]).alias("h"),
            F.coalesce(box["y1"], F.lit(0)).alias("top"), geometry.median_text_height(g["polys"]).alias("text"))

    def planned(g: Column) -> Column:
        return F.struct(g.alias("g"), budget.solve(g["w"], g["h"], g["text"], s.fit).alias("plan"))

    def split(x: Column) -> Column:
        g, cuts = x["g"], F.lit(None).cast("array<int>")
        span = lambda p: let(F.transform(p, lambda q: q["y"]), lambda y: F.struct((F.array_min(y) - g["top"]).alias("y0"), (F.array_max(y) - g["top"]).alias("y1")))
        for n in range(2, s.fit.reflow_max_cols + 1 if s.fit.reflow_enabled else 2):
            cuts = F.when(x["plan"]["columns"] == n, geometry.safe_splits(F.transform(g["polys"], span), g["h"], n, s.fit.reflow_split_search_frac)).otherwise(cuts)
        return F.struct(g.alias("g"), x["plan"].alias("plan"), cuts.alias("cuts"))

    def measured_out(x: Column) -> Column:
        g, n = x["g"], F.size(x["cuts"]) + 1
        laid = x["cuts"].isNotNull()
        wide = F.when(laid, g["w"] * n + (n - 1) * s.fit.reflow_separator_px).otherwise(g["w"])
        tall = F.when(laid, F.ceil(g["h"] / n).cast("int")).otherwise(g["h"])
        dims = budget.target_dims(wide, tall, x["plan"]["scale"], s.fit) if s.fit.enabled else F.lit(None).cast("struct<width:int,height:int>")
        return F.struct(g.alias("g"), x["plan"].alias("plan"), x["cuts"].alias("cuts"), dims.alias("dims"), wide.alias("wide"), tall.alias("tall"))

    def grown(x: Column) -> Column:
        kept = (x[n].alias(n) for n in ("g", "plan", "cuts", "dims"))
        return F.struct(*kept, F.greatest(x["dims"]["width"] / x["wide"], x["dims"]["height"] / x["tall"]).alias("grown"))

    def samples(g: Column) -> Column:
        """The boxes of the largest polygons in the page's box, for the scorer."""
        if not s.gate.variants_enabled:
            return F.lit(None).cast(f"array<{BOX}>")
        polys = geometry.shift(geometry.top_by_area(g["polys"], s.gate.variant_sample), F.coalesce(g["box"]["x1"], F.lit(0)), F.coalesce(g["box"]["y1"], F.lit(0)))
        return F.filter(F.transform(polys, lambda p: geometry.crop_box(p, g["w"], g["h"], SCORED_SIDE)), lambda b: b.isNotNull())

    def finished(x: Column) -> Column:
        g, plan, dims = x["g"], x["plan"], x["dims"]
        return F.struct(
            g["polys"].alias("polys"), g["degrees"].alias("degrees"), g["box"].alias("box"), x["cuts"].alias("cuts"), dims["width"].alias("width"), dims["height"].alias("height"),
            F.coalesce(budget.padding(dims["width"], dims["height"], s.fit), F.lit(0)).alias("pad"), g["text"].alias("text_height"), plan["text_height_out"].alias("text_height_out"),
            F.when((plan["zoomed"] | (plan["scale"] > 1)) & (x["grown"] > 1), F.bround(x["grown"], 2)).otherwise(F.lit(1.0)).alias("zoom"), samples(g).alias("samples"))

    for step in (tilted, level, cut, sized, planned, split, measured_out, grown, finished):
        page = let(page, step)
    return page
