import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.functions import budget, geometry
from sheafline.operators import images, ocr, quality
from sheafline.plans import page_queries, stages
from sheafline.sources.config import Fit

SF = "/root/testdata/sf0.001"


def lines(spark, *rows):
    return spark.createDataFrame([([(t, a, b, c, d, 0.9, (b + d) / 2) for t, a, b, c, d in rows],)], f"l array<{ocr.LINE}>")


def merged(spark, *rows):
    got = lines(spark, *rows).select(ocr.merge_rows(F.col("l")).alias("m"), ocr.text_block(ocr.merge_rows(F.col("l"))).alias("b")).first()
    return [(h.text, h.x1, h.y1, h.x2, h.y2) for h in got.m], got.b


def test_rows(spark):
    row = [("Coca", 10, 10, 60, 30), ("2", 70, 11, 80, 31), ("25,000", 100, 10, 160, 30)]
    got, block = merged(spark, *row)
    assert got == [("Coca 2 25,000", 10, 10, 160, 31)] and block == "<ocr_text>\n5,5,80,15|Coca 2 25,000\n</ocr_text>\n"
    got, _ = merged(spark, *row, ("Hotline", 400, 10, 470, 30))
    assert [t for t, *_ in got] == ["Hotline", "Coca 2 25,000"]
    got, _ = merged(spark, ("a", 0, 0, 9, 20), ("b", 20, 4, 29, 24))
    assert len(got) == 2
    assert merged(spark)[1] == ""


def test_fit(spark):
    df = spark.createDataFrame([([10] * 20,), ([500],), ([],), ([100] * 300,)], "n array<int>")
    got = [(r.f.keep, r.f.status) for r in df.select(ocr.fit_lines(F.col("n"), F.lit(50), 200).alias("f")).collect()]
    assert got == [(14, "fit"), (None, "overflow"), (None, "no_lines"), (None, "no_convergence")]


def loop_dims(w, h, scale, fit):
    tw, th = (max(fit.block, round(x * scale / fit.block) * fit.block) for x in (w, h))
    while tw > fit.max_side:
        tw -= fit.block
    while th > fit.max_side:
        th -= fit.block
    while tw * th > fit.max_pixels and (tw > fit.block or th > fit.block):
        if tw >= th:
            tw -= fit.block
        else:
            th -= fit.block
    for _ in range(256):
        if tw * th >= fit.min_pixels:
            break
        options = [(fit.block / tw, 0)] * (tw + fit.block <= fit.max_side) + [(fit.block / th, 1)] * (th + fit.block <= fit.max_side)
        if not options:
            break
        if th + fit.block <= fit.max_side and (tw + fit.block > fit.max_side or fit.block / th <= fit.block / tw):
            th += fit.block
        else:
            tw += fit.block
    return tw, th


def test_dimensions_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8, 6000), rng.randrange(8, 6000), rng.uniform(0.1, 3)) for _ in range(2000)] + [(k * 32, k * 32, 1.0) for k in range(1, 130)] + [(3584, k, 1.0) for k in range(8, 400, 7)]
    df = spark.createDataFrame(rows, "w int, h int, s double")
    for fit in (Fit(), Fit(max_pixels=600_000, min_pixels=300_000, max_side=1000), Fit(max_pixels=992 * 1024, block=32), Fit(min_pixels=0)):
        for r in df.select("w", "h", "s", budget.target_dims(F.col("w"), F.col("h"), F.col("s"), fit).alias("d")).collect():
            assert tuple(r.d) == loop_dims(r.w, r.h, r.s, fit), r


def test_reflow_takes_the_best_number_of_columns(spark):
    fit = Fit(zoom_target_text_h=32.0, reflow_enabled=True)
    df = spark.createDataFrame([(300, 6000, 20.0), (300, 900, 20.0), (300, 6000, None), (4000, 500, 9.0)], "w int, h int, t double")
    got = [r.p for r in df.select(budget.solve(F.col("w"), F.col("h"), F.col("t"), fit).alias("p")).collect()]
    assert got[0].columns > 1 and [p.columns for p in got[1:]] == [1, 1, 1]

    def scale(w, h, t):
        hard = min(3584 / max(w, h), (4194304 / (w * h)) ** 0.5)
        s = min(32 / t, hard, 2.5) if t < 32 else min(1.0, hard)
        return max(s, min((1048576 / (w * h)) ** 0.5, hard)) if w * h * s * s < 1048576 else s

    best = max((scale(n * 300 + (n - 1) * 10, -(-6000 // n), 20.0), -n) for n in (2, 3, 4))
    assert (got[0].scale, -got[0].columns) == pytest.approx(best)


def test_safe_splits_match_a_loop(spark):
    rng, rows = random.Random(5), []
    for _ in range(80):
        y, spans = 0, []
        while y < 280:
            y += rng.randrange(0, 30)
            spans.append((float(y), float(y + rng.randrange(4, 25))))
        rows.append((spans,))
    rows.append(([(0.0, 300.0)],))  # no gap at all

    def loop(spans, page, columns, reach=0.2):
        gaps, end = [], 0.0
        for a, b in sorted(spans):
            if a - end >= 3:
                gaps.append((end, a))
            end = max(end, b)
        if page - end >= 3:
            gaps.append((end, float(page)))
        out, last = [], None
        for k in range(1, columns):
            target = page * k / columns
            fits = [min(max(target, a + 1), b - 1) for a, b in gaps]
            fits = [c for c, (a, b) in zip(fits, gaps) if a < c < b and abs(c - target) <= reach * page]
            best = min(fits, key=lambda c: abs(c - target), default=None)
            if best is None or (out and best - out[-1] < page / (2 * columns)):
                return None
            out.append(int(round(best)))
        return out

    df = spark.createDataFrame(rows, "s array<struct<y0:double,y1:double>>")
    got = [r.c for r in df.select(geometry.safe_splits(F.col("s"), F.lit(300), 3).alias("c")).collect()]
    assert got == [loop(r[0], 300, 3) for r in rows] and any(got) and not all(got)


def test_quality_flags(spark):
    df = spark.createDataFrame([("a", 2000, 1300, None, None), ("a", 1500, 1100, None, 1.5), ("b", 0, None, 15.96, 0.0)], "ref string, input_long_side int, input_short_side int, median_text_height_px double, legibility_zoom_ratio double")
    a, b = quality.worst_of(df).orderBy("ref").collect()
    assert (a.input_long_side, a.low_res_input, a.low_legibility, a.legibility_zoom_ratio) == (1500, True, None, 1.5)
    assert (b.input_long_side, b.low_res_input, b.low_legibility, b.median_text_height_px) == (None, False, True, 16.0)


def test_images_decode_and_turn():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (12, 9, 3), dtype=np.uint8)
    assert (images.decode_ppm(b"P6 9 12 255\n" + rgb.tobytes()) == rgb[:, :, ::-1]).all()
    assert (images.decode_ppm(images.encode_ppm(rgb)) == rgb).all()
    assert images.decode_ppm(b"junk") is None and images.decode_ppm(b"") is None
    turned = images.rotate_quarters(rgb, 1)
    assert turned.shape == (9, 12, 3) and (turned[9 - 1 - 2, 5] == rgb[5, 2]).all()
    with pytest.raises(ValueError):
        images.ingest(rgb[:5])
    assert images.compose_columns(rgb, [4]).shape == (8, 28, 3)
    assert images.pad(rgb, 5).shape == (12, 14, 3)
    flat = images.stats(np.full((20, 20), 200, np.uint8))
    assert flat["blur_lapvar"] == 0 and flat["flat_frac"] == 1 and flat["bg_peak"] == 1


def test_even_light_takes_the_background_out():
    image = np.random.default_rng(4).integers(0, 256, (40, 33, 3), dtype=np.uint8)
    light, a, b = images.to_lab(image)
    at = lambda n, c: np.clip(np.arange(c - 7, c + 8), 0, n - 1)
    windows = lambda x, of: np.array([[of(x[at(40, r)][:, at(33, c)]) for c in range(33)] for r in range(40)])
    closed = windows(windows(light, np.max), np.min).astype(float)
    taps = np.exp(-0.5 * (np.arange(-8, 9) / 2.5) ** 2)
    mirror = lambda n, k: k if 0 <= k < n else -k if k < 0 else 2 * n - 2 - k
    mean = lambda r, c: sum(taps[i] * taps[j] * closed[mirror(40, r + i - 8), mirror(33, c + j - 8)] for i in range(17) for j in range(17)) / taps.sum() ** 2
    ground = np.array([[max(1, round(mean(r, c))) for c in range(33)] for r in range(40)])
    even = np.clip(np.rint(light * (220.0 / ground)), 0, 255).astype(np.uint8)
    got = images.even_light(image, 0.125, 2.0, 8)
    assert (got == images.from_lab(images.local_contrast(even, 2.0, 8), a, b)).mean() > 0.999
    assert abs(images.even_light(np.full((40, 40, 3), 90, np.uint8), clip=40.0).mean() - 220) <= 40


def test_colours_survive_lab():
    image = np.random.default_rng(7).integers(0, 256, (50, 40, 3), dtype=np.uint8)
    assert np.abs(images.from_lab(*images.to_lab(image)).astype(int) - image).mean() < 1.5
    gray = np.repeat(np.arange(256, dtype=np.uint8)[:, None, None], 3, axis=2)
    light, a, b = images.to_lab(gray)
    assert (np.abs(a.astype(int) - 128) <= 1).all() and (np.abs(b.astype(int) - 128) <= 1).all() and (np.diff(light.astype(int).ravel()) >= 0).all() and light[0] == 0 and light[-1] == 255
    assert np.abs(images.from_lab(light, a, b).astype(int) - gray).max() <= 2


def equalised(g, clip, grid):
    """Tile by tile and pixel by pixel."""
    h, w = g.shape
    th, tw = -(-h // grid), -(-w // grid)
    mirror = lambda n, k: k if k < n else 2 * n - 2 - k
    tables = {}
    for ty in range(grid):
        for tx in range(grid):
            counts = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    counts[g[mirror(h, y), mirror(w, x)]] += 1
            if clip:
                limit = max(1, int(clip * th * tw / 256))
                over = sum(max(0, c - limit) for c in counts)
                counts = [min(c, limit) + over // 256 for c in counts]
                rest = over % 256
                for k in range(rest):
                    counts[k * max(256 // rest, 1)] += 1
            total, table = 0, []
            for c in counts:
                total += c
                table.append(min(255, round(total * (255 / (th * tw)))))
            tables[ty, tx] = table
    out = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            ay, ax = y / th - 0.5, x / tw - 0.5
            y0, x0 = math.floor(ay), math.floor(ax)
            fy, fx = ay - y0, ax - x0
            of = lambda ty, tx, v=g[y, x]: tables[min(max(ty, 0), grid - 1), min(max(tx, 0), grid - 1)][v]
            out[y, x] = round((of(y0, x0) * (1 - fx) + of(y0, x0 + 1) * fx) * (1 - fy) + (of(y0 + 1, x0) * (1 - fx) + of(y0 + 1, x0 + 1) * fx) * fy)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_local_contrast_equals_loops(seed):
    rng = np.random.default_rng(seed)
    h, w, grid = int(rng.integers(17, 60)), int(rng.integers(17, 60)), int(rng.integers(1, 9))
    g = np.clip(rng.normal(rng.integers(40, 200), rng.integers(1, 60), (h, w)), 0, 255).astype(np.uint8)
    clip = [0.0, 1.0, 2.0, 7.5][seed % 4]
    assert (images.local_contrast(g, clip, grid) == equalised(g, clip, grid)).all()


def cubic_at(image, y, x):
    """The value between pixels, from sixteen of them."""
    k = lambda d: (1.25 * d - 2.25) * d * d + 1 if d <= 1 else ((-0.75 * d + 3.75) * d - 6) * d + 3 if d < 2 else 0.0
    h, w = image.shape[:2]
    y0, x0 = math.floor(y), math.floor(x)
    return sum(k(abs(y - j)) * k(abs(x - i)) * image[min(max(j, 0), h - 1), min(max(i, 0), w - 1)].astype(float) for j in range(y0 - 1, y0 + 3) for i in range(x0 - 1, x0 + 3))


@pytest.mark.parametrize("seed", range(6))
def test_cubic_resampling_equals_loops(seed):
    rng = np.random.default_rng(seed)
    h, w, nh, nw = (int(v) for v in rng.integers(8, 40, 4))
    image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
    want = np.array([[cubic_at(image, (y + 0.5) * h / nh - 0.5, (x + 0.5) * w / nw - 0.5) for x in range(nw)] for y in range(nh)])
    assert np.abs(images.resize_cubic(image, nw, nh) - np.clip(want, 0, 255)).max() <= 0.501
    degrees = float(rng.uniform(-40, 40))
    turned, c, s = images.rotate_free(image, degrees), math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    th, tw = turned.shape[:2]
    want = np.array([[cubic_at(image, s * (x - tw / 2) + c * (y - th / 2) + h / 2, c * (x - tw / 2) - s * (y - th / 2) + w / 2) for x in range(tw)] for y in range(th)])
    assert np.abs(turned - np.clip(want, 0, 255)).max() <= 0.501


def test_cubic_keeps_constant_and_linear_images():
    flat = np.full((12, 9, 3), 77, np.uint8)
    assert (images.resize_cubic(flat, 31, 5) == 77).all() and (images.rotate_free(flat, 13.0) == 77).all()
    ramp = np.repeat((np.arange(40, dtype=np.uint8) * 4)[:, None, None], 3, axis=2).repeat(9, axis=1)
    want = np.clip((np.arange(80) + 0.5) / 2 - 0.5, 0, 39) * 4
    # Inside, a slope of four levels a pixel comes out within a level.
    assert np.abs(images.resize_cubic(ramp, 9, 80)[4:-4, 4, 0] - want[4:-4]).max() <= 1
    assert images.resize_cubic(ramp, 9, 40) is ramp


def test_statistics_are_exact_at_ties():
    g = np.tile(np.array([[0, 1, 0, 0]], np.uint8), (5, 5))  # a mean of 0.25
    assert images.stats(g)["brightness_mean"] == 0.2 and images.half_even(35, 100, 1) == 0.4 and images.half_even(25, 100, 1) == 0.2 and images.half_even(-25, 100, 1) == -0.2


def test_stats_match_loops():
    g = np.random.default_rng(3).integers(0, 256, (9, 7), dtype=np.uint8)
    at = lambda y, x: float(g[min(abs(y), 2 * 8 - abs(y)), min(abs(x), 2 * 6 - abs(x))])
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(9) for x in range(7)]
    assert images.stats(g)["blur_lapvar"] == round(float(np.var(lap)), 1)


def test_free_turn_keeps_polygons_on_the_canvas(spark):
    df = spark.createDataFrame([([[(0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)]],)], "p array<array<struct<x:double,y:double>>>")
    got = df.select(geometry.rotate_free(F.col("p"), F.lit(90.0), F.lit(100), F.lit(50)).alias("r")).first().r[0]
    assert {(round(q.x), round(q.y)) for q in got} == {(0, 0), (50, 0), (50, 100), (0, 100)}


def mentions(spark, column, name, over="polys"):
    """How often a plan mentions a function; what it mentions twice is worked out twice."""
    kinds = {"polys": geometry.POLYS, "lines": f"array<{ocr.LINE}>", "spans": "array<struct<y0:double,y1:double>>"}
    made = spark.createDataFrame([], f"{over} {kinds[over]}").select(column.alias("out"))
    return made._jdf.queryExecution().analyzed().toString().lower().count(name)


def test_the_sides_of_polygons_are_measured_once_for_the_tilt(spark):
    # Once to tell which are slender, once for their direction.
    assert mentions(spark, geometry.tilt(F.col("polys")), "hypot(") == 2
    assert mentions(spark, geometry.tilt(F.col("polys")), "atan2(") == 2


def test_lines_are_folded_once_for_dates_and_times(spark):
    assert mentions(spark, ocr.sweep_datetime(F.lit(""), F.lit(""), F.col("lines"), 2026), "translate(", "lines") == 1


def test_the_sides_of_slender_polygons_are_measured_once_for_their_share(spark):
    assert mentions(spark, geometry.vertical_ratio(F.col("polys")), "hypot(") == 2
    # The values are sorted once, and so are the corners that follow each other.
    assert mentions(spark, geometry.median_text_height(F.col("polys")), "array_sort(") == 1


def test_gaps_are_merged_once_for_all_cuts(spark):
    assert mentions(spark, geometry.safe_splits(F.col("spans"), F.lit(300), 4), "array_sort(", "spans") == 1


def test_the_median_height_of_a_row_is_worked_out_once(spark):
    # One sort of the lines, one of their heights, and none within the walk along the row.
    column = ocr.split_columns(F.filter("lines", lambda h: h["score"] > 0))
    assert mentions(spark, column, "array_sort(", "lines") == 2
    assert mentions(spark, column, "filter(", "lines") == 2


def test_pages_reach_python_in_small_batches(spark):
    key, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        page_queries.page_prepare(spark, SF)
        assert int(spark.conf.get(key)) <= 100
        batch = F.pandas_udf(lambda x: x * 0 + len(x), "long")
        sizes = [r.n for r in spark.range(0, 1000, 1, 1).select(batch("id").alias("n")).distinct().collect()]
        spark.conf.set(key, 7)
        stages.small_batches(spark.range(1))
        assert int(spark.conf.get(key)) == 7
    finally:
        spark.conf.set(key, before)
    assert max(sizes) <= 100
