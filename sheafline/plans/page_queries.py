"""Queries of the operators over pages: lines, boxes, polygons, images, quality, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sheafline.functions import budget, geometry, text
from sheafline.operators import evaluation, images, ocr, quality
from sheafline.plans import stages
from sheafline.plans.base import SQL_WS, per_order, table
from sheafline.shipping import ship
from sheafline.sources.config import Fit, load
from sheafline.sources.providers import read_images, token_costs, word_counter
from sheafline.streaming.detector import check_batch, event_counts
from sheafline.streaming.events import first_requests, sessions

ship(__name__)

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def sql_half_even(over: str, under: str, places: int) -> str:
    """over/under (whole numbers) rounded to places, a tie to the even digit, without floats before the end."""
    a, b = f"(2 * ({over})::HUGEINT * {10**places})", f"(2 * ({under})::HUGEINT)"
    return f"(({a} + {b} // 2) // {b} - ({a} % {b} = {b} // 2 AND ({a} // {b}) % 2 = 0)::INT)::DOUBLE / {10**places}"


#: Boxes made from an order's lines, in Spark and in SQL.
X1, Y1 = "l_partkey % 50 * 10", "l_suppkey % 4 * 3 + l_linenumber % 3 * 20"
X2, Y2 = f"({X1}) + 10 + l_quantity::INT % 20", f"({Y1}) + 8 + l_quantity::INT % 5"
BOXES = f"SELECT l_orderkey AS page, ({X1})::INT AS x1, ({Y1})::INT AS y1, ({X2})::INT AS x2, ({Y2})::INT AS y2, (({Y1}) + ({Y2})) / 2.0 AS yc, 'p' || l_partkey AS t, l_discount * 10 AS score, l_linenumber AS n FROM lineitem"


def boxes(spark, d):
    cast = lambda e: F.expr(e.replace("::INT", "")).cast("int")
    q = "cast(l_quantity as int)"
    x1, y1 = cast(X1), cast(Y1)
    x2, y2 = (x1 + 10 + F.expr(f"{q} % 20")).cast("int"), (y1 + 8 + F.expr(f"{q} % 5")).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ocr.line(F.concat(F.lit("p"), F.col("l_partkey")), x1, y1, x2, y2, F.col("l_discount") * 10).alias("line"))


def pages(spark, d):
    """(page, lines): an order's lines as recognised lines, in an order that ties cannot change."""
    rows = boxes(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return rows.select(F.col("l_orderkey").alias("page"), "lines")


@query(f"""
    WITH RECURSIVE b AS ({BOXES}), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY yc, x1, t, y1, x2, y2, score) AS k FROM b),
    r AS (SELECT page, k, 1 AS row_no, y1 AS ry1, y2 AS ry2 FROM o WHERE k = 1
          UNION ALL SELECT o.page, o.k, CASE WHEN j THEN row_no ELSE row_no + 1 END, CASE WHEN j THEN least(ry1, y1) ELSE y1 END, CASE WHEN j THEN greatest(ry2, y2) ELSE y2 END
          FROM (SELECT o.*, r.row_no, r.ry1, r.ry2, greatest(0, least(o.y2, r.ry2) - greatest(o.y1, r.ry1)) >= 0.85 * least(greatest(1, o.y2 - o.y1), greatest(1, r.ry2 - r.ry1)) AS j
                FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1) o)
    SELECT page, max(row_no) AS n_rows, max(k) AS n_lines FROM r GROUP BY page""")
def ocr_rows(spark, d):
    """Lines into visual rows by a running union of their boxes."""
    rows = ocr.group_rows(ocr.sort_lines(F.col("lines")))
    return pages(spark, d).select("page", F.size(rows).alias("n_rows"), F.size("lines").cast("long").alias("n_lines"))


@query(f"""
    WITH b AS ({BOXES}), h AS (SELECT page, median(y2 - y1) AS m FROM b GROUP BY page),
    g AS (SELECT b.*, m, x1 - lag(x2) OVER (PARTITION BY page ORDER BY x1, t, y1, x2, y2, score) AS gap FROM b JOIN h USING (page))
    SELECT page, count(*) FILTER (gap IS NULL OR gap > 5 * m) AS n_parts, any_value(m)::DOUBLE AS median_height FROM g GROUP BY page""")
def col_split(spark, d):
    """A row cut at wide gaps."""
    ordered = F.array_sort(F.transform("lines", lambda h: F.struct(h["x1"].alias("x1"), h["text"].alias("t"), h["y1"].alias("y1"), h["x2"].alias("x2"), h["y2"].alias("y2"), h["score"].alias("score"), h.alias("line"))))
    parts = ocr.split_columns(F.transform(ordered, lambda t: t["line"]))
    return pages(spark, d).select("page", F.size(parts).alias("n_parts"), ocr.median(F.transform("lines", lambda h: h["y2"] - h["y1"])).alias("median_height"))


@query(f"""
    SELECT page, '<ocr_text>' || chr(10) || string_agg(x1 // 2 || ',' || y1 // 2 || ',' || x2 // 2 || ',' || y2 // 2 || '|' || t, chr(10) ORDER BY yc, x1, t, y1, x2, y2, score) || chr(10) || '</ocr_text>' || chr(10) AS block
    FROM ({BOXES}) GROUP BY page""")
def text_block(spark, d):
    """K5, L1."""
    return pages(spark, d).select("page", ocr.text_block(ocr.sort_lines(F.col("lines"))).alias("block"))


@query(f"""
    SELECT page, string_agg(t, ' ' ORDER BY x1, t, y1, x2, y2, score) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(score), 6) AS score FROM ({BOXES}) GROUP BY page""")
def row_merge_agg(spark, d):
    """A4: one line of a row's."""
    ordered = F.array_sort(F.transform("lines", lambda h: F.struct(h["x1"].alias("x1"), h["text"].alias("t"), h["y1"].alias("y1"), h["x2"].alias("x2"), h["y2"].alias("y2"), h["score"].alias("score"), h.alias("line"))))
    got = pages(spark, d).select("page", ocr.join_line(F.transform(ordered, lambda t: t["line"])).alias("m"))
    return got.select("page", "m.text", "m.x1", "m.y1", "m.x2", "m.y2", F.round("m.score", 6).alias("score"))


@query(f"""
    SELECT page, count(*) FILTER (score >= 0.5 AND n % 6 <> 0) AS kept, least(3, count(*)) AS head FROM ({BOXES}) GROUP BY page""")
def ocr_filter(spark, d):
    """Lines with score, text and a box; the first three of all."""
    blank = F.transform("rows", lambda r: F.when(r["l_linenumber"] % 6 == 0, r["line"].withField("x2", r["line"]["x1"])).otherwise(r["line"]))
    rows = boxes(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "line")).alias("rows"))
    return rows.select(F.col("l_orderkey").alias("page"), F.size(ocr.keep_lines(blank)).alias("kept"), F.size(F.slice("rows", 1, 3)).alias("head"))


@query("""
    SELECT l_orderkey AS page, greatest(0, least(count(*), 4)) AS n, min(l_partkey)::INT % 7 AS x1 FROM lineitem GROUP BY l_orderkey""")
def zip_lines(spark, d):
    """Three lists of unequal length, read as far as the shortest goes."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    poly = lambda v: F.array(point(v % 7 + 0.9, F.lit(1)), point(v % 7 + 5.2, F.lit(9)), point(v % 7 + 5.2, F.lit(1)), point(v % 7 + 0.9, F.lit(9)))
    lines = ocr.zip_lines(F.transform("p", lambda v: F.concat(F.lit(" t"), v)), F.slice(F.transform("p", lambda v: F.lit(0.9)), 1, 4), F.transform("p", poly))
    got = rows.select(F.col("l_orderkey").alias("page"), lines.alias("l"))
    return got.select("page", F.size("l").alias("n"), F.col("l")[0]["x1"].alias("x1"))


@query("""
    WITH l AS (SELECT l_orderkey AS page, l_linenumber % 4 AS k, l_shipdate + INTERVAL 10 YEAR AS t, l_linenumber * 10 AS y, l_partkey AS p FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, p, t) AS r FROM l)
    SELECT page, strftime(arg_min(t, r) FILTER (k IN (0, 3)), '%Y-%m-%d') AS date, CASE WHEN page % 2 = 0 THEN '12:00' ELSE strftime(arg_min(t + to_minutes(p % 1000), r) FILTER (k IN (1, 3)), '%H:%M') END AS time FROM o GROUP BY page""")
def dt_sweep(spark, d):
    """Missing dates and times from the lowest line that shows them."""
    k, t = F.col("l_linenumber") % 4, F.col("l_shipdate") + F.expr("INTERVAL 10 YEAR")
    clock = t + F.make_dt_interval(mins=(F.col("l_partkey") % 1000).cast("int"))
    text = F.when(k == 0, F.concat(F.lit("Ngày "), F.date_format(t, "dd/MM/yyyy"))).when(k == 1, F.concat(F.lit("Giờ "), F.date_format(clock, "HH:mm"))).when(
        k == 2, F.concat(F.lit("HSD "), F.date_format(t, "dd/MM/yyyy HH:mm"))).otherwise(F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit(" "), F.date_format(clock, "HH:mm")))
    y = (F.col("l_linenumber") * 10).cast("int")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct((-y).alias("y"), F.col("l_partkey").alias("p"), t.alias("t"), ocr.line(text, F.lit(0), y, F.lit(9), y, F.lit(1.0)).alias("line")).alias("r"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rows")).select(F.col("l_orderkey").alias("page"), F.transform("rows", lambda r: r["line"]).alias("lines"))
    found = ocr.sweep_datetime(F.lit(""), F.when(F.col("page") % 2 == 0, F.lit("12:00")), F.col("lines"), 2026)
    return rows.select("page", found.alias("found")).select("page", "found.date", "found.time")


@query("""
    WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^ ]+'))) AS n FROM documents),
    k AS (SELECT doc_id, n, len(n)::BIGINT AS k0 FROM t),
    k1 AS (SELECT *, CASE WHEN k0 <= 1 THEN 1 WHEN floor(k0 * 0.9::DOUBLE) >= k0 THEN k0 - 1 ELSE greatest(1, floor(k0 * 0.9::DOUBLE)::BIGINT) END AS k1 FROM k),
    k2 AS (SELECT *, CASE WHEN k1 <= 1 THEN 1 WHEN floor(k1 * 0.9::DOUBLE) >= k1 THEN k1 - 1 ELSE greatest(1, floor(k1 * 0.9::DOUBLE)::BIGINT) END AS k2 FROM k1),
    k3 AS (SELECT *, CASE WHEN k2 <= 1 THEN 1 WHEN floor(k2 * 0.9::DOUBLE) >= k2 THEN k2 - 1 ELSE greatest(1, floor(k2 * 0.9::DOUBLE)::BIGINT) END AS k3 FROM k2),
    k4 AS (SELECT *, CASE WHEN k3 <= 1 THEN 1 WHEN floor(k3 * 0.9::DOUBLE) >= k3 THEN k3 - 1 ELSE greatest(1, floor(k3 * 0.9::DOUBLE)::BIGINT) END AS k4 FROM k3),
    k5 AS (SELECT *, CASE WHEN k4 <= 1 THEN 1 WHEN floor(k4 * 0.9::DOUBLE) >= k4 THEN k4 - 1 ELSE greatest(1, floor(k4 * 0.9::DOUBLE)::BIGINT) END AS k5 FROM k4),
    k6 AS (SELECT *, CASE WHEN k5 <= 1 THEN 1 WHEN floor(k5 * 0.9::DOUBLE) >= k5 THEN k5 - 1 ELSE greatest(1, floor(k5 * 0.9::DOUBLE)::BIGINT) END AS k6 FROM k5),
    k7 AS (SELECT *, CASE WHEN k6 <= 1 THEN 1 WHEN floor(k6 * 0.9::DOUBLE) >= k6 THEN k6 - 1 ELSE greatest(1, floor(k6 * 0.9::DOUBLE)::BIGINT) END AS k7 FROM k6),
    a AS (SELECT doc_id, n, [k0, k1, k2, k3, k4, k5, k6, k7] AS ks FROM k7),
    f AS (SELECT doc_id, ks, list_filter(ks, lambda k: 50 + coalesce(list_sum(n[1:k]), 0) <= 300)[1] AS keep FROM a)
    SELECT doc_id, keep, CASE WHEN keep IS NOT NULL THEN 'fit' WHEN list_contains(ks, 1) THEN 'overflow' ELSE 'no_convergence' END AS status FROM f""")
def fit_lines(spark, d):
    """L4: how many lines of a document fit 300 tokens, words counted as tokens."""
    counts = F.transform(F.split("text", "\n"), lambda x: F.regexp_count(x, F.lit("[^ ]+")))
    got = table(spark, d, "documents").select("doc_id", counts.alias("n"))
    got = got.select("doc_id", ocr.fit_lines(F.col("n"), F.lit(50), 300).alias("f"))
    return got.select("doc_id", F.col("f.keep").alias("keep"), F.col("f.status").alias("status"))


@query("""
    SELECT l_orderkey AS ref, min(nullif(l_partkey, 0))::INT AS input_long_side, min(nullif(l_suppkey % 3 * 700, 0))::INT AS input_short_side,
           coalesce(min(nullif(l_suppkey % 3 * 700, 0)) < 1200, false) AS low_res_input, round_even(min(CASE WHEN l_quantity > 20 THEN l_quantity / 1.5 END), 1) AS median_text_height_px,
           min(CASE WHEN l_quantity > 20 THEN l_quantity / 1.5 END) < 16 AS low_legibility, max(coalesce(nullif(l_discount * 20, 0), 1.0)) AS legibility_zoom_ratio FROM lineitem GROUP BY 1""")
def quality_rollup(spark, d):
    """A2, P5: a request's quality by its worst image."""
    metas = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ref"), F.col("l_partkey").cast("int").alias("input_long_side"), (F.col("l_suppkey") % 3 * 700).cast("int").alias("input_short_side"),
        F.when(F.col("l_quantity") > 20, F.col("l_quantity") / 1.5).alias("median_text_height_px"), (F.col("l_discount") * 20).alias("legibility_zoom_ratio"))
    return quality.worst_of(metas)


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 OR (l_quantity < 12 AND l_partkey % 400 < 80) THEN 'unreadable' WHEN l_quantity < 20 OR l_partkey % 400 < 250 THEN 'marginal' ELSE 'readable' END AS verdict,
           CASE WHEN l_discount >= 0.05 AND l_tax >= 0.04 THEN 'digital' ELSE 'photo' END AS route, CASE WHEN l_discount - l_tax >= 0.02 THEN 'photometric' ELSE 'minimal' END AS variant FROM lineitem""")
def gate_verdict(spark, d):
    """C3, I1, I5, A11."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", quality.gate(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_partkey") % 400).alias("verdict"),
        quality.route(F.col("l_discount"), F.col("l_tax"), 0.05, 0.04).alias("route"), quality.variant_choice(F.col("l_tax"), F.col("l_discount")).alias("variant"))


@query("""
    WITH v AS (SELECT l_orderkey AS page, l_returnflag = 'R' AS up, l_linestatus = 'O' AS known, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS r FROM lineitem)
    SELECT page, count(*) FILTER (up AND known) AS upside, count(*) FILTER (known) AS total FROM v WHERE r <= 5 GROUP BY page""")
def vote(spark, d):
    """A10, L3: votes of the five largest crops; some have no verdict."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("area"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag") == "R").alias("up"))
    return quality.votes(rows, ["page"], "up")


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS ratio, l_partkey % 4 AS q, l_suppkey % 4 AS u0, l_quantity::INT % 4 AS u1, l_linenumber % 4 AS u3 FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN ratio >= 0.6 THEN CASE WHEN ratio >= 0.9 AND q IN (1, 3) THEN CASE WHEN (q = 1 AND u1 > 1.5) OR (q = 3 AND u3 > 1.5) THEN 4 - q ELSE q END
        WHEN u1 < u3 THEN 1 WHEN u3 < u1 THEN 3 WHEN q IN (1, 3) THEN q ELSE 1 END ELSE CASE WHEN q IN (0, 2) AND u0 > 1.5 THEN 2 ELSE 0 END END::INT AS quarters FROM r""")
def cardinal_decision(spark, d):
    """Quarter turns by polygons, the page model and line votes."""
    rows = table(spark, d, "lineitem")
    label = F.when(F.col("l_partkey") % 4 > 0, (F.col("l_partkey") % 4 * 90).cast("string"))
    three = F.lit(3)
    votes = {0: (F.col("l_suppkey") % 4, three), 1: (F.col("l_quantity").cast("int") % 4, three), 3: (F.col("l_linenumber") % 4, three)}
    return rows.select("l_orderkey", "l_linenumber", quality.cardinal(F.col("l_discount") * 10, label, votes).cast("int").alias("quarters"))


FIT = Fit(zoom_target_text_h=32.0)


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, (200 + l_partkey % 3000)::DOUBLE AS w, (300 + l_suppkey * 37 % 5000)::DOUBLE AS h, l_quantity::DOUBLE AS t FROM lineitem),
    a AS (SELECT *, least(3584 / greatest(w, h), sqrt(4194304 / (w * h))) AS hard, CASE WHEN t < 32 THEN 32 / t WHEN t > 32 THEN 32 / t ELSE 1 END AS want FROM r),
    b AS (SELECT *, CASE WHEN want > 1 THEN least(want, hard, 2.5) ELSE least(want, hard) END AS s0 FROM a),
    c AS (SELECT *, CASE WHEN w * h * s0 * s0 < 1048576 THEN greatest(s0, least(sqrt(1048576 / (w * h)), hard)) ELSE s0 END AS s FROM b)
    SELECT l_orderkey, l_linenumber, round(s, 6) AS scale, round(t * s, 4) AS text_height_out, w * h * s0 * s0 < 1048576 AND w * h * s * s < 1048576 * 0.999 AS pad, t < 32 AND s > 1 AS zoomed, t > 32 AND s < 1 AS thrifty,
           t < 32 AND t * s < 32 * 0.98 AS capped FROM c""")
def budget_plan(spark, d):
    """M3, with zoom on."""
    w, h = F.lit(200) + F.col("l_partkey") % 3000, F.lit(300) + F.col("l_suppkey") * 37 % 5000
    got = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", budget.plan(w, h, F.col("l_quantity"), FIT).alias("p"))
    return got.select("l_orderkey", "l_linenumber", F.round("p.scale", 6).alias("scale"), F.round("p.text_height_out", 4).alias("text_height_out"), "p.pad", "p.zoomed", "p.thrifty", "p.capped")


def sql_layout(n: int) -> str:
    """The plan of n columns over w, h and t, as text_height_out, -n and scale; null where columns are too flat."""
    w, h = (f"(w * {n} + {(n - 1) * 10})", f"ceil(h / {n})") if n > 1 else ("w", "h")
    hard = f"least(3584 / greatest({w}, {h}), sqrt(4194304 / ({w} * {h})))"
    wish = f"CASE WHEN t < 32 THEN least(32 / t, {hard}, 2.5) WHEN t > 32 THEN least(32 / t, {hard}) ELSE least(1.0, {hard}) END"
    scale = f"CASE WHEN {w} * {h} * ({wish}) * ({wish}) < 1048576 THEN greatest({wish}, least(sqrt(1048576 / ({w} * {h})), {hard})) ELSE {wish} END"
    made = f"{{'t': t * ({scale}), 'c': -{n}, 's': {scale}}}"
    return f"CASE WHEN {h} >= w THEN {made} END" if n > 1 else made


@query(f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, (200 + l_partkey % 300)::DOUBLE AS w, (3000 + l_suppkey * 37 % 5000)::DOUBLE AS h, l_quantity::DOUBLE AS t FROM lineitem),
    p AS (SELECT *, {sql_layout(1)} AS p1, list_max(list_filter([{", ".join(map(sql_layout, range(1, 5)))}], lambda x: x IS NOT NULL)) AS best FROM r),
    c AS (SELECT *, CASE WHEN h > w AND h / w > 4 AND t > 0 AND p1.t < 32 AND best.c < -1 AND best.t >= p1.t * 1.2 THEN best ELSE p1 END AS p FROM p),
    s AS (SELECT *, least(greatest(1, round_even(w * p.s / 32, 0)::INT), 112) AS a, least(greatest(1, round_even(h * p.s / 32, 0)::INT), 112) AS b FROM c),
    m AS (SELECT *, CASE WHEN a * b <= 4096 THEN a WHEN least(a, b) * least(a, b) > 4096 THEN 64 WHEN a >= b THEN 4096 // b ELSE a END AS a2,
                    CASE WHEN a * b <= 4096 THEN b WHEN least(a, b) * least(a, b) > 4096 THEN 64 WHEN a < b THEN 4096 // a ELSE b END AS b2 FROM s),
    g AS (SELECT *, least(112, greatest(greatest(a2, b2), ceil(1024.0 / least(a2, b2))::INT)) AS long FROM m),
    d AS (SELECT *, least(112, greatest(least(a2, b2), ceil(1024.0 / long)::INT)) AS short FROM g),
    o AS (SELECT *, (CASE WHEN a2 > b2 THEN long ELSE short END * 32)::INT AS width, (CASE WHEN a2 > b2 THEN short ELSE long END * 32)::INT AS height FROM d)
    SELECT l_orderkey, l_linenumber, (-p.c)::INT AS columns, round(p.s, 6) AS scale, width, height,
           CASE WHEN width * height < 1048576 THEN greatest(0, greatest(32, ceil(ceil(1048576.0 / greatest(width, height)) / 32) * 32) - least(width, height)) ELSE 0 END::INT AS pad_px FROM o""")
def budget_solve(spark, d):
    """Column layout and whole-block sides; also tested against a loop."""
    w, h = (F.lit(200) + F.col("l_partkey") % 300).cast("int"), (F.lit(3000) + F.col("l_suppkey") * 37 % 5000).cast("int")
    fit = Fit(zoom_target_text_h=32.0, reflow_enabled=True)
    got = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"), budget.solve(w, h, F.col("l_quantity"), fit).alias("p"))
    got = got.withColumn("dims", budget.target_dims(F.col("w"), F.col("h"), F.col("p.scale"), fit))
    return got.select("l_orderkey", "l_linenumber", F.col("p.columns").alias("columns"), F.round("p.scale", 6).alias("scale"), "dims.width", "dims.height", budget.padding(F.col("dims.width"), F.col("dims.height"), fit).alias("pad_px"))


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, (200 + l_partkey % 3000)::DOUBLE AS w, (300 + l_suppkey * 37 % 5000)::DOUBLE AS h FROM lineitem),
    a AS (SELECT *, greatest(32, round_even(w / 32, 0) * 32) AS w0, greatest(32, round_even(h / 32, 0) * 32) AS h0 FROM r)
    SELECT l_orderkey, l_linenumber,
           CASE WHEN w0 * h0 > 4194304 THEN greatest(32, floor(w / sqrt(w * h / 4194304) / 32) * 32) WHEN w0 * h0 < 1048576 THEN ceil(w * sqrt(1048576 / (w * h)) / 32) * 32 ELSE w0 END::INT AS width,
           CASE WHEN w0 * h0 > 4194304 THEN greatest(32, floor(h / sqrt(w * h / 4194304) / 32) * 32) WHEN w0 * h0 < 1048576 THEN ceil(h * sqrt(1048576 / (w * h)) / 32) * 32 ELSE h0 END::INT AS height FROM a""")
def smart_resize(spark, d):
    """M6."""
    w, h = F.lit(200) + F.col("l_partkey") % 3000, F.lit(300) + F.col("l_suppkey") * 37 % 5000
    got = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", budget.smart_resize(w, h).alias("s"))
    return got.select("l_orderkey", "l_linenumber", "s.width", "s.height")


def polygons(spark, d):
    """(page, polys): each line a rectangle of 30 by 10 or 12 by 10, turned by ten degrees a line number."""
    angle = F.radians((F.col("l_linenumber") * 10 + F.col("l_suppkey") % 2 * 60).cast("double"))
    long = F.when(F.col("l_partkey") % 3 == 0, F.lit(12.0)).otherwise(F.lit(30.0))
    x, y = (F.col("l_partkey") % 200).cast("double"), (F.col("l_suppkey") * 7 % 300).cast("double")
    point = lambda a, b: F.struct((x + F.cos(angle) * a - F.sin(angle) * b).alias("x"), (y + F.sin(angle) * a + F.cos(angle) * b).alias("y"))
    zero, ten = F.lit(0.0), F.lit(10.0)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(point(zero, zero), point(long, zero), point(long, ten), point(zero, ten)).alias("poly")).alias("r"))
    rows = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select(F.col("l_orderkey").alias("page"), F.transform("rows", lambda r: r["poly"]).alias("polys"))


POLY = """
    WITH p AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey, l_suppkey, radians(l_linenumber * 10 + l_suppkey % 2 * 60) AS a, CASE WHEN l_partkey % 3 = 0 THEN 12.0 ELSE 30.0 END AS w,
                      (l_partkey % 200)::DOUBLE AS x, (l_suppkey * 7 % 300)::DOUBLE AS y, (l_linenumber * 10 + l_suppkey % 2 * 60) AS deg FROM lineitem)"""


@query(POLY + """
    SELECT page, round(median(w * abs(sin(a)) + 10 * abs(cos(a))), 6) AS text_height, count(*) FILTER (w = 30) AS n_slender, round(sum(w * 10), 4) AS area,
           round(CASE WHEN count(*) FILTER (w = 30) >= 3 THEN count(*) FILTER (w = 30 AND deg > 45 AND deg < 135) / count(*) FILTER (w = 30)::DOUBLE ELSE 0 END, 6) AS vertical FROM p GROUP BY page""")
def poly_stats(spark, d):
    """Heights, slender polygons, the share that stands."""
    got = polygons(spark, d)
    areas = F.aggregate(F.transform("polys", geometry.area), F.lit(0.0), lambda s, v: s + v)
    shape = text.let(geometry.slender(F.col("polys"), 1.5), lambda of: F.struct(F.size(of).alias("n"), geometry.standing_ratio(of).alias("vertical")))
    got = got.select("page", F.round(geometry.median_text_height(F.col("polys")), 6).alias("text_height"), F.round(areas, 4).alias("area"), shape.alias("s"))
    return got.select("page", "text_height", F.col("s.n").alias("n_slender"), "area", F.round("s.vertical", 6).alias("vertical"))


@query(POLY + """,
    s AS (SELECT page, n, l_partkey, l_suppkey, CASE WHEN deg > 90 THEN deg - 180 ELSE deg END AS angle, row_number() OVER (PARTITION BY page ORDER BY n, l_partkey, l_suppkey) AS k FROM p WHERE w = 30),
    d AS (SELECT a.page, a.k, any_value(a.angle) AS angle, round(sum(abs(atan2(sin(radians(2 * (a.angle - b.angle))), cos(radians(2 * (a.angle - b.angle)))))), 6) AS dist, count(*) AS m FROM s a JOIN s b USING (page) GROUP BY a.page, a.k)
    SELECT p.page, (SELECT round(arg_min(angle, dist * 1000 + k), 4) FROM d WHERE d.page = p.page AND m >= 3) AS tilt FROM (SELECT DISTINCT page FROM p) p""")
def tilt_medoid(spark, d):
    """The axis nearest to all others."""
    return polygons(spark, d).select("page", F.round(geometry.tilt(F.col("polys")), 4).alias("tilt"))


@query(f"""
    WITH b AS ({BOXES}), u AS (SELECT page, greatest(0, min(x1) - 20) AS x1, greatest(0, min(y1) - 20) AS y1, least(600, max(x2) + 20) AS x2, least(200, max(y2) + 20) AS y2,
        count(*) AS n, (max(x2) - min(x1)) * (max(y2) - min(y1)) / 120000.0 AS covered FROM b GROUP BY page)
    SELECT page, x1, y1, x2, y2, n < 3 AS no_evidence, NOT (n >= 4 AND covered >= 0.12) AS low_trust FROM u""")
def bbox_union(spark, d):
    """The padded box of all polygons, and whether it is trusted."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    got = pages(spark, d).withColumn("polys", F.transform("lines", lambda h: F.array(point(h["x1"], h["y1"]), point(h["x2"], h["y1"]), point(h["x2"], h["y2"]), point(h["x1"], h["y2"]))))
    w, h = F.lit(600), F.lit(200)
    box = geometry.union_box(F.col("polys"), w, h, 20)
    return got.select("page", box["x1"].alias("x1"), box["y1"].alias("y1"), box["x2"].alias("x2"), box["y2"].alias("y2"), geometry.enough(F.col("polys")).isNull().alias("no_evidence"),
                      (quality.localize(F.col("polys"), w, h, min_polys=4)["decision"] == "low_trust").alias("low_trust"))


@query(POLY + """
    SELECT page, n, round(CASE page % 4 WHEN 1 THEN min(y) WHEN 2 THEN min(399 - x) WHEN 3 THEN min(599 - y) ELSE min(x) END, 6) AS x, round(CASE page % 4 WHEN 1 THEN min(399 - x) WHEN 2 THEN min(599 - y) WHEN 3 THEN min(x) ELSE min(y) END, 6) AS y
    FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n, l_partkey, l_suppkey) - 1 AS k FROM p) WHERE k = 0 GROUP BY page, n""")
def rotate_polys(spark, d):
    """Polygons turned by quarters with their page."""
    got = polygons(spark, d).withColumn("r", geometry.rotate_quarters(F.col("polys"), F.col("page") % 4, F.lit(400), F.lit(600)))
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.min("l_linenumber").alias("n"))
    return got.join(first, "page").select("page", "n", F.round(F.col("r")[0][0]["x"], 6).alias("x"), F.round(F.col("r")[0][0]["y"], 6).alias("y"))


@query(f"""
    WITH b AS ({BOXES}), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, t, x1, y1, x2, y2, score) AS r FROM b)
    SELECT page, sum((x2 - x1) * (y2 - y1))::DOUBLE AS area, count(*) FILTER (x2 - x1 >= 12 AND y2 - y1 >= 10) AS croppable FROM o WHERE r <= 3 GROUP BY page""")
def top_k_area(spark, d):
    """The three largest polygons, and those large enough to crop."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    polys = F.transform(F.array_sort(F.transform("lines", lambda h: F.struct(h["text"].alias("t"), h["x1"].alias("x1"), h["y1"].alias("y1"), h["x2"].alias("x2"), h["y2"].alias("y2"), h["score"].alias("s")))),
                        lambda h: F.array(point(h["x1"], h["y1"]), point(h["x2"], h["y1"]), point(h["x2"], h["y2"]), point(h["x1"], h["y2"])))
    top = pages(spark, d).select("page", geometry.top_by_area(polys, 3).alias("top"))
    area = F.aggregate(F.transform("top", geometry.area), F.lit(0.0), lambda s, v: s + v)
    wide = F.filter("top", lambda p: ((geometry.crop_box(p, F.lit(10_000), F.lit(10_000), 1)["x2"] - geometry.crop_box(p, F.lit(10_000), F.lit(10_000), 1)["x1"]) >= 12) & geometry.crop_box(p, F.lit(10_000), F.lit(10_000), 10).isNotNull())
    return top.select("page", area.alias("area"), F.size(wide).alias("croppable"))


@query("""
    WITH s AS (SELECT l_orderkey AS page, l_linenumber * 30 + l_partkey % 40 AS y0, l_linenumber * 30 + l_partkey % 40 + l_quantity AS y1 FROM lineitem),
    o AS (SELECT page, y0, greatest(0, coalesce(max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM s),
    g AS (SELECT page, y0 - before AS gap FROM o WHERE y0 - before >= 3 UNION ALL SELECT page, 400 - greatest(0, max(y1)) FROM s GROUP BY page HAVING 400 - greatest(0, max(y1)) >= 3)
    SELECT page, count(*) AS n_gaps, sum(gap)::DOUBLE AS total FROM g GROUP BY page""")
def interval_union(spark, d):
    """Gaps between the union of a page's spans."""
    y0 = F.col("l_linenumber") * 30 + F.col("l_partkey") % 40
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(F.struct(y0.alias("y0"), (y0 + F.col("l_quantity")).alias("y1"))).alias("spans"))
    gaps = geometry.merge_spans(F.col("spans"), F.lit(400))
    got = rows.select("page", gaps.alias("g")).where(F.size("g") > 0)
    return got.select("page", F.size("g").alias("n_gaps"), F.aggregate(F.transform("g", lambda s: s["y1"] - s["y0"]), F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("""
    WITH s AS (SELECT l_orderkey AS page, (l_linenumber * 30 + l_partkey % 40)::DOUBLE AS y0 FROM lineitem),
    e AS (SELECT page, y0, coalesce(max(y0 + 12) OVER (PARTITION BY page ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS till FROM s),
    g AS (SELECT page, till AS a, y0 AS b FROM e WHERE y0 - till >= 3 UNION ALL SELECT page, max(y0) + 12, 300 FROM s GROUP BY page HAVING 300 - (max(y0) + 12) >= 3),
    t AS (SELECT page, k, abs(spot - 100 * k) AS off, a, spot FROM (SELECT page, k, a, b, least(greatest(100 * k, a + 1), b - 1) AS spot FROM g, (VALUES (1), (2)) v(k)) WHERE spot > a AND spot < b AND abs(spot - 100 * k) <= 60),
    c AS (SELECT page, min({'off': off, 'a': a, 'spot': spot}) FILTER (k = 1) AS one, min({'off': off, 'a': a, 'spot': spot}) FILTER (k = 2) AS two FROM t GROUP BY page)
    SELECT DISTINCT s.page, CASE WHEN two.spot - round_even(one.spot, 0) >= 50 THEN round_even(one.spot, 0)::INT || ',' || round_even(two.spot, 0)::INT ELSE '' END AS cuts FROM s LEFT JOIN c USING (page)""")
def safe_splits(spark, d):
    """Where to cut a page into three columns; also tested against a loop."""
    y0 = F.col("l_linenumber") * 30 + F.col("l_partkey") % 40
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(F.struct(y0.alias("y0"), (y0 + 12).alias("y1"))).alias("spans"))
    return rows.select("page", F.concat_ws(",", geometry.safe_splits(F.col("spans"), F.lit(300), 3)).alias("cuts"))


def sql_pixels(fill: str) -> str:
    """CTEs of the gray pages that texts make, 64 bytes to a row, the last filled up: g (pixels) and s (exact sums)."""
    return f"""
    WITH l AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT) AS v FROM documents WHERE text <> ''),
    f AS (SELECT doc_id, list_resize(v, (len(v) + 63) // 64 * 64, {fill}) AS v FROM l),
    g AS (SELECT doc_id, rows, k // 64 AS y, k % 64 AS x, v FROM (SELECT doc_id, unnest(v) AS v, unnest(range(len(v))) AS k, len(v) // 64 AS rows FROM f)),
    c AS (SELECT *, lag(v) OVER (PARTITION BY doc_id, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY doc_id, y ORDER BY x) AS r, lag(v) OVER (PARTITION BY doc_id, x ORDER BY y) AS u, lead(v) OVER (PARTITION BY doc_id, x ORDER BY y) AS d FROM g),
    p AS (SELECT doc_id, v, (CASE WHEN rows > 1 THEN coalesce(l, r) + coalesce(r, l) + coalesce(u, d) + coalesce(d, u) ELSE coalesce(l, v) + coalesce(r, v) + 2 * v END - 4 * v)::HUGEINT AS lap FROM c),
    t AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, v, count(*) AS n FROM p GROUP BY doc_id, v) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*)::HUGEINT AS n, sum(lap) AS s1, sum(lap * lap) AS s2, sum(v)::HUGEINT AS v, count(*) FILTER (v >= 250) AS high, count(*) FILTER (v <= 5) AS low, count(*) FILTER (abs(lap) <= 1) AS flat FROM p GROUP BY doc_id)"""


@query(sql_pixels("v[-1]") + """
    SELECT doc_id, """ + ", ".join(f"{sql_half_even(a, b, places)} AS {name}" for name, a, b, places in (
        ("blur_lapvar", "n * s2 - s1 * s1", "n * n", 1), ("brightness_mean", "v", "n", 1), ("highlight_clip_frac", "high", "n", 4),
        ("shadow_clip_frac", "low", "n", 4), ("flat_frac", "flat", "n", 3), ("bg_peak", "most", "n", 3))) + " FROM s JOIN t USING (doc_id)")
def image_stats(spark, d):
    """Statistics of the gray image that all bytes of a document make, 64 to a row."""
    got = table(spark, d, "documents").where("text <> ''").select("doc_id", images.byte_stats(F.to_binary("text", F.lit("utf-8")), 64).alias("s"))
    return got.select("doc_id", "s.*")


def ink_blocks():
    """A stand-in detector for pages of text bytes: the ink (beyond a blank) of each eight rows of pixels is a polygon."""
    def run(image):
        ink, polys = image[:, :, 0] > 32, []
        for top in range(0, len(ink), 8):
            across, end = np.flatnonzero(ink[top : top + 8].any(axis=0)), min(top + 8, len(ink))
            if len(across):
                x1, x2 = int(across[0]), int(across[-1]) + 1
                polys.append([(x1, top), (x2, top), (x2, end), (x1, end)])
        return {"polys": polys}

    return run


#: Pages of text bytes are measured as they are, not turned and not scaled.
PAGE_ENV = {"PP2_QUALITY_NORM_WIDTH": "64", "PP2_ORIENT_ENABLED": "0", "PP2_FIT_ENABLED": "0", "PP2_QUALITY_DIGITAL_FLAT_MIN": "0.05", "PP2_QUALITY_DIGITAL_BG_PEAK_MIN": "0.15"}


@query(sql_pixels("32") + f""",
    k AS (SELECT doc_id, any_value(rows) AS h, y // 8 AS k, min(x) FILTER (v > 32) AS x1, max(x) FILTER (v > 32) + 1 AS x2 FROM g GROUP BY doc_id, y // 8),
    b AS (SELECT doc_id, any_value(h) AS h, count(x1) AS n, min(x1) AS x1, max(x2) AS x2, min(8 * k) FILTER (x1 >= 0) AS y1, max(least(8 * k + 8, h)) FILTER (x1 >= 0) AS y2, median(least(8 * k + 8, h) - 8 * k) FILTER (x1 >= 0) AS t FROM k GROUP BY doc_id),
    q AS (SELECT b.doc_id, h, {sql_half_even("n * s2 - s1 * s1", "n * n", 1).replace("n *", "s.n *").replace("* n", "* s.n")} AS blur, b.n, x1, x2, y1, y2, t,
                 {sql_half_even("flat", "s.n", 3)} >= 0.05 AND {sql_half_even("most", "s.n", 3)} >= 0.15 AS digital FROM b JOIN s USING (doc_id) JOIN t m USING (doc_id) WHERE h >= 8),
    e AS (SELECT doc_id, h, blur, digital, CASE WHEN digital OR n < 3 THEN 0 ELSE n END AS n, x1, x2, y1, y2, CASE WHEN NOT digital AND n >= 3 THEN t END AS t FROM q),
    z AS (SELECT *, n >= 7 AND (x2 - x1) * (y2 - y1) / (64.0 * h) >= 0.12 AS trusted, greatest(0, x1 - 20) AS a, greatest(0, y1 - 20) AS b, least(64, x2 + 20) AS c, least(h, y2 + 20) AS d FROM e),
    w AS (SELECT *, greatest(c - a, d - b)::DOUBLE / least(c - a, d - b) / (greatest(64, h)::DOUBLE / least(64, h)) > 1.5 AND n < 50 AS long FROM z),
    o AS (SELECT *, CASE WHEN NOT trusted THEN 64 WHEN long AND h >= 64 THEN 64 ELSE c - a END AS w_out, CASE WHEN NOT trusted THEN h WHEN long AND h < 64 THEN h ELSE d - b END AS h_out FROM w),
    r AS (SELECT *, least(1.0, least(3584.0 / greatest(w_out, h_out), sqrt(4194304.0 / (w_out * h_out)))) AS base, least(3584.0 / greatest(w_out, h_out), sqrt(4194304.0 / (w_out * h_out))) AS hard FROM o),
    x AS (SELECT *, t * CASE WHEN w_out * h_out * base * base < 1048576 THEN greatest(base, least(sqrt(1048576.0 / (w_out * h_out)), hard)) ELSE base END AS t_out FROM r),
    v AS (SELECT *, CASE WHEN digital THEN 'readable' WHEN n < 3 OR coalesce(t_out < 12 AND blur < 80, false) THEN 'unreadable' WHEN coalesce(t_out < 20, false) OR blur < 250 THEN 'marginal' ELSE 'readable' END AS verdict FROM x)
    SELECT d.doc_id, verdict, CASE WHEN digital THEN 'digital' WHEN h > 0 THEN 'photo' END AS route,
           CASE WHEN verdict = 'unreadable' THEN CASE WHEN n < 3 THEN 'no_text_detected(n_polys=' || n || '<3)' ELSE format('text_unrecoverable(text_h={{:.1f}}px<12.0, blur={{:.0f}}<80.0)', t_out, blur) END END AS reject_reason,
           CASE WHEN h > 0 THEN greatest(h, 64) END::INT AS long_side, CASE WHEN h > 0 THEN least(h, 64) END::INT AS short_side, CASE WHEN h > 0 THEN least(h, 64) < 1200 END AS low_res_input, round_even(t, 1) AS text_height, t < 16 AS low_legibility,
           CASE WHEN h > 0 THEN length('P6 ' || w_out || ' ' || h_out || ' 255') + 1 + 3 * w_out * h_out ELSE length('P5 64 ' || (octet_length(encode(d.text)) + 63) // 64 || ' 255') + 1 + (octet_length(encode(d.text)) + 63) // 64 * 64 END::INT AS n_bytes
    FROM documents d LEFT JOIN v USING (doc_id)""")
def page_prepare(spark, d):
    """Every document's bytes as a page, taken through the image stages by stand-in providers."""
    docs = table(spark, d, "documents")
    data = F.to_binary("text", F.lit("utf-8"))
    rows = F.ceil(F.octet_length(data) / 64).cast("int")
    head = F.to_binary(F.format_string("P5 64 %d 255\n", rows), F.lit("utf-8"))
    content = F.when(data.isNotNull(), F.concat(head, F.rpad(data, rows * 64, F.lit(bytearray(b" ")))))
    out = stages.prepare(docs.select("doc_id", content.alias("content")), lambda: images.decode_ppm, ink_blocks, lambda: images.encode_ppm, load((), PAGE_ENV))
    q = F.col("image_quality")
    return out.select(
        "doc_id", "verdict", "route", "reject_reason", q["input_long_side"].alias("long_side"), q["input_short_side"].alias("short_side"), q["low_res_input"].alias("low_res_input"),
        q["median_text_height_px"].alias("text_height"), q["low_legibility"].alias("low_legibility"), F.octet_length("content").alias("n_bytes"))


@query("""
    SELECT event_type AS variant, count(*) AS n, round_even(avg(nullif(value, 0)), 4) AS rec_conf_mean, round_even(avg(user_id), 1) AS n_boxes_mean, round_even(avg(event_id), 1) AS n_chars_mean,
           round_even(median(nullif(value, 0)), 1) AS text_h_median, round_even(avg(user_id * 10), 0) AS pixels_mean, round_even(avg(event_id % 100), 0) AS latency_ms_mean, count(*) FILTER (event_id % 3 = 0) AS resampled_by_vllm
    FROM events WHERE event_id % 11 <> 0 GROUP BY 1""")
def eval_summary(spark, d):
    """One row for each variant; rows with an error do not count."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("variant"), F.when(F.col("event_id") % 11 == 0, F.lit("decode_failed")).alias("error"), F.col("value").alias("rec_conf_mean"), F.col("user_id").alias("n_boxes"), F.col("event_id").alias("n_chars"),
        F.col("value").alias("text_h_at_model_px"), (F.col("user_id") * 10).alias("pixels"), (F.col("event_id") % 100).alias("latency_ms"), (F.col("event_id") % 3 == 0).alias("resample_by_vllm"))
    return evaluation.summary(rows)


@query(f"""
    WITH b AS ({BOXES}), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n, t, x1, y1, x2, y2, score) <= 4 AND x2 - x1 >= 8 AND y2 - y1 >= 8 AS ok FROM b)
    SELECT page, count(*)::INT AS n_boxes, round_even(avg(score) FILTER (ok), 4) AS rec_conf_mean, round_even(median(score) FILTER (ok), 4) AS rec_conf_median, coalesce(sum(length(t)) FILTER (ok), 0)::BIGINT AS n_chars,
           round_even(median(y2 - y1), 1) AS text_h_at_model_px FROM r GROUP BY page""")
def eval_proxy(spark, d):
    """Reading quality of each page, scores of four boxes at most."""
    rows = boxes(spark, d).select(F.col("l_orderkey").alias("page"), F.struct(F.col("l_linenumber").alias("n"), F.col("line.text").alias("t"), F.col("line.x1").alias("a"), F.col("line.y1").alias("b"), F.col("line.x2").alias("c"), F.col("line.y2").alias("d"), F.col("line.score").alias("e")).alias("pos"), "line.*")
    return evaluation.proxy_metrics(rows.withColumn("n_chars", F.length("text")), ["page"], most=4)


@query("SELECT doc_id, v.variant, v.n FROM documents, (VALUES ('raw', 0), ('v2_full', 0), ('v2_no_orient', 1), ('v2_no_localize', 1), ('v2_no_zoom', 1), ('v2_no_reflow', 1), ('v2_no_gate', 1), ('v2_photometric_on', 1)) v(variant, n)")
def eval_runs(spark, d):
    """3.3: each file with each variant."""
    got = evaluation.runs(table(spark, d, "documents").select("doc_id"))
    return got.select("doc_id", "variant", F.size("settings").alias("n"))


@query("""
    SELECT o_orderkey, round_even(o_custkey / 16.0 + o_orderkey / 16.0, 1)::DOUBLE AS total_ms, round_even(o_custkey / 16.0, 1)::DOUBLE AS quality_ms, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_meta FROM orders""")
def journal(spark, d):
    """A13, P6, P7."""
    stages = F.create_map(F.lit("quality"), F.struct((F.col("o_custkey") / 16).alias("elapsed_ms")), F.lit("fit"), F.struct((F.col("o_orderkey") / 16).alias("elapsed_ms")))
    meta = F.create_map(F.lit("route"), F.lit("photo"), F.lit("verdict"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("readable")), F.lit("private"), F.lit("x"))
    got = table(spark, d, "orders").select("o_orderkey", quality.journal(stages).alias("j"), quality.whitelist(meta).alias("m"))
    return got.select("o_orderkey", F.col("j.total_ms").alias("total_ms"), F.col("j.stages")["quality"].alias("quality_ms"), F.size("m").alias("n_meta"))


@query()
def stream_loop(spark, d):
    """Conversations as growing texts, checked every 500 characters; tested against the stream."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("ref"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    return check_batch(rows)


@query(f"""
    SELECT conv_id, count(*) AS n_turns, sum(len(list_filter(string_split_regex(coalesce(text, ''), '{SQL_WS}+'), lambda w: w <> '')))::BIGINT AS tokens, max(len(list_filter(string_split_regex(coalesce(text, ''), '{SQL_WS}+'), lambda w: w <> '')))::BIGINT AS longest
    FROM conversations GROUP BY conv_id""")
def turn_tokens(spark, d):
    """Token counts of all turns by a stand-in tokenizer, which is asked once for each distinct text."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    costs = token_costs(turns, "conv_id", "texts", word_counter)
    return costs.select("conv_id", F.size("costs").cast("long").alias("n_turns"), F.aggregate("costs", F.lit(0).cast("long"), lambda a, c: a + c).alias("tokens"), F.array_max("costs").alias("longest"))


@query("""
    WITH RECURSIVE k AS (
        SELECT user_id, min(ts) AS ts FROM events WHERE ts IS NOT NULL GROUP BY user_id
        UNION ALL SELECT k.user_id, min(e.ts) FROM k JOIN events e ON e.user_id IS NOT DISTINCT FROM k.user_id AND e.ts >= k.ts + INTERVAL 3 HOUR GROUP BY k.user_id, k.ts)
    SELECT user_id, ts::TIMESTAMP AS ts FROM k""")
def first_events(spark, d):
    """2.13: of each user's events those that are kept, where one repeats another within three hours."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return first_requests(rows, "user_id", "ts", "3 hours").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g WHERE ts IS NOT NULL)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    """A Spark extension: sessions of each user's events."""
    got = sessions(table(spark, d, "events"), "user_id")
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return got.select("user_id", naive("start"), naive("end"), "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """A Spark extension: hourly counts by event type."""
    got = event_counts(table(spark, d, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN (o_orderkey * 37 % 441 - 220) / 4.0 END AS t FROM orders)
    SELECT o_orderkey, CASE WHEN t IS NULL THEN 'insufficient_samples' WHEN abs(t) > 45 THEN 'capped' WHEN abs(t) < 0.5 THEN 'below_min' ELSE 'applied' END AS decision, CASE WHEN abs(t) BETWEEN 0.5 AND 45 THEN t ELSE 0 END::DOUBLE AS degrees FROM t""")
def deskew_decision(spark, d):
    """Whether a tilt is corrected, for tilts of -55 to 55 degrees and none."""
    tilt = F.when(F.col("o_custkey") % 7 > 0, (F.col("o_orderkey") * 37 % 441 - 220) / 4.0)
    return table(spark, d, "orders").select("o_orderkey", quality.deskew(tilt).alias("t")).select("o_orderkey", "t.decision", "t.degrees")


@query()
def scan_sorted(spark, d):
    """A folder's files by name and length, content unread."""
    files = read_images(spark, d, "\\.parquet$").select("path", "length")
    return files.select(F.regexp_extract("path", "([^/]+/?[^/]*)$", 1).alias("name"), "length").orderBy("name")
