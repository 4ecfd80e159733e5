"""Recognised lines to visual rows to prompt text.

A page's lines are one array column: struct(text, x1, y1, x2, y2, score, y_center).
Everything runs inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.dates import EXPIRY, folded_date, folded_time
from sheafline.functions.text import fold, let, strip

LINE = "struct<text:string,x1:int,y1:int,x2:int,y2:int,score:double,y_center:double>"
MIN_SCORE, MAX_LINES, MAX_CHARS, ROW_OVERLAP, COLUMN_GAP, QUANT = 0.5, 400, 500, 0.85, 5.0, 2
TRIM, ROUNDS, INPUT_CAP = 0.9, 8, 9500


def line(text: Column, x1: Column, y1: Column, x2: Column, y2: Column, score: Column) -> Column:
    y = (y1.cast("double") + y2.cast("double")) / 2
    return F.struct(text.alias("text"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"), score.cast("double").alias("score"), y.alias("y_center"))


def zip_lines(texts: Column, scores: Column, polys: Column) -> Column:
    """Lines of three parallel lists, as many as the shortest has; polys are lists of struct(x, y)."""
    n = F.least(F.size(texts), F.size(scores), F.size(polys))
    box = lambda p, of, axis: of(F.transform(p, lambda q: q[axis])).cast("int")  # noqa: E731  toward zero, as int()
    made = F.transform(F.slice(F.arrays_zip(texts.alias("t"), scores.alias("s"), polys.alias("p")), 1, F.greatest(n, F.lit(0))), lambda z: line(
        strip(F.coalesce(z["t"], F.lit(""))), box(z["p"], F.array_min, "x"), box(z["p"], F.array_min, "y"), box(z["p"], F.array_max, "x"), box(z["p"], F.array_max, "y"), F.coalesce(z["s"], F.lit(0.0))))
    return F.coalesce(made, F.array().cast(f"array<{LINE}>"))


def keep_lines(lines: Column, least: float = MIN_SCORE) -> Column:
    """Lines with a score, text and a box of some size."""
    return F.filter(lines, lambda h: (h["score"] >= least) & (h["text"] != "") & (h["x2"] > h["x1"]) & (h["y2"] > h["y1"]))


def _sorted(lines: Column, *names: str) -> Column:
    """Stable: lines that are alike in names keep their order."""
    tagged = F.transform(lines, lambda h, k: F.struct(*(h[n].alias(f"k_{n}") for n in names), k.alias("k"), h.alias("line")))
    return F.transform(F.array_sort(tagged), lambda t: t["line"])


def sort_lines(lines: Column) -> Column:
    """Top to bottom by centre, then left to right."""
    return _sorted(lines, "y_center", "x1")


def _ends(rows: Column, extra: Column) -> Column:
    """rows with extra put into the last one."""
    return F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.concat(F.element_at(rows, -1), F.array(extra))))


def group_rows(lines: Column, overlap: float = ROW_OVERLAP) -> Column:
    """Lists of lines that share a visual row, from lines sorted top to bottom.

    A line joins the current row if it overlaps the row's box, which grows with every
    line, by enough of the lower of the two heights.
    """
    none = F.lit(0)
    start = F.struct(F.array().cast(f"array<array<{LINE}>>").alias("rows"), none.alias("y1"), none.alias("y2"))

    def step(acc: Column, h: Column) -> Column:
        shared = F.greatest(F.lit(0), F.least(h["y2"], acc["y2"]) - F.greatest(h["y1"], acc["y1"]))
        lower = F.least(F.greatest(F.lit(1), h["y2"] - h["y1"]), F.greatest(F.lit(1), acc["y2"] - acc["y1"]))
        joins = (F.size(acc["rows"]) > 0) & (shared >= lower * F.lit(overlap))
        return F.struct(
            F.when(joins, _ends(acc["rows"], h)).otherwise(F.concat(acc["rows"], F.array(F.array(h)))).alias("rows"),
            F.when(joins, F.least(acc["y1"], h["y1"])).otherwise(h["y1"]).alias("y1"), F.when(joins, F.greatest(acc["y2"], h["y2"])).otherwise(h["y2"]).alias("y2"))

    return F.aggregate(lines, start, step, lambda acc: acc["rows"])


def median(values: Column) -> Column:
    """The median of a list of numbers; null of an empty one."""
    mid = lambda s, k: F.get(s, k.cast("int")).cast("double")
    middle = lambda s, n: F.when(n > 0, (mid(s, F.floor((n - 1) / 2)) + mid(s, F.floor(n / 2))) / 2)
    return let(F.array_sort(values), lambda s: middle(s, F.size(s)))


def split_columns(row: Column, gap: float = COLUMN_GAP) -> Column:
    """A row's lines, left to right, cut where the space between two is over gap times the median height."""
    if gap <= 0:
        return F.array(row)
    start = F.struct(F.array().cast(f"array<array<{LINE}>>").alias("rows"), F.lit(0).alias("x2"))

    def step(acc: Column, h: Column, wide: Column) -> Column:
        apart = (F.size(acc["rows"]) == 0) | F.coalesce(h["x1"] - acc["x2"] > wide, F.lit(False))
        return F.struct(F.when(apart, F.concat(acc["rows"], F.array(F.array(h)))).otherwise(_ends(acc["rows"], h)).alias("rows"), h["x2"].alias("x2"))

    def cut(lines: Column) -> Column:
        wide = median(F.filter(F.transform(lines, lambda h: h["y2"] - h["y1"]), lambda v: v > 0)) * gap
        parts = let(wide, lambda w: F.aggregate(_sorted(lines, "x1"), start, lambda acc, h: step(acc, h, w), lambda acc: acc["rows"]))
        return F.when(F.size(lines) <= 1, F.array(lines)).otherwise(parts)

    return let(row, cut)


def join_line(row: Column) -> Column:
    """One line of a row's: texts joined, the box of all, the mean score."""
    of = lambda name: F.transform(row, lambda h: h[name])
    total = F.aggregate(of("score"), F.lit(0.0), lambda a, s: a + s)
    return line(F.array_join(of("text"), " "), F.array_min(of("x1")), F.array_min(of("y1")), F.array_max(of("x2")), F.array_max(of("y2")), total / F.size(row))


def merge_rows(lines: Column, overlap: float = ROW_OVERLAP, gap: float = COLUMN_GAP, most: int = MAX_LINES) -> Column:
    """Lines merged into visual rows, split at column gaps, sorted, the first `most`."""
    rows = F.flatten(F.transform(group_rows(sort_lines(lines), overlap), lambda r: split_columns(r, gap)))
    merged = F.transform(rows, lambda r: F.when(F.size(r) == 1, r[0]).otherwise(join_line(r)))
    return F.slice(sort_lines(merged), 1, most)


def text_block(lines: Column, quant: int = QUANT, most: int = MAX_CHARS) -> Column:
    """The prompt block of lines: ``x1,y1,x2,y2|text``; no lines give ''."""
    at = lambda h, n: F.floor(h[n] / quant).cast("string")
    flat = lambda h: strip(F.translate(h["text"], "\n\r", "  "))
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), "(?U)[\\s\\x1c-\\x1f]+$", ""), F.lit("…"))).otherwise(t)
    shown = F.transform(F.filter(lines, lambda h: flat(h) != ""), lambda h: F.concat(at(h, "x1"), F.lit(","), at(h, "y1"), F.lit(","), at(h, "x2"), F.lit(","), at(h, "y2"), F.lit("|"), cut(flat(h))))
    return F.when(F.size(shown) > 0, F.concat(F.lit("<ocr_text>\n"), F.array_join(shown, "\n"), F.lit("\n</ocr_text>\n"))).otherwise(F.lit(""))


def fit_lines(line_tokens: Column, fixed_tokens: Column, input_cap: int = INPUT_CAP, rounds: int = ROUNDS) -> Column:
    """struct(keep, status): how many of the first lines fit a prompt of input_cap tokens.

    line_tokens: tokens of each line; fixed_tokens: of the rest of the prompt. Each round
    drops a tenth of the lines, one at least. status: fit, template_too_big, no_lines,
    overflow (one line is too much) or no_convergence.
    """
    shrink = lambda n: F.when(F.floor(n * F.lit(TRIM)) >= n, n - 1).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(TRIM)).cast("int")))
    tried = F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), F.array(F.size(line_tokens)), lambda acc, _: F.concat(acc, F.array(F.when(F.element_at(acc, -1) > 1, shrink(F.element_at(acc, -1))).otherwise(F.lit(1)))))
    cost = lambda n: fixed_tokens + F.aggregate(F.slice(line_tokens, 1, n), F.lit(0), lambda a, t: a + t)
    keep = F.get(F.filter(tried, lambda n: cost(n) <= input_cap), F.lit(0))
    status = F.when(fixed_tokens > input_cap, F.lit("template_too_big")).when(F.size(line_tokens) < 1, F.lit("no_lines")).when(keep.isNotNull(), F.lit("fit")).when(
        F.array_contains(tried, 1), F.lit("overflow")).otherwise(F.lit("no_convergence"))
    return F.struct(F.when(status == "fit", keep).alias("keep"), status.alias("status"))


def output_budget(input_tokens: Column, model_len: int, margin: int, most: int) -> Column:
    return F.least(F.lit(model_len) - input_tokens - margin, F.lit(most))


def sweep_datetime(date: Column, time: Column, lines: Column, as_of_year: int) -> Column:
    """struct(date, time): as given, or where missing from the lowest line that shows one.

    Lines about a product's shelf life do not count. Lines of one height keep their order.
    Lines are put in order once, and none is parsed once a value is known.
    """
    missing = lambda c: F.nullif(c, F.lit(""))
    # A line is folded once, for the test and for both searches.
    folded = F.transform(lines, lambda h, k: F.struct((-(h["y1"] + h["y2"]) / 2).alias("y"), k.alias("k"), F.when(strip(h["text"]) != "", fold(h["text"])).alias("t")))
    tagged = F.array_sort(F.filter(folded, lambda h: ~h["t"].rlike(EXPIRY)))
    tagged = F.when(missing(date).isNull() | missing(time).isNull(), tagged)
    fill = lambda c, found, rows: F.aggregate(rows, missing(c), lambda a, x: F.coalesce(a, found(x["t"])))
    return let(F.coalesce(tagged, F.array().cast("array<struct<y:double,k:int,t:string>>")), lambda rows: F.struct(fill(date, lambda t: folded_date(t, as_of_year), rows).alias("date"), fill(time, folded_time, rows).alias("time")))


def parse_block(block: Column, quant: int = QUANT) -> Column:
    """Lines of a prompt block, as text_block wrote them: boxes in whole steps of quant, no score."""
    rows = F.filter(F.split(block, "\n"), lambda r: r.rlike("^-?\\d+,-?\\d+,-?\\d+,-?\\d+\\|"))
    number = lambda r, k: F.split_part(F.split_part(r, F.lit("|"), F.lit(1)), F.lit(","), F.lit(k)).cast("int") * quant
    return F.transform(rows, lambda r: line(F.regexp_extract(r, "^[^|]*\\|(.*)$", 1), number(r, 1), number(r, 2), number(r, 3), number(r, 4), F.lit(None).cast("double")))
