"""Dates and times as Column expressions; results are ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.text import fold, let, strip

SEP = "[\\s\\x1c-\\x1f./\\-]"
#: Words of a line that is about a product's shelf life, not the purchase (fixed values).
EXPIRY = "(?U)\\b(?:hsd|hsd:|nsx|nsx:|exp|exp:|mfg|mfg:|han\\s*su\\s*dung|expir|expiry)\\b"
#: Words that make a bare DDMMYYYY a date (fixed values).
LABEL = "(?U)\\bngay\\b|\\bdate\\b"


def _group(text: Column, pattern: str, k: int) -> Column:
    # A blank is no number; a cast that fails makes an error of it first, which takes long.
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int")


def iso(year: Column, month: Column, day: Column) -> Column:
    """The ISO date of a calendar day, or null."""
    made = F.try_to_date(F.format_string("%04d-%d-%d", year, month, day), "yyyy-M-d")
    return let(made, lambda x: F.when(F.year(x) >= 1, F.date_format(x, "yyyy-MM-dd")))


def normalize_date(text: Column) -> Column:
    """A printed date as YYYY-MM-DD; what is no calendar date stays as it is; blank is null.

    Year-first, then day-first with a four-digit year, then eight digits, then a
    two-digit year at the front (or at the end where only that can be one). Where the
    month is impossible, day and month are swapped.
    """
    ymd = f"(?U)^(\\d{{4}}){SEP}(\\d{{1,2}}){SEP}(\\d{{1,2}})$"
    dmy = f"(?U)^(\\d{{1,2}}){SEP}(\\d{{1,2}}){SEP}(\\d{{4}})$"
    eight = "^(\\d{4})(\\d{2})(\\d{2})$"
    yy = f"(?U)^(\\d{{2}}){SEP}(\\d{{1,2}}){SEP}(\\d{{1,2}})$"

    def parts(s: Column, pattern: str, body) -> Column:
        a, b, c = (_group(s, pattern, k) for k in (1, 2, 3))
        return F.when(s.rlike(pattern), let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), lambda g: body(g["a"], g["b"], g["c"])))

    def short(p: Column, q: Column, r: Column) -> Column:
        last = (r > 31) & (p <= 31)
        year, day = F.when(last, r + 2000).otherwise(p + 2000), F.when(last, p).otherwise(r)
        return F.coalesce(iso(year, q, day), iso(year, day, q))

    def body(s: Column) -> Column:
        return F.coalesce(
            parts(s, ymd, iso), parts(s, dmy, lambda d, m, y: F.coalesce(iso(y, m, d), iso(y, d, m))),
            parts(s, eight, lambda a, b, c: F.coalesce(iso(a, b, c), iso(c, b, a))), parts(s, yy, short), s)

    return let(F.nullif(strip(text), F.lit("")), body)


def normalize_time(text: Column) -> Column:
    """HH:MM[:SS] from the front of a text; null if out of range; other shapes give their first ten characters."""
    clock = lambda s: F.when(s.rlike("^\\d{1,2}:\\d{2}"), _clock(s, "^(\\d{1,2}):(\\d{2})(?::(\\d{2}))?")).otherwise(F.substring(s, 1, 10))
    return let(F.nullif(strip(text), F.lit("")), clock)


def _clock(s: Column, pattern: str) -> Column:
    def shown(t: Column) -> Column:
        good = (t["h"] <= 23) & (t["m"] <= 59) & (t["s"].isNull() | (t["s"] <= 59))
        return F.when(good & t["s"].isNotNull(), F.format_string("%02d:%02d:%02d", t["h"], t["m"], t["s"])).when(good, F.format_string("%02d:%02d", t["h"], t["m"]))

    return let(F.struct(*(_group(s, pattern, k).alias(n) for k, n in ((1, "h"), (2, "m"), (3, "s")))), shown)


#: How lines of text show dates and times (fixed values).
YEAR_FIRST, DAY_FIRST, RUN_TOGETHER = "(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})", f"(?U)(\\d{{1,2}}){SEP}(\\d{{1,2}}){SEP}(\\d{{2,4}})", "(?U)\\b(\\d{2})(\\d{2})(\\d{4})\\b"
CLOCK = "(\\d{1,2})[:h](\\d{2})(?::(\\d{2}))?"


def is_expiry_line(text: Column) -> Column:
    return fold(text).rlike(EXPIRY)


def find_date(text: Column, as_of_year: int) -> Column:
    """The date that a line of text shows: year-first, day-first, or DDMMYYYY behind a label.

    Years before 2000 or after the year that follows as_of_year count as none.
    """
    return folded_date(fold(text), as_of_year)


def folded_date(text: Column, as_of_year: int) -> Column:
    """find_date of a text that is folded already."""
    def checked(s: Column, pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (_group(s, pattern, k) for k in order)

        def known(g: Column) -> Column:
            year = F.when(g["y"] < 100, g["y"] + 2000).otherwise(g["y"])
            return F.when((year >= 2000) & (year <= as_of_year + 1), iso(year, g["m"], g["d"]))

        return F.when(s.rlike(pattern), let(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), known))

    def body(s: Column) -> Column:
        first, second = checked(s, YEAR_FIRST, (1, 2, 3)), checked(s, DAY_FIRST, (3, 2, 1))
        third = F.when(s.rlike(LABEL), checked(s, RUN_TOGETHER, (3, 2, 1)))
        return F.coalesce(first, second, third)

    return let(text, body)


def find_time(text: Column) -> Column:
    """The first clock time of a line of text, if it is one."""
    return folded_time(fold(text))


def folded_time(text: Column) -> Column:
    """find_time of a text that is folded already."""
    return let(text, lambda s: F.when(s.rlike(CLOCK), _clock(s, CLOCK)))


#: What the model is told about two-digit years (fixed text).
YEAR_NOTE = (
    ". Use ONLY to expand a PRINTED 2-digit year (DD/MM/YY -> 20YY). Never add a year when the printed date has only day and month.\n</context>\n\n"
)


def year_context(year: Column) -> Column:
    """The prompt block that anchors two-digit years."""
    return F.concat(F.lit("<context>\nCurrent year is "), year.cast("string"), F.lit(YEAR_NOTE))
