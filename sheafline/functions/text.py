"""Text normalisation as Column expressions, all JVM-side.

Patterns follow Python's reading of ``\\s`` and ``\\w`` (Unicode by default), which Java
needs ``(?U)`` and a few extra characters for.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space; Java's Unicode class lacks the four separators.
WS = "[\\s\\x1c-\\x1f]"
#: The characters of that class.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Scripts that no receipt in the supported languages prints (fixed values).
CJK_BLOCKS = "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}"
#: The same with the wider range that the literal pattern of strict mode spans.
CJK_STRICT = CJK_BLOCKS.replace("\\x{F900}-\\x{FAFF}", "\\x{8C48}-\\x{FAFF}")
#: Characters that JSON syntax and its literals are made of (fixed value).
STRUCTURE = '{}[]":,nulltrefas \n'
#: An item's name and total in JSON that is still being written (fixed value).
ITEM_PAIR = r'"(?:n|name)"\s*:\s*"([^"\n]{1,100})"[^}]{0,200}?"t"\s*:\s*(-?\d+(?:\.\d+)?|null)'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body mentions it.

    Plans hold expressions as trees: what is mentioned twice is computed twice, and
    chains of such expressions grow beyond what can be compiled.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.cache
def _folding() -> tuple[str, str]:
    """Every character of the basic plane that decomposes to one base letter, and that letter."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for cp in range(0x80, min(0x10000, sys.maxunicode)):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != ch:
            source.append(ch)
            target.append(base[0])
    return "".join(source), "".join(target)


def strip_diacritics(text: Column) -> Column:
    """Letters without their marks; đ and Đ become d and D. Null stays null."""
    return F.regexp_replace(F.translate(text, *_folding()), "\\p{Mn}+", "")


def strip(text: Column) -> Column:
    """Without white space at either end, as Python's strip."""
    return F.trim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){WS}+", " ")


def normalize_for_match(text: Column) -> Column:
    """Lower case without marks, white space collapsed; punctuation stays. Null is ''."""
    return F.coalesce(F.trim(collapse(F.lower(strip_diacritics(text)))), F.lit(""))


def normalize_name(text: Column) -> Column:
    """As normalize_for_match, with punctuation made blank: the key of duplicate items."""
    plain = F.regexp_replace(F.lower(strip_diacritics(text)), "(?U)[^\\p{L}\\p{N}_\\s\\x1c-\\x1f]+", " ")
    return F.coalesce(F.trim(collapse(plain)), F.lit(""))


def fold(text: Column) -> Column:
    """Lower case without marks, for line patterns."""
    return F.lower(strip_diacritics(F.coalesce(text, F.lit(""))))


def strip_cjk(text: Column, strict_reference: bool = False) -> Column:
    """Without CJK characters, white space collapsed; null if nothing is left."""
    blocks = CJK_STRICT if strict_reference else CJK_BLOCKS
    return F.nullif(F.trim(collapse(F.regexp_replace(text, f"[{blocks}]", ""))), F.lit(""))


def strip_trailing_punct(text: Column) -> Column:
    """Without ``.,;:`` and white space at the end, unless that is all there is."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "(?U)[.,;:\\s\\x1c-\\x1f]+$", ""), F.lit("")), text)


def trim_to(text: Column, most: int) -> Column:
    """Stripped and cut to most characters; blank is null."""
    return F.nullif(F.substring(strip(text), 1, most), F.lit(""))


def preview(text: Column, most: int) -> Column:
    """One line of most characters at most, with an ellipsis where text was cut."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(text) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def has_char_run(text: Column, least: int = 6) -> Column:
    """Whether one character, no digit or white space, repeats least times in a row."""
    return F.coalesce(text.rlike(f"(?U)([^\\d\\s\\x1c-\\x1f])\\1{{{least - 1},}}"), F.lit(False))


def char_run(text: Column, least: int = 6) -> Column:
    """The first such run, or null."""
    return F.nullif(F.regexp_extract(text, f"(?U)([^\\d\\s\\x1c-\\x1f])\\1{{{least - 1},}}", 0), F.lit(""))


def ngram_loops(text: Column, lengths: tuple[int, ...] = (2, 3, 4), least: int = 4) -> Column:
    """What repeats, of every n-gram that repeats least times in a row, shorter ones first.

    N-grams of digits alone or of JSON structure alone do not count.
    """
    structure = "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(STRUCTURE))
    hits = [F.regexp_extract_all(text, F.lit(f"(?d)(.{{{n}}})\\1{{{least - 1},}}"), F.lit(1)) for n in lengths]
    return F.filter(F.concat(*hits), lambda g: ~g.rlike("(?U)^\\d+$") & ~g.rlike(f"^[{structure}]+$"))


def has_loop(text: Column) -> Column:
    """Whether a text shows a character run or an n-gram loop."""
    # Few texts repeat anything four times: one search finds them, the loops are listed for these alone.
    some = text.rlike("(?d)(..)\\1{3}|(...)\\2{3}|(....)\\3{3}")
    return F.coalesce(has_char_run(text) | F.when(some, F.size(ngram_loops(text)) > 0).otherwise(F.lit(False)), F.lit(False))


def strip_code_fences(text: Column) -> Column:
    """Without the fence lines of a text that starts with a fence."""
    whole = strip(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(whole, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"), lambda x: ~strip(x).startswith("```"))
    return F.when(whole.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(whole)


def json_substring(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; else the same with brackets; else the text."""
    whole = strip(F.coalesce(text, F.lit("")))
    braces = F.nullif(F.regexp_extract(whole, "(?s)\\{.*\\}", 0), F.lit(""))
    brackets = F.nullif(F.regexp_extract(whole, "(?s)\\[.*\\]", 0), F.lit(""))
    return F.coalesce(braces, brackets, whole)


def json_item_pairs(text: Column) -> Column:
    """(name, total) of every item that partial JSON holds up to its total."""
    pattern = F.lit(ITEM_PAIR)
    names, totals = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(names.alias("name"), totals.alias("total")), lambda x: F.struct(x["name"].alias("name"), x["total"].alias("total")))
