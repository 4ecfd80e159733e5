"""Numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafline.functions.text import let, strip

#: What Python's float() reads.
FLOAT = "(?i)^[+-]?(?:inf|infinity|nan|(?:\\d+(?:_\\d+)*\\.?(?:\\d+(?:_\\d+)*)?|\\.\\d+(?:_\\d+)*)(?:e[+-]?\\d+(?:_\\d+)*)?)$"


def python_float(text: Column) -> Column:
    """The double that Python reads from a text; null where it reads none."""
    return F.when(text.rlike(FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def coerce_numeric(text: Column) -> Column:
    """A printed amount as a double, or null.

    Blanks go, as do a currency sign behind and a currency name before the number.
    Dashes, commas and dots between groups of three digits are thousands separators; a
    single comma before one or two digits is a decimal comma. Numbers that are not text
    need no call: cast them.
    """
    s = F.replace(strip(text), F.lit(" "), F.lit(""))
    s = F.regexp_replace(s, "[đ₫]$", "")
    s = strip(F.regexp_replace(s, "(?iuU)^(?:VNĐ|VND|USD)\\s*", ""))
    s = let(s, lambda x: F.when(x.rlike("^\\d+(?:-\\d{3})+$"), F.replace(x, F.lit("-"), F.lit(""))).otherwise(x))
    s = let(s, lambda x: F.when(x.rlike("^[^,]*,\\d{1,2}$"), F.replace(x, F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit(""))))
    s = let(s, lambda x: F.when(x.rlike("^[^.]*(?:\\.\\d{3})+$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(x))
    return let(s, python_float)


def normalize_total(text: Column) -> Column:
    """A line total as a key: '' for none, one spelling for equal numbers, else lower case."""
    def key(s: Column) -> Column:
        none = (s == "") | (F.lower(s) == "null")
        return F.when(none, F.lit("")).otherwise(F.coalesce(python_float(s).cast("string"), F.lower(s)))

    return let(F.coalesce(strip(text), F.lit("")), key)


def align_down(n: Column, block: int) -> Column:
    """The largest multiple of block up to n, block at least."""
    return F.greatest(F.lit(block), (F.floor(n / block) * block).cast("int"))


def align_up(n: Column, block: int) -> Column:
    """The smallest multiple of block from n on, block at least."""
    return F.greatest(F.lit(block), (F.ceil(n / block) * block).cast("int"))


def max_tokens(prompt_tokens: Column, most: int, model_len: int, margin: int, least: int) -> Column:
    """Output tokens left by a prompt; where its length is unknown the most that is allowed."""
    budget = F.lit(model_len) - prompt_tokens - margin
    return F.when(prompt_tokens.isNull(), F.lit(most)).when(budget < least, F.lit(least)).otherwise(F.least(F.lit(most), budget))
