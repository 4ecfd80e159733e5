"""Model output to typed receipts: parse ladder, lenient coercion, validity.

A receipt that breaks a rule is kept with its violations, never silently cut.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.dates import normalize_date, normalize_time
from sheafline.functions.numbers import coerce_numeric
from sheafline.functions.text import json_substring, let, strip, strip_code_fences, trim_to
from sheafline.shipping import ship

ship(__name__)

#: Values a layout may have (fixed values).
LAYOUTS = ("COMPLETE", "MISSING-HEADER", "ITEM-ONLY", "MISSING-MIDDLE", "MISSING-FOOTER")
MAX_ITEMS, MAX_NAME, MAX_ADDRESS, MAX_DATE = 100, 250, 300, 20
ITEM = "struct<name:string,quantity:double,price:double,total:double>"
SCALARS = ("merchant_name", "merchant_address", "transaction_date", "transaction_time", "total_amount")


class _Lenient:
    """Reads JSON that was cut off or is slightly wrong, as far as it makes sense.

    Strings, lists and objects that do not end are closed; commas, colons, quotes and
    brackets that are missing or too many are passed over; bare words are read as text.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self, more: str = "") -> str:
        while self.at < len(self.text) and (self.text[self.at].isspace() or self.text[self.at] in more):
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def value(self):
        """The value at this place. Open lists and objects stand on a stack, so any depth can be read."""
        top: list = []
        stack: list[tuple[dict | list, str | None]] = [(top, None)]
        while stack:
            holder, key = stack.pop()
            if key is None and holder is not top:  # inside a list or object: what comes next in it
                closing = "}" if isinstance(holder, dict) else "]"
                c = self._skip(",")
                if c in ("}", "]", ""):
                    self.at += c == closing
                    continue
                stack.append((holder, None))
                if isinstance(holder, dict):
                    key = self._string(c) if c in "\"'" else str(self._bare(":"))
                    if self._skip() == ":":
                        self.at += 1
                    if self._skip() in (",", "}", ""):
                        holder[key] = None
                        continue
            c = self._skip(":")
            found = {} if c == "{" else [] if c == "[" else self._string(c) if c in ("\"", "'") else self._bare()
            if isinstance(holder, dict):
                holder[key] = found
            else:
                holder.append(found)
            if c in ("{", "["):
                self.at += 1
                stack.append((found, None))
        return top[0]

    def _string(self, quote: str) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text) and (c := self.text[self.at]) != quote:
            if c == "\\" and self.at + 1 < len(self.text):
                self.at += 1
                e = self.text[self.at]
                if e == "u":
                    try:
                        out.append(chr(int(self.text[self.at + 1 : self.at + 5], 16)))
                        self.at += 4
                    except ValueError:
                        pass
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
            elif c != "\\":
                out.append(c)
            self.at += 1
        self.at += 1
        return "".join(out)

    def _bare(self, stop: str = ""):
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",]}" + stop:
            self.at += 1
        word = self.text[start : self.at].strip()
        if self.at == start:
            self.at += 1
        known = {"true": True, "false": False, "null": None, "none": None, "": None}
        if word.lower() in known:
            return known[word.lower()]
        try:
            return json.loads(word)
        except ValueError:
            return word


def repair(text: str | None) -> str | None:
    """JSON text of what a broken object or list says; null where there is neither, or more nesting than JSON readers take."""
    start = min((k for k in ((text or "").find("{"), (text or "").find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    try:
        out = json.dumps(_Lenient(text[start:]).value(), ensure_ascii=False)
    except RecursionError:
        return None
    # Code points that no UTF-8 text can hold are replaced.
    return out.encode("utf-8", "replace").decode()


def repair_json(text: Column | str) -> Column:
    """repair() of a column, for the few rows that need it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([repair(t) for t in texts], dtype=object)

    return run(text)


def parse_ladder(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """df with `data` VARIANT and `parsed_by`: json, substring, repair or null (nothing to read).

    One pass: rows that a parser has read are null for the next one, so that only texts
    that both parsers give up on are shipped to the Python repair.
    """
    df = df.withColumn("__text", strip_code_fences(F.col(raw)))
    df = df.withColumn("__json", F.try_parse_json("__text"))
    df = df.withColumn("__sub", F.when(F.col("__json").isNull(), F.try_parse_json(json_substring(F.col("__text")))))
    broken = F.col("__json").isNull() & F.col("__sub").isNull() & (F.col("__text") != "")
    df = df.withColumn("__mended", F.try_parse_json(repair_json(F.when(broken, F.col("__text")))))
    steps = {"json": "__json", "substring": "__sub", "repair": "__mended"}
    by = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in steps.items()))
    return df.withColumn("data", F.coalesce(*(F.col(c) for c in steps.values()))).withColumn("parsed_by", by).drop("__text", *steps.values())


def field(data: Column, *keys: str) -> Column:
    """The first of the keys that an object has, as VARIANT, even where its value is JSON null."""
    return F.coalesce(*(F.try_variant_get(data, f"$.{k}", "variant") for k in keys))


def kind(value: Column) -> Column:
    """The JSON type of a VARIANT: STRING, OBJECT, ARRAY, BOOLEAN, VOID or a number's."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object; its fields are not read, as kind() does."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column) -> Column:
    """A number as it is, true and false as 1 and 0, text by coerce_numeric, else null."""
    def number(v: Column) -> Column:
        return let(kind(v), lambda k: F.when(k == "STRING", coerce_numeric(as_text(v))).when(k.isin("OBJECT", "ARRAY", "VOID"), F.lit(None).cast("double")).when(
            k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(v, "$", "double")))

    return let(value, number)


def items_of(value: Column) -> Column:
    """Items of a VARIANT list: objects and non-blank texts; all else is left out; no list gives []."""
    elements = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    # The type of an element is read once: for an object it means reading all of it.
    tagged = F.transform(elements, lambda e: F.struct(e.alias("e"), kind(e).alias("k")))
    kept = F.filter(tagged, lambda t: (t["k"] == "OBJECT") | ((t["k"] == "STRING") & (strip(as_text(t["e"])) != "")))

    def item(t: Column) -> Column:
        e, obj = t["e"], t["k"] == "OBJECT"
        name = F.when(obj, as_text(field(e, "n", "name"))).otherwise(as_text(e))
        number = lambda *keys: F.when(obj, as_number(field(e, *keys)))
        return F.struct(trim_to(name, MAX_NAME).alias("name"), number("qty", "quantity").alias("quantity"), number("p", "price").alias("price"), number("t", "total").alias("total"))

    return F.transform(kept, item)


def dropped_of(value: Column, items: Column) -> Column:
    """How many elements of the list items_of left out."""
    return F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")), F.lit(0)) - F.size(items)


def to_receipt(df: DataFrame, data: str = "data") -> DataFrame:
    """df with the receipt's columns, `items_dropped`, `violations` and `is_valid`.

    Short keys win over full names; keys that no receipt has are ignored. Violations
    name what makes the whole receipt invalid: no object, too many items, an unknown
    layout, a date or layout that is too long or no text.
    """
    d = F.col(data)
    it = field(d, "it", "items")
    out = df.withColumn("layout", as_text(field(d, "ly", "layout"))).withColumn("items", items_of(it)).withColumn("items_dropped", dropped_of(it, F.col("items")))
    out = out.withColumn("merchant_name", trim_to(as_text(field(d, "mn", "merchant_name")), MAX_NAME))
    out = out.withColumn("merchant_address", trim_to(as_text(field(d, "ma", "merchant_address")), MAX_ADDRESS))
    out = out.withColumn("transaction_date", normalize_date(as_text(field(d, "td", "transaction_date"))))
    out = out.withColumn("transaction_time", normalize_time(as_text(field(d, "tt", "transaction_time"))))
    out = out.withColumn("total_amount", as_number(field(d, "ta", "total_amount")))
    checks = {
        "not_an_object": ~is_object(d), "too_many_items": F.size("items") > MAX_ITEMS,
        "unknown_layout": F.col("layout").isNotNull() & ~F.col("layout").isin(*LAYOUTS), "long_date": F.coalesce(F.length("transaction_date") > MAX_DATE, F.lit(False)),
    }
    out = out.withColumn("violations", F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull()))
    return out.withColumn("is_valid", F.size("violations") == 0)


def fail_safe(df: DataFrame, where: Column) -> DataFrame:
    """df with the receipt's columns emptied where a condition holds."""
    for name in SCALARS:
        df = df.withColumn(name, F.when(~where, F.col(name)))
    return df.withColumn("items", F.when(where, F.array().cast(f"array<{ITEM}>")).otherwise(F.col("items")))


def substantive(value: Column, is_text: bool) -> Column:
    return (value.isNotNull() & (strip(value) != "")) if is_text else value.isNotNull()


def substantive_scalars() -> Column:
    """How many of a receipt's five scalars hold something."""
    return sum((F.coalesce(substantive(F.col(n), n != "total_amount"), F.lit(False)).cast("int") for n in SCALARS[1:]), F.coalesce(substantive(F.col(SCALARS[0]), True), F.lit(False)).cast("int"))


def has_data(items: Column | None = None) -> Column:
    """Whether a receipt has items or a scalar that holds something."""
    return (F.coalesce(F.size(F.col("items") if items is None else items), F.lit(0)) > 0) | (substantive_scalars() > 0)


def receipt_json() -> Column:
    """A receipt's answer as JSON text, without the layout it was read by."""
    return F.to_json(F.struct(*SCALARS[:4], "items", "total_amount"), {"ignoreNullFields": "false"})
