"""Repetition loops in item lists and text fields."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheafline.functions.numbers import normalize_total
from sheafline.functions.text import has_loop, let, normalize_name, strip
from sheafline.scratch import materialize

#: Longest cycle, repeats that make a loop of one item, and of a cycle of several.
MAX_PERIOD, SINGLE_REPEATS, CYCLE_REPEATS = 5, 10, 3
#: Rows of a group beyond which it is worked on by several tasks.
SEGMENT = 1 << 20


def item_key(name: Column, total: Column, strict_reference: bool = False) -> Column:
    """What duplicate items are told by: name and line total; in strict mode the name alone.

    An item without a name has the empty key, which equals nothing.
    """
    n = normalize_name(name)
    t = F.lit("") if strict_reference else normalize_total(total.cast("string"))
    return F.struct(n.alias("name"), F.when(n == "", F.lit("")).otherwise(t).alias("total"))


def cyclic_runs(keys: DataFrame, group: list[str], order: str, name: str, key: str, max_period: int = MAX_PERIOD, single: int = SINGLE_REPEATS, cycle: int = CYCLE_REPEATS, segment: int = SEGMENT) -> DataFrame:
    """The strongest cycle of each group that has one: group, period, repeats, sample.

    keys: one row for each item; key is compared, name is empty for what matches
    nothing. A position matches if it equals the one a period earlier; a maximal run of
    L matches is L div period + 1 repeats. Most repeats win, then the shorter period,
    then the earlier run. Longer cycles of one and the same key do not count.

    A group of more than `segment` rows is worked on in segments of so many rows, many
    tasks to a group; runs that reach a segment's end are joined to those that go on.
    keys are read more than once. Rows of one order are in any order.
    """
    rows = keys.select(*group, F.col(order).alias("__order"), F.col(name).alias("__name"), F.col(key).alias("__key"))
    # Fewer groups than rows / segment are large, which bounds what is broadcast.
    large = materialize(rows.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > segment).drop("__n"))
    if large.isEmpty():
        return strongest_runs(runs_in(rows, group, max_period), group, single, cycle)
    same = lambda a, b: functools.reduce(lambda x, y: x & y, (a[g].eqNullSafe(b[g]) for g in group))
    small = runs_in(rows.join(F.broadcast(large), same(rows, large), "left_anti"), group, max_period)
    parts = segments(rows.join(F.broadcast(large), same(rows, large), "left_semi"), group, segment, max_period)
    return strongest_runs(small.unionByName(joined_runs(runs_in(parts, [*group, "__segment"], max_period), group, segment)), group, single, cycle)


def segments(rows: DataFrame, group: list[str], segment: int, max_period: int) -> DataFrame:
    """rows of large groups with `__segment` and `__at`, their place in the group from 0.

    Sorted by range, so that places are counted part by part and added up. The last rows
    of a segment are there once more as `__halo` of the next one.
    """
    # A part's number is the upper half of the id: ids rise with group and order.
    ranged = materialize(rows.repartitionByRange(*group, "__order").sortWithinPartitions(*group, "__order").withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(*group, part.alias("__part")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # Two columns of each part and group, of which a part has one large group or few: as many rows as parts and large groups.
    starts = starts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__part").alias("__p"), "__first", "__before")
    same = functools.reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(group)), part == F.col("__p"))
    placed = ranged.join(F.broadcast(starts), same).withColumn("__at", F.col("__id") - F.col("__first") + F.col("__before"))
    own = F.floor(F.col("__at") / segment)
    last = F.col("__at") % segment >= segment - max_period
    both = F.array(F.struct(own.alias("s"), F.lit(False).alias("h")), F.struct((own + 1).alias("s"), F.lit(True).alias("h")))
    placed = placed.withColumn("__where", F.explode(F.when(last, both).otherwise(F.slice(both, 1, 1))))
    return placed.select(*group, "__order", "__name", "__key", "__at", F.col("__where.s").alias("__segment"), F.col("__where.h").alias("__halo"))


def runs_in(rows: DataFrame, group: list[str], max_period: int) -> DataFrame:
    """Maximal runs of matches of each group: period, start, length, sample, varied.

    rows: group, __order, __name, __key and, of segments, __at and __halo: what is halo is
    compared with, but is in no run.
    """
    cut = "__at" in rows.columns
    wide = W.partitionBy(*group).orderBy("__at" if cut else "__order")
    upto = wide.rowsBetween(W.unboundedPreceding, W.currentRow)
    periods = range(1, max_period + 1)
    # One shuffle and sort by group serves every window and the grouping below.
    step = F.coalesce((F.col("__key") != F.lag("__key").over(wide)).cast("int"), F.lit(1))
    at, own = (F.col("__at"), ~F.col("__halo")) if cut else (F.row_number().over(wide).cast("long") - 1, F.lit(True))
    rows = rows.select(*group, *(["__at", "__halo"] if cut else ["__order"]), "__name", "__key", at.alias("at"), step.alias("step"),
                       *(F.coalesce(own & (F.col("__name") != "") & (F.col("__key") == F.lag("__key", p).over(wide)), F.lit(False)).alias(f"hit{p}") for p in periods))
    rows = rows.withColumns({"steps": F.sum("step").over(upto), **{f"island{p}": F.sum((~F.col(f"hit{p}")).cast("int")).over(upto) for p in periods}})
    # Within a run of matches the first period keys are all alike just if each equals the one before it.
    varied = lambda p: F.coalesce(F.lag("steps").over(wide) - F.lag("steps", p).over(wide) > 0, F.lit(False))
    each = F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"hit{p}").alias("hit"), F.col(f"island{p}").alias("island"), F.lag("__name", p).over(wide).alias("seed"), varied(p).alias("varied")) for p in periods))
    rows = rows.select(*group, "at", each.alias("each")).select(*group, "at", F.explode(F.filter("each", lambda e: e["hit"])).alias("e"))
    runs = rows.select(*group, "at", "e.*").groupBy(*group, "period", "island").agg(
        F.count("*").alias("length"), F.min("at").alias("start"), F.min_by("seed", "at").alias("sample"), F.min_by("varied", "at").alias("varied"))
    return runs.drop("island")


def joined_runs(runs: DataFrame, group: list[str], segment: int) -> DataFrame:
    """runs of segments as runs of their groups: two that meet at a segment's border are one."""
    end = F.col("start") + F.col("length")
    whole = (F.col("start") % segment != 0) & (end % segment != 0)
    inside = runs.where(whole).drop("__segment")
    # Two rows for each border and period at most.
    over = W.partitionBy(*group, "period").orderBy("start")
    open_ = runs.where(~whole).withColumn("new", F.coalesce((F.lag(end).over(over) != F.col("start")).cast("int"), F.lit(1)))
    open_ = open_.withColumn("island", F.sum("new").over(over.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = lambda c: F.min_by(c, "start").alias(c)
    open_ = open_.groupBy(*group, "period", "island").agg(F.sum("length").alias("length"), first("sample"), first("varied"), F.min("start").alias("start"))
    return inside.unionByName(open_.drop("island"))


def strongest_runs(runs: DataFrame, group: list[str], single: int, cycle: int) -> DataFrame:
    runs = runs.withColumn("repeats", F.floor(F.col("length") / F.col("period")) + 1)
    enough = F.when(F.col("period") == 1, F.col("repeats") >= single).otherwise((F.col("repeats") >= cycle) & F.col("varied"))
    best = F.struct((-F.col("repeats")).alias("r"), F.col("period").alias("p"), F.col("start").alias("s"), F.col("sample").alias("n"))
    runs = runs.where(enough).groupBy(*group).agg(F.min(best).alias("b"))
    return runs.select(*group, F.col("b.p").alias("period"), (-F.col("b.r")).cast("long").alias("repeats"), F.col("b.n").alias("sample"))


def cycle_in(keys: Column, max_period: int = MAX_PERIOD, single: int = SINGLE_REPEATS, cycle: int = CYCLE_REPEATS) -> Column:
    """What cyclic_runs() finds in one list of keys (struct with name): struct(period, repeats, sample), or null."""
    def strongest(p: int) -> Column:
        """struct(r, p, s, n) of the best run of period p, the earliest of equals; r is 0 where there is none."""
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("at"))

        def step(acc: Column, i: Column) -> Column:
            key = F.get(keys, i)
            hit = (i >= p) & (key["name"] != "") & (key == F.get(keys, i - p))
            run = F.when(F.coalesce(hit, F.lit(False)), acc["run"] + 1).otherwise(F.lit(0))
            first = i - acc["run"] - p  # where the run's first period begins
            alike = F.forall(F.slice(keys, F.greatest(F.lit(1), first + 1), p), lambda k: k == F.get(keys, first))
            repeats = F.floor(run / p).cast("int") + 1
            better = (run > 0) & (repeats >= (single if p == 1 else cycle)) & (repeats > acc["best"])
            better = better if p == 1 else better & ~alike
            return F.struct(run.alias("run"), F.when(better, repeats).otherwise(acc["best"]).alias("best"), F.when(better, first).otherwise(acc["at"]).alias("at"))

        places = F.when(F.size(keys) > p, F.sequence(F.lit(p), F.size(keys) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda acc: F.struct((-acc["best"]).alias("r"), F.lit(p).alias("p"), acc["at"].alias("s"), F.get(keys, acc["at"])["name"].alias("n")))

    return let(F.array_min(F.array(*(strongest(p) for p in range(1, max_period + 1)))), lambda b: F.when(b["r"] < 0, F.struct(b["p"].alias("period"), (-b["r"]).alias("repeats"), b["n"].alias("sample"))))


def dedup_consecutive(items: Column, strict_reference: bool = False) -> Column:
    """Items without those that repeat the key of the item before; nameless items stay."""
    keys = F.transform(items, lambda x: item_key(x["name"], x["total"], strict_reference))
    # Keys are made once an item, and each is held against the one before.
    both = lambda k: F.arrays_zip(items.alias("item"), k.alias("key"))
    kept = let(keys, lambda k: F.filter(both(k), lambda x, i: (i == 0) | (x["key"]["name"] == "") | (x["key"] != F.get(k, i - 1))))
    return F.transform(kept, lambda x: x["item"])


def repeated_rows(rows: DataFrame, group: list[str], order: str, key: Column, blank: Column) -> DataFrame:
    """rows with `repeats`: whether the key is that of the row before in its group, and not blank."""
    before = F.lag(key).over(W.partitionBy(*group).orderBy(order))
    return rows.withColumn("repeats", ~blank & F.coalesce(key == before, F.lit(False)))


def scrub(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """df without looping texts, and `nulled`: the paths of what went.

    Merchant fields become null. An item's name becomes null if the item has a number;
    else, and always in strict mode, the item goes.
    """
    looped = lambda c: F.coalesce((strip(c) != "") & has_loop(c), F.lit(False))
    numeric = lambda i: F.lit(False) if strict_reference else F.coalesce(i["quantity"], i["price"], i["total"]).isNotNull()
    # Marked in a projection of their own, so that every text is searched once.
    df = df.withColumn("__items", F.transform("items", lambda i: F.struct(i.alias("i"), looped(i["name"]).alias("bad"))))
    for n in ("merchant_name", "merchant_address"):
        df = df.withColumn(f"__{n}", looped(F.col(n)))
    none = F.array().cast("array<string>")
    paths = [F.when(F.col(f"__{n}"), F.array(F.lit(n))).otherwise(none) for n in ("merchant_name", "merchant_address")]
    spots = F.filter(F.transform("__items", lambda t, k: F.when(t["bad"], F.concat(
        F.format_string("items[%d].name", k), F.when(numeric(t["i"]), F.lit("")).otherwise(F.lit("(dropped)"))))), lambda p: p.isNotNull())
    df = df.withColumn("nulled", F.concat(*paths, F.coalesce(spots, none)))
    kept = F.filter("__items", lambda t: ~t["bad"] | numeric(t["i"]))
    df = df.withColumn("items", F.transform(kept, lambda t: F.struct(F.when(~t["bad"], t["i"]["name"]).alias("name"), t["i"]["quantity"].alias("quantity"), t["i"]["price"].alias("price"), t["i"]["total"].alias("total"))))
    for n in ("merchant_name", "merchant_address"):
        df = df.withColumn(n, F.when(~F.col(f"__{n}"), F.col(n)))
    return df.drop("__items", "__merchant_name", "__merchant_address")


def detect(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """df with `loop_reason`: what cycle the items of a receipt go round in, or null. Worked out inside the row."""
    keys = F.transform("items", lambda i: item_key(i["name"], i["total"], strict_reference))
    reason = lambda c: F.format_string("%s period=%d repeats=%d name='%s'", F.when(c["period"] == 1, F.lit("dup_items_run")).otherwise(F.lit("cyclic_items")), c["period"], c["repeats"], c["sample"])
    df = df.withColumn("__keys", keys).withColumn("__cycle", cycle_in(F.col("__keys")))
    return df.withColumn("loop_reason", F.when(F.col("__cycle").isNotNull(), reason(F.col("__cycle")))).drop("__keys", "__cycle")
