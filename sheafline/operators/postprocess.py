"""Cleanup of typed receipts: scripts, sentinels, deny-lists, canonical merchant names.

The order of the steps matters: a merchant is made canonical before it may be denied.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import sys
import types
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import let, normalize_for_match, strip, strip_cjk, strip_trailing_punct
from sheafline.shipping import ship

ship(__name__)

#: The item name that models write for rows they cannot read (fixed value).
SENTINEL = "item blur"
MIN_RATIO = 0.9
#: Characters by which names and patterns meet, at most.
GRAM = 6
#: Patterns that stand in the plan as literals at most; characters of those that are broadcast at most; and columns by which similar names are compared before their characters are.
LITERALS, BROADCAST_CHARS, BAG = 64, 1 << 24, 64
#: Subsequences of one length by which similar names meet, at most; characters that longer names meet by at once, and tokens of so many that a name may have, at most.
SUBSEQUENCES, TOGETHER, TOKENS = 640, 4, 64
#: Characters of aliases whose tokens are broadcast, at most.
BROADCAST_ALIASES = 1 << 14


def _with_name(item: Column, name: Column) -> Column:
    return F.struct(name.alias("name"), item["quantity"].alias("quantity"), item["price"].alias("price"), item["total"].alias("total"))


def drop_scripts(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    for n in ("merchant_name", "merchant_address"):
        df = df.withColumn(n, strip_cjk(F.col(n), strict_reference))
    return df.withColumn("items", F.transform("items", lambda i: _with_name(i, strip_cjk(i["name"], strict_reference))))


def drop_sentinel(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.filter("items", lambda i: normalize_for_match(i["name"]) != SENTINEL))


def automaton(patterns: Sequence[str]) -> ahocorasick.Automaton | None:
    """The worker's automaton of patterns, each with its first place in the list; made once, as a worker runs many tasks."""
    held = sys.modules.setdefault("_sheafline_patterns", types.ModuleType("_sheafline_patterns"))
    key = hashlib.sha256("\0".join(patterns).encode("utf-8", "surrogatepass")).digest()
    if getattr(held, "key", None) != key:
        made = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            if p and p not in made:
                made.add_word(p, k)
        if len(made):
            made.make_automaton()
        held.key, held.made = key, made if len(made) else None
    return held.made


def first_in(text: str | None, found: ahocorasick.Automaton | None) -> int | None:
    return min((k for _, k in found.iter(text)), default=None) if text and found is not None else None


@functools.lru_cache(maxsize=8)
def _sent(session, patterns: tuple[str, ...]):
    chars = sum(map(len, patterns))
    if chars > BROADCAST_CHARS:
        raise ValueError(f"{len(patterns)} patterns of {chars} characters are too many to broadcast ({BROADCAST_CHARS}): hold them in a table (deny_rows, canonical_by_substring)")
    return session.sparkContext.broadcast(patterns)


def first_entries(df: DataFrame, texts: Column, patterns: Sequence[str]) -> Column:
    """For each of an array of normalised texts, the place of the first pattern in the list that it contains, or null.

    One automaton finds all patterns in one pass over a text, so their number costs nothing there.
    """
    shared = _sent(df.sparkSession, tuple(patterns))

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        found = automaton(shared.value)
        return pd.Series([None if r is None else [first_in(t, found) for t in r] for r in rows], dtype=object)

    return run(texts)


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """The place of the first pattern that a normalised text contains, or null, of LITERALS patterns at most."""
    listed = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")
    hits = lambda t: F.array_min(F.transform(listed, lambda p, k: F.when((p != "") & t.contains(p), k)))
    return let(text, lambda t: F.when(t != "", hits(t)))


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether a normalised text contains any of normalised patterns; a blank text has none, and a blank pattern is in none."""
    listed = F.array(*(F.lit(p) for p in patterns if p)).cast("array<string>")
    return let(text, lambda t: (t != "") & F.exists(listed, lambda p: t.contains(p)))


def deny_items(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Items whose name contains a pattern (normalised texts) go; nameless ones stay."""
    if len(patterns) <= LITERALS:
        return df.withColumn("items", F.filter("items", lambda i: ~any_pattern(normalize_for_match(i["name"]), patterns))) if patterns else df
    names = F.transform("items", lambda i: normalize_for_match(i["name"]))
    df = df.withColumn("__hits", first_entries(df, names, patterns))
    return df.withColumn("items", F.filter("items", lambda i, k: F.get("__hits", k).isNull())).drop("__hits")


def deny_merchant(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    if not patterns:
        return df
    norm = normalize_for_match(F.col("merchant_name"))
    if len(patterns) <= LITERALS:
        hit = F.coalesce(any_pattern(norm, patterns), F.lit(False))
        return df.withColumn("merchant_name", F.when(~hit, F.col("merchant_name")))
    df = df.withColumn("__hit", F.get(first_entries(df, F.array(norm), patterns), F.lit(0)))
    return df.withColumn("merchant_name", F.when(F.col("__hit").isNull(), F.col("merchant_name"))).drop("__hit")


def containing(names: DataFrame, patterns: DataFrame, pattern: str) -> DataFrame:
    """names (column __norm) with the rows of patterns whose `pattern` is part of the name.

    An equi-join: both sides meet at the first characters of the pattern, which a name has
    once for each place; as many characters as the shortest pattern has, GRAM at most.
    Blank patterns are part of nothing, nor is any pattern of a blank name.
    """
    patterns = patterns.where(F.length(pattern) > 0)
    size = min(patterns.agg(F.min(F.length(pattern))).first()[0] or 1, GRAM)
    places = F.when(F.length("__norm") >= size, F.sequence(F.lit(1), F.length("__norm") - (size - 1)))
    grams = names.withColumn("__gram", F.explode(F.array_distinct(F.transform(places, lambda k: F.substr("__norm", k, F.lit(size))))))
    return grams.join(patterns.withColumn("__gram", F.substring(pattern, 1, size)), "__gram").where(F.col("__norm").contains(F.col(pattern))).drop("__gram")


def held(patterns: DataFrame, pattern: str, most: int = BROADCAST_CHARS) -> list | None:
    """The rows of a pattern table if it has `most` characters at most, else None. One job, and no more than that reaches the driver."""
    size = patterns.agg(F.count("*"), F.sum(F.length(pattern))).first()
    return patterns.collect() if size[0] <= most // 4 and (size[1] or 0) <= most else None


def deny_rows(rows: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """Exploded form of deny_items: rows whose name contains no `pattern_norm` of patterns.

    Patterns that can be broadcast are looked for where the rows are; a longer list meets
    the names by an equi-join of their characters.
    """
    norm = normalize_for_match(F.col(name))
    listed = held(patterns.select("pattern_norm"), "pattern_norm")
    if listed is not None:
        entries = [r.pattern_norm for r in listed if r.pattern_norm]
        if len(entries) <= LITERALS:
            return rows.where(~F.coalesce(any_pattern(norm, entries), F.lit(False))) if entries else rows
        return rows.withColumn("__hit", F.get(first_entries(rows, F.array(norm), entries), F.lit(0))).where("__hit IS NULL").drop("__hit")
    keyed = rows.withColumn("__norm", norm)
    hits = containing(keyed.select("__norm").distinct(), patterns.select("pattern_norm"), "pattern_norm").select("__norm").distinct()
    return keyed.join(hits, "__norm", "left_anti").select(rows.columns)


def canonical_by_substring(names: DataFrame, name: str, canonical: DataFrame) -> DataFrame:
    """names with `canonical`: of the first entry (by ord) whose alias_norm the name contains, or null."""
    listed = held(canonical.select("ord", "alias_norm", "canonical"), "alias_norm")
    if listed is not None:
        entries = sorted((r for r in listed if r.alias_norm), key=lambda r: r.ord)
        return named_by(names, normalize_for_match(F.col(name)), [(r.alias_norm, r.canonical) for r in entries], "canonical")
    distinct = names.select(name).distinct().withColumn("__norm", normalize_for_match(F.col(name)))
    hits = containing(distinct, canonical.select("ord", "alias_norm", "canonical"), "alias_norm").groupBy(name).agg(F.min_by("canonical", "ord").alias("canonical"))
    return names.join(hits, name, "left")


def named_by(df: DataFrame, norm: Column, pairs: Sequence[tuple[str, str]], into: str) -> DataFrame:
    """df with column `into`: the canonical name of the first of pairs whose alias a normalised text contains, or null."""
    if not pairs:
        return df.withColumn(into, F.lit(None).cast("string"))
    aliases = [a for a, _ in pairs]
    if len(pairs) <= LITERALS:
        return df.withColumn(into, F.get(F.array(*(F.lit(c) for _, c in pairs)), first_pattern(norm, aliases)))
    shared = _sent(df.sparkSession, tuple(c for _, c in pairs))

    @F.pandas_udf("string")
    def called(places: pd.Series) -> pd.Series:
        names = shared.value
        return pd.Series([names[int(p[0])] if p is not None and p[0] is not None and p[0] == p[0] else None for p in places], dtype=object)

    return df.withColumn("__first", first_entries(df, F.array(norm), aliases)).withColumn(into, called(F.col("__first"))).drop("__first")


def ratio_match(pairs: Sequence[tuple[str, str]], least: float = MIN_RATIO):
    """A pandas UDF: the canonical name of the first alias that is similar enough to a normalised name."""

    @F.pandas_udf("string")
    def match(names: pd.Series) -> pd.Series:
        near = Similar([a for a, _ in pairs], least)
        found = {n: near.first(n) for n in names.dropna().unique()}
        return pd.Series([None if (k := found.get(n)) is None else pairs[k][1] for n in names], dtype=object)

    return match


def _level(size: int, least: float) -> tuple[int, int]:
    """By how many characters at once a text of that size is met, and how many it shares with any text that is similar enough."""
    # The other text has least / (2 - least) of the length at least; so many characters of this one are shared with it.
    shared = int(np.ceil(least / (2 - least) * size - 1e-9))
    fits = (k for k in range(TOGETHER, 1, -1) if k <= shared and math.comb(size - shared + k, k) <= TOKENS)
    return next(fits, 1), shared


@functools.lru_cache(maxsize=4096)
def _ways(size: int, least: float) -> tuple[list[int], list[int]]:
    """How a text of that size meets those of every size that may be similar enough: the lengths of subsequences, and the numbers of characters.

    Which way two texts meet depends on their two sizes alone, so both take the same.
    """
    kept, levels, ratio, (level, _) = set(), set(), least / (2 - least), _level(size, least)
    for other in range(max(1, int(np.ceil(ratio * size - 1e-9))), int(size / ratio + 1e-9) + 1) if ratio > 0 else ():
        both = int(np.ceil(least * (size + other) / 2 - 1e-9))
        if max(math.comb(size, both), math.comb(other, both)) <= SUBSEQUENCES:
            kept.add(both)
        else:
            levels.add(min(level, _level(other, least)[0]))
    return sorted(kept), sorted(levels) if ratio > 0 else [1]


def prefix(text: str, least: float, rank: dict[str, int] | None = None) -> list[str]:
    """The tokens by which every text that is similar enough is met.

    Two texts whose ratio is `least` or more share a subsequence as long as the ratio asks of
    their sizes: where neither text has more than SUBSEQUENCES of that length, these are the tokens.
    Longer texts are met by their rarest characters, a character counting with how often it came
    before: of what two texts share, in any one order, the first k are among the first of each, and
    a token is k of those. Characters are ordered by rank (the rarer first), then by code.
    """
    kept, levels = _ways(len(text), least)
    out = {f"{n}={''.join(some)}" for n in kept for some in itertools.combinations(text, n)}
    if levels:
        seen: Counter = Counter()
        tokens = []
        for c in text:
            tokens.append((-(rank or {}).get(c, 0) if rank else 0, -ord(c), seen[c], c))
            seen[c] += 1
        first, shared = [f"{c}{k}" for _, _, k, c in sorted(tokens)], _level(len(text), least)[1]
        out.update(f"{k}:{''.join(some)}" for k in levels for some in itertools.combinations(first[: len(text) - shared + k], k))
    return list(out)


def bags(texts: Sequence[str]) -> np.ndarray:
    """How many characters of each text fall into each of BAG columns: what two texts share is at most the sum of the smaller counts."""
    out = np.zeros((len(texts), BAG), np.int32)
    for k, t in enumerate(texts):
        if t:
            out[k] = np.bincount(np.fromiter(map(ord, t), np.int64, len(t)) % BAG, minlength=BAG)
    return out


class Similar:
    """The first of a list of texts whose SequenceMatcher ratio to a text is `least` or more."""

    def __init__(self, texts: Sequence[str], least: float):
        self.texts, self.least, self.compared = texts, least, 0
        self.size, self.bags = np.array([len(t) for t in texts], np.int64), bags(texts)

    def first(self, text: str) -> int | None:
        """All lengths and bags of characters at once, then character by character what is left, in order."""
        total = self.size + len(text)
        close = np.flatnonzero(2 * np.minimum(self.size, len(text)) >= self.least * total)
        shared = np.minimum(self.bags[close], bags([text])).sum(axis=1)
        for k in close[2 * shared >= self.least * total[close]].tolist():
            self.compared += 1
            if SequenceMatcher(None, text, self.texts[k]).ratio() >= self.least:
                return k
        return None


def similar(names: DataFrame, name: str, canonical: DataFrame, least: float = MIN_RATIO) -> DataFrame:
    """(name, ord, canonical): of each distinct normalised name the first entry (by ord) of a table of any size that is similar enough.

    canonical: ord, alias_norm, canonical. Names and aliases meet by an equi-join of tokens (see
    prefix; of few aliases they are broadcast), where lengths may differ by what the ratio allows;
    pairs that share enough characters are compared. Blank texts are similar to nothing.
    """
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: prefix(t, least))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        shared, total = np.minimum(bags(a), bags(b)).sum(axis=1), (a.str.len() + b.str.len()).to_numpy()
        return pd.Series([bool(near) and SequenceMatcher(None, x, y).ratio() >= least for x, y, near in zip(a, b, 2 * shared >= least * total)], dtype=bool)

    # Tokens meet by a hash: what meets by chance is compared and dropped.
    of = lambda df, text: df.withColumn("__token", F.explode(tokens(text))).withColumn("__token", F.xxhash64("__token")).withColumn("__size", F.length(text))
    left = of(names.select(F.col(name)).where(F.col(name) != "").distinct(), name)
    aliases = canonical.select("ord", "alias_norm", "canonical").where("alias_norm <> ''")
    right = of(aliases, "alias_norm")
    few = (aliases.agg(F.sum(F.length("alias_norm"))).first()[0] or 0) <= BROADCAST_ALIASES
    right = right.hint("broadcast" if few else "merge")
    met = left.join(right.withColumnRenamed("__size", "__other"), "__token").where(2 * F.least("__size", "__other") >= F.lit(least) * (F.col("__size") + F.col("__other")))
    pairs = met.select(name, "ord", "alias_norm", "canonical").distinct()
    return pairs.where(alike(F.col(name), F.col("alias_norm"))).groupBy(name).agg(F.min("ord").alias("ord"), F.min_by("canonical", "ord").alias("canonical"))


def canonicalize(df: DataFrame, pairs: Sequence[tuple[str, str]], least: float = MIN_RATIO) -> DataFrame:
    """Merchant names made canonical: by substring, else by similarity; the first entry in order wins.

    pairs: (normalised alias, canonical name). A least of 0 or less turns this off.
    Only names that no alias is part of reach Python, where there are few pairs.
    """
    if not pairs or least <= 0:
        return df
    df = df.withColumn("__norm", normalize_for_match(F.col("merchant_name")))
    df = named_by(df, F.col("__norm"), pairs, "__found")
    # Names that are found or blank are null to the similarity search.
    near = ratio_match(pairs, least)(F.when(F.col("__found").isNull() & (F.col("__norm") != ""), F.col("__norm")))
    return df.withColumn("merchant_name", F.coalesce("__found", near, "merchant_name")).drop("__norm", "__found")


def trim_items(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.transform("items", lambda i: _with_name(i, strip_trailing_punct(i["name"]))))


def postprocess(df: DataFrame, item_patterns: Sequence[str] = (), merchant_patterns: Sequence[str] = (), pairs: Sequence[tuple[str, str]] = (), least: float = MIN_RATIO, strict_reference: bool = False) -> DataFrame:
    """All steps in order; the layout that the model read by is dropped."""
    df = drop_sentinel(drop_scripts(df, strict_reference))
    df = canonicalize(deny_items(df, item_patterns), pairs, least)
    return trim_items(deny_merchant(df, merchant_patterns)).drop("layout")


def parse_entry(line: Column) -> Column:
    """struct(alias_norm, canonical) of ``alias => name`` or a bare name; null if a side is blank."""
    parts = F.split(line, "=>", 2)
    mapped = F.size(parts) == 2
    alias, name = strip(parts[0]), strip(F.when(mapped, F.get(parts, F.lit(1))).otherwise(parts[0]))
    norm = normalize_for_match(alias)
    return F.when((norm != "") & (name != ""), F.struct(norm.alias("alias_norm"), name.alias("canonical")))
