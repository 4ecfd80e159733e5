"""Secrets in texts, told apart by who holds them in the whole corpus.

Patterns give candidates. The hash of each candidate's value is counted over the
corpus by distinct repositories and distinct owners: what many of them hold is an
example that was copied, what few hold and looks drawn at random is a live
credential. Values themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import materialize, ship, small_batches

ship(__name__)

#: Base kinds in their order, each with its pattern, the group of the value and the characters that must be there (fixed values).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: The kind of spans that the corpus adds: bare strings that look drawn at random and that few hold.
LIVE = "live"
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Different characters of a value that looks drawn at random; it also has a letter and a digit.
DISTINCT = 10
#: Owners and repositories from which on a value counts as copied.
OWNERS, REPOSITORIES = 3, 10
#: Values that are broadcast at most: those of more than one in so many candidates.
HOT = 1 << 12

FOUND = "array<struct<kind: string, start: long, end: long, key: binary, random: boolean>>"


def looks_random(value: str) -> bool:
    return len(set(value)) >= DISTINCT and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all base matches, and of bare strings that no base match touches."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, *m.span(), m.group(group)))
    spans = sorted((a, b) for _, a, b, _ in out)
    starts, reach = [a for a, _ in spans], [0, *accumulate((b for _, b in spans), max)]
    for m in BARE.finditer(text):
        if looks_random(m.group()) and reach[bisect_left(starts, m.end())] <= m.start():
            out.append((LIVE, *m.span(), m.group()))
    return out


def scanned(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """(row, doc_id, repo, owner, found) of every row; found has the candidates of its whole text."""
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))  # noqa: E731  null is one of its own

    def scan(batches):
        for pdf in batches:
            found = [[{"kind": k, "start": a, "end": b, "key": hashlib.sha256(v.encode()).digest()[:16], "random": looks_random(v)} for k, a, b, v in candidates(t or "")] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "repo": pdf["repo"], "owner": pdf["owner"], "found": found})

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), name(repo).alias("repo"), name(owner).alias("owner"))
    return rows.mapInPandas(scan, f"doc_id {kind}, repo string, owner string, found {FOUND}").withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame, owners: int, repositories: int) -> DataFrame:
    """(key, n_rows, n_repos, n_owners, copied) of every candidate value (key, repo, owner)."""
    # Repositories and owners of one value are counted apart first, so no value is one task's.
    held = found.groupBy("key").agg(F.count("*").alias("n_rows"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    return held.withColumn("copied", (F.col("n_owners") >= owners) | (F.col("n_repos") >= repositories))


def secrets(docs: DataFrame, repo: Column, owner: Column, owners: int = OWNERS, repositories: int = REPOSITORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every row's whole text, with their verdict in the corpus.

    Base kinds are assign, access and hex. The corpus adds spans of kind `live`: bare strings of 20
    characters and more that look drawn at random (letters, digits, 10 different characters) and that
    fewer than `owners` owners and `repositories` repositories hold. A base span stays whatever its verdict:
    `example` for values that so many hold, `live` for others that look random, else `weak`.

    repo, owner: who holds a row; null is one of its own. Null texts are empty and have no spans; repeated
    rows give repeated rows and count once by repository; other columns are not read; an empty table
    gives an empty result.

    Returns doc_id, spans array<struct<kind, start, end (exclusive, code points), verdict, n_repos, n_owners>>
    by start, then kind in the order above.
    """
    rows = materialize(scanned(docs, id_col, text_col, repo, owner))
    single = rows.where(F.size("found") > 0).select("row", "doc_id", "repo", "owner", F.explode("found").alias("f")).select("row", "doc_id", "repo", "owner", "f.*")
    held = materialize(ownership(single, owners, repositories))
    n = held.agg(F.sum("n_rows")).first()[0] or 0
    # Values with more than one in HOT of all candidates are fewer than HOT: these are broadcast, the others shuffled.
    often = F.col("n_rows") > n // HOT
    looked = single.join(F.broadcast(held.where(often)), "key", "left")
    rare = looked.where("n_rows IS NULL").select(single.columns).join(held.where(~often), "key")
    judged = looked.where("n_rows IS NOT NULL").unionByName(rare)
    judged = judged.withColumn("verdict", F.when(F.col("copied"), "example").when(F.col("random"), "live").otherwise("weak")).where((F.col("kind") != LIVE) | (F.col("verdict") == "live"))
    place = F.array_position(F.array(*map(F.lit, [*BASE, LIVE])), F.col("kind"))
    span = F.struct("kind", "start", "end", "verdict", "n_repos", "n_owners")
    told = judged.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), span.alias("span")))).span.alias("spans"))
    kind = told.schema["spans"].dataType
    # Rows without a candidate, and rows all of whose candidates went, have no span.
    without = rows.where(F.size("found") == 0).select("doc_id", F.array().cast(kind).alias("spans"))
    only_bare = rows.where((F.size("found") > 0) & F.forall("found", lambda f: f.kind == LIVE)).select("row", "doc_id").join(told.select("row"), "row", "left_anti")
    return told.select("doc_id", "spans").unionByName(without).unionByName(only_bare.select("doc_id", F.array().cast(kind).alias("spans")))


def digests(found: DataFrame) -> DataFrame:
    """One narrow row for each row of secrets: how many of each kind, their places, and how many of each verdict."""
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select(
        "doc_id", *(count("kind", k).alias(f"n_{k}") for k in BASE), F.sha2(listed(F.filter("spans", lambda s: s.kind != LIVE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_example"),
    )
