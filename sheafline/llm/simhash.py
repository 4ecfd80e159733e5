"""SimHash near-dedup by pigeonring filtering.

The 64 bits stand in a ring of five segments. If two fingerprints differ in at most
t bits, some segment starts a chain whose every prefix of l segments differs in at
most l*t/5 bits. With t = 2 the first two segments of that chain are equal, so rows
meet in buckets keyed by a chain's start and its first two segments, and the longer
prefixes prune pairs before the full Hamming check. A bucket that is too large is
not cut off: the ring is drawn again over the bits still free, which is exact for
the same reason, until at most 14 bits are free and a bucket cannot be large.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import components, materialize, numbered, settled, ship, small_batches, without

ship(__name__)

SEGMENTS, SEED = 5, 42
#: Rows of a bucket that are compared in one go; larger buckets get a ring of their own.
BUCKET = 2048
#: Free bits from which on a bucket is compared as it is: it has 2^14 rows at most.
LAST_BITS = 14
BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a whole text: lower-cased A-Z, words split at ``[\\x20\\x09-\\x0D]``.

    A bit is set if it is set in over half of the shingles' XXH64 values. A text of
    fewer words is one shingle; one without words (or null) has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    of = xxhash.xxh64_intdigest
    hashes = [of(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[k : k + (1 << 14)], dtype="<u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(votes * 2 > len(hashes), np.uint64(1) << BITS, np.uint64(0))))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp long) of every row; the text does not leave the scan's stage."""

    def run(batches):
        for pdf in batches:
            prints = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": prints.view(np.int64)})

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, fp long")


@functools.cache
def chain(path: tuple[int, ...]) -> tuple[int, ...]:
    """Masks for the chain that path names by its start in each ring drawn so far.

    First the bits that all rows of its bucket share, then the bits of the chain's
    first 3, 4 and 5 segments.
    """
    free, shared = list(range(64)), 0
    for start in path:
        cuts = [round(k * len(free) / SEGMENTS) for k in range(SEGMENTS + 1)]
        ring = [sum(1 << b for b in free[cuts[k % SEGMENTS] : cuts[k % SEGMENTS + 1]]) for k in range(start, start + SEGMENTS)]
        longer = [sum(ring[:n]) for n in (3, 4, 5)]
        shared |= ring[0] | ring[1]
        free = [b for b in range(64) if not shared >> b & 1]
    return shared, *longer


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keys(prints: DataFrame, paths: list[tuple[int, ...]]) -> DataFrame:
    """(path, value, fp): a row of prints (path string, fp) for each chain below its path."""
    of = None
    for parent in paths:
        each = F.array(*(F.struct(F.lit(",".join(map(str, (*parent, k)))).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(chain((*parent, k))[0])).cast("long")).alias("value")) for k in range(SEGMENTS)))
        hit = F.col("path") == F.lit(",".join(map(str, parent)))
        of = F.when(hit, each) if of is None else of.when(hit, each)
    return prints.select("fp", F.explode(of).alias("k")).select("k.path", "k.value", "fp")


def linked(prints: np.ndarray, path: tuple[int, ...], limit: int) -> pd.DataFrame:
    """Star links (a, b) that join what a bucket's pairs link, each member to the least."""
    longer = [np.uint64(m) for m in chain(path)[1:]]
    labels = np.arange(len(prints))
    step = max(1, (1 << 20) // max(1, len(prints)))
    for k in range(0, len(prints), step):
        diff = prints[k : k + step, None] ^ prints[None, k:]
        i, j = np.nonzero(np.bitwise_count(diff & longer[0]) <= 3 * limit // SEGMENTS)
        x = diff[i, j]
        for mask, n in zip(longer[1:], (4, 5)):
            stay = np.bitwise_count(x & mask) <= n * limit // SEGMENTS
            i, j, x = i[stay], j[stay], x[stay]
        stay = (np.bitwise_count(x) <= limit) & (i != j)
        i, j = i[stay] + k, j[stay] + k
        while len(i):
            a, b = labels[i], labels[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            for at in (a, b, i, j):
                np.minimum.at(labels, at, low)
            while (labels[labels] != labels).any():
                labels = labels[labels]
    while (labels[labels] != labels).any():
        labels = labels[labels]
    off = np.flatnonzero(labels != np.arange(len(prints)))
    return pd.DataFrame({"a": prints[off].view(np.int64), "b": prints[labels[off]].view(np.int64)})


def frames(parts: list[pd.DataFrame]):
    """The rows of parts in frames of a few thousand."""
    if parts:
        whole = pd.concat(parts)[["a", "b", "path", "fp"]]
        yield from (whole[k : k + 5000] for k in range(0, len(whole), 5000))


def near_links(prints: DataFrame, limit: int = 2) -> DataFrame:
    """(a, b) fingerprint links that connect whatever differs in at most limit bits.

    prints: (fp) without repeats. No pair between different components, no component
    left apart; pairs inside a bucket stay inside the task that compares them.
    """
    if 2 * limit >= SEGMENTS:
        raise ValueError("the first two segments of a chain are equal only for limits of 2 or less")

    def compare(batches):
        held, now, over = [], None, False
        out = []

        def flush():
            if over or not held:
                return
            got = np.concatenate(held)
            if len(got) > 1:
                out.append(linked(got.view(np.uint64), tuple(map(int, now[0].split(","))), limit).assign(path=None, fp=0))

        def onward(part):
            out.append(pd.DataFrame({"a": 0, "b": 0, "path": now[0], "fp": part}))

        for pdf in batches:
            path, value, fp = pdf["path"].to_numpy(), pdf["value"].to_numpy(), pdf["fp"].to_numpy()
            new = np.r_[True, (path[1:] != path[:-1]) | (value[1:] != value[:-1])] if len(pdf) else np.zeros(0, bool)
            cut = np.flatnonzero(new)
            for s, e in zip(cut, [*cut[1:], len(pdf)]):
                if (path[s], value[s]) != now:
                    flush()
                    held, now, over = [], (path[s], value[s]), False
                    room = 1 << LAST_BITS if 64 - chain(tuple(map(int, path[s].split(","))))[0].bit_count() <= LAST_BITS else BUCKET
                if not over:
                    held.append(fp[s:e])
                    if sum(map(len, held)) > room:
                        over = True
                        for part in held:
                            onward(part)
                        held = []
                else:
                    onward(fp[s:e])
            if sum(map(len, out)) > 50_000:
                yield from frames(out)
                out.clear()
        flush()
        yield from frames(out)

    level, paths, links = prints.select(F.lit("").alias("path"), "fp"), [()], None
    rows = prints.count()
    while True:
        spread = keys(level, paths).repartition("path", "value").sortWithinPartitions("path", "value")
        done = materialize(spread.mapInPandas(compare, "a long, b long, path string, fp long"), SEGMENTS * rows)
        found = done.where("path IS NULL").select("a", "b")
        links = found if links is None else links.unionByName(found)
        level = done.where("path IS NOT NULL").select("path", "fp")
        paths = [tuple(map(int, r.path.split(","))) for r in level.select("path").distinct().collect()]  # at most 5 ** depth, depth below 4
        if not paths:
            return links
        rows = level.count()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    component_id is the smallest doc_id reachable over links, itself included. Null,
    empty and blank texts have fingerprint zero and are linked like any other. Rows
    repeated with one id give repeated rows; null ids are smallest of nothing: a
    component of null ids alone has a null component_id. Other columns are not read.
    An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, id_col, text_col))
    n = marked.count()

    def grouped() -> DataFrame:
        prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), n)
        links = near_links(prints.select("fp"), limit)
        member = components(links).select(F.col("node").alias("fp"), "component")
        return prints.join(member, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))

    of = settled(docs.sparkSession, grouped, n)
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(least, "component").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each near-duplicate group, all columns unchanged: the smallest id (null last), then any one row.

    Ids may be null and repeat. Null and blank texts are one group; an empty table stays empty.
    """
    rows = numbered(docs)
    groups = materialize(simhash_groups(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id"))
    many = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = groups.join(many, "component_id").join(rows.select("__row", "doc_id"), "__row")
    members = materialize(members.select("component_id", F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), F.col("__row").alias("r")).alias("key")))
    first = members.groupBy("component_id").agg(F.min("key").alias("first"))
    return without(rows, members.join(first, "component_id").where("key.r <> first.r").select("key.r"), "__row").drop("__row")


