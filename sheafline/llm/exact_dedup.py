"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

Every partition packs its 64-bit fingerprints into counting quotient filters, one
for each slice of the fingerprint space. A slice's filters are merged by their
sorted remainders, which loses nothing, as quotient and remainder together are the
whole fingerprint. A large table's slices are cut again, level by level, so that a
filter holds thousands of fingerprints however many rows there are. Only rows whose
fingerprint has a count above one have their text shuffled and compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import among, materialize, numbered, ship, small_batches, without

ship(__name__)

#: Fingerprints that are cut into filters together, about so many a slice at last, and bits of the space that one
#: level cuts at most: 2^20 fingerprints become 256 filters of some 4096.
FILTER_ROWS, SLICE_ROWS, LEVEL_BITS = 1 << 20, 1 << 16, 8
#: Fingerprints of one filter at most (some 110 kB), as frames of filters are counted in rows.
FILTER_MOST = 8192
OCCUPIED, RUN_END, COUNTER, USED = 1, 2, 4, 8


class CountingQuotientFilter:
    """A static counting quotient filter over sorted, distinct 64-bit fingerprints.

    The top ``q`` bits are the quotient, the rest the remainder. Remainders of a
    quotient stand together in sorted order (a run) at or after their home slot.
    A count above one is held in counter slots behind the remainder: the digits of
    count - 1 to base 2^r, least first. Each slot has four bits: its home is
    occupied, a run ends here, it is a counter, it is in use.
    """

    def __init__(self, q: int, bits: np.ndarray, slots: np.ndarray):
        self.q, self.bits, self.slots = q, bits, slots

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """prints: sorted distinct uint64; counts: at least 1 each."""
        q = max(1, int(len(prints)).bit_length())
        r = 64 - q
        home = (prints >> np.uint64(r)).astype(np.int64)
        mask = np.uint64((1 << r) - 1)
        rest = (counts - 1).astype(np.uint64)
        more = (rest > 0).astype(np.int64)  # a count fits one digit: r is 32 bits at least
        width = 1 + more
        before = np.cumsum(width) - width
        at = before + np.maximum.accumulate(home - before) if len(home) else home
        size = int(max((1 << q), at[-1] + width[-1])) if len(home) else 1 << q
        slots, bits = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        slots[at] = prints & mask
        bits[at] = USED
        has = more > 0
        slots[at[has] + 1] = rest[has]
        bits[at[has] + 1] = USED | COUNTER
        bits[home] |= OCCUPIED
        last = np.r_[home[1:] != home[:-1], True] if len(home) else np.zeros(0, bool)
        bits[(at + more)[last]] |= RUN_END
        return cls(q, bits, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts, read back from the slots.

        Slots inside runs are found from the metadata: the k-th run belongs to the
        k-th occupied home, starts at its home or behind the run before it, and ends
        at the k-th run end.
        """
        homes = np.flatnonzero(self.bits & OCCUPIED)
        ends = np.flatnonzero(self.bits & RUN_END)
        if not len(homes):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.maximum(homes, np.r_[0, ends[:-1] + 1])
        length = ends - starts + 1
        run = np.repeat(np.arange(len(homes)), length)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + starts[run]
        counter = (self.bits[at] & COUNTER) > 0
        prints = (homes[run].astype(np.uint64) << np.uint64(64 - self.q)) | self.slots[at]
        counts = np.ones(len(at), np.int64)
        digit = np.flatnonzero(counter)
        counts[digit - 1] += self.slots[at[digit]].astype(np.int64)
        return prints[~counter], counts[~counter]

    def pack(self) -> bytes:
        used = np.flatnonzero(self.bits)
        return self.q.to_bytes(1, "little") + len(self.bits).to_bytes(8, "little") + len(used).to_bytes(8, "little") + used.astype(np.uint32).tobytes() + self.bits[used].tobytes() + self.slots[used].tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        q, size, n = data[0], int.from_bytes(data[1:9], "little"), int.from_bytes(data[9:17], "little")
        used = np.frombuffer(data, np.uint32, n, 17)
        bits, slots = np.zeros(size, np.uint8), np.zeros(size, np.uint64)
        bits[used] = np.frombuffer(data, np.uint8, n, 17 + 4 * n)
        slots[used] = np.frombuffer(data[17 + 5 * n :], np.uint64, n)
        return cls(q, bits, slots)


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of distinct fingerprints, counts added, from lists that are sorted and distinct."""
    while len(lists) > 1:
        pairs = [merged_two(*lists[k], *lists[k + 1]) for k in range(0, len(lists) - 1, 2)]
        lists = pairs + lists[len(lists) // 2 * 2 :]
    return lists[0]


def merged_two(p: np.ndarray, c: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges q into p in order: each fingerprint of q is at its place in p or goes there."""
    at = np.searchsorted(p, q)
    same = np.zeros(len(q), bool)
    inside = at < len(p)
    same[inside] = p[at[inside]] == q[inside]
    c = c.copy()
    c[at[same]] += d[same]
    return np.insert(p, at[~same], q[~same]), np.insert(c, at[~same], d[~same])


def slices_of(rows: int) -> int:
    """Slices of the fingerprint space for so many rows, a power of two."""
    return 1 << max(4, (rows // SLICE_ROWS).bit_length())


def levels(slices: int) -> list[int]:
    """The bits that name a slice after each level, alike many new ones a level, the last those of `slices`."""
    bits = slices.bit_length() - 1
    n = max(1, -(-bits // LEVEL_BITS))
    return [bits * k // n for k in range(1, n + 1)]


def filters_of(prints: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    """(slice, filter) of sorted distinct fingerprints, a slice named by their first bits."""
    part = (prints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(prints) else []
    rows = []
    for a, b in zip(cut, [*cut[1:], len(prints)]):
        n = -(-(b - a) // FILTER_MOST)
        for k in range(n):
            some = slice(a + (b - a) * k // n, a + (b - a) * (k + 1) // n)
            # Inside a slice the top bits are all alike: shift them out to spread the quotients.
            rows.append((int(part[a]), CountingQuotientFilter.build(prints[some] << np.uint64(bits), counts[some]).pack()))
    return pd.DataFrame(rows, columns=["slice", "filter"])


def whole_prints(slice_: int, bits: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A filter's fingerprints, with the bits of its slice again, and their counts."""
    p, c = CountingQuotientFilter.unpack(data).items()
    return (p >> np.uint64(bits)) | np.uint64(slice_ << (64 - bits)) if bits else p, c


def repeated_fingerprints(prints: DataFrame, slices: int) -> DataFrame:
    """(fp long) of every fingerprint that prints (fp long) holds more than once.

    slices: a power of two; a slice is a contiguous part of the fingerprint space. Each
    level shuffles the filters by slice; but for the last, it adds up to FILTER_ROWS
    fingerprints of a slice at a time and cuts them into finer slices.
    """
    steps = levels(slices)

    def build(batches):
        held, n = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf["fp"].to_numpy().view(np.uint64))
                n += len(pdf)
            if n >= FILTER_ROWS:
                yield filters_of(*np.unique(np.concatenate(held), return_counts=True), steps[0])
                held, n = [], 0
        if n:
            yield filters_of(*np.unique(np.concatenate(held), return_counts=True), steps[0])

    def by_slice(filters: DataFrame, bits: int, give, rows: int | None, schema: str) -> DataFrame:
        """give(merged fingerprints, counts) for a slice's filters, up to some `rows` fingerprints at a time (None: all)."""
        def run(batches):
            at, held, n = None, [], 0
            for pdf in batches:
                for slice_, data in zip(pdf["slice"], pdf["filter"]):
                    if held and (slice_ != at or rows is not None and n >= rows):
                        yield give(*merged(held))
                        held, n = [], 0
                    at = slice_
                    held.append(whole_prints(int(slice_), bits, data))
                    n += len(held[-1][0])
            if held:
                yield give(*merged(held))

        return small_batches(filters.repartition("slice").sortWithinPartitions("slice")).mapInPandas(run, schema)

    filters = prints.mapInPandas(build, "slice long, filter binary")
    for bits, finer in zip(steps, steps[1:]):
        filters = by_slice(filters, bits, lambda p, c, finer=finer: filters_of(p, c, finer), FILTER_ROWS, "slice long, filter binary")
    return by_slice(filters, steps[-1], lambda p, c: pd.DataFrame({"fp": p[c > 1].view(np.int64)}), None, "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts, one row per row of docs.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``;
    null counts as empty, so null, empty and blank texts are one group. Of a group
    the row with the most code points, then the smallest id, stays; a null id comes
    last, and rows repeated with one id all carry that id's verdict. Other columns
    are not read. An empty table gives an empty result.

    Returns doc_id, keep_id, group_size long, kept boolean, text_sha256 string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    squeezed = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    wide = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), squeezed.alias("norm"))
    wide = wide.withColumn("fp", F.xxhash64("norm"))
    narrow = materialize(wide.select("doc_id", "chars", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")))
    n = narrow.count()
    again = materialize(repeated_fingerprints(narrow.select("fp"), slices_of(n)), n)

    # Byte verification: only rows with a repeated fingerprint bring their text along,
    # and equal texts collapse map-side before the shuffle.
    suspects = among(wide, again, again.count(), "fp")
    classes = suspects.groupBy("fp", "norm").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("o"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"))).alias("best"),
    )
    classes = classes.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", F.col("best.i").alias("keep_id"))
    flagged = narrow.join(classes, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return flagged.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all columns unchanged.

    Most code points, then the smallest id (null last), then any one row. Ids may be null and repeat.
    """
    rows = numbered(docs)
    keys = rows.select("text", F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), F.col("__row").alias("r")).alias("key"))
    return without(rows, exact_dedup(keys, id_col="key").where("NOT kept").select("doc_id.r"), "__row").drop("__row")
