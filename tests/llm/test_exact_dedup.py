import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sheafline.llm import common, exact_dedup
from sheafline.llm.exact_dedup import CountingQuotientFilter, merged
from sheafline.llm.queries import QUERIES, SQL
from tests.compare import check

SF = "/root/testdata/sf0.001"


@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 2**31), max_size=80))
def test_filter_gives_back_what_went_in(counts):
    prints = np.array(sorted(counts), np.uint64)
    made = CountingQuotientFilter.build(prints, np.array([counts[int(p)] for p in prints], np.int64))
    p, c = CountingQuotientFilter.unpack(made.pack()).items()
    assert dict(zip(map(int, p), map(int, c))) == counts


def test_crowded_runs():
    prints = np.arange(500, dtype=np.uint64)  # one quotient holds all
    p, c = CountingQuotientFilter.unpack(CountingQuotientFilter.build(prints, np.full(500, 3)).pack()).items()
    assert (p == prints).all() and (c == 3).all()


def test_merging_adds_counts():
    of = lambda *x: np.array(x, np.uint64)
    p, c = merged([(of(1, 5), np.array([1, 2])), (of(5, 9), np.array([3, 1])), (of(), np.zeros(0, np.int64)), (of(0, 9, 2**64 - 1), np.array([1, 1, 4]))])
    assert list(p) == [0, 1, 5, 9, 2**64 - 1] and list(c) == [1, 1, 5, 2, 4] and p.dtype == np.uint64


@pytest.mark.parametrize("slices", [1, 16, 64])
def test_repeated_fingerprints(spark, slices):
    rng = random.Random(slices)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    rows = values + values[:40] * 2
    df = spark.createDataFrame([(v,) for v in rows], "fp long").repartition(5)
    assert {r.fp for r in exact_dedup.repeated_fingerprints(df, slices).collect()} == set(values[:40])


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_levels_lose_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "LEVEL_BITS", bits)
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", 64)
    rng = random.Random(bits)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(2000)] + [-1, 0, 2**63 - 1, -(2**63)]
    rows = values + values[:300] * 2 + [values[5]] * 500
    df = spark.createDataFrame([(v,) for v in rows], "fp long").repartition(7)
    got = [r.fp for r in exact_dedup.repeated_fingerprints(df, 64).collect()]
    assert len(got) == 300 and set(got) == set(values[:300])
    assert exact_dedup.repeated_fingerprints(df.limit(0), 64).collect() == []


def test_filters_hold_thousands_of_fingerprints_at_any_size():
    for rows in (1, 10**5, 10**8, 5 * 10**10, 10**13):
        slices = exact_dedup.slices_of(rows)
        steps = exact_dedup.levels(slices)
        assert steps[-1] == slices.bit_length() - 1 and all(0 < b - a <= 8 for a, b in zip([0, *steps], steps))
        assert all(exact_dedup.FILTER_ROWS >> (b - a) >= 4096 for a, b in zip([0, *steps], steps)) and rows // slices <= exact_dedup.SLICE_ROWS
    prints = np.sort(np.random.default_rng(0).integers(0, 2**64, 1 << 20, dtype=np.uint64))
    made = exact_dedup.filters_of(prints, np.ones(len(prints), np.int64), 8)
    assert len(made) == 256 and made["filter"].map(len).sum() / len(prints) < 14


def test_against_brute_force_with_every_odd_case(spark):
    rows = [(3, "a b"), (1, "ab "), (2, "a\tb"), (9, None), (8, ""), (7, " \x0b"), (5, "é"), (5, "é"), (6, "x" * 300_000), (4, "x " * 300_000), (None, "q"), (10, "A b"), (11, "a\xa0b")]
    df = spark.createDataFrame([(i, t, 0, "k", 1) for i, t in rows], "doc_id long, text string, fp int, norm string, chars int")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        norm = (t or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[4])
    got = exact_dedup.exact_dedup(df)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []
    assert exact_dedup.keep_first(df).columns == df.columns


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(df).collect()) == [(1, 3), (2, 2), (3, 3)]


def test_texts_are_looked_up_alike_however_many_keys_there_are(spark):
    rows = spark.range(2000).withColumn("kind", F.lit("k"))
    keys = spark.range(0, 2000, 3)
    for most in (0, 10**6):
        assert {r.id for r in common.among(rows, keys, 700, "id", most).collect()} == set(range(0, 2000, 3))
        left = common.without(rows, keys.union(keys), "id", most)
        assert left.columns == ["id", "kind"] and sorted(r.id for r in left.collect()) == [k for k in range(2000) if k % 3]
    clear = common.marked(rows, F.col("id"), keys).where("NOT __maybe")
    assert clear.count() > 1200 and clear.where("id % 3 = 0").isEmpty()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    check(spark, SF, QUERIES[name], SQL[name])
