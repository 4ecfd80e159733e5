import random

import pytest

from sheafline.operators import loops


def plain(keys, single, several):
    """(period, repeats, sample) of one list's strongest cycle, run by run."""
    found = []
    for p in range(1, 6):
        i = p
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j][0] and keys[j] == keys[j - p]:
                j += 1
            repeats, seed = (j - i) // p + 1, keys[i - p : i]
            if j > i and repeats >= (single if p == 1 else several) and (p == 1 or len(set(seed)) > 1):
                found.append((-repeats, p, i, seed[0][0]))
            i = max(j, i + 1)
    return (min(found)[1], -min(found)[0], min(found)[3]) if found else None


@pytest.mark.parametrize("segment", [5, 7, 16, 10_000])
def test_segments_find_what_whole_groups_show(spark, segment):
    rng = random.Random(segment)
    lists = {}
    for g in range(30):
        keys = []
        while len(keys) < rng.choice([3, 20, 60, 200]):
            unit = [rng.choice([("a", "1"), ("b", "1"), ("b", "2"), ("", "")]) for _ in range(rng.randrange(1, 6))]
            keys += unit * rng.randrange(1, 12)
        lists[None if g == 0 else f"g{g}"] = keys
    rows = [(g, k, n, n + t) for g, keys in lists.items() for k, (n, t) in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, n string, k string").repartition(6)
    got = {r.g: (r.period, r.repeats, r["sample"]) for r in loops.cyclic_runs(df, ["g"], "o", "n", "k", single=3, cycle=2, segment=segment).collect()}
    want = {g: plain([(n, n + t) for n, t in keys], 3, 2) for g, keys in lists.items()}
    assert got == {g: w for g, w in want.items() if w}


def test_one_hot_group_is_many_tasks(spark):
    n = 400_000
    df = spark.range(n).selectExpr("0 AS g", "id AS o", "CAST(IF(id BETWEEN 100000 AND 350000, id % 4, hash(id)) AS STRING) AS k").repartition(8)
    parts = loops.segments(df.selectExpr("g", "o AS __order", "k AS __name", "k AS __key"), ["g"], 50_000, 5)
    sizes = {r["__segment"]: r["count"] for r in parts.groupBy("__segment").count().collect()}
    assert len(sizes) in (8, 9) and max(sizes.values()) <= 50_005
    assert [r["__at"] for r in parts.where("NOT __halo").orderBy("__order").select("__at").collect()] == list(range(n))
    got = loops.cyclic_runs(df, ["g"], "o", "k", "k", segment=50_000).first()
    assert (got.period, got.repeats, got["sample"]) == (4, 250_001 // 4, "0")
