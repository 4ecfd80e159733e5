import itertools
import random
import re

import numpy as np
import xxhash

from sheafline.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    of = {p: p for p in prints}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            of[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\x0b", "a", "A b", "É à b C d", "x\x1cy z w v", "a " * 5000]
    texts += [" ".join(rng.choice("ab cd ef Gh ij".split()) for _ in range(rng.randrange(60))) for _ in range(50)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def groups(df, key, of):
    out = {}
    for r in df:
        out.setdefault(r[of], set()).add(r[key])
    return {frozenset(v) for v in out.values()}


def test_links_equal_brute_force_also_in_crowded_buckets(spark, monkeypatch):
    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, 3}
    for b in bases:
        for _ in range(90):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    monkeypatch.setattr(simhash, "BUCKET", 8)  # most buckets draw rings of their own
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long")).collect()
    of = {p: p for p in prints}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for r in links:
        of[find(r.a & (2**64 - 1))] = find(r.b & (2**64 - 1))
    got, want = {}, {}
    for p in prints:
        got.setdefault(find(p), set()).add(p)
    for p, c in plain_components(sorted(prints)).items():
        want.setdefault(c, set()).add(p)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def test_groups_with_nulls_repeats_and_extra_columns(spark):
    docs = [(5, None, 1), (3, "", 2), (9, "one two three four", 3), (7, "One  TWO three four", 4), (7, "One  TWO three four", 4), (1, "entirely other words stand here", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.simhash_groups(df).select("doc_id", "component_id").collect()))
    assert got == [(1, 1), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert simhash.simhash_groups(df.limit(0)).collect() == []
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3, 7]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    of = plain_components(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(least.get(of[p], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {i: (f"{p:016x}", least[of[p]]) for i, p in prints.items()}
