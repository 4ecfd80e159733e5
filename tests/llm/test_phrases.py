import random
import re
from collections import Counter

import pytest

from sheafline.llm import phrases
from sheafline.llm.phrases import collocations


def brute(rows, least, words, top, share):
    """All of it in loops: lang -> [(phrase, a, l, r, n, score)]."""
    counts, total = {}, Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, words + 1):
                for i in range(len(w) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = {}
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        rows = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in found.items()):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((" ".join(g), a, f[g[:k]], f[g[k:]], total[lang], score))
        out[lang] = sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.lang, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.lang, [])) + 1
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return out


SCHEMA = "text string, lang string, piece string, n long, gram string, salt string, size int"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_loops_in_many_buckets_and_small_batches(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(phrases, "BUCKET_WORDS", 500)
        monkeypatch.setattr(phrases, "CHARS", 300)
    rng = random.Random(seed)
    words = ["a", "B", "cé", "É", "İ", "x y", " ", "'q'", "\U0001f600", "d" * 40]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "?!", "\x0b"]) for _ in range(rng.randrange(40)))
    rows = [(text(), rng.choice(["en", "en", None, "und", ""])) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), (" \t ", None), (".,;", "xx"), ("a b " * 3000, "de")] + [("one hot piece, one hot piece", "en")] * 200
    df = spark.createDataFrame([(t, lang, "p", 1, "g", "s", 2) for t, lang in rows], SCHEMA).repartition(5)
    for least, size, top, share in ((3, 4, 25, 80), (2, 3, 10_000, 100)):
        assert told(collocations(df, least=least, words=size, top=top, share=share)) == {k: v for k, v in brute(rows, least, size, top, share).items() if v}


def test_empty_tables_have_no_phrases(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(None, None, None, None, None, None, None)] * 3, SCHEMA)).collect() == []


def test_scores_are_exact_where_products_pass_64_bits(spark):
    rows = [("en", g, f, s) for g, f, s in (("", 2**62, 0), ("x", 2**62 - 1, 1), ("y", 2**61 + 1, 1), ("x y", 2**61, 2), ("x y x", 2**60, 3), ("y x", 2**60, 2))]
    df = spark.createDataFrame(rows, "lang string, gram string, f long, size int")

    class Whole:
        sparkSession = spark

    original = phrases.settled
    phrases.settled = lambda spark, build: df
    try:
        got = {r.phrase: (r.score, r.l, r.r) for r in collocations(Whole()).collect()}
    finally:
        phrases.settled = original
    # Half of what "x y" and all of what "y x" counts lies inside the phrase of three words.
    assert got == {"x y": (2000000 * 2**61 // (2**62 + 2**61), 2**62 - 1, 2**61 + 1), "x y x": (2000000 * 2**60 // (2**61 + 2**62 - 1), 2**61, 2**62 - 1)}


def test_the_pair_table_clears_no_frequent_phrase(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PAIR_BITS", 64)  # full at once: nothing is ruled out
    rows = [(" ".join(f"w{(i * i + k) % 50}" for i in range(30)), "en") for k in range(40)]
    df = spark.createDataFrame([(t, lang, "p", 1, "g", "s", 2) for t, lang in rows], SCHEMA)
    assert told(collocations(df, least=2, top=300)) == brute(rows, 2, 4, 300, 80)
