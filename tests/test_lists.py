import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sheafline.functions.text import normalize_for_match
from sheafline.operators import postprocess
from sheafline.plans import receipt_queries

ITEMS = "array<struct<name:string,quantity:double,price:double,total:double>>"
SF = "/root/testdata/sf0.001"


def entries(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(4, 12))).strip() + f"z{k}" for k in range(n)]


def receipts(spark, rows):
    return spark.createDataFrame([(m, [(n, None, None, None) for n in names] if names is not None else None) for m, names in rows], f"merchant_name string, items {ITEMS}")


@pytest.mark.parametrize("n", [3, 100_000])
def test_long_lists_find_what_short_ones_do(spark, n):
    patterns = [*entries(n), "tip", "", "tip jar", "é"]
    rows = [("The Tip Jar", ["tip", "tea", None, ""]), (patterns[1].upper() + "!", [f"x {patterns[2]} y", "rice"]), (None, None), ("", []), ("plain", ["plain"]), ("Té", ["té"])]
    known = [p for p in patterns if p]
    got = postprocess.deny_merchant(postprocess.deny_items(receipts(spark, rows), patterns), patterns).collect()
    norm = {t: spark.range(1).select(normalize_for_match(F.lit(t)).alias("n")).first().n for t in {x for m, names in rows for x in [m, *(names or [])] if x is not None}}
    hit = lambda t: t is not None and norm[t] != "" and any(p in norm[t] for p in known)
    for r, (m, names) in zip(got, rows):
        assert r.merchant_name == (None if hit(m) else m) and (None if r["items"] is None else [i.name for i in r["items"]]) == (None if names is None else [x for x in names if not hit(x)])


def test_first_entry_of_a_hundred_thousand_wins(spark):
    pairs = [(p, f"c{k}") for k, p in enumerate(entries(100_000))]
    pairs[70_000:70_000] = [("coop", "Late"), (pairs[9][0][:5], "Part")]
    rows = [(f"shop {pairs[500][0]} and {pairs[20][0]}", None), ("the coop", None), (pairs[9][0], None), ("nothing known here", None), ("", None), (None, None), ("cooop supermarket of the town", None)]
    got = [r.merchant_name for r in postprocess.canonicalize(receipts(spark, rows), pairs).collect()]
    want = [next((c for a, c in pairs if m and a in m), None) for m, _ in rows]
    assert got[:4] == [want[0], "Late", "c9", "nothing known here"] and got[4:6] == ["", None] and got[6] == (want[6] or rows[6][0])


def test_rows_and_tables_of_patterns_by_either_way(spark, monkeypatch):
    rng = random.Random(2)
    patterns = [*entries(200), "", None, "tip"]
    names = [rng.choice(patterns[:200]) + " x" if k % 3 else "".join(rng.choice("abcdez1") for _ in range(9)) for k in range(300)] + [None, "", "TIP!"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, name string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern_norm string")
    canon = spark.createDataFrame([(k, p, f"c{k}") for k, p in enumerate(patterns) if p], "ord int, alias_norm string, canonical string")
    got = []
    for chars in (1 << 24, 0):
        monkeypatch.setattr(postprocess.held, "__defaults__", (chars,))
        kept = {r.id for r in postprocess.deny_rows(df, "name", table).collect()}
        got.append((kept, {r.id: r.canonical for r in postprocess.canonical_by_substring(df, "name", canon).collect()}))
    assert got[0] == got[1] and 300 in got[0][0] and 301 in got[0][0] and 302 not in got[0][0]
    with pytest.raises(ValueError, match="too many to broadcast"):
        monkeypatch.setattr(postprocess, "BROADCAST_CHARS", 10)
        postprocess._sent.cache_clear()
        postprocess.deny_merchant(receipts(spark, []), entries(70))
    postprocess._sent.cache_clear()


def changed(rng, text):
    t = list(text)
    for _ in range(rng.randrange(4)):
        if not t:
            break
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [t[k], rng.choice("abcxyz")]])
    return "".join(t)


def test_similar_names_equal_the_loop_and_few_are_compared(spark):
    rng = random.Random(5)
    parts = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    names = [normal for normal in parts][:200]
    aliases = [changed(rng, rng.choice(parts)) if k % 2 else " ".join(rng.sample(" ".join(rng.sample(parts, 5)).split(), 4)) for k in range(10_000)]
    near = postprocess.Similar(aliases, 0.9)
    got = {n: near.first(n) for n in names}
    loop = {}
    for n in names:
        m = SequenceMatcher(None, "", "")
        m.set_seq1(n)
        for k, a in enumerate(aliases):
            m.set_seq2(a)  # the bounds do not depend on the order; the ratio itself does
            if m.real_quick_ratio() >= 0.9 and m.quick_ratio() >= 0.9 and SequenceMatcher(None, n, a).ratio() >= 0.9:
                loop[n] = k
                break
    assert {n: k for n, k in got.items() if k is not None} == loop and len(loop) > 20
    assert near.compared < len(names) * len(aliases) / 100
    canon = spark.createDataFrame([(k, a, f"c{k}") for k, a in enumerate(aliases)], "ord int, alias_norm string, canonical string").repartition(8)
    df = spark.createDataFrame([(n,) for n in [*names, "", None, names[0]]], "name string")
    met = {r.name: (r.ord, r.canonical) for r in postprocess.similar(df, "name", canon).collect()}
    assert met == {n: (k, f"c{k}") for n, k in loop.items()}


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9, 1.0])
def test_texts_that_are_similar_share_a_token(least):
    rng = random.Random(int(least * 10))
    for _ in range(4000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 16)))
        b = changed(rng, a)
        if b and SequenceMatcher(None, a, b).ratio() >= least:
            assert set(postprocess.prefix(a, least)) & set(postprocess.prefix(b, least)), (a, b)


def test_words_of_few_syllables_meet_few_that_are_not_similar():
    rng = random.Random(3)
    syllables = ["ung", "keit", "sch", "ein", "ver", "heit", "tion", "the", "ing", "ou", "er", "ent", "an", "le", "re", "in"]
    names, aliases = ({w for _ in range(900) if 8 <= len(w := "".join(rng.choices(syllables, k=rng.randrange(2, 6)))) <= 15} for _ in range(2))
    met = {a: set(postprocess.prefix(a, 0.85)) for a in aliases}
    pairs = [(n, a) for n in names for tokens in [set(postprocess.prefix(n, 0.85))] for a, of in met.items() if not of.isdisjoint(tokens)]
    near = [(n, a) for n in names for a in aliases if min(len(n), len(a)) * 2 >= 0.85 * (len(n) + len(a)) and SequenceMatcher(None, n, a).quick_ratio() >= 0.85 and SequenceMatcher(None, n, a).ratio() >= 0.85]
    assert set(near) <= set(pairs) and len(near) > 100
    assert len(pairs) < len(names) * len(aliases) // 5


def test_similar_words_query_equals_difflib(spark):
    got = {r.word: r.canonical for r in receipt_queries.QUERIES["similar_words"](spark, SF).collect()}
    words = {}
    for name in ("conversations", "benchmark"):
        texts = spark.read.parquet(f"{SF}/{name}.parquet").select(normalize_for_match(F.col("text")).alias("t")).collect()
        words[name] = {w for r in texts for w in re.split(r"[^\w]+|[\d_]+", r.t) if len(w) >= 8}
    want = {}
    for w in words["conversations"]:
        near = [a for a in words["benchmark"] if min(len(a), len(w)) * 2 >= 0.85 * (len(a) + len(w)) and SequenceMatcher(None, w, a).ratio() >= 0.85]
        if near:
            want[w] = min(near)
    assert got == want and len(want) > 20
