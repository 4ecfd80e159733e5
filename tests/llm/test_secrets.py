import random
from collections import defaultdict

from pyspark.sql import functions as F

from sheafline.llm import secret_scan
from sheafline.llm.secret_scan import candidates, digests, secrets

KEY = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c"


def scan(spark, rows, **more):
    df = spark.createDataFrame([(i, t, repo, who, "k") for i, t, repo, who in rows], "doc_id long, text string, repo string, owner string, key string")
    return secrets(df, F.col("repo"), F.col("owner"), **more)


def test_patterns_at_their_edges():
    of = lambda text: [(k, a, b) for k, a, b, _ in candidates(text)]
    assert of("PassWord='abcdefgh'") == [("assign", 0, 18)] and of("password='abcdefg'") == []
    # A match that is too short still uses up its text, as no shorter one is looked for inside it.
    assert of("token=token:password123") == [] and of("api-key: abcdefgh") == [] and of("APIKEY\"  :  \"a.b=c/d+") == [("assign", 0, 21)]
    assert of("ſecret=abcdefghij") == [] and of("toKen=abcdefghij") == []  # letters that only fold to these
    assert of("AKIA" + "A" * 12) == [("access", 0, 16)] and of("AKIA" + "A" * 11) == [] and of("xAKIAABCDEFGHIJKL9z") == [("access", 1, 18)]
    assert of("g" + KEY + "g") == [("hex", 1, 33)] and of(KEY[:31]) == [("live", 0, 31)]
    assert [k for k, *_ in of("token=" + KEY)] == ["assign", "hex"]
    assert of("\U0001f600 " + "Ab3dE6gH9jK2mN5pQ8s-") == [("live", 2, 22)] and of("a" * 30 + "1") == [] and of("nodigitsinthislongstring") == []


def test_ownership_against_loops(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "HOT", 8)  # some values are broadcast, others shuffled
    rng = random.Random(3)
    bare = ["".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(24)) + "7x" for _ in range(12)]
    values = ["token = " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(6)] + bare + ["password: changeme1", "AKIA" + "Q" * 16]
    rows = [(k, " é ".join(rng.choice(values) for _ in range(rng.randrange(4))), rng.choice([None, "", *(f"r{j}" for j in range(9))]), rng.choice([None, "", "o1", "o2"])) for k in range(60)]
    rows += [(100 + k, "see " + bare[0], f"hot{k % 3}", "o1") for k in range(150)] + [(1, rows[1][1], rows[1][2], rows[1][3]), (None, bare[1], None, None), (900, None, None, None), (901, "", "r", "o")]
    held = defaultdict(lambda: (set(), set()))
    for _, text, repo, owner in rows:
        for *_, value in candidates(text or ""):
            held[value][0].add(repo)
            held[value][1].add(owner)
    want = []
    for i, text, _, _ in rows:
        spans = []
        for kind, a, b, value in candidates(text or ""):
            repos, owners = map(len, held[value])
            verdict = "example" if owners >= 3 or repos >= 6 else "live" if secret_scan.looks_random(value) else "weak"
            if kind != "live" or verdict == "live":
                spans.append((kind, a, b, verdict, repos, owners))
        want.append((i, sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex", "live"].index(s[0])))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in scan(spark, rows, repositories=6).collect()), key=key)
    assert got == sorted(want, key=key) and {s[3] for _, spans in got for s in spans} == {"example", "live", "weak"}


def test_base_spans_stay_and_added_ones_depend_on_the_corpus(spark):
    bare = "Zk3vQ9xT7bN2mR5wY8pL4"
    rows = [(k, f"use {bare} here", f"r{k}", f"o{k % 2}") for k in range(4)]
    one = {r.doc_id: r for r in digests(scan(spark, rows)).collect()}
    assert all(one[k].spans == "live:4:25" and one[k].n_live == 1 for k in range(4))
    many = {r.doc_id: r for r in digests(scan(spark, rows + [(9, f"{bare} token={KEY}", "r9", "o9")])).collect()}
    assert all(many[k].spans == "" for k in range(4)) and many[9].spans == "assign:22:60,hex:28:60" and (many[9].n_assign, many[9].n_hex, many[9].n_access) == (1, 1, 0)


def test_empty_table(spark):
    assert digests(secrets(spark.createDataFrame([], "doc_id long, text string, source string"), F.col("doc_id"), F.col("source"))).collect() == []
