import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import chat, embed_dedup, mixing, sharding, warc
from sheafline.llm.common import components
from sheafline.llm.queries import QUERIES, mix_domain

SF = "/root/testdata/sf0.001"


# ---- mixing ----

def water(total, children):
    """{name: share} of a total split by weight among (weight, holds) children, by raising the level."""
    out = {n: 0.0 for n in children}
    open_ = {n for n, (w, h) in children.items() if w > 0 and h > 0}
    left = min(float(total), sum(children[n][1] for n in open_))
    while open_ and left > 1e-9:
        unit = min(left / sum(children[n][0] for n in open_), min((children[n][1] - out[n]) / children[n][0] for n in open_))
        for n in open_:
            out[n] += unit * children[n][0]
        left -= unit * sum(children[n][0] for n in open_)
        open_ = {n for n in open_ if children[n][1] - out[n] > 1e-9}
    return {n: int(s + 1e-6) for n, s in out.items()}


def plain_budgets(leaves, total, weights, epochs):
    w = lambda level, n: weights.get(level, {}).get(n, 1.0)
    holds = {k: t * epochs * all(w(level, n) > 0 for level, n in zip(mixing.LEVELS, k)) for k, t in leaves.items()}
    sums = lambda n: Counter()  # noqa: E731, F841
    by_domain, by_language = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for (d, l, _), h in holds.items():
        by_domain[d] += h
        by_language[d][l] += h
    out = {}
    for d, b in water(total, {d: (w("domain", d), h) for d, h in by_domain.items()}).items():
        for l, c in water(b, {l: (w("language", l), h) for l, h in by_language[d].items()}).items():
            out |= {(d, l, s): x for s, x in water(c, {k[2]: (w("source", k[2]), h) for k, h in holds.items() if k[:2] == (d, l)}).items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_match_water_filling(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, l, s): rng.choice([0, 1, 50, 900, 12_000]) for d in "AB" for l in "xyz" for s in "pqr" if rng.random() < 0.8}
    weights = {"domain": {"A": 3}, "language": {"x": 0 if seed == 2 else 5}, "source": {"q": 0.5, "r": 2}}
    total = int(sum(leaves.values()) * rng.choice([0.2, 0.7, 3]))
    df = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "domain string, language string, source string, tokens long")
    got = {(r.domain, r.language, r.source): r.budget for r in mixing.budgets(df, F.lit(total), weights, 2).collect()}
    want = plain_budgets(leaves, total, weights, 2)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes_stay_in_budget_and_repeat_whole_epochs(spark):
    docs = [(i, "w " * (i % 9), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(None, "a b", "en", "s1"), (7, "w " * 7, "en", "s3")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, source string, tokens int, bucket string")
    got = mixing.mix(df, F.col("tokens") * 1.5, {"source": {"s1": 4.0}}, F.lit(None).cast("string"), epochs=3).collect()
    assert len(got) == len(docs)
    spent, leaf = Counter(), {}
    for r in got:
        key = (r.domain, r.language, r.source)
        spent[key] += r.tokens * r.copies
        leaf[key] = r.budget
        assert r.copies == 0 or r.tokens > 0
    assert all(spent[k] <= leaf[k] < spent[k] + 9 for k in leaf) and {k[0] for k in leaf} == {"(null)"}
    assert max(r.copies for r in got) > 1
    assert mixing.mix(df.limit(0), F.col("tokens"), {}, F.lit("a")).collect() == []


def test_each_epoch_has_its_own_order_and_no_partition_matters(spark):
    df = spark.createDataFrame([(i, "w w", "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    taken = lambda frame, share, epochs: {r.doc_id for r in mixing.mix(frame, F.col("tokens") * share, {}, F.lit("d"), epochs).collect() if r.copies == int(share) + 1}
    first = taken(df, 0.5, 2)
    assert len(first) == 150 and first == taken(df.repartition(7), 0.5, 2) and first != taken(df, 1.5, 2)


def test_mix_domain(spark):
    df = spark.createDataFrame([("src0",), ("src2",), ("src3",), (None,)], "source string")
    assert [r.d for r in df.select(mix_domain().alias("d")).collect()] == ["web", "books", "forums", "forums"]


# ---- WARC ----

def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, None), (8, "u", ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "é\r\n\r\n" * 50_000), (3, "again", "same"), (None, "n", "same"), (None, "n", "other"), (4, "u", "z" * 10)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, first string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path)
    whole = warc.resolved(got).collect()
    assert len(whole) == len(rows)
    html = {}
    for i, _, h in rows:
        html.setdefault(h or "", []).append(i)
    for r in whole:
        if r.record_type == "response":
            payload = r.html.encode()
            assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() and r.refers_to is None
            ids = [i for i in html[r.html] if i is not None]
            assert r.page_id == (min(ids) if ids else None)
        else:
            assert r.html is None and r.original_bytes == r.payload_bytes and r.refers_to == min(i for i in next(v for k, v in html.items() if base64.b32encode(hashlib.sha1(k.encode()).digest()).decode() == r.payload_digest) if i is not None)
    assert Counter(r.record_type for r in whole) == {"response": 7, "revisit": 3}
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*/*/*.txt"))
    assert len(re.findall(rb"(?:^|\r\n\r\n)WARC/1\.1\r\nWARC-Type", data)) == len(rows) and b"\r\nX: y" not in data
    assert warc.round_trip(df.limit(0)).collect() == []
    assert {r.record_type for r in warc.round_trip(df, least_bytes=10**9).collect()} == {"response"}


def test_base32_matches_the_standard_library(spark):
    texts = ["", "a", "é" * 99]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32(F.sha1("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}


def test_archives_are_bounded_in_bytes_and_records(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "x" * size) for i, size in enumerate([10] * 2500 + [100_000] * 130 + [3_000_000] * 9 + [20_000_000] * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w")
    files = sorted((tmp_path / "w").glob("*/*/*.txt"))
    assert Counter(f.parent.parent.name for f in files) == {"class=0": 3, "class=1": 3, "class=2": 3, "class=3": 2} and max(f.stat().st_size for f in files) < 65 << 20
    got = warc.read_archives(spark, f"file://{tmp_path}/w", payloads=False)
    assert got.count() == len(rows) and got.where("html IS NOT NULL").isEmpty()


def test_payloads_find_their_first_record_by_either_way(spark):
    rows = spark.range(300).selectExpr("id AS page_id", "sha1(CAST(id % 200 AS STRING)) AS digest", "'h' AS html")
    firsts = warc.materialize(warc.resolve(rows.withColumn("payload_bytes", F.lit(1))))
    want = {k: k % 200 if k % 200 < 100 else None for k in range(300)}
    for most in (0, 10**6):
        assert {r.page_id: r.first for r in warc.with_first(rows, firsts, most).collect()} == want


# ---- sharding ----

def test_shards_hold_their_law(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_sharding"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert all(r.size == len(docs[r.doc_id].text.encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].text.encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_shards_match_the_mixture_and_brute_force(spark):
    rows = [(i, "t" * (i % 5), ["big", "mid", None][0 if i % 6 < 4 else 1 if i % 6 == 4 else 2]) for i in range(1200)] + [(None, None, "mid"), (3, "t", "big"), (3, "t", "big")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, rank int, stratum string").repartition(6)
    got = sharding.interleave(df, shards=5, seed=9).collect()
    source = {i: s for i, _, s in rows}
    for shard in range(5):
        share = Counter(source[r.doc_id] for r in got if r.shard == shard)
        assert abs(share["big"] - 803 / 5) <= 3 and abs(share["mid"] - 200 / 5) <= 3
    mix = lambda i: hashlib.md5(f"9:{'-' if i is None else i}".encode()).hexdigest()
    place = []
    for s in ("big", "mid", None):
        own = sorted((mix(i), i is not None, i or 0) for i, _, x in rows if x == s)
        name = "-" if s is None else f"={s}"
        begin = (int(hashlib.md5(f"9/{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        place += [((k + begin) / len(own), name, m, i if real else None) for k, (m, real, i) in enumerate(own)]
    place.sort(key=lambda p: p[:3])
    want = Counter((i, k * 5 // len(place)) for k, (*_, i) in enumerate(place))
    assert Counter((r.doc_id, r.shard) for r in got) == want
    assert sharding.interleave(df.limit(0)).collect() == []


def test_thousands_of_small_sources_are_spread_over_all_shards(spark):
    rows = [(i, "t", f"host{i}") for i in range(4000)] + [(5000 + i, "t", "big") for i in range(4000)] + [(10_000 + i, "t", f"pair{i // 2}") for i in range(1000)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).collect()
    of = {i: s.rstrip("0123456789") for i, _, s in rows}
    share = Counter((r.shard, of[r.doc_id]) for r in got)
    for shard in range(8):
        assert abs(share[shard, "host"] - 500) < 100 and abs(share[shard, "big"] - 500) < 100 and abs(share[shard, "pair"] - 125) < 50
        assert sum(share[shard, s] for s in ("host", "big", "pair")) == 1125


def test_written_shards_read_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i), f"s{i % 3}") for i in range(100)], "doc_id long, text string, source string")
    sharding.write_shards(df, f"file://{tmp_path}/s", shards=4)
    got = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert sorted(r.doc_id for r in got) == list(range(100)) and Counter(r.shard for r in got) == {k: 25 for k in range(4)}


def test_shards_keep_every_row_whatever_its_id(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "b", "x"), (1, "c", "y"), (1, "d", None), (2, None, "x"), (None, "a", "x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    sharding.write_shards(df, f"file://{tmp_path}/s", shards=2)
    got = spark.read.parquet(f"file://{tmp_path}/s").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=key) == sorted(rows, key=key)
    assert Counter(r.shard for r in got) == {0: 3, 1: 3} and {r["size"] for r in got} == {9}


# ---- chats ----

def test_chats_read_back_whatever_they_say(spark):
    rng = random.Random(6)
    parts = ["###", "#", "</turn>", "<", "/turn>", "\\", "\n", " ", "### Assistant: ", "ok", "é", " </turn>\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool: x", "@", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for c in (*range(30), None) for t in range(rng.randrange(1, 9))]
    rows += [(100, None, "user", "x" * 200_000), (100, 0, "assistant", ""), (100, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, turn_no int, ok boolean").repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        r = got[c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        roles = ["^", *(a for a, _ in turns)]
        assert r.valid == all(b in chat.TEMPLATE.follows.get(a, ()) for a, b in zip(roles, roles[1:]))
    assert chat.digests(chat.format_chats(df.limit(0))).collect() == []


def test_reading_back_sees_a_missing_escape(spark):
    text = "\\### Assistant: </turn> ok"
    df = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    good = chat.digests(chat.format_chats(df)).first()
    assert good.n_turns == 2 and good.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert good.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    for text in (text, "x </turn>\n### User: y"):
        df = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")
        want = hashlib.sha256(f"user\n{text}\n".encode()).hexdigest()
        assert chat.digests(chat.format_chats(df)).first().turns_sha256 == want
        loose = chat.Template(controls=())
        try:
            assert chat.digests(chat.format_chats(df, loose), loose).first().turns_sha256 != want
        except Exception as error:
            assert "no turn" in str(error)


def test_turns_are_read_from_the_text_and_not_from_segments(spark):
    whole = "".join(p for role, t in (("user", "a # </turn> \\"), ("assistant", "é\n### b")) for p, _ in chat.TEMPLATE.segments(role, t))
    rows = [(1, 0, k, c, False, True) for k, c in enumerate(whole)]
    df = spark.createDataFrame(rows, "conv_id long, turn_no int, segment_no int, text string, loss boolean, ok boolean").coalesce(1).sortWithinPartitions("segment_no")
    got = chat.digests(df).first()
    assert got.n_turns == 2 and got.formatted_chars == len(whole)
    assert got.turns_sha256 == hashlib.sha256("user\na # </turn> \\\nassistant\né\n### b\n".encode()).hexdigest()


def test_only_assistant_texts_are_under_the_loss_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b ###")], "conv_id long, turn long, role string, text string")
    got = [(r.text, r.loss) for r in chat.format_chats(df).collect()]
    assert got == [("### User: ", False), ("a", False), (" </turn>\n", False), ("### Assistant: ", False), ("b \\###", True), (" </turn>\n", False)]


# ---- embeddings ----

def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "FAN", 2)
    monkeypatch.setattr(embed_dedup, "TILES", 3)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(25, 6))
    rows = [(int(i), (base[i % 25] + rng.normal(size=6) * rng.choice([0, 0.1, 0.3])).tolist()) for i in rng.permutation(220)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [1e300] * 6), (307, [2e300] * 6), (308, [1e-300] * 6), (309, [1.0, 2.0]), (310, [2.0, 4.0]), (5, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, 0) for r in rows], "vec_id long, embedding array<double>, n_links int, row int").repartition(4)
    unit = [embed_dedup.unit(v) for _, v in rows]
    link = [[k != j and u is not None and v is not None and len(u) == len(v) and u @ v >= 0.9 for j, v in enumerate(unit)] for k, u in enumerate(unit)]
    of = list(range(len(rows)))
    for _ in rows:
        for k, line in enumerate(link):
            of[k] = min([of[k], *(of[j] for j, x in enumerate(line) if x)])
    least = defaultdict(list)
    for k, c in enumerate(of):
        least[c].append(rows[k][0])
    want = sorted((rows[k][0], sum(link[k]), min(least[of[k]]), rows[k][0] == min(least[of[k]])) for k in range(len(rows)))
    assert sorted(map(tuple, embed_dedup.near_groups(df, 0.9).collect())) == want
    assert embed_dedup.near_groups(df.limit(0)).collect() == []


def test_distant_blocks_are_skipped(spark):
    blocks = spark.createDataFrame([(2, k, [10.0 * k, 0.0], [10.0 * k + 1, 1.0]) for k in range(40)], "dim int, pos long, lo array<double>, hi array<double>")
    got = {(r.a, r.b) for r in embed_dedup.interval_pairs(blocks, 9.5).collect()}
    assert got == {(k, k) for k in range(40)} | {(k, k + 1) for k in range(39)}
    assert len(embed_dedup.interval_pairs(blocks, 8.5).collect()) == 40


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 200)] + [(500 + k, 500 + k + 2) for k in range(30)] + [(7, 7), (3, 2)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500 + k: 500 + k % 2 for k in range(32)}
