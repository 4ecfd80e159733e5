import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sheafline.llm import lm_score


def small_lexicon():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    kinds = np.zeros(lm_score.SLOTS)
    kinds[:400] = rng.integers(0, 5, 400)
    n = kinds * rng.integers(1, 4, lm_score.SLOTS)
    lex = lm_score.lexicon(words, rng.integers(2, 90, 300), n, kinds)
    return lex, kinds, rng


def test_probabilities_of_all_words_add_up_to_one():
    lex, kinds, rng = small_lexicon()
    lex.forks += rng.normal(0, 0.5, lex.forks.shape).astype(np.float32)
    lex.vectors += rng.normal(0, 0.5, lex.vectors.shape).astype(np.float32)
    w = lm_score.unpack(lm_score.initial(rng.random(lm_score.PAD) * 9, 1))
    tables = [lex.vectors @ m for m in w["mix"]]

    def at(k):
        ids, spot = lm_score.padded([np.array([259, 7, k, 300, 200], np.int32)])
        return np.exp(lm_score.log_probs(w, ids, spot[2:3], lex, tables)[0])

    first = lm_score.PAD + 1 + len(lex.words)
    total = sum(at(k) for k in [*range(lm_score.KNOWN), *range(lm_score.PAD + 1, first)])
    for token in range(lm_score.SHARED):  # the words of a slot and one that was never seen, by the share of its token's slots
        slots = np.arange(token, lm_score.SLOTS, lm_score.SHARED)
        total += at(first + token) / np.exp(lex.share[token]) * (np.exp(lex.share[slots].astype(np.float64)) * (kinds[slots] + 1)).sum()
    assert total == pytest.approx(1, rel=1e-4)


def test_a_step_follows_the_slope_of_the_loss():
    lex, _, rng = small_lexicon()
    lex.forks += rng.normal(0, 0.3, lex.forks.shape).astype(np.float32)
    flat = lm_score.initial(rng.random(lm_score.PAD) * 9, 1)
    ids, at = lm_score.padded([rng.integers(lm_score.PAD + 1, lm_score.PAD + 301, 40).astype(np.int32) for _ in range(3)])
    own = lm_score.Learner(flat, lex)
    own.step(ids, at)

    def loss(lexicon):
        w = {k: v.astype(np.float64) for k, v in lm_score.unpack(flat).items()}
        return -lm_score.log_probs(w, ids, at, lexicon, [lexicon.vectors @ m for m in w["mix"]]).sum()

    for name in ("vectors", "forks"):
        step = getattr(own.lex, name) - getattr(lex, name)
        # The slope is what the step was before it was scaled by its row's moved sum.
        moved = own.rows_moved[name]
        slope = -step * np.sqrt(moved)[:, None] / lm_score.RATE
        for row in np.flatnonzero(own.seen[name])[:5]:
            got = []
            for h in (1e-2, -1e-2):
                nudged = lm_score.replace(lex, **{name: getattr(lex, name).astype(np.float64)})
                getattr(nudged, name)[row, 3] += h
                got.append(loss(nudged))
            assert (got[0] - got[1]) / 2e-2 == pytest.approx(slope[row, 3], rel=2e-2, abs=2e-3)


def test_rows_of_one_id_and_copies_of_one_text_are_spread(spark):
    coded = lambda k: bytearray(np.arange(k % 50 + 1, dtype=np.int32).tobytes())
    one_id = spark.createDataFrame([(None if k % 2 else 7, bytearray(np.full(3, k, np.int32).tobytes())) for k in range(800)], "doc_id long, tokens binary")
    copies = spark.createDataFrame([(k, coded(3)) for k in range(800)], "doc_id long, tokens binary")
    for df in (one_id, copies):
        sizes = {r.part: r["count"] for r in lm_score.dealt(df, 8, 13).groupBy("part").count().collect()}
        assert len(sizes) == 8 and max(sizes.values()) < 150
    again = [sorted((r.part, bytes(r.tokens)) for r in lm_score.dealt(one_id.repartition(n), 8, 13).collect()) for n in (1, 5)]
    assert again[0] == again[1]


def corpus(spark, n, size):
    rng = random.Random(6)
    words = [f"{rng.choice('abcdefgh')}{k}" for k in range(size)]
    texts = [" ".join(words[int(size * rng.random() ** 3)] for _ in range(50)) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), texts


def test_vocabulary_grows_and_junk_scores_below_documents(spark):
    sizes = []
    for n in (100, 1000):
        docs, texts = corpus(spark, n, 5000)
        counts = lm_score.word_counts(docs)
        known, frequency = lm_score.most_frequent(counts)
        lex = lm_score.words_below(counts, known, frequency)
        sizes.append(len(lex.words))
        assert not set(known) & set(lex.words)
    assert sizes[1] > 1.5 * sizes[0] > 0
    rng = random.Random(8)
    junk = [(10_000 + k, " ".join("".join(rng.choice("jklmnopqrs") for _ in range(9)) for _ in range(50))) for k in range(40)]
    tokens = lm_score.token_table(docs, known, lex=lex)
    weights, lex = lm_score.fit(tokens, frequency, lex=lex)
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    got = {r.doc_id: r.mean_log_score for r in lm_score.score_tokens(lm_score.token_table(both, known, lex=lex), weights, lex).collect()}
    real = sorted(v for k, v in got.items() if k < 10_000)
    worst = max(v for k, v in got.items() if k >= 10_000)
    assert worst < real[len(real) // 20]


def test_every_position_is_a_target(spark, monkeypatch):
    texts = ["left right " * 40, "right", "left", "left left right"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    none = np.zeros(lm_score.SLOTS)
    lex = lm_score.lexicon(["left", "right"], np.array([43, 42]), none, none)
    tokens = lm_score.token_table(df, [], lex=lex)
    rows = lm_score.dealt(tokens, 2, 13).collect()
    assert sum(len(r.tokens) // 4 for r in rows) == lm_score.word_counts(df).agg({"n": "sum"}).first()[0] == 85
    # Each word's positions as targets, in all passes, are as many as its occurrences.
    monkeypatch.setattr(lm_score.Learner, "step", lambda self, ids, spot: np.add.at(self.seen["vectors"], ids[spot], 1))
    monkeypatch.setattr(lm_score, "HELD", 7)
    got = []
    monkeypatch.setattr(lm_score, "averages", lambda parts, groups: got.append(parts.where("name = 'vectors'").collect()) or parts.limit(0))
    lm_score.fit(tokens, np.ones(lm_score.PAD) * 85 / lm_score.PAD, lex=lex, group=43)
    times = Counter()
    for parts in got:
        for r in parts:
            for i, n in zip(np.frombuffer(bytes(r.at), np.int32).tolist(), np.frombuffer(bytes(r.n), np.int64).tolist()):
                times[i] += n
    assert times == {lm_score.PAD + 1: 43, lm_score.PAD + 2: 42}
    monkeypatch.undo()
    with pytest.raises(ValueError):
        lm_score.fit(tokens, np.ones(lm_score.PAD), rounds=2, stride=16, lex=lex)


def test_training_reaches_words_at_any_place(spark):
    # The word stands only where neither a multiple of 16 nor one 8 further trains.
    text = " ".join("odd" if k % 16 in (3, 9, 14) else "even" for k in range(1600))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    flat = np.ones(lm_score.PAD)
    weights = lm_score.train(df, ["even", "odd"], flat)
    base = lm_score.unpack(weights)["last"][-1] - lm_score.unpack(lm_score.initial(flat, 13))["last"][-1]
    assert base[1] > 0.1 and base[0] > 0.1 and (base[2:] < 0).all()


def test_long_words_are_words_of_their_own(spark):
    a, b = "x" * 65, "x" * 66
    assert lm_score.words(f"A {a} {b} {a.upper()}")[0] == "a" and len(set(lm_score.words(f"{a} {b} {a.upper()}"))) == 2
    df = spark.createDataFrame([(k, f"{a} {a} {b} y") for k in range(3)], "doc_id long, text string")
    assert sorted(r.n for r in lm_score.word_counts(df).collect()) == [3, 3, 6]


# ---- training and the whole query against plain loops ----

def plain_probability(w, lex, ids, k):
    """The log-probability of word k of one document, and what its gradient needs, one number at a time."""
    leaf = [int(x) for x in lex.leaf_ids(np.asarray(ids))]
    near = [leaf[k + d] if 0 <= k + d < len(leaf) else lm_score.PAD for d in lm_score.WINDOW]
    one = np.tanh(sum(lex.vectors[i].astype(np.float64) @ w["mix"][j] for j, i in enumerate(near)) + w["bias"])
    one[-1] = 1.0
    z = one @ w["last"]
    token = lex.token[leaf[k]]
    out = z[token] - np.log(np.exp(z - z.max()).sum()) - z.max()
    for at in range(lex.start[leaf[k]], lex.start[leaf[k]] + lex.length[leaf[k]]):
        out -= np.log1p(np.exp(-lex.side[at] * (one @ lex.forks[lex.fork[at]].astype(np.float64))))
    if ids[k] >= len(lex.token):
        out += lex.share[ids[k] - len(lex.token)]
    return out


def test_a_training_step_equals_numeric_slopes_with_adagrad():
    lex, _, rng = small_lexicon()
    lex.forks += rng.normal(0, 0.3, lex.forks.shape).astype(np.float32)
    lex.vectors += rng.normal(0, 0.3, lex.vectors.shape).astype(np.float32)
    flat = lm_score.initial(rng.random(lm_score.PAD) * 9, 1)
    doc = rng.integers(0, lm_score.PAD + 300, 12)
    doc[doc == lm_score.PAD] = 5
    ids, at = lm_score.padded([doc.astype(np.int32)])
    own = lm_score.Learner(flat, lex)
    own.step(ids, at)
    w = {k: v.astype(np.float64) for k, v in lm_score.unpack(flat).items()}
    loss = lambda: -np.mean([plain_probability(w, lex, doc, k) for k in range(12)])
    for name, spot in (("mix", (1, 2, 3)), ("bias", (4,)), ("last", (5, int(lex.token[doc[0]]))), ("last", (-1, int(lex.token[doc[1]])))):
        kept, got = w[name][spot], []
        for h in (1e-5, -1e-5):
            w[name][spot] = kept + h
            got.append(loss())
        w[name][spot] = kept
        slope = (got[0] - got[1]) / 2e-5
        want = kept - lm_score.RATE * slope / np.sqrt(1e-2 + slope * slope)
        assert own.w[name][spot] == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_the_query_equals_plain_loops_however_the_table_is_cut(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP", 700)
    monkeypatch.setattr(lm_score, "AVERAGED", 2)
    monkeypatch.setattr(lm_score, "KNOWN", 6)
    monkeypatch.setattr(lm_score, "PAD", 6 + lm_score.SHARED)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]  # many ties
    texts = [" ".join(vocabulary[int(60 * rng.random() ** 2)] for _ in range(rng.randrange(60))) + rng.choice(["", f" only{k}", " " + "long" * 40]) for k in range(90)]
    rows = [(k if k % 10 else None, t, 1, "x") for k, t in enumerate(texts)] + [(200, None, 1, "x"), (201, " \n", 1, "x"), (3, texts[3], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int, part string")

    # The vocabulary by plain counts.
    counts = Counter(w for _, t, *_ in rows for w in lm_score.words(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    known, least = ranked[:6], max(2, np.ceil(sum(counts.values()) ** (2 / 3) / 1300))
    own = [w for w in ranked[6:] if counts[w] >= least]
    n, kinds = np.zeros(lm_score.SLOTS), np.zeros(lm_score.SLOTS)
    for w in ranked[6:]:
        if counts[w] < least:
            n[zlib.crc32(w.encode()) % lm_score.SLOTS] += counts[w]
            kinds[zlib.crc32(w.encode()) % lm_score.SLOTS] += 1
    frequency = np.array([*(counts[w] for w in known), *(sum(counts[w] for w in ranked[6:] if zlib.crc32(w.encode()) % lm_score.SHARED == k) for k in range(lm_score.SHARED))], float)
    lex = lm_score.lexicon(own, np.array([counts[w] for w in own]), n, kinds)
    first = lm_score.PAD + 1 + len(own)
    number = {w: k for k, w in enumerate(known)} | {w: lm_score.PAD + 1 + k for k, w in enumerate(own)}
    ids = lambda t: [number.get(w, first + zlib.crc32(w.encode()) % lm_score.SLOTS) for w in lm_score.words(t)]

    # Groups, passes and averages in loops.
    coded = spark.createDataFrame([(i, bytearray(np.array(ids(t), np.int32).tobytes())) for i, t, *_ in rows], "doc_id long, tokens binary")
    hashes = {(r.doc_id, bytes(r.tokens)): r.h for r in coded.selectExpr("doc_id", "tokens", "xxhash64(doc_id, tokens, 13) AS h").collect()}
    groups = int(np.ceil(sum(counts.values()) / 700))
    assert groups > 2
    weights = lm_score.initial(frequency, 13)
    for turn in range(lm_score.ROUNDS):
        made = []
        for g in range(groups):
            every = [(hashes[i, code], code) for i, t, *_ in rows if lm_score.words(t) for code in [np.array(ids(t), np.int32).tobytes()]]
            docs = sorted(x for x in every if x[0] % groups == g)
            flat, at = lm_score.padded([np.frombuffer(x, np.int32) for _, x in docs])
            flat, learner, steps, spots = lex.leaf_ids(flat), lm_score.Learner(weights, lex), 0, at[turn % 2 :: 2]
            while len(spots):
                size = lm_score.BATCH if steps < lm_score.SMALL else lm_score.LARGER * lm_score.BATCH
                learner.step(flat, spots[:size])
                spots, steps = spots[size:], steps + 1
            made.append((len(at), learner))
        weights = (sum(n * x.flat.astype(float) for n, x in made) / sum(n for n, _ in made)).astype(np.float32)
        for name in ("vectors", "forks"):
            table = getattr(lex, name).copy()
            for row in range(len(table)):
                if times := sum(x.seen[name][row] for _, x in made):
                    table[row] = sum(x.seen[name][row] * getattr(x.lex, name)[row].astype(float) for _, x in made) / times
            lex = lm_score.replace(lex, **{name: table})

    w = {k: v.astype(np.float64) for k, v in lm_score.unpack(weights).items()}
    want = sorted((-1 if i is None else i, len(ids(t)), sum(plain_probability(w, lex, ids(t), k) for k in range(len(ids(t))))) for i, t, *_ in rows)
    for cut in (df.coalesce(1), df.repartition(7)):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.log_score, r.mean_log_score) for r in lm_score.pseudo_likelihood(cut).collect())
        assert [g[:2] for g in got] == [x[:2] for x in want]
        for g, x in zip(got, want):
            assert g[2] == pytest.approx(x[2], rel=1e-3, abs=1e-3) and (g[3] is None if not g[1] else g[3] == pytest.approx(x[2] / x[1], rel=1e-3, abs=1e-3))


# ---- the parts of a step ----

def test_paths_hold_the_steps_of_all_ids_depth_by_depth():
    lex, _, rng = small_lexicon()
    for ids in (rng.integers(0, len(lex.token), 90), np.arange(5), np.zeros(0, np.int64)):
        order, reach = lex.longest_first(ids)
        fork, side = lex.paths(ids.take(order), reach)
        got = [[] for _ in ids]
        for k, m in enumerate(reach):
            done = int(reach[:k].sum())
            for row in range(m):
                got[order[row]].append((fork[done + row], side[done + row]))
        assert got == [[(lex.fork[at], lex.side[at]) for at in range(lex.start[i], lex.start[i] + lex.length[i])] for i in ids]


def test_rows_are_added_by_any_index():
    rng = np.random.default_rng(7)
    for most in (3, 40, 1 << 21, 1 << 30):  # of 32 bits and beyond, with the place in the batch
        index, rows = rng.integers(0, most, 3000).astype(np.int32), rng.normal(0, 1, (3000, 16)).astype(np.float32)
        index[:5] = most - 1
        at, times, total = lm_score.added(index, rows)
        want, n = np.unique(index, return_counts=True)
        assert at.tolist() == want.tolist() and times.tolist() == n.tolist()
        assert total == pytest.approx(np.array([rows[index == i].sum(axis=0) for i in want]), abs=1e-3)
