import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafline.llm import bpe, langid, lm_score
from sheafline.llm.queries import QUERIES

SF, VOCABULARY = "/root/testdata/sf0.001", public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoding_equals_the_library(encoder, library):
    rng = random.Random(1)
    letters = "abcdeéèß ÄÖ  \n\t'sdmtll123½中文字<|endoftext|>\r "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 5000, "x" * 5000 + "y", "x" * 70, "ab" * 40 + "é" * 300, " " * 3000, "\U0001f600" * 40, "a" * 70 + " " + "b" * 64]
    mine = encoder.encode_many(texts)
    assert mine == [as_bytes(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [encoder.decode(c).decode() for c in mine] == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts] == texts


def test_code_points_are_split_as_the_library_splits_them(encoder, library):
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}? {chr(c)}" for c in range(0, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    assert encoder.encode_many(texts) == [as_bytes(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_query_on_all_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, SF).collect()}
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(as_bytes(ids)).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "The cat and the dog " * 9000), (4, "The cat and the dog " * 9000), (None, "le chat et le chien"), (5, "é")]
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, held_out string, n_tokens int, score double")


def test_encode_odd_cases_and_back(spark):
    df = odd_documents(spark)
    got = bpe.encode(df, VOCABULARY)
    assert sorted(r.n_tokens for r in got.collect())[:2] == [0, 0]
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(got, VOCABULARY).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in df.collect())
    assert bpe.encode(df.limit(0), VOCABULARY).collect() == []


def ngrams(text, features=langid.FEATURES):
    """The features of a whole text, one n-gram at a time."""
    line, out = [ord(c) for c in f" {text.lower()} "], []
    for k in range(len(line)):
        mixed = 0
        for n in (1, 2, 3):
            if k + n > len(line):
                break
            mixed = (mixed ^ line[k + n - 1]) * 0x9E3779B1 & 0xFFFFFFFF
            mixed ^= mixed >> 15
            out.append((mixed * 0x85EBCA6B & 0xFFFFFFFF) >> 8)
    return sorted(x % features for x in out)


def test_ngrams_match_loops():
    texts = ["Ab c", "", "é", "xyxy", "ΑΣ", "\U0001f600 İ"]
    lines = [langid.framed(t) for t in texts]
    flat, starts = langid.hashed(lines, [len(x) for x in lines])
    assert [sorted(flat[a:b].tolist()) for a, b in zip(starts, starts[1:])] == [ngrams(t) for t in texts]


def test_ngrams_of_a_long_text_are_those_of_its_parts():
    rng = random.Random(3)
    text = "".join(rng.choice("abc É\nΣß") for _ in range(600_000))
    parts = langid.pieces(langid.framed(text))
    got = np.concatenate([langid.hashed([x], [n])[0] for x, n in parts])
    line = langid.framed(text)
    assert len(list(parts)) == 2 and sorted(got.tolist()) == sorted(langid.hashed([line], [len(line)])[0].tolist())
    short = "ab cde f" * 3
    for chars in (1, 2, 3, 7):
        got = np.concatenate([langid.hashed([x], [n])[0] for x, n in langid.pieces(langid.framed(short), chars)])
        assert sorted(got.tolist()) == ngrams(short)


def test_training_matches_loops(spark):
    rng = random.Random(5)
    rows = [(k if k % 7 else None, " ".join(rng.choice(["the", "le", "and", "et", "12", "É"]) for _ in range(k % 5)) or None, rng.choice(["en", "fr", None])) for k in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n int").repartition(3)
    want = {x: np.zeros(512) for x in ("en", "fr")}
    for _, text, lang in rows:
        if lang and text and any(map(str.isalpha, text)):
            for f in ngrams(text, 512):
                want[lang][f] += 1
    model = langid.train(df, rows=10**6, features=512)
    assert model.languages == ["en", "fr"]
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.logp[:, k], np.log((want[lang] + langid.ALPHA) / (want[lang] + langid.ALPHA).sum()), atol=1e-5)


def test_the_sample_is_bounded_and_never_empty(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a copy', CAST(id AS STRING)) AS text", "IF(id < 19000, 'en', 'fr') AS lang")
    got = {r.lang: r["count"] for r in langid.sampled(df, rows=900).groupBy("lang").count().collect()}
    assert 750 < got["en"] < 1050 and 750 < got["fr"] <= 1000
    copies = langid.sampled(df, rows=900).where("text = 'a copy'").count()
    assert 400 < copies < 800  # as many as a third of the rows are
    with pytest.raises(ValueError, match="2 languages of 1"):
        langid.sampled(df, rows=900, languages=1)
    unnamed = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert 400 < langid.sampled(unnamed, rows=900).where("text = 'a copy'").count() < 800  # not all copies or none
    assert langid.sampled(df.limit(0)).collect() == []


def test_more_labels_than_512_are_all_learned(spark):
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03d}")
    rows = [(k * 3 + j, f"{name(k)} {name(k)}{name(k)} " * 3, f"x{k:03d}") for k in range(513) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df, features=1 << 12)
    assert len(model.languages) == 513
    got = langid.identify(spark.createDataFrame([(k, name(k) * 2) for k in range(0, 513, 8)], "doc_id long, text string"), model).collect()
    assert np.mean([r.lang_pred == f"x{r.doc_id:03d}" for r in got]) > 0.9


def test_language_scores_match_loops():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], np.log(rng.random((langid.FEATURES, 2))).astype(np.float32), np.log([0.5, 0.5]))
    texts = ["Hello there", "so", "äöü ß " * 500]
    want = [[sum(float(model.logp[s, k]) for s in ngrams(t)) + np.log(0.5) for k in (0, 1)] for t in texts]
    assert np.allclose(model.scores(texts), want, rtol=1e-6)
    names, sure = model.predict([None, "", "12", *texts])
    assert names[:3] == ["und"] * 3 and all(0 <= s <= 1 for s in sure)
    assert names[3:] == ["ab"[int(np.argmax(w))] for w in want]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_langid"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
    assert len(held) > 20 and np.mean(held) > 0.97


def test_language_odd_cases(spark):
    df = odd_documents(spark)
    taught = spark.createDataFrame([(1, "the cat", "en"), (None, "le chat", "fr"), (3, None, "de"), (4, "x", None), (5, "1", "es")], "doc_id long, text string, lang string")
    model = langid.train(taught)
    assert model.languages == ["en", "fr"]
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(df, model).collect())
    assert got[:3] == [("1", "und"), ("2", "und"), ("3", "und")] and got[3] == got[4] == ("4", "en") and ("None", "fr") in got
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.train(taught.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert sorted(str(r.doc_id) for r in langid.keep_known(df, model).collect()) == ["4", "4", "5", "None"]
    assert sorted(str(r.doc_id) for r in langid.keep_known(df, nothing).collect()) == ["4", "4", "5", "None"]
    even = langid.Model(["a", "b", "c"], np.zeros((langid.FEATURES, 3), np.float32), np.log([0.4, 0.3, 0.3]))
    assert langid.keep_known(df, even).collect() == [] and langid.keep_known(df, even, least=0.3).count() == 4
    assert langid.keep_known(df, model).columns == df.columns and langid.keep_known(df.limit(0), model).collect() == []


def test_scores_match_loops(spark):
    known = ["the", "cat"]
    weights = lm_score.initial(np.arange(lm_score.PAD, dtype=float), 3)
    w = {k: v.astype(np.float64) for k, v in lm_score.unpack(weights).items()}

    vectors = lm_score.no_words().vectors.astype(np.float64)

    def plain(text):
        ids = [known.index(x) if x in known else lm_score.KNOWN + zlib.crc32(x.encode()) % lm_score.SHARED for x in (text or "").lower().split()]
        total = 0.0
        for k, token in enumerate(ids):
            near = [ids[k + d] if 0 <= k + d < len(ids) else lm_score.PAD for d in lm_score.WINDOW]
            h = np.tanh(sum(vectors[n] @ w["mix"][j] for j, n in enumerate(near)) + w["bias"])
            h[-1] = 1.0
            z = h @ w["last"]
            total += z[token] - np.log(np.exp(z).sum())
        return len(ids), total

    df = spark.createDataFrame([(1, "The cat sat on the cat"), (2, None), (3, "cat"), (4, " \n"), (None, "a b c " * 500)], "doc_id long, text string")
    for r in lm_score.score(df, known, weights).collect():
        text = {1: "The cat sat on the cat", 3: "cat", None: "a b c " * 500}.get(r.doc_id)
        n, total = plain(text)
        assert r.n_tokens == n and r.log_score == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert r.mean_log_score is None if n == 0 else r.mean_log_score == pytest.approx(total / n, rel=1e-4)
    assert lm_score.score(df.limit(0), known, weights).collect() == []


def test_training_helps_and_counts_all_documents(spark):
    rng = random.Random(2)
    pairs = [("red", "rose"), ("blue", "sky"), ("green", "grass"), ("white", "snow")]
    texts = [" ".join(x for _ in range(60) for x in rng.choice(pairs)) for _ in range(120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    known, frequency = lm_score.vocabulary(df)
    assert frequency.sum() == sum(len(t.split()) for t in texts) and set(known) == {w for p in pairs for w in p}
    mean = lambda w: np.mean([r.mean_log_score for r in lm_score.score(df, known, w).collect()])
    before = mean(lm_score.initial(frequency, 13))
    assert mean(lm_score.train(df, known, frequency, rounds=3, stride=2)) > before + 0.5
    empty = lm_score.pseudo_likelihood(df.limit(0))
    assert empty.collect() == []
