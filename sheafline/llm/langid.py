"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows per partition and sums
the counts by language; the log-probability matrix (languages x features, a size set
by parameters) is broadcast. Scoring hashes a batch of texts in one numpy pass and
adds up the matrix rows of each text's n-grams.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import ship, small_batches

ship(__name__)

#: Features, n-gram lengths, added count, labelled rows to learn from for each language, and characters hashed in one go.
FEATURES, LENGTHS, ALPHA, ROWS, CHARS = 1 << 15, (1, 2, 3), 0.1, 3000, 500_000
#: Bytes of a model at most, as it is broadcast: 2048 languages of FEATURES. More labels are an error, never a choice among them.
MODEL_BYTES = 256 << 20
#: Languages that are scored in one go.
BLOCK = 16
UNKNOWN = "und"
#: keep_known() rejects a text whose likeliest language is less likely than all others together.
LEAST_SCORE = 0.5


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode category L."""
    return bool(text) and any(map(str.isalpha, text))


def framed(text: str) -> str:
    """What a text's n-grams are taken from: all of it in lower case, between two spaces."""
    return f" {text.lower()} "


def hashed(lines: list[str], own: list[int], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The feature of every n-gram that starts in the first own[k] characters of line k.

    n-grams do not reach from line to line. The result is flat: line k has
    features[starts[k]:starts[k + 1]].
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in lines])
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(codes)) - np.repeat(begin, sizes)
    left = np.repeat(sizes, sizes) - at  # characters to the line's end
    counts = at < np.repeat(own, sizes)
    mixed, every = np.zeros(len(codes), np.uint32), []
    for n in range(1, max(LENGTHS) + 1):
        end = len(codes) - n + 1
        mixed = (mixed[:end] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if n in LENGTHS:
            spot = np.zeros(len(codes), np.int32)
            spot[:end] = ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(8)) % np.uint32(features)
            every.append(np.where(counts & (left >= n), spot, -1))
    table = np.stack(every, axis=1)
    real = table >= 0
    starts = np.r_[0, np.cumsum(np.add.reduceat(real.sum(axis=1), begin))] if len(lines) else np.zeros(1, np.int64)
    return table[real], starts


def runs(texts: list[str], chars: int = CHARS):
    start = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(line: str, chars: int = CHARS):
    """(part, own) of a line: own is how many characters n-grams start in, the rest is where they end.

    The n-grams of all parts are exactly those of the line.
    """
    return [(line[k : k + chars + max(LENGTHS) - 1], min(chars, len(line) - k)) for k in range(0, len(line), chars)]


class Model:
    """languages: sorted names; logp: features x languages; prior: log-probabilities."""

    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray):
        self.languages, self.logp, self.prior = languages, logp, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log-probabilities, a row for each text."""
        found = np.zeros((len(texts), len(self.languages)))
        for a, b in runs(texts):
            part = [(k, *p) for k in range(a, b) for p in pieces(framed(texts[k]))]
            for c in range(0, len(part), 1 << 12):
                rows = part[c : c + (1 << 12)]
                spots, starts = hashed([x for _, x, _ in rows], [n for _, _, n in rows], len(self.logp))
                of = [k for k, _, _ in rows]
                for first in range(0, len(self.languages), BLOCK):
                    block = slice(first, first + BLOCK)
                    np.add.at(found[:, block], of, np.add.reduceat(self.logp[:, block][spots], starts[:-1], axis=0, dtype=np.float64))
        return found + self.prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior probability; ties go to the first by name."""
        real = [k for k, t in enumerate(texts) if has_letter(t)]
        names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if real and self.languages:
            joint = self.scores([texts[k] for k in real])
            best = joint.argmax(axis=1)
            odds = np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
            for k, i, s in zip(real, best, 1 / odds):
                names[k], sure[k] = self.languages[i], s
        return names, sure


def sampled(labelled: DataFrame, rows: int = ROWS, seed: int = 11, languages: int = MODEL_BYTES // (4 * FEATURES)) -> DataFrame:
    """(text, lang): about `rows` of each language of (doc_id, text, lang) rows; an error beyond so many languages.

    Rows are drawn by a seeded hash of their id, so copies of a text count as often as they
    are drawn and no group of copies is in or out as a whole. Rows without an id are drawn by
    their text and their place in the table.
    """
    labelled = labelled.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    found = sizes.count()
    if found > languages:
        raise ValueError(f"{found} languages of {languages} that a model holds: train with fewer features, or raise MODEL_BYTES")
    draw = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    place = labelled.withColumn("place", F.monotonically_increasing_id())
    drawn = F.when(F.col("doc_id").isNull(), draw(F.col("text"), F.col("place"))).otherwise(draw(F.col("doc_id").cast("string")))
    return place.join(F.broadcast(sizes), "lang").where(drawn * F.col("n") < rows).select("text", "lang")


def train(labelled: DataFrame, rows: int = ROWS, features: int = FEATURES, seed: int = 11) -> Model:
    """A model of (doc_id, text, lang) rows, whole texts, learned from what sampled() draws.

    Rows with a null lang or no letter teach nothing. Every other label is learned; if
    languages x features pass MODEL_BYTES, that is an error. Priors are uniform.
    """
    picked = sampled(labelled, rows, seed, MODEL_BYTES // (4 * features))

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if has_letter(text):
                    for part, own in pieces(framed(text)):
                        spots, _ = hashed([part], [own], features)
                        tables.setdefault(lang, np.zeros(features, np.int64))
                        tables[lang] += np.bincount(spots, minlength=features)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "feature": at.astype(np.int32), "n": table[at]})

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """A language's log-probabilities; a language has `features` rows at most."""
        counts = np.full(features, ALPHA)
        counts[pdf["feature"]] += pdf["n"]
        return pd.DataFrame({"lang": [key[0]], "logp": [(np.log(counts) - np.log(counts.sum())).astype("<f4").tobytes()]})

    sums = small_batches(picked).mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # What reaches the driver is the model itself, a row of bytes for each language.
    packed = sorted((r.lang, r.logp) for r in sums.groupBy("lang").applyInPandas(pack, "lang string, logp binary").collect())
    languages = [lang for lang, _ in packed]
    logp = np.stack([np.frombuffer(bytes(x), "<f4") for _, x in packed], axis=1) if packed else np.zeros((features, 0), np.float32)
    return Model(languages, np.ascontiguousarray(logp), np.full(len(languages), -np.log(max(1, len(languages)))))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing may be learned from: crc32 of the id as text, mod 4, is 2. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every text
    under a model that has learned nothing. Repeated rows give repeated rows; other
    columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.prior))
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def run(batches):
        own = Model(*shared.value)
        for pdf in batches:
            names, sure = own.predict(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": names, "score": sure})

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is known, all columns unchanged, without a shuffle.

    Known is a text with a letter whose likeliest language has a posterior of `least` or
    more; under a model that has learned nothing, every text with a letter. Null texts
    go; an empty table stays empty; ids play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.prior))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        if not own.languages:
            return texts.map(has_letter).astype(bool)
        names, sure = own.predict(list(texts))
        return pd.Series([n != UNKNOWN and s >= least for n, s in zip(names, sure)], dtype=bool)

    return small_batches(docs).where(known("text"))
