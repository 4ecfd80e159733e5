"""Phrase collocations: n-grams of distinct pieces, counted by hash bucket in DuckDB.

Equal pieces of text become one row with a multiplicity. Every partition of them
counts its own n-grams and sends each, once, to the hash bucket of its text, where
DuckDB adds the parts up, out of core where a bucket is large. Words and pairs are
counted first; a longer phrase can only be frequent if all its pairs are, so the
second pass sends no phrase that a bit table of the frequent pairs rules out.

A phrase is scored by the counts of its parts, which lie in other buckets: it sends
a request for each part to the part's bucket, and the answers come back to it.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.common import discard, materialize, settled, ship, small_batches
from sheafline.scratch import scratch_path

ship(__name__)

#: Characters of pieces whose n-grams are counted together, words for each hash bucket, and hash buckets at most.
CHARS, BUCKET_WORDS, BUCKETS = 3_000_000, 1 << 21, 1 << 13
#: Bits of the table of frequent pairs (8 MB), whatever their number is.
PAIR_BITS = 1 << 26
#: What DuckDB may hold in memory for a bucket, in MB.
BUCKET_MB = 192
#: Parts into which the requests for one word and the rows of one language are dealt.
SALTS = 16

PARTS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
COUNTS = "lang string, gram string, f long"


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): each distinct piece of a language, its words joined by one space, and how often it occurs.

    A-Z is lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at blanks and tabs. Pieces without a word go.
    """
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz ")
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, "[.,;:!?\\x0A-\\x0D]+")).alias("piece"))
    cut = cut.select("lang", F.trim(F.regexp_replace("piece", " {2,}", " ")).alias("piece")).where("piece <> ''")
    return cut.groupBy("lang", "piece").agg(F.count("*").alias("n"))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a followed by b, from their hashes."""
    h = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    start = lang.encode() + b"\0"
    return np.array([xxhash.xxh3_64_intdigest(start + w.encode()) for w in words], np.uint64)


class Grams:
    """The n-grams of one language's pieces: words as numbers, with the piece and the weight of each place."""

    def __init__(self, lang: str, pieces: pa.Array, n: np.ndarray):
        lists = pc.split_pattern(pieces, " ")
        coded = lists.flatten().dictionary_encode()
        lengths = np.diff(lists.offsets.to_numpy())
        self.lang, self.words, self.ids = lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.weights, self.left = np.repeat(n, lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.ids))
        self.hashes = word_hashes(lang, self.words.to_pylist())

    def level(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts the n-grams at places `at`, each a known shorter one (number `first`) and a word (number `last`).

        Returns the number of each place's n-gram, and for each distinct one its first, its last and its count.
        """
        key, of = np.unique(first * len(self.words) + last, return_inverse=True)
        counts = np.zeros(len(key), np.int64)
        np.add.at(counts, of, self.weights[at])
        return of, key // len(self.words), key % len(self.words), counts

    def short(self):
        """(texts, hashes, counts) of all words, and of all pairs; and the number of words under the empty text."""
        counts = np.zeros(len(self.words), np.int64)
        np.add.at(counts, self.ids, self.weights)
        yield pa.array([""], pa.string()), np.zeros(1, np.uint64), np.array([self.weights.sum()])
        yield self.words, self.hashes, counts
        at = np.flatnonzero(self.left > 1)
        _, a, b, counts = self.level(at, self.ids[at], self.ids[at + 1])
        yield pc.binary_join_element_wise(self.words.take(a), self.words.take(b), " "), mixed(self.hashes[a], self.hashes[b]), counts

    def long(self, bits: np.ndarray, words: int):
        """The same of the phrases of 3 to `words` words whose pairs all are in the bit table."""
        at = np.flatnonzero(self.left > 1)
        of, a, b, _ = self.level(at, self.ids[at], self.ids[at + 1])
        slot = mixed(self.hashes[a], self.hashes[b]) % np.uint64(PAIR_BITS)
        good = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        number = np.full(len(self.ids) + 1, -1, np.int64)  # of the n-gram at a place, -1 where it is none or cannot be frequent
        number[at] = np.where(good[of], of, -1)
        fine = number >= 0
        texts, hashes = pc.binary_join_element_wise(self.words.take(a), self.words.take(b), " "), mixed(self.hashes[a], self.hashes[b])
        for size in range(3, words + 1):
            at = np.flatnonzero((number[:-1] >= 0) & (self.left >= size))
            at = at[fine[at + size - 2]]
            of, a, b, counts = self.level(at, number[at], self.ids[at + size - 1])
            texts = pc.binary_join_element_wise(texts.take(a), self.words.take(b), " ")
            hashes = mixed(hashes[a], self.hashes[b])
            yield texts, hashes, counts
            number[:] = -1
            number[at] = of


def packed(made, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, its rows as a compressed Arrow stream) of (lang, texts, hashes, counts)."""
    parts = [(lang, texts.cast(pa.string()), hashes, counts) for lang, texts, hashes, counts in made if len(counts)]
    if not parts:
        return []
    lang = pa.concat_arrays([pa.repeat(pa.scalar(p[0], pa.string()), len(p[3])) for p in parts])
    table = pa.table([lang, pa.concat_arrays([p[1] for p in parts]), pa.array(np.concatenate([p[3] for p in parts]))], schema=PARTS)
    bucket = (np.concatenate([p[2] for p in parts]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    table, bucket = table.take(pa.array(order)).combine_chunks(), bucket[order]
    cut, rows = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), []
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        out = io.BytesIO()
        with pa.ipc.new_stream(out, PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table.slice(a, b - a))
        rows.append((int(bucket[a]), out.getvalue()))
    return rows


def counted(pieces: DataFrame, buckets: int, least: int, make, folder: str | None) -> DataFrame:
    """(lang, gram, f) of the n-grams that make(Grams) yields of all pieces and that occur `least` times or more."""

    def emit(batches):
        held, chars = [], 0

        def flush():
            table, made = pa.Table.from_batches(held).combine_chunks(), []
            for lang in pc.unique(table["lang"]).to_pylist():
                of = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
                grams = Grams(lang, of["piece"].combine_chunks(), of["n"].to_numpy())
                made += [(lang, *part) for part in make(grams)]
            rows = packed(made, buckets)
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "part"])

        for batch in batches:
            held.append(batch)
            chars += pc.sum(pc.binary_length(batch["piece"])).as_py() or 0
            if chars >= CHARS:
                yield flush()
                held, chars = [], 0
        if held:
            yield flush()

    def add_up(batches):
        spill = folder and f"{folder}/{uuid.uuid4().hex}"
        if spill:
            os.makedirs(spill)
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{BUCKET_MB}MB", "preserve_insertion_order": False} | ({"temp_directory": spill} if spill else {}))
        try:
            con.execute("CREATE TABLE parts (lang VARCHAR, gram VARCHAR, n BIGINT)")
            for batch in batches:
                for part in batch["part"]:
                    rows = pa.ipc.open_stream(part.as_buffer()).read_all()  # noqa: F841  DuckDB finds it by its name
                    con.execute("INSERT INTO parts SELECT * FROM rows")
            found = con.sql(f"SELECT lang, gram, sum(n)::BIGINT AS f FROM parts GROUP BY lang, gram HAVING f >= {least} OR gram = ''")
            yield from found.to_arrow_reader(100_000)
        finally:
            con.close()
            if spill:
                shutil.rmtree(spill, ignore_errors=True)

    # A bucket is one task's; a partition may hold several.
    return small_batches(pieces).mapInArrow(emit, "bucket int, part binary").repartition(buckets, "bucket").mapInArrow(add_up, COUNTS)


def spill_folder(df: DataFrame) -> str | None:
    """Where DuckDB may put what memory does not hold: a scratch folder in the shared one, if that is a mounted path."""
    found = scratch_path(df.sparkSession, "-duckdb").removeprefix("file:").replace("//", "/")
    return found if found.startswith("/") else None


def pair_bits(pairs: DataFrame) -> np.ndarray:
    """The bit table of (lang, gram) rows of two words each; PAIR_BITS bits reach the driver, however many rows there are."""

    def slots(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(table["lang"]).to_pylist():
                of = [g.split(" ") for g in table.filter(pc.equal(table["lang"], lang))["gram"].to_pylist()]
                slot = mixed(word_hashes(lang, [a for a, _ in of]), word_hashes(lang, [b for _, b in of])) % np.uint64(PAIR_BITS)
                yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array(np.uint64(1) << (slot & np.uint64(63))).view(pa.int64())], ["word", "bit"])

    made = pairs.mapInArrow(slots, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(PAIR_BITS // 64, np.int64)
    table[made["word"].to_numpy()] = made["bits"].to_numpy()
    return table.view(np.uint8)


def part(gram: Column, first: Column | int, count: Column | int) -> Column:
    """`count` words of a phrase from word number `first` (from 1) on."""
    return F.array_join(F.slice(F.split(gram, " "), first, count), " ")


def phrase_counts(docs: DataFrame, least: int = 30, words: int = 4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, f, size): every phrase of 1 to `words` words that occurs `least` times or more within pieces of its language.

    The row of the empty phrase (size 0) has the number of all words of the language.
    """
    pieces = materialize(pieces_of(docs, text_col, lang_col))
    total = pieces.agg(F.sum(F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1)).first()[0] or 0
    buckets = min(BUCKETS, total // BUCKET_WORDS + 1)
    spill = spill_folder(docs)
    short = materialize(counted(pieces, buckets, least, lambda g: g.short(), spill))
    bits = docs.sparkSession.sparkContext.broadcast(pair_bits(short.where("gram LIKE '% %'")))
    long = materialize(counted(pieces, buckets, least, lambda g: g.long(bits.value, words), spill))
    discard(pieces)
    size = F.when(F.col("gram") == "", 0).otherwise(F.length("gram") - F.length(F.replace("gram", F.lit(" "))) + 1)
    return short.unionByName(long).withColumn("size", size.cast("int"))


def answered(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """requests (lang, part, ...) with the count f of each part, whose bucket they are sent to.

    Single words are few and may be asked for by a great many phrases: requests for a word are dealt
    into SALTS parts, and the word's count is sent to each.
    """
    salts = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = counts.where("size > 0").select("lang", F.col("gram").alias("part"), "f", F.explode(salts).alias("salt"))
    salt = F.when(F.instr("part", " ") == 0, F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int")).otherwise(0)
    return requests.withColumn("salt", salt).join(held.hint("shuffle_merge"), ["lang", "part", "salt"]).drop("salt")


def collocations(docs: DataFrame, least: int = 30, words: int = 4, top: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of 2 to `words` words of each language by the weakest tie between their parts.

    Of a phrase that occurs a >= least times, each cut into two parts of l and r occurrences has the
    score floor(2000000 * a / (l + r)); the lowest counts, ties to the shortest first part. Phrases go
    whose words lie inside a longer one that is at least `share` percent as frequent, be it kept or not.
    Best first; ties by a, then by the bytes of the phrase.

    Null texts are empty and have no words; a null language is `und`. Repeated rows count as often as
    they stand. Other columns are not read. An empty table gives no rows.

    Returns lang, rank, phrase, a, l, r, n (all words of the language), score.
    """
    counts = settled(docs.sparkSession, lambda: phrase_counts(docs, least, words, text_col, lang_col))
    grams = counts.where("size >= 2").select("lang", "gram", "f", "size")

    cut = grams.select("lang", "gram", "f", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), part(F.col("gram"), 1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("gram"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    asked = cut.select("lang", "gram", F.col("f").alias("a"), "k", F.explode(sides).alias("p")).select("lang", "gram", "a", "k", "p.side", "p.part")
    got = answered(asked, counts).groupBy("lang", "gram", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in "lr"))
    score = F.expr("(2000000BD * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    scored = got.groupBy("lang", "gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # What lies inside longer phrases, with the most frequent of these.
    width = F.explode(F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), i -> named_struct('i', i, 'w', w))))")).alias("s")
    inner = grams.where("size > 2").select("lang", "f", "gram", width)
    inner = inner.select("lang", part(F.col("gram"), F.col("s.i"), F.col("s.w")).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    held = F.expr(f"100BD * CAST(longer AS DECIMAL(19, 0)) >= {int(share)}BD * CAST(a AS DECIMAL(19, 0))")
    free = scored.join(inner, ["lang", "gram"], "left").where(F.col("longer").isNull() | ~held)

    # The first of each part of a language, then of the language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("gram")]
    rows = free.select("lang", "gram", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).alias("salt"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return rows.join(n, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
