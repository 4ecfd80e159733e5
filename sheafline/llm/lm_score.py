"""Masked pseudo-likelihood of documents under a small bidirectional window network.

The network predicts every word from the words on both its sides; a document's score
is the sum of the conditional log-probabilities of all its words. The softmax has three
levels: a token (the most frequent words have one each, the others share some by hash),
then a word among those that share the token, down a Huffman tree with a learned vector
at each fork. Every word that occurs often enough for the size of the corpus is a leaf
and has a vector of its own as context. The rarer words of a token are one leaf; below
it each has a share by how often the words of its hash slot occur, and a word that was
never seen has one too.

Vocabulary and frequencies are counted over all documents. Training is data parallel:
documents are dealt into groups by a hash of their id and words, each group starts from the shared
weights and passes over the positions of all its documents (each is a target once in
all passes), and the groups' weights are averaged by the positions behind them, a word's
or fork's own vector by the positions that it took part in. Groups and their order do
not depend on how the table is partitioned, so neither do the weights.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import sys
import types
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import discard, materialize, ship, small_batches

ship(__name__)

#: Words with a token of their own, tokens that other words share by hash, and characters from which on a word goes by its digest.
KNOWN, SHARED, LONGEST = 64, 64, 64
#: Hash slots of rare words: with the vocabulary, the bound of what is broadcast. A multiple of SHARED.
SLOTS = 1 << 21
#: A word is a leaf of its own if it occurs LEAST times and (words in the corpus) ** (2 / 3) / PER_CUBE times, so that
#: there are PER_CUBE * (words in the corpus) ** (1 / 3) such words at most.
LEAST, PER_CUBE = 2, 1300
#: Offsets of the window, width of a word's vector, hidden width: the last hidden value is the constant one.
WINDOW, WIDTH, HIDDEN = (-2, -1, 1, 2), 16, 16
#: Passes; each trains on every STRIDE-th position of all documents, from an offset of its own: together on all.
ROUNDS, STRIDE, BATCH, RATE = 2, 2, 256, 0.2
#: Positions of a group, about, positions held before they are trained on, and groups that are averaged in one go.
GROUP, HELD, AVERAGED = 1 << 23, 1 << 16, 64
#: Groups, and their files, at most. Beyond 3e10 words groups grow; one of more bytes than a row group is trained in pieces, each as
#: a group of its own.
GROUPS, PIECE = 1 << 12, 1 << 27
#: Batches of BATCH positions before batches are LARGER times as large, and rows of own vectors that are averaged in one go.
SMALL, LARGER, BLOCK = 64, 16, 1024
#: Words remembered by a worker, distinct words counted before they are sent on, positions scored in one go, rows in a frame, positions held at once.
WORDS, COUNTED, CHUNK, ROWS_OUT, POSITIONS = 400_000, 400_000, 4096, 5000, 200_000
PAD = KNOWN + SHARED


class Ids(dict):
    """The id of every word: frequent words are entries, the rest is hashed and remembered.

    slots: where the ids of hash slots begin; None gives rare words their shared token.
    """

    def __init__(self, entries, slots: int | None):
        super().__init__(entries)
        self.slots, self.room = slots, WORDS

    def __missing__(self, word: str) -> int:
        token = shared_token(word) if self.slots is None else self.slots + slot_of(word)
        if self.room > 0:
            self.room -= 1
            self[word] = token
        return token


def slot_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS


def shared_token(word: str) -> int:
    return KNOWN + slot_of(word) % SHARED


def words(text: str | None) -> list[str]:
    """A text's words in lower case; in place of a word of over LONGEST characters its digest, which no other word has."""
    out = (text or "").lower().split()
    if max(map(len, out), default=0) > LONGEST:
        out = [w if len(w) <= LONGEST else "\0" + hashlib.sha1(w.encode("utf-8", "surrogatepass")).hexdigest() for w in out]
    return out


def shapes() -> dict[str, tuple[int, ...]]:
    return {"mix": (len(WINDOW), WIDTH, HIDDEN), "bias": (HIDDEN,), "last": (HIDDEN, PAD)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(frequency: np.ndarray, seed: int) -> np.ndarray:
    """Small seeded weights; the output starts from the tokens' frequencies in the corpus.

    Nothing is mixed into the last hidden value, which is one: its slope there is zero.
    """
    rng = np.random.default_rng(seed)
    share = (frequency + 1.0) / (frequency + 1.0).sum()
    parts = {"mix": rng.normal(0, 0.3, shapes()["mix"]), "bias": np.zeros(HIDDEN), "last": np.vstack([rng.normal(0, 0.1, (HIDDEN - 1, PAD)), np.log(share)])}
    parts["mix"][:, :, -1] = 0
    return np.concatenate([np.ravel(parts[name]) for name in shapes()]).astype(np.float32)


@dataclass
class Lexicon:
    """The words below the tokens. Ids below PAD are tokens, PAD stands between documents, words follow, then hash slots.

    By id without slots: `token`, and where the path to the id's leaf stands in `fork`
    and `side` (1 or -1): from `start`, `length` entries. A token that is shared is as an
    id the leaf of its rarer words; `share` (log) is what a word of each slot has of that
    leaf. Trained: `vectors` of all ids as context, and `forks`, whose last column is a bias.
    """

    words: list[str]
    token: np.ndarray
    share: np.ndarray
    start: np.ndarray
    length: np.ndarray
    fork: np.ndarray
    side: np.ndarray
    vectors: np.ndarray
    forks: np.ndarray

    def plain(self) -> dict:
        """What workers need, without the class: a broadcast is read where this module may be missing."""
        return {**vars(self), "words": []}

    def leaf_ids(self, ids: np.ndarray) -> np.ndarray:
        """ids with the shared token in place of each slot."""
        first = len(self.token)
        return np.where(ids >= first, KNOWN + (ids - first) % SHARED, ids)

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """The log of a word's share of its leaf: 0 for words that are leaves."""
        out, slot = np.zeros(len(ids)), ids - len(self.token)
        rare = slot >= 0
        out[rare] = self.share[slot[rare]]
        return out

    def longest_first(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of ids by falling length of the paths to their leaves, and how many have a first step, a second and so on."""
        length = self.length.take(ids)
        return np.argsort(-length.astype(np.int16), kind="stable"), len(ids) - np.cumsum(np.bincount(length))[:-1]

    def paths(self, ids: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fork and side of every step to the leaves of ids, which are in that order: first steps of all, then second ones and so on."""
        start = self.start.take(ids)
        at = np.concatenate([start[:0], *(start[:m] + k for k, m in enumerate(reach))])
        return self.fork.take(at), self.side.take(at)


def slot_shares(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The log of the share that a word of each slot has among the rare words of its token.

    n, kinds: by slot, how often its rare words occur and how many they are. All slots of
    a token have one occurrence more between them, and each slot has room for one word more.
    """
    each = SHARED / SLOTS
    rest = n.reshape(-1, SHARED).sum(axis=0) + 1.0
    return (np.log(n + each) - np.log(np.tile(rest, len(n) // SHARED)) - np.log(kinds + 1.0)).astype(np.float32)


def lexicon(words_: list[str], counts: np.ndarray, n: np.ndarray, kinds: np.ndarray, seed: int = 13) -> Lexicon:
    """Huffman trees over the words of each shared token. n, kinds: as for slot_shares().

    Vectors start as seeded ones by token, forks from the counts on both their sides.
    """
    size = PAD + 1 + len(words_)
    token = np.r_[np.arange(PAD + 1), np.array([shared_token(w) for w in words_], np.int64)].astype(np.int32)
    weight = np.zeros(size)
    weight[KNOWN:PAD] = n.reshape(-1, SHARED).sum(axis=0) + 1.0
    weight[PAD + 1 :] = counts
    share = slot_shares(n, kinds)
    # A parent for each leaf (by id) and fork (behind them); the side is 1 for the second child.
    up, side, bias = np.full(size + len(words_), -1), np.zeros(size + len(words_), np.float32), np.zeros(len(words_), np.float32)
    members: dict[int, list[int]] = {}
    for k in range(PAD + 1, size):
        members.setdefault(int(token[k]), []).append(k)
    made = 0
    for shared, leaves in sorted(members.items()):
        heap = [(float(weight[k]), k) for k in (shared, *leaves)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (low, a), (high, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[[a, b]], side[a], side[b], bias[made] = made, -1, 1, math.log(high / low)
            heapq.heappush(heap, (low + high, size + made))
            made += 1
    leaf, at, steps = np.arange(size), np.arange(size), []
    while True:
        stay = up[at] >= 0
        leaf, at = leaf[stay], at[stay]
        if not len(leaf):
            break
        steps.append((leaf, up[at], side[at]))
        at = up[at] + size
    leaf, fork, way = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 3
    order = np.argsort(leaf, kind="stable")
    length = np.bincount(leaf, minlength=size)
    forks = np.zeros((made, HIDDEN), np.float32)
    forks[:, -1] = bias[:made]
    vectors = np.random.default_rng(seed).normal(0, 0.3, (PAD + 1, WIDTH)).astype(np.float32)[token]
    return Lexicon(words_, token, share, np.cumsum(length) - length, length, fork[order].astype(np.int32), way[order].astype(np.float32), vectors, forks)


def no_words() -> Lexicon:
    """Tokens alone: words that share a token are not told apart."""
    return lexicon([], np.zeros(0), np.zeros(SLOTS), np.zeros(SLOTS))


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The window's tokens around positions of padded ids, a column for each offset."""
    return np.stack([ids[at + d] for d in WINDOW], axis=1)


def padded(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in one array with pads between documents, and where the tokens stand."""
    reach = max(map(abs, WINDOW))
    sizes = np.array([len(x) for x in lists], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(lists) + 1) * reach, sizes)
    ids = np.full(int(sizes.sum()) + reach * (len(lists) + 1), PAD, np.int32)
    if len(at):
        ids[at] = np.concatenate(lists)
    return ids, at


def log_probs(w: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, lex: Lexicon, tables: list[np.ndarray]) -> np.ndarray:
    """The log-probability of the word at each position, given its window. tables: lex.vectors times each mix."""
    out = lex.shares(ids[at])
    ids = lex.leaf_ids(ids)
    for k in range(0, len(at), CHUNK):
        order, reach = lex.longest_first(ids.take(at[k : k + CHUNK]))
        spot, part = at[k : k + CHUNK].take(order), np.zeros(len(order))
        h = tables[0].take(ids.take(spot + WINDOW[0]), axis=0)
        for table, d in zip(tables[1:], WINDOW[1:]):
            h += table.take(ids.take(spot + d), axis=0)
        h += w["bias"]
        np.tanh(h, out=h)
        h[:, -1] = 1
        target = ids.take(spot)
        fork, side = lex.paths(target, reach)
        if len(fork):
            cost = (lex.forks.take(fork, axis=0) * steps_of(h, reach)) @ np.ones(HIDDEN, h.dtype)
            cost *= -side
            np.exp(np.minimum(cost, 80, out=cost), out=cost)
            cost += 1  # what rounding takes here is as small as what it takes from h
            stack(part, np.log(cost, out=cost), reach)
        z = h @ w["last"]
        part -= z[np.arange(len(spot)), lex.token.take(target)]
        total, top = exponentials(z, w["last"])
        out[k + order] -= part + np.log(total) + top
    return out


def steps_of(rows: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The rows behind each step of paths(): the first reach[0], then the first reach[1] and so on."""
    return np.concatenate([rows[:0], *(rows[:m] for m in reach)])


def stack(out: np.ndarray, rows: np.ndarray, reach: np.ndarray) -> None:
    """Adds what each step of paths() gives to the row it belongs to."""
    done = 0
    for m in reach:
        out[:m] += rows[done : done + m]
        done += m


def exponentials(z: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(z) in place of z = h @ last, less a shift for each row, and the rows' sums and shifts."""
    # The hidden layer is within -1 and 1, which bounds z: a shift is seldom needed before exp.
    top = 0.0 if np.abs(last).sum(axis=0).max() < 60 else z.max(axis=1)
    if np.ndim(top):
        z -= top[:, None]
    return np.exp(z, out=z) @ np.ones(PAD, z.dtype), top


def added(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of index, how often each is there, and the sum of its rows (of even width)."""
    bits = len(index).bit_length()
    kind = np.uint32 if int(index.max()) >> (32 - bits) == 0 else np.int64  # half as wide sorts in a third of the time
    packed = np.sort(index.astype(kind) << bits | np.arange(len(index), dtype=kind))
    index, order = packed >> bits, packed & ((1 << bits) - 1)
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    return index[first], np.diff(np.r_[first, len(index)]), sums(rows.take(order, axis=0), first)


def sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of the stretches of rows that begin at first; two numbers are added at a time, as complex ones."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


class Learner:
    """Weights that one group trains: the network's and the lexicon's, steps as in Adagrad.

    Steps shrink for parameters that have moved much; a word or fork has one such sum.
    """

    def __init__(self, flat: np.ndarray, lex: Lexicon):
        self.flat, self.lex = flat.copy(), replace(lex, vectors=lex.vectors.copy(), forks=lex.forks.copy())
        self.w = unpack(self.flat)
        self.moved = {name: np.full(shape, 1e-2, np.float32) for name, shape in shapes().items()}
        self.rows_moved = {name: np.ones(len(getattr(lex, name)), np.float32) for name in ("vectors", "forks")}
        self.seen = {name: np.zeros(len(getattr(lex, name)), np.int64) for name in ("vectors", "forks")}

    def step(self, ids: np.ndarray, spot: np.ndarray) -> None:
        w, lex, n = self.w, self.lex, len(spot)
        order, reach = lex.longest_first(ids.take(spot))
        spot = spot.take(order)
        near = ids.take((spot[:, None] + np.array(WINDOW)).ravel())
        target = ids.take(spot)
        e = lex.vectors.take(near, axis=0).reshape(n, -1)
        mix = w["mix"].reshape(-1, HIDDEN)
        h = e @ mix
        h += w["bias"]
        np.tanh(h, out=h)
        h[:, -1] = 1
        p = h @ w["last"]
        # The softmax is p over its sum; the sum and the mean over n are put in where they cost least.
        total, _ = exponentials(p, w["last"])
        p[np.arange(n), lex.token.take(target)] -= total
        scale = (1 / (n * total))[:, None]
        dlast, dh = (p.T @ (h * scale)).T, (p @ w["last"].T) * scale
        fork, side = lex.paths(target, reach)
        if len(fork):
            below, hidden = lex.forks.take(fork, axis=0), steps_of(h, reach)
            slope = (below * hidden) @ np.ones(HIDDEN, h.dtype)
            slope = (-side / (1 + np.exp(np.minimum(side * slope, 80))))[:, None]
            below *= slope * np.float32(1 / n)
            hidden *= slope
            stack(dh, below, reach)
            self.row_step("forks", *added(fork, hidden))
        dh *= 1 - h * h  # zero for the last one
        index, times, g = added(near, (dh @ mix.T).reshape(-1, WIDTH))
        self.row_step("vectors", index, times, g * n)
        for name, g in (("mix", (e.T @ dh).reshape(w["mix"].shape)), ("bias", dh.sum(axis=0)), ("last", dlast)):
            self.moved[name] += g * g
            w[name] -= RATE * g / np.sqrt(self.moved[name])

    def row_step(self, name: str, at: np.ndarray, times: np.ndarray, g: np.ndarray) -> None:
        self.seen[name][at] += times
        moved = self.rows_moved[name].take(at) + np.einsum("td,td->t", g, g) / g.shape[1]
        self.rows_moved[name][at] = moved
        table = getattr(self.lex, name)
        table[at] = table.take(at, axis=0) - g * (np.float32(RATE) / np.sqrt(moved))[:, None]

    def parts(self, group: int, positions: int):
        """(name, block, part, at, n, w): the network's weights, and blocks of the rows that took part."""
        yield "net", 0, group, np.zeros(1, np.int32).tobytes(), np.array([positions]).tobytes(), self.flat.tobytes()
        for name, seen in self.seen.items():
            at = np.flatnonzero(seen)
            cut = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(at)]):
                part = at[a:b]
                yield name, int(part[0] // BLOCK), group, part.astype(np.int32).tobytes(), seen[part].tobytes(), getattr(self.lex, name)[part].tobytes()


PARTS = "name string, block int, part long, at binary, n binary, w binary"


def averaged(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block from several groups, averaged by what is behind them."""
    pdf = pdf.sort_values("part")  # sums come out alike however the rows arrive
    at = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["at"]])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["n"]])
    w = np.concatenate([np.frombuffer(x, np.float32).reshape(len(y) // 4, -1) for x, y in zip(pdf["w"], pdf["at"])])
    index, where = np.unique(at, return_inverse=True)
    total, mean = np.zeros(len(index), np.int64), np.zeros((len(index), w.shape[1]))
    np.add.at(total, where, n)
    np.add.at(mean, where, w * n[:, None].astype(np.float64))
    mean = (mean / total[:, None]).astype(np.float32)
    return pd.DataFrame([(key[0], int(key[1]), int(key[2]), index.astype(np.int32).tobytes(), total.tobytes(), mean.tobytes())], columns=["name", "block", "part", "at", "n", "w"])


def averages(parts: DataFrame, groups: int) -> DataFrame:
    """parts of all groups as one: AVERAGED groups go into one, again and again, so no task holds them all."""
    while True:
        above = F.floor(F.col("part") / AVERAGED).alias("part")
        parts = parts.groupBy("name", "block", above).applyInPandas(averaged, PARTS)
        groups = -(-groups // AVERAGED)
        if groups <= 1:
            return parts


def token_ids(known: list[str], more: list[str], slots: bool) -> Ids:
    """The worker's word table, kept from task to task."""
    held = sys.modules.setdefault("_sheafline_lm", types.ModuleType("_sheafline_lm"))
    if getattr(held, "known", None) != (known, more, slots):
        entries = [*((w, k) for k, w in enumerate(known)), *((w, PAD + 1 + k) for k, w in enumerate(more))]
        held.known, held.ids = (known, more, slots), Ids(entries, PAD + 1 + len(more) if slots else None)
    return held.ids


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n long), written once: how often every word of all docs occurs."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            out = pd.DataFrame({"word": list(seen), "n": np.array(list(seen.values()), np.int64)})
            yield from (out[k : k + ROWS_OUT] for k in range(0, len(out), ROWS_OUT))

        for pdf in batches:
            for text in pdf["text"]:
                seen.update(words(text))
            if len(seen) > COUNTED:
                yield from rows()
                seen.clear()
        yield from rows()

    return materialize(small_batches(docs).select(F.col("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words of all docs, ties by word, and every token's count in all docs."""
    return most_frequent(word_counts(docs))


def most_frequent(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = [r.word for r in top]
    frequency = np.zeros(PAD)
    frequency[: len(known)] = [r.n for r in top]
    other = counts.where(~F.col("word").isin(known)) if known else counts
    for r in other.groupBy((F.crc32("word") % SHARED).alias("k")).agg(F.sum("n").alias("n")).collect():  # SHARED rows at most
        frequency[KNOWN + r.k] = r.n
    return known, frequency


def often(total: float) -> int:
    """How often a word occurs at least that is a leaf of its own in a corpus of so many words."""
    return max(LEAST, math.ceil(total ** (2 / 3) / PER_CUBE))


def words_below(counts: DataFrame, known: list[str], frequency: np.ndarray) -> Lexicon:
    """The lexicon of what word_counts() gave."""
    least = often(frequency.sum())
    other = counts.where(~F.col("word").isin(known)) if known else counts
    own = other.where(F.col("n") >= least).select("word", "n").orderBy(F.desc("n"), "word").toArrow()
    rare = other.where(F.col("n") < least).groupBy((F.crc32("word") % SLOTS).cast("int").alias("slot")).agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("kinds"))
    got = rare.toArrow()  # SLOTS rows at most
    n, kinds = np.zeros(SLOTS), np.zeros(SLOTS)
    slot = got["slot"].to_numpy()
    n[slot], kinds[slot] = got["n"].to_numpy(), got["kinds"].to_numpy()
    return lexicon(own["word"].to_pylist(), own["n"].to_numpy(), n, kinds)


def token_table(docs: DataFrame, known: list[str], id_col: str = "doc_id", text_col: str = "text", lex: Lexicon | None = None) -> DataFrame:
    """(doc_id, tokens binary): four bytes for each word of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((known, lex.words if lex else [], lex is not None))
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def run(batches):
        of = token_ids(*shared.value).__getitem__
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [np.fromiter(map(of, words(t)), np.int32).tobytes() for t in pdf["text"]]})

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, tokens binary")


def train(docs: DataFrame, known: list[str], frequency: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE, seed: int = 13) -> np.ndarray:
    """Weights after `rounds` passes over every stride-th position of all docs (doc_id, text).

    Pass by pass the offset moves on by one, so rounds must not be less than stride.
    """
    return fit(token_table(docs, known), frequency, rounds, stride, seed)[0]


def dealt(tokens: DataFrame, groups: int, seed: int) -> DataFrame:
    """(part long, tokens binary), written once: a file for each group, its documents in an order by hash.

    tokens: a token_table. Rows go by a hash of id and tokens together, so neither an id that many rows share nor
    copies of one text are dealt as a whole, and null ids are like any other; rows that agree in both are.
    A file of up to PIECE bytes is one row group, so one task reads it.
    """
    mix = F.xxhash64("doc_id", "tokens", F.lit(seed))
    rows = tokens.select(F.pmod(mix, F.lit(groups)).cast("int").alias("part"), mix.alias("mix"), "tokens").where(F.octet_length("tokens") > 0)
    rows = rows.repartitionById(groups, F.col("part")).sortWithinPartitions("part", "mix", "tokens")
    return materialize(rows.select(F.col("part").cast("long").alias("part"), "tokens"), options={"parquet.block.size": PIECE})


def fit(tokens: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE, seed: int = 13, lex: Lexicon | None = None, group: int = GROUP) -> tuple[np.ndarray, Lexicon]:
    """Weights and lexicon from a token_table; positions are counted through each group."""
    if rounds < stride:
        raise ValueError("with fewer rounds than the stride some positions would never be trained on")
    weights, lex = initial(frequency, seed), lex or no_words()
    groups = min(GROUPS, max(1, math.ceil(frequency.sum() / group)))
    texts = dealt(tokens, groups, seed)
    context = tokens.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast((weights, lex.plain()))

        def learn(batches, turn=turn, shared=shared):
            flat, arrays = shared.value
            start = Lexicon(**arrays)
            now, own, steps, positions, held, waiting = None, None, 0, 0, [], 0

            def settle():
                nonlocal steps, positions, held, waiting
                ids, at = padded(held)
                ids, first = start.leaf_ids(ids), (turn - positions) % stride
                positions, held, waiting = positions + len(at), [], 0
                at = at[first::stride]
                while len(at):
                    n = BATCH if steps < SMALL else LARGER * BATCH
                    own.step(ids, at[:n])
                    at, steps = at[n:], steps + 1

            def finished():
                if held:
                    settle()
                rows = list(own.parts(now, positions)) if positions else []
                yield from (pd.DataFrame(rows[k : k + 64], columns=["name", "block", "part", "at", "n", "w"]) for k in range(0, len(rows), 64))

            for pdf in batches:
                for part, data in zip(pdf["part"], pdf["tokens"]):
                    if part != now:
                        if own:
                            yield from finished()
                        now, own, steps, positions = int(part), Learner(flat, start), 0, 0
                    held.append(np.frombuffer(data, np.int32))
                    waiting += len(held[-1])
                    if waiting >= HELD:
                        settle()
            if own:
                yield from finished()

        got = averages(texts.mapInPandas(learn, PARTS), groups).toArrow().to_pylist()
        lex = replace(lex, vectors=lex.vectors.copy(), forks=lex.forks.copy())
        for r in got:
            rows = np.frombuffer(r["w"], np.float32)
            if r["name"] == "net":
                weights = rows.copy()
            else:
                at = np.frombuffer(r["at"], np.int32)
                getattr(lex, r["name"])[at] = rows.reshape(len(at), -1)
    discard(texts)
    return weights, lex


def score(docs: DataFrame, known: list[str], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens long, log_score double, mean_log_score double of every row's whole text.

    log_score sums the log-probabilities of all words (lower-cased, split at white
    space); words without a token of their own count by the token they share, as this
    takes tokens alone (pseudo_likelihood tells words apart). Null,
    empty and blank texts have no tokens, score 0 and a null mean. Repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty result.
    """
    return score_tokens(token_table(docs, known, id_col, text_col), weights)


def score_tokens(tokens: DataFrame, weights: np.ndarray, lex: Lexicon | None = None) -> DataFrame:
    """What score() returns, of a token_table."""
    shared = tokens.sparkSession.sparkContext.broadcast((weights, (lex or no_words()).plain()))
    kind = tokens.select("doc_id").dtypes[0][1]

    def run(batches):
        flat, arrays = shared.value
        w, lex = unpack(flat), Lexicon(**arrays)
        tables = [lex.vectors @ m for m in w["mix"]]
        for pdf in batches:
            lists = [np.frombuffer(x, np.int32) for x in pdf["tokens"]]
            n = np.array([len(x) for x in lists], np.int64)
            sums = np.zeros(len(lists))
            rows = np.flatnonzero(n)
            # A batch is scored in stretches of whole documents.
            cuts = np.flatnonzero(np.diff(np.cumsum(n[rows]) // POSITIONS, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                part = rows[a:b]
                ids, at = padded([lists[k] for k in part])
                sums[part] = np.add.reduceat(log_probs(w, ids, at, lex, tables), np.cumsum(n[part]) - n[part])
            mean = pd.Series(np.where(n > 0, sums / np.maximum(n, 1), np.nan)).where(n > 0, None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "log_score": sums, "mean_log_score": mean.astype("Float64")})

    return tokens.mapInPandas(run, f"doc_id {kind}, n_tokens long, log_score double, mean_log_score double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Trains on all docs (doc_id, text) and scores all of them; texts become tokens once.

    Returns what score() does, rare words told apart by their hash slots. Ties in the
    vocabulary go by word. Null, empty and blank texts teach nothing; repeated rows
    teach and score each; other columns are not read; an empty table gives an empty result.
    """
    counts = word_counts(docs)
    known, frequency = most_frequent(counts)
    lex = words_below(counts, known, frequency)
    discard(counts)
    tokens = materialize(token_table(docs, known, lex=lex))
    return score_tokens(tokens, *fit(tokens, frequency, lex=lex, group=GROUP))
