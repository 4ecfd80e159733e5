"""Byte-level BPE encoding over a trie of distinct words.

An encoding is fixed by its last token: the encoding of a prefix is the encoding of
that prefix without its last token, plus that token. So a trie node needs no more
than the last token of the prefix it stands for, and words that share a prefix share
the work for it. A node's last token is the one token ending there that is a legal
neighbour of the last token of the prefix before it; a pair is legal if no merge
would have crossed the border between the two.

The trie is held as its sorted words: read in order they are its nodes depth first,
and what a word shares with the one before it is the part of the path that stays.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import ship, small_batches

ship(__name__)

#: Words and token pairs that a worker remembers at most, characters encoded in one go, and bytes of a word that is
#: remembered, and of a prefix whose whole encoding is held on the path.
WORDS, PAIRS, CHARS, SHORT = 250_000, 500_000, 2_000_000, 64
#: What the vocabulary's pre-tokenizer splits at (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte behind each letter that byte-level vocabulary files write for it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes with a byte-level BPE vocabulary file in JSON."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        raw = lambda text: bytes(letters[c] for c in text)
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.across: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(data["model"]["merges"]):
            a, b = (self.ids[raw(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            text = raw("".join(merge.split(" ") if isinstance(merge, str) else merge))
            self.across[a, b] = n
            self.parts.setdefault(self.ids[text], (n, a, b))
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.text = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in added.items()}
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN).findall
        self.packed = {i: i.to_bytes(4, "little") for i in self.text}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def legal(self, a: int, b: int) -> bool:
        """Whether the texts of a and b, joined, are encoded as a, b.

        Takes the later-made of the two tokens facing each other apart, again and
        again. A merge across the border that ranks before the token just taken apart
        would have been done first; at equal rank the one further left goes first.
        """
        bound, none = len(self.across), (-1, -1, -1)
        while True:
            if self.across.get((a, b), bound) < bound:
                return False
            left, right = self.parts.get(a, none), self.parts.get(b, none)
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                bound, a = left[0], left[2]
            else:
                bound, b = right[0] + 1, right[1]

    def learn(self, words: Iterable[str], into: dict[str, bytes]) -> None:
        """Encodes distinct words of any length over one trie, depth first.

        ``last`` holds the last token of each prefix on the path, ``code`` the whole
        encoding of prefixes up to SHORT bytes. A longer word's encoding is read back
        along its last tokens, down to a prefix that has a whole one.
        """
        ids, pairs, packed, legal = self.ids.get, self.pairs, self.packed, self.legal
        path, last, code = b"", [-1], [b""]
        for raw, word in sorted((w.encode(), w) for w in words):
            shared = len(path) if raw.startswith(path) else next(k for k, (x, y) in enumerate(zip(path, raw)) if x != y)
            del last[shared + 1 :], code[shared + 1 :]
            for depth in range(shared + 1, len(raw) + 1):
                start = depth - 1
                while True:
                    token = ids(raw[start:depth])
                    if token is not None:
                        if not start:
                            break
                        pair = last[start] << 20 | token
                        fits = pairs.get(pair)
                        if fits is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            fits = pairs[pair] = legal(last[start], token)
                        if fits:
                            break
                    start -= 1
                last.append(token)
                if depth <= SHORT:
                    code.append(code[start] + packed[token])
            if len(raw) <= SHORT:
                into[word] = code[-1]
            else:
                back, depth = [], len(raw)
                while depth > SHORT:
                    back.append(packed[last[depth]])
                    depth -= len(self.text[last[depth]])
                into[word] = code[depth] + b"".join(back[::-1])
            path = raw

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        # Texts of added tokens stand at odd places of a text cut at them.
        cut = [[t] if self.special is None else self.special.split(t) for t in texts]
        cut = [[[part] if k % 2 else self.split(part) for k, part in enumerate(of)] for of in cut]
        fresh = set().union(*(words for of in cut for words in of[::2])).difference(self.words)
        if len(self.words) + len(fresh) > WORDS:
            self.words.clear()
            fresh = set().union(*(words for of in cut for words in of[::2]))
        long = {w for w in fresh if len(w.encode()) > SHORT}
        if not long:
            self.learn(fresh, self.words)
            known = self.words.__getitem__
        else:
            made: dict[str, bytes] = {}
            self.learn(fresh, made)
            self.words |= {w: made[w] for w in fresh - long}  # long ones are not remembered: their size has no bound
            known = lambda w: made[w] if w in long else self.words[w]
        return [b"".join([self.added[words[0]] if k % 2 else b"".join(map(known, words)) for k, words in enumerate(of)]) for of in cut]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").encode()


def encoder(spec: str) -> Encoder:
    """The worker's encoder for spec; made once, as a worker runs many tasks."""
    held = sys.modules.setdefault("_sheafline_bpe", types.ModuleType("_sheafline_bpe"))
    key = hashlib.sha256(spec.encode()).hexdigest()
    if getattr(held, "key", None) != key:
        held.key, held.made = key, Encoder(spec)
    return held.made


def runs(texts: list[str]):
    """Slices of texts of about CHARS characters."""
    start = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= CHARS:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """The encoding of every row's whole text, without a shuffle.

    vocabulary: a file on the driver in the JSON format of byte-level vocabularies (a few
    MB; broadcast). Texts of added tokens inside a text become those tokens. Null
    counts as empty and has no tokens. Repeated rows give repeated rows; other columns
    are not read; an empty table gives an empty result.

    Returns doc_id, n_tokens long, ids_sha256, decoded_sha256, and with ids the column
    token_ids array<int>.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def run(batches):
        coder = encoder(spec.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            for part in runs(texts):
                coded = coder.encode_many(texts[part])
                out = {"doc_id": pdf["doc_id"].iloc[part], "n_tokens": [len(c) // 4 for c in coded], "ids_sha256": [sha(c) for c in coded], "decoded_sha256": [sha(coder.decode(c)) for c in coded]}
                if ids:
                    out["token_ids"] = [np.frombuffer(c, "<u4").astype(np.int32) for c in coded]
                yield pd.DataFrame(out)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows with token_ids array<int>; null ids decode to the empty text."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = encoded.select("doc_id").dtypes[0][1]

    def run(batches):
        coder = encoder(spec.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [coder.decode(np.array([] if x is None else x, "<u4").tobytes()).decode() for x in pdf["token_ids"]]})

    return small_batches(encoded).select("doc_id", "token_ids").mapInPandas(run, f"doc_id {kind}, text string")
