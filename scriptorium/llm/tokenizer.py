"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: batched numpy merge rounds. A batch of texts is one flat code-point array; token edges of the
published split pattern are found by class changes; the distinct words of the batch become one flat array of
byte symbols, and each round finds every word's lowest-rank pair by binary search over the sorted pair keys
and merges it everywhere in that word. Words are kept between batches, so a worker merges a word once.

Defined results: null and empty text give an empty list; strings that look like control tokens are text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptorium.llm.flat import chunks, code_points, ragged, runs, span_hash

DEFAULT_PATH = os.environ.get("SCRIPTORIUM_TOKENIZERS", "/opt/tokenizers")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that the split pattern cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


class Vocabulary:
    """Sorted pair keys with rank and merged id; a few MB whatever the corpus, so it travels with the task."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.byte_id[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position of each pair among the keys, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each; every word has a byte at least."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        none = np.int64(1 << 60)
        while len(symbols):
            n = len(symbols)
            at = np.full(n, -1)
            if n > 1:
                at[:-1] = np.where(word[:-1] == word[1:], self.look(symbols[:-1], symbols[1:]), -1)
            rank = np.where(at >= 0, self.rank[at], none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, n])
            live = best < none
            if not live.all():
                settled = np.repeat(~live, sizes)
                done_ids.append(symbols[settled])
                done_words.append(word[settled])
            chosen = (rank == np.repeat(best, sizes)) & (rank < none)
            spots = np.flatnonzero(chosen)
            if len(spots):
                # of overlapping equal pairs (a run of one symbol) every other one merges, from the left
                head = np.r_[True, np.diff(spots) > 1]
                place = np.arange(len(spots)) - np.maximum.accumulate(np.where(head, np.arange(len(spots)), 0))
                spots = spots[place % 2 == 0]
                symbols = symbols.copy()
                symbols[spots] = self.merged[at[spots]]
            keep = np.repeat(live, sizes)
            keep[spots + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_edges(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the words that the published split pattern makes of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    last &= ~edge[1:]
    tail = np.flatnonzero(last)  # white space just before another character of the same text
    start[tail] = True
    start[tail[points[tail] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start[:n])
    for ending in CONTRACTIONS:
        size = len(ending)
        at = quote[quote + size < n]
        good = np.ones(len(at), bool)
        for k, char in enumerate(ending, 1):
            good &= (points[at + k] == ord(char)) & ~edge[at + k]
        at = at[good]
        start[at + 1] = False
        after = at + size + 1
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches of texts; distinct words met so far are kept, up to a bound, then forgotten together. Words are found
    by hash and then compared character by character, so words of one hash don't get each other's ids."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        self.vocab, self.keep = vocabulary(path), keep
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.points, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[np.ndarray], hashes: np.ndarray | None = None) -> np.ndarray:
        """Slots of new words, given as code points; without hashes they can't be found again."""
        ids, sizes = self.vocab.encode_words([w.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for w in words])
        slots = np.arange(len(self.sizes), len(self.sizes) + len(words))
        lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.begins = np.concatenate([self.begins, len(self.points) + np.cumsum(lengths) - lengths])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.points, self.lengths = np.concatenate([self.points, *words]), np.concatenate([self.lengths, lengths])
        if hashes is not None:
            known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, slots])
            order = np.argsort(known)
            self.known, self.slot = known[order], slot[order]
        return slots

    def unlike(self, slot: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words whose characters aren't those of their slot: two words of one hash."""
        wrong = self.lengths[slot] != end - start
        same = np.flatnonzero(~wrong)
        size = self.lengths[slot[same]]
        differs = self.points[ragged(self.begins[slot[same]], size)] != points[ragged(start[same], size)]
        wrong[same[np.searchsorted(np.cumsum(size), np.flatnonzero(differs), "right")]] = True
        return np.flatnonzero(wrong)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.slot[at], -1)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each word of the texts in turn, and the number of words of each text."""
        points, offsets = code_points(texts)
        start = word_edges(points, offsets)
        end = np.r_[start[1:], len(points)].astype(np.int64)
        code, distinct = pd.factorize(self.hash(points, start, end))
        if len(self.known) > self.keep:
            self.forget()
        slot = self.find(distinct)
        new = np.flatnonzero(slot < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            slot[new] = self.learn([points[start[k] : end[k]] for k in first[new]], distinct[new])
        slot = slot[code]
        odd = self.unlike(slot, points, start, end)
        if len(odd):
            slot[odd] = self.learn([points[start[k] : end[k]] for k in odd])
        return slot, np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])

    hash = staticmethod(span_hash)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        slot, per_text = self.words(texts)
        sizes = self.sizes[slot]
        ends = np.r_[0, np.cumsum(sizes)]
        edges = np.r_[0, np.cumsum(per_text)]
        return self.ids[ragged(self.starts[slot], sizes)], np.diff(ends[edges])

    def count(self, texts: list[str]) -> np.ndarray:
        slot, per_text = self.words(texts)
        ends = np.r_[0, np.cumsum(self.sizes[slot])]
        return np.diff(ends[np.r_[0, np.cumsum(per_text)]])


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty."""
    return [x or "" for x in column.to_pylist()]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", folder: str = DEFAULT_PATH) -> DataFrame:
    """(key, ids): the ids of each text; one narrow stage, no shuffle. Other columns are not read."""
    path = os.path.join(folder, name)
    vocabulary(path)  # fails early, on the driver, where the file is missing

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in chunks(texts):
                ids, sizes = encoder.encode(texts[a:b])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids))], [key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), True))])
    return df.select(key, text).mapInArrow(encode, schema)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json", folder: str = DEFAULT_PATH) -> DataFrame:
    """(key, n_tokens): the number of ids of each text, by the same rounds without keeping the ids."""
    path = os.path.join(folder, name)
    vocabulary(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encoder.count(texts[a:b]).astype(np.int32))], [key, "n_tokens"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.IntegerType())])
    return df.select(key, text).mapInArrow(count, schema)
