"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word looks up its adjacent
pairs by binary search over the sorted pair keys and merges all places of its lowest-rank pair;
words without a known pair leave the array. Text is cut into words by the public pattern of the
vocabulary; the special tokens of the vocabulary file are recognised inside a text as that file says. A word of over
``LONG_WORD`` bytes would need about a round for each rank that occurs in it: its pairs, ranked by one
search, go through a heap instead, which takes about a second for 200 KB.

Null text encodes as no tokens and decodes as the empty text. An empty table gives an empty table; repeated rows are encoded each.
A long text is a pass of its own, whose arrays take some 60 bytes a byte of text.
Columns of the output that exist in the input are replaced; all other columns pass through.
Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from kbspark.llm.common import batch_rows, list_array, offsets_of, release, replace_columns, schema_with, slices, spread

#: Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encoding a task remembers before it starts over.
MEMORY_WORDS = 200_000
#: Bytes of a word from which on its merges go through a heap.
LONG_WORD = 400
NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys with ranks and merged ids, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.of_byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        spelled = [b""] * self.base
        for token, i in vocab.items():
            spelled[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelling = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.lengths = np.array([len(s) for s in spelled], dtype=np.int64)
        self.starts = offsets_of(self.lengths)[:-1]
        self.pairs: dict[int, tuple[int, int]] = {}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.fresh: list[str] = []
        self.flat = np.zeros(0, dtype=np.int32)
        self.count = np.zeros(0, dtype=np.int64)
        self.begin = np.zeros(0, dtype=np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        done_symbols, done_words = [], []
        while len(symbol):
            key = symbol[:-1] * self.base + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbol), NO_RANK)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            lowest = np.minimum.reduceat(rank, first)
            over = np.repeat(lowest == NO_RANK, size)
            chosen = (rank == np.repeat(lowest, size)) & ~over
            place = np.flatnonzero(chosen)
            # of overlapping places, as in "aaa", every second one merges, counted from the left
            run = np.cumsum(np.r_[True, np.diff(place) != 1]) - 1
            place = place[(place - place[np.r_[True, np.diff(place) != 1]][run]) % 2 == 0] if len(place) else place
            symbol[place] = self.merged[at[place]]
            keep = ~over
            keep[place + 1] = False
            done_symbols.append(symbol[over])
            done_words.append(word[over])
            symbol, word = symbol[keep], word[keep]
        symbols = np.concatenate([*done_symbols, np.zeros(0, np.int64)])
        owners = np.concatenate([*done_words, np.zeros(0, np.int64)])
        order = np.argsort(owners, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owners, minlength=len(words)).astype(np.int64)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: the lowest-rank pair, leftmost first, merges until none is known."""
        symbols = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        n = len(symbols)
        key = symbols[:-1] * self.base + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == key)
        heap = np.sort(self.ranks[at[place]] << 32 | place).tolist()
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        pairs, base, symbol = self.pairs, self.base, symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (-1, -1)
        while heap:
            top = heapq.heappop(heap)
            i, j = top & 0xFFFFFFFF, after[top & 0xFFFFFFFF]
            if symbol[i] < 0 or j >= n:
                continue
            rank, merged = pairs.get(symbol[i] * base + symbol[j], none)
            if rank != top >> 32:
                continue
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = pairs.get(merged * base + symbol[k], none)[0]
                if rank >= 0:
                    heapq.heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = pairs.get(symbol[h] * base + merged, none)[0]
                if rank >= 0:
                    heapq.heappush(heap, rank << 32 | h)
        return np.array([x for x in symbol if x >= 0], dtype=np.int32)

    def _learn(self) -> None:
        words = [w.encode("utf-8") for w in self.fresh]
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        flat, count = self.merge([w if len(w) <= LONG_WORD else b"" for w in words])
        for i in long:
            ids = self.merge_long(words[i])
            at = int(count[:i].sum())
            flat, count[i] = np.concatenate([flat[:at], ids, flat[at:]]), len(ids)
        self.begin = np.concatenate([self.begin, len(self.flat) + offsets_of(count)[:-1]])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
        self.fresh = []

    def _number(self, words: list[str]) -> list[int]:
        known, fresh, out = self.known, self.fresh, []
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = len(known)
                fresh.append(w)
            out.append(n)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        numbers: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            before = len(numbers)
            if self.split and any(s in text for s in self.special):
                for piece in self.split.split(text):
                    numbers += [-1 - self.special[piece]] if piece in self.special else self._number(self.words.findall(piece))
            else:
                numbers += self._number(self.words.findall(text))
            sizes[i] = len(numbers) - before
        if self.fresh:
            self._learn()
        number = np.array(numbers, dtype=np.int64)
        plain = number >= 0
        ordinary = np.where(plain, number, 0)
        count = np.where(plain, self.count[ordinary] if len(self.count) else 0, 1)
        ids = np.empty(int(count.sum()), dtype=np.int32)
        if plain.all():
            ids[:] = self.flat[spread(self.begin[number], count)] if len(number) else 0
        else:
            from_words = np.repeat(plain, count)
            ids[from_words] = self.flat[spread(self.begin[ordinary[plain]], count[plain])] if plain.any() else 0
            ids[~from_words] = -1 - number[~plain]
        return ids, np.add.reduceat(np.r_[count, 0], offsets_of(sizes)[:-1]) * (sizes > 0) if len(texts) else sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become replacement characters."""
        inside = (ids >= 0) & (ids < self.base)
        safe = np.where(inside, ids, 0)
        lengths = np.where(inside, self.lengths[safe], 0)
        data = self.spelling[spread(self.starts[safe], lengths)].tobytes()
        ends = offsets_of(lengths)[offsets_of(sizes)]
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.fill_null(pc.list_flatten(column), -1).to_numpy(zero_copy_only=False), sizes


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as array<int>."""

    def run(batches):
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, text):
                flat, sizes = v.encode(batch.column(text).to_pylist())
                yield replace_columns(batch, {ids: list_array(flat, sizes, pa.int32())})
        v.forget()
        release()

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{ids: "array<int>"}))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of the token ids in ``ids``; special tokens are kept."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                yield replace_columns(part, {text: pa.array(v.decode(*_list_values(part.column(ids))), type=pa.string())})

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{text: "string"}))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() of the ids in one pass over the rows."""

    def run(batches):
        v = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, text):
                flat, sizes = v.encode(batch.column(text).to_pylist())
                back = v.decode(flat, sizes)
                yield replace_columns(batch, {ids: list_array(flat, sizes, pa.int32()), decoded: pa.array(back, type=pa.string())})
        v.forget()
        release()

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{ids: "array<int>", decoded: "string"}))
