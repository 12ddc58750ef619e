"""Encoding with a public byte-level BPE vocabulary by a pair occurrence index.

All distinct pieces of a batch are laid out in one symbol list. An index maps each mergeable pair - named by
the rank of what it merges to - to all its positions; ranks are taken in ascending order and the lists of the
neighbouring pairs are updated after each merge. A piece met before comes from a bounded cache.

Defined cases: a null and an empty text give an empty list; text that looks like a special token is ordinary
text; every other text is encoded whole, however long.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.runtime import spread

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_WORDS = 400_000


class PairIndexEncoder:
    """Encodes batches of texts; holds the vocabulary and a cache of pieces."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: t for t, r in self.rank.items()}
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.merged: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}

    def _merge_rank(self, left: int, right: int) -> int:
        key = left << 32 | right
        got = self.merged.get(key)
        if got is None:
            got = self.merged[key] = self.rank.get(self.token[left] + self.token[right], -1)
        return got

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; the pieces are merged together, pair by pair over the whole batch."""
        symbols: list[int] = []
        after: list[int] = []  # position of the next symbol of the same piece, -1 at its end
        starts = []
        for piece in pieces:
            starts.append(len(symbols))
            symbols.extend(self.single[b] for b in piece)
            after.extend(range(len(after) + 1, len(symbols) + 1))
            after[-1] = -1
        before = [-1] * len(symbols)
        for at, to in enumerate(after):
            if to >= 0:
                before[to] = at
        where: dict[int, list[int]] = {}
        merge_rank, merged = self._merge_rank, self.merged
        for at, to in enumerate(after):
            if to >= 0:
                rank = merged.get(symbols[at] << 32 | symbols[to])
                if rank is None:
                    rank = merge_rank(symbols[at], symbols[to])
                if rank >= 0:
                    where.setdefault(rank, []).append(at)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places = where.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for at in places:
                to = after[at]
                if to < 0 or symbols[at] < 0 or merge_rank(symbols[at], symbols[to]) != rank:
                    continue  # an earlier merge used up one of the two
                symbols[at], symbols[to] = rank, -1
                beyond = after[at] = after[to]
                if beyond >= 0:
                    before[beyond] = at
                for left, right in ((before[at], at), (at, beyond)):
                    if left >= 0 and right >= 0:
                        new = merge_rank(symbols[left], symbols[right])
                        if new >= 0:
                            if new in where:
                                where[new].append(left)
                            else:
                                where[new] = [left]
                                heapq.heappush(active, new)
        starts.append(len(symbols))
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts, starts[1:])]

    def learn(self, words: set[str]) -> None:
        """Bring the ids of all ``words`` into the cache."""
        known, rank = self.known, self.rank
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(words)
        if not new:
            return
        raw = [w.encode() for w in new]
        whole = [rank.get(r) for r in raw]
        for w, r in zip(new, whole):
            if r is not None:
                known[w] = [r]
        rest = [i for i, r in enumerate(whole) if r is None]
        for i, ids in zip(rest, self.encode_pieces([raw[i] for i in rest])):
            known[new[i]] = ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        flat, sizes = self.encode_flat(texts)
        ends = np.cumsum(sizes)
        return [flat[e - n : e].tolist() for e, n in zip(ends, sizes)]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        words = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*words) if words else set())
        ids = self.known.__getitem__
        parts, sizes = [], np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            if w:
                one = np.fromiter(chain.from_iterable(map(ids, w)), np.int32)
                parts.append(one)
                sizes[i] = len(one)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), sizes

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        words = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*words) if words else set())
        size = {w: len(ids) for w, ids in self.known.items()} if sum(map(len, words)) > 4 * len(self.known) else None
        if size is not None:
            return np.array([sum(map(size.__getitem__, w)) for w in words], np.int64)
        return np.array([sum(len(self.known[x]) for x in w) for w in words], np.int64)


def _slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, so that a batch of very long texts stays small in Python."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def encode_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` for each row of ``df``: the token ids of ``text``. A map over the scan, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(path)
        for batch in batches:
            for a, b in _slices(batch, 1):
                flat, sizes = encoder.encode_flat(batch.column(1).slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, flat)], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``(key, n_tokens)`` for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(path)
        for batch in batches:
            for a, b in _slices(batch, 1):
                n = encoder.count(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n)], [key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decoded_hashes(df: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """``(key, text_hash)``: SHA-256 of the text that the ids stand for, the way back from ``encode_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = PairIndexEncoder(path).token
        for batch in batches:
            raw = [b"".join(token[i] for i in x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [key, "raw"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, raw binary").select(key, F.sha2("raw", 256).alias("text_hash"))
