"""Byte-level BPE, encoding and decoding, with a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in one bucket for each merge rank.  A bitmap of two levels says which buckets hold anything, so the
next rank is two find-first-set steps away however long the pre-token is.  A bucket holds places in a linked list of tokens, the
leftmost first.  Only pairs that come before both their neighbours wait there: the next pair of all is one of these, and a merge tells which
others join them.  A merge leaves the entries of the pairs it destroys where they are; they are skipped when their rank comes up and
the pair at that place is another one by then.
"""

from __future__ import annotations

import array
import base64
import functools
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import CACHES, small_batches, tidy

#: Pre-tokens whose ids a worker remembers: half of them met lately, half met before these and not again since.
CACHE = 300_000
#: The rank of a pair that has none.
NONE = 1 << 60
#: A pattern, and one that finds the same matches in less time: as only contractions begin with an apostrophe and letters and digits have alternatives of their own, these can be tried first.
USUAL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)


class RankQueue:
    """Smallest rank first, then smallest place.

    A word of the lower level tells which of 64 neighbouring buckets hold anything, the upper level which of these words aren't zero.  A queue that
    has run empty is as good as new, so one serves all pre-tokens.
    """

    __slots__ = ("upper", "lower", "buckets")

    def __init__(self, ranks: int):
        self.upper = 0
        self.lower = [0] * (ranks // 64 + 1)
        self.buckets: list[list[int]] = [[] for _ in range(ranks + 1)]

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, place)
            return
        bucket.append(place)
        word = rank >> 6
        if not self.lower[word]:
            self.upper |= 1 << word
        self.lower[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int]:
        """The queue must hold something."""
        word = (self.upper & -self.upper).bit_length() - 1
        bits = self.lower[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        self.lower[word] = bits = bits & (bits - 1)
        if not bits:
            self.upper &= self.upper - 1
        return rank, bucket.pop()


class Vocabulary(dict):
    """Ranks of a tiktoken file; as a dict it remembers the ids of pre-tokens, packed, as they are met."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(USUAL[1] if pattern == USUAL[0] else pattern).findall
        self.top = top = max(self.ranks.values())
        self.queue = RankQueue(top)
        self.type = np.dtype(np.uint16 if top < 65536 else np.int32)
        # Ids of single bytes, numbers over all ids for bytes that have none; the id of each two bytes.
        self.single = [self.ranks.get(bytes([b]), top + 1 + b) for b in range(256)]
        self.shift = (top + 256).bit_length()
        self.two = [[self.ranks.get(bytes((a, b)), NONE) for b in range(256)] for a in range(256)]
        self.code = array.array("H" if self.type.itemsize == 2 else "i").typecode

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is None:
            ids = array.array(self.code, self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE // 2:
                self.old = dict(self)
                super().clear()
            self[piece] = ids
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 1:
            raise KeyError(f"no id for byte {piece!r}")
        # The queue's push and pop are written out here: most pre-tokens are short, and calls would take most of the time.  A token's rank is its id.
        find, shift, two, lower, buckets, upper = self.pairs.get, self.shift, self.two, self.queue.lower, self.queue.buckets, 0
        token = [*map(self.single.__getitem__, piece)]
        after = [*range(1, n + 1)]
        before = [*range(-1, n - 1)]
        current = [two[a][b] for a, b in pairwise(piece)]  # the rank of the pair that begins here
        current.append(NONE)
        left = NONE
        for i, (rank, right) in enumerate(pairwise(current)):
            if rank < left and rank <= right:
                if bucket := buckets[rank]:
                    bucket.append(i)
                else:
                    bucket.append(i)
                    word = rank >> 6
                    upper |= 1 << word
                    lower[word] |= 1 << (rank & 63)
            left = rank
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                lower[word] = bits = bits & (bits - 1)
                if not bits:
                    upper &= upper - 1
            if current[i] != rank:
                continue
            j = after[i]
            after[i] = k = after[j]
            h = before[i]
            old, current[j] = current[j], NONE
            token[i], token[j] = rank, -1
            here = there = left = NONE  # the ranks of the pairs at i, k and h
            if k < n:
                before[k] = i
                here, there = find(rank << shift | token[k], NONE), current[k]
            current[i] = here
            join = []
            if h >= 0:
                was = current[h]
                current[h] = left = find(token[h] << shift | rank, NONE)
                g = before[h]
                first = current[g] if g >= 0 else NONE
                if left < first and left <= here:
                    join.append((left, h))
                elif was < first <= left and first < (current[before[g]] if before[g] >= 0 else NONE):
                    join.append((first, g))
            if here < left and here <= there:
                join.append((here, i))
            elif old <= there < here and there <= current[after[k]]:
                join.append((there, k))
            for new, i in join:
                if bucket := buckets[new]:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    word = new >> 6
                    upper |= 1 << word
                    lower[word] |= 1 << (new & 63)
        out = [t for t in token if t >= 0]
        if max(out) > self.top:
            raise KeyError(f"no id for a byte of {piece!r}")
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), self.type)

    def decode(self, ids) -> bytes:
        """Bytes of the ids; an id outside the vocabulary is a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """The id of each two ids that make one, by one number for the two; workers that only decode don't hold it."""
        part = self.ranks | {bytes([b]): i for b, i in enumerate(self.single)}
        return {part[a] << self.shift | part[b]: i for t, i in self.ranks.items() for k in range(1, len(t)) if (a := t[:k]) in part and (b := t[k:]) in part}

    @functools.cached_property
    def tokens(self) -> pa.Array:
        """The bytes of each id, null where there is none."""
        return pa.array([self.bytes_of.get(i) for i in range(self.top + 1)], pa.large_binary())


_HELD: dict[tuple[str, str], Vocabulary] = {}
#: The whole vocabularies go, not only the ids they remember: other operators' tasks would carry their tables along.
CACHES.append(_HELD)


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once in each worker, and again after other operators' tasks."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = Vocabulary(path, pattern)
    return _HELD[path, pattern]


def _encoded(v: Vocabulary, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """The rows and ids of a batch of (row, text), in parts of some text."""
    offsets = tv.column(batch.column(1))[1]
    for lo, hi in tv.blocks(offsets, 4 << 20):
        own = [v.encode(t or "").astype(np.int32) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        yield batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, np.concatenate(own) if own else np.zeros(0, np.int32))


def _decoded(v: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The bytes of each row's ids."""
    ends = ids.offsets.to_numpy()
    out: list[memoryview] = []
    for lo, hi in tv.blocks(ends, 1 << 18):  # so many ids at once
        pieces = v.tokens.take(ids.values.slice(ends[lo], ends[hi] - ends[lo]))
        if pieces.null_count:
            raise KeyError("an id outside the vocabulary")
        at = np.frombuffer(pieces.buffers()[1], np.int64)[ends[lo : hi + 1] - ends[lo]]
        data = memoryview(pieces.buffers()[2] or b"")
        out += [data[a:b] for a, b in pairwise(at.tolist())]
    return pa.array(out, pa.binary())


def _rows(docs: DataFrame, columns: list[str], text_col: str) -> tuple[DataFrame, str]:
    """(row struct of `columns`, t), and the struct's fields as a schema."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text_col).cast("string").alias("t"))
    return rows, rows.select("row").schema.simpleString()[len("struct<row:") : -1]


def encode(docs: DataFrame, path: str, pattern: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """(row struct of `columns`, ids array<int>): ids of each whole text, without special tokens; null and empty texts have none.

    Every row is encoded on its own, so repeated rows, clashing names among `columns` and empty tables need no rule.
    """
    rows, schema = _rows(docs, columns, text_col)

    @tidy
    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            for row, ids in _encoded(v, batch):
                yield pa.record_batch([row, ids], names=["row", "ids"])

    return rows.mapInArrow(run, f"row {schema}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(row, ids, decoded binary): the bytes of the ids of each row; null ids give none."""

    @tidy
    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), _decoded(v, batch.column(1))], names=["row", "ids", "decoded"])

    schema = encoded.select("row", "ids").schema.simpleString()[len("struct<") : -1].replace("row:", "row ", 1).replace(",ids:", ", ids ")
    return encoded.select("row", "ids").mapInArrow(run, f"{schema}, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """What `decode` returns of what `encode` returns, (row, ids, decoded binary), in one pass: a task has one worker, not one for each of the two."""
    rows, schema = _rows(docs, columns, text_col)

    @tidy
    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            for row, ids in _encoded(v, batch):
                yield pa.record_batch([row, ids, _decoded(v, ids)], names=["row", "ids", "decoded"])

    return rows.mapInArrow(run, f"row {schema}, ids array<int>, decoded binary")
