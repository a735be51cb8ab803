"""Substring de-duplication by super-k-mers.

A window is `window` consecutive words of one text.  Its minimiser is the smallest hash of the `mer`-word runs in it.
Consecutive windows with the same minimiser, at the same place, are one super-k-mer: one packed string.  Three passes over the texts:

1. count minimisers; a window whose minimiser occurs in one super-k-mer only cannot repeat, so it need not travel;
2. send the super-k-mers of repeated minimisers, equal strings of a block of texts once, to their minimiser's bucket, where
   sorting their windows' 128-bit digests counts them and finds each repeated window's first start;
3. look each window of those minimisers up in the sorted arrays that the buckets wrote, and drop the words that it covers if
   it also starts earlier.

No occurrence is ever returned to its document by a join, so a passage that a third of all texts share costs each of
them a look-up.  Super-k-mers of a minimiser that many blocks of texts send do not meet in its bucket: their windows, as digests that each task sums
first, go to buckets that follow from the digests, so a common passage is one small row a window and task, spread over all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import HashStore, pack, shard_bits, shard_of, text_bytes, tidy, unpack, workspace

_LAST = np.iinfo(np.int64).max
#: A minimiser that more blocks of texts than this send is common.
COMMON = 32
#: Windows of common minimisers that a task holds before it sends their sums.
HELD = 1 << 20
#: Bytes of super-k-mers that a bucket takes apart at once.
TEXTS = 2 << 20


class Windows:
    """The windows of a block of texts with their super-k-mers."""

    def __init__(self, w: tv.Words, window: int, mer: int):
        self.w, self.window = w, window
        self.h = w.hashes(0)
        self.at, each = w.runs(window)
        self.text_of = np.repeat(np.arange(len(each)), each)
        if not len(self.at):
            self.least = np.zeros(0, np.uint64)
            self.new = np.zeros(0, bool)
            return
        mers = tv.rolling(self.h, mer)
        least, place = mers[self.at], self.at.copy()
        for j in range(1, window - mer + 1):
            other = mers[self.at + j]
            better = other < least
            np.copyto(least, other, where=better)
            np.copyto(place, self.at + j, where=better)
        self.least = least
        self.new = np.ones(len(place), bool)
        self.new[1:] = (place[1:] != place[:-1]) | (self.text_of[1:] != self.text_of[:-1])

    def digests(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each of these windows."""
        at = self.at[which]
        return tv.rolling(self.h, self.window, at), tv.rolling(self.w.hashes(1), self.window, at, np.uint64(0x2545F4914F6CDD1D))

    def starts(self, which: np.ndarray) -> np.ndarray:
        """The windows' first words, counted in their own text."""
        return self.at[which] - self.w.doc[self.text_of[which]]


def _ids(array: pa.Array) -> np.ndarray:
    """Ids to order by; null comes last."""
    return array.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _first(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, in this order."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _repeated(texts: DataFrame, store: HashStore, window: int, mer: int) -> None:
    """Pass 1: stores the minimisers of two or more super-k-mers, and which of them are common."""

    @tidy
    def count(batches):
        for batch in batches:
            for _, _, w in tv.words_of(batch.column(1), tv.PLAIN):
                x = Windows(w, window, mer)
                keys, n = np.unique(x.least[x.new], return_counts=True)
                shard = shard_of(keys, store.bits)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]))
                rows = [(int(shard[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0))), (n[a:b] > 1).tobytes()) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "keys", "many"])

    def gather(key, table):
        keys = np.concatenate([np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")])
        many = np.concatenate([np.frombuffer(x.as_py(), bool) for x in table.column("many")])
        order = np.argsort(keys, kind="stable")
        keys, many = keys[order], many[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(first, len(keys)))
        keep = (n > 1) | many[first]
        store.write(key[0].as_py(), key=keys[first][keep], common=(n[keep] > COMMON).astype(np.uint8))
        return pa.table({"shard": [key[0].as_py()], "n": [int(keep.sum())]})

    texts.mapInArrow(count, "shard int, keys binary, many binary").groupBy("shard").applyInArrow(gather, "shard long, n long").agg(F.sum("n")).collect()


class Sums:
    """Windows by digest: their smallest place and how many there are, for as many as a task may hold."""

    def __init__(self):
        self.cols: list[list[np.ndarray]] = [[], [], [], [], []]
        self.size = 0

    def add(self, *cols: np.ndarray) -> None:
        """d1, d2, ids, starts and numbers of windows."""
        for held, c in zip(self.cols, cols):
            held.append(c)
        self.size += len(cols[0])

    def take(self) -> tuple[np.ndarray, ...]:
        """Each digest once, in order of digests, with its smallest place and its total; nothing is held then."""
        d1, d2, own, at, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.cols)
        self.__init__()
        order = np.lexsort((at, own, d2, d1))
        first = _first(order, d1, d2)
        pick = order[first]
        return d1[pick], d2[pick], own[pick], at[pick], np.add.reduceat(n[order], first) if len(order) else n


def _firsts(texts: DataFrame, repeated: HashStore, firsts: HashStore, window: int, mer: int) -> None:
    """Pass 2: stores each repeated window's first start, in the shard of its minimiser, or of its digest if that is common."""
    names = ["shard", "text", "size", "id", "start", "n"]
    types = [pa.int32(), *[pa.binary()] * 5]

    def digests(sums: Sums):
        """Rows without texts: instead of sizes, the digests."""
        d1, d2, own, at, n = sums.take()
        shard = shard_of(d1, firsts.bits)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(d1)])) if len(d1) else np.zeros(1, int)
        rows = [(int(shard[a]), None, pack(d1[a:b]) + pack(d2[a:b]), pack(own[a:b]), pack(at[a:b]), pack(n[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

    @tidy
    def send(batches):
        sums = Sums()
        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, _, w in tv.words_of(batch.column(1), tv.PLAIN):
                x = Windows(w, window, mer)
                head = np.flatnonzero(x.new)
                tail = np.append(head[1:], len(x.at)) - 1
                keys, inverse = np.unique(x.least[head], return_inverse=True)
                found, got = repeated.lookup(keys)
                common = (got["common"] > 0)[inverse]
                if common.any():
                    every = np.flatnonzero(common[np.cumsum(x.new) - 1])
                    sums.add(*x.digests(every), ids[lo + x.text_of[every]], x.starts(every), np.ones(len(every), np.int64))
                    if sums.size > HELD:
                        held = sums.take()
                        sums.add(*held)
                        if sums.size > HELD // 2:
                            yield digests(sums)
                keep = found[inverse] & ~common
                head, tail, least = head[keep], tail[keep], x.least[head[keep]]
                if not len(head):
                    continue
                own, start = ids[lo + x.text_of[head]], x.starts(head)
                (a1, a2), (b1, b2) = x.digests(head), x.digests(tail)
                d1, d2 = tv.mix(a1 * np.uint64(3) + b1), tv.mix(a2 * np.uint64(5) + b2)
                shard = shard_of(least, firsts.bits)
                order = np.lexsort((start, own, d2, d1, shard))
                first = _first(order, shard, d1, d2)
                n = np.diff(np.append(first, len(order)))
                pick = order[first]
                begin, size = w.start[x.at[head[pick]]], w.start[x.at[tail[pick]] + window]
                size = size - begin
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard[pick])) + 1, [len(pick)]))
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    s = size[a:b]
                    at = np.arange(s.sum()) + np.repeat(begin[a:b] - np.cumsum(s) + s, s)
                    p = pick[a:b]
                    rows.append((int(shard[p[0]]), w.text[at].tobytes(), pack(s), pack(own[p]), pack(start[p]), pack(n[a:b])))
                yield pa.record_batch([pa.array(c, pa.int32() if i == 0 else pa.large_binary()).cast(types[i]) for i, c in enumerate(zip(*rows))], names=names)
        if sums.size:
            yield digests(sums)

    def add(sums: Sums, rows: list[tuple]) -> None:
        """The windows of rows with texts, all at once: of many shards a block of texts sends few super-k-mers to each."""
        raw = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
        size, own, start, n = (np.concatenate([unpack(c, np.int64) for c in column]) for column in list(zip(*rows))[1:])
        edges = np.concatenate(([0], np.cumsum(size)))
        for lo, hi in tv.blocks(edges):
            x = Windows(tv.Words(raw[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], tv.PLAIN), window, mer)
            of = lo + x.text_of
            sums.add(*x.digests(np.arange(len(x.at))), own[of], start[of] + x.starts(np.arange(len(x.at))), n[of])

    def gather(key, table):
        sums = Sums()
        held, size_held = [], 0
        for text, size, own, start, n in zip(*(table.column(c).to_pylist() for c in names[1:])):
            if text is None:
                d = size[: len(size) // 2], size[len(size) // 2 :]
                sums.add(*(unpack(c, np.uint64) for c in d), *(unpack(c, np.int64) for c in (own, start, n)))
                continue
            held.append((text, size, own, start, n))
            size_held += len(text)
            if size_held >= TEXTS:
                add(sums, held)
                held, size_held = [], 0
        if held:
            add(sums, held)
        d1, d2, own, at, n = sums.take()
        many = n > 1
        firsts.write(key[0].as_py(), key=d1[many], other=d2[many], id=own[many], start=at[many])
        return pa.table({"shard": [key[0].as_py()], "n": [int(many.sum())]})

    sent = texts.mapInArrow(send, "shard int, text binary, size binary, id binary, start binary, n binary")
    sent.groupBy("shard").applyInArrow(gather, "shard long, n long").agg(F.sum("n")).collect()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, window: int = 20, mer: int = 8) -> DataFrame:
    """(row struct of `columns`, n_words, n_removed, kept): each text without the words of windows that also start earlier.

    Earlier: smaller id, or the same id and an earlier start; windows are judged on the input.  A null id comes after all others.  Rows
    with equal id are one document: equal windows at equal starts are not earlier than each other, so an exactly repeated row keeps
    its words.  Null, empty or short texts have no window and keep all their words; texts of any length are taken whole.  kept: the words left, joined by one space.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "superkmer")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    size = text_bytes(texts, "t")
    repeated = HashStore(folder, "repeated", shard_bits(size, 1.5e6), ("common",))
    firsts = HashStore(folder, "first", shard_bits(size, 1.5e6), ("other", "id", "start"))
    _repeated(texts, repeated, window, mer)
    _firsts(texts, repeated, firsts, window, mer)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or [id_col]]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    @tidy
    def strip(batches):
        for batch in batches:
            ids = _ids(batch.column(1))
            for lo, hi, w in tv.words_of(batch.column(2), tv.PLAIN):
                x = Windows(w, window, mer)
                keys, inverse = np.unique(x.least[x.new], return_inverse=True)
                there, got = repeated.lookup(keys)
                of = inverse[np.cumsum(x.new) - 1] if len(keys) else np.zeros(0, int)
                some = np.flatnonzero(there[of])
                d1, d2 = x.digests(some)
                own, start = ids[lo + x.text_of[some]], x.starts(some)
                shard = np.where(got["common"][of[some]] > 0, shard_of(d1, firsts.bits), shard_of(x.least[some], firsts.bits))
                order = np.lexsort((d1, shard))
                found, got = firsts.lookup(d1[order], shard[order], d2[order])
                late = found & ((own[order] > got["id"]) | ((own[order] == got["id"]) & (start[order] > got["start"])))
                at = x.at[some[order[late]]]
                cover = np.zeros(w.n + 1, np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                before = np.concatenate(([0], np.cumsum(gone)))
                removed = before[w.doc[1:]] - before[w.doc[:-1]]
                left = w.text if not len(at) else w.text[np.repeat(~gone, np.diff(w.start))]
                kept_bytes = np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(w.start)))))
                edges = kept_bytes[w.doc]
                data = left.tobytes()
                kept = [data[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:])]
                out = pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.doc).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])
                yield out

    schema = carried.select("row").schema.simpleString()[len("struct<row:") : -1]
    return carried.mapInArrow(strip, f"row {schema}, n_words long, n_removed long, kept string")
