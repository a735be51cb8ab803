"""Benchmark decontamination over a distributed positional inverted index.

The training texts are indexed in segments of bounded size: for each term its postings, the sorted word positions in the segment, and
where each text begins.  A test window is looked for segment by segment: its terms are ordered by their number of postings there,
the rarest list is shifted by its term's offset and intersected with the next ones, and what is left are exact phrase matches.
With `slop` a looser search also finds places where the window's terms stand close together in any order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import map_array, map_sections, remove, resolve, sections, tidy, workspace, write_array

#: Bytes of text of a segment; a longer text is a segment of its own.
SEGMENT = 4 << 20
#: Test windows that a task holds at once.
WINDOWS = 1 << 16
#: Blocks of test windows that a task keeps.
HELD = 16
_SEGMENTS = "file string, at long, size long, n_docs long"


def build(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Indexes all texts below folder; (file, at, size, n_docs) of each segment, one file for each attempt of a task.  Null texts have no words."""

    @tidy
    def index(batches):
        out, name, at = None, f"{folder}/{uuid.uuid4().hex}.segments", 0
        filesystem, path = resolve(name)
        try:
            for batch in batches:
                ids, hashes = batch.column(0), batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
                known, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                rows = []
                for lo, hi, w in tv.words_of(batch.column(1), tv.ALNUM, SEGMENT):
                    h = w.hashes()
                    order = np.argsort(h, kind="stable")
                    ordered = h[order]
                    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if w.n else np.zeros(0, int)
                    ends = np.append(first[1:], w.n) if w.n else first
                    data = sections([ordered[first], ends, order.astype(np.int32 if w.n < 2**31 else np.int64), w.doc, known[lo:hi], null[lo:hi], hashes[lo:hi]])
                    out = out or filesystem.open_output_stream(path)
                    out.write(data)
                    rows.append((name, at, len(data), hi - lo))
                    at += len(data)
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "at", "size", "n_docs"])
        finally:
            if out:
                out.close()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    return texts.mapInArrow(index, _SEGMENTS)


def test_windows(items: DataFrame, folder: str, id_col: str, text_col: str, window: int) -> list[str]:
    """Stores the items' windows as blocks of arrays and names the blocks.  An item of fewer words, but not none, is one window."""

    @tidy
    def cut(batches):
        for batch in batches:
            ids = np.array(batch.column(0).fill_null("null").to_pylist(), dtype=np.str_)
            for lo, hi, w in tv.words_of(batch.column(1), tv.ALNUM, 1 << 20):
                h, count = w.hashes(), np.diff(w.doc)
                each = np.where(count == 0, 0, np.maximum(count - window + 1, 1))
                of = np.repeat(np.arange(len(each)), each)
                at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + w.doc[of]
                size = np.minimum(window, count[of])
                terms = np.zeros((len(of), window), np.uint64)
                for j in range(window):
                    some = size > j
                    terms[some, j] = h[at[some] + j]
                for a in range(0, len(of), WINDOWS):
                    name = f"{folder}/windows-{uuid.uuid4().hex}"
                    for k, v in (("terms", terms), ("size", size), ("item", ids[lo + of])):
                        write_array(f"{name}-{k}.npy", v[a : a + WINDOWS])
                    yield pa.record_batch([pa.array([name])], names=["block"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, "block string").collect()
    return sorted(r["block"] for r in rows)


class Block:
    """One block of test windows: `size` and `item` of each, its distinct terms once, and where each window's terms are among these."""

    def __init__(self, name: str):
        terms, self.size, self.item = (map_array(f"{name}-{k}.npy") for k in ("terms", "size", "item"))
        self.terms, inverse = np.unique(terms, return_inverse=True)
        self.of = inverse.reshape(terms.shape).astype(np.int32)
        self.unused = np.arange(terms.shape[1]) >= self.size[:, None]


class Segment:
    """One mapped segment."""

    def __init__(self, file: str, at: int, size: int):
        self.terms, self.ends, self.places, self.docs, self.ids, self.null, self.hash = map_sections(file, at, size)

    def _list(self, term: int) -> np.ndarray:
        return self.places[self.ends[term - 1] if term else 0 : self.ends[term]]

    def find(self, block: Block, slop: int = 0):
        """Yields (window, first words of its occurrences, words an occurrence spans)."""
        if not len(self.terms):
            return
        at = np.searchsorted(self.terms, block.terms)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == block.terms
        place = np.where(there, at, -1)
        size = block.size
        for i in np.flatnonzero((there[block.of] | block.unused).all(1)):
            own = place[block.of[i, : size[i]]]
            count = self.ends[own] - np.where(own > 0, self.ends[own - 1], 0)
            order = np.argsort(count, kind="stable")
            start = self._list(own[order[0]]).astype(np.int64)
            if slop:
                found = self._close(start, own, size[i] + slop)
                if len(found):
                    yield i, found, int(size[i]) + slop
                continue
            start = start - order[0]
            for j in order[1:]:
                if not len(start):
                    break
                other = self._list(own[j])
                want = start + j
                near = np.searchsorted(other, want)
                near[near == len(other)] = 0
                start = start[other[near] == want]
            if len(start):
                owner = np.searchsorted(self.docs, start, side="right")
                start = start[(start >= 0) & (self.docs[np.minimum(owner, len(self.docs) - 1)] >= start + size[i])]
            if len(start):
                yield i, start, int(size[i])

    def _close(self, rare: np.ndarray, own: np.ndarray, span: int) -> np.ndarray:
        """Starts of stretches of `span` words of one text that hold all these terms, one for each place of the rarest that has any."""
        lists = [self._list(t) for t in np.unique(own)]
        out = []
        for p in rare:
            lo, hi = self.docs[np.searchsorted(self.docs, p, side="right") - 1], self.docs[np.searchsorted(self.docs, p, side="right")]
            for s in range(max(lo, p - span + 1), min(p, hi - 1) + 1):
                if all(np.searchsorted(x, s) < np.searchsorted(x, min(s + span, hi)) for x in lists):
                    out.append(s)
                    break
        return np.array(out, np.int64)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = 0, share: int = 20) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items array<string>, contaminated, whole), one row per row of docs; text_hash: xxhash64(text).

    A word is hit if it stands in any occurrence of an item's window of `window` words (of all the item's words, if fewer); contaminated: some
    word is hit, and at least one in `share`; whole: some window of just `window` words occurs.  Items are sorted as strings; rows with one item_id are one item, a null item_id is the
    item "null".  Null, empty or wordless texts have no words and are not contaminated; wordless items match nothing; without items nothing is
    hit.  Repeated rows give repeated rows.  A text of any length is searched whole, in one segment.  The result is written to the shared folder and the index is then removed.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "posindex")
    names = test_windows(items, folder, item_col, item_text, window)
    build(docs, folder, id_col, text_col).write.parquet(f"{folder}/segments")
    segments = spark.read.schema(_SEGMENTS).parquet(f"{folder}/segments")

    @tidy
    def search(batches):
        blocks: dict[str, Block] = {}
        for batch in batches:
            for file, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                s = Segment(file, at, length)
                n = int(s.docs[-1])
                cover = np.zeros(n + 1, np.int64)
                hits: list[tuple[np.ndarray, str]] = []
                whole = np.zeros(len(s.docs) - 1, bool)
                for name in names:
                    if name not in blocks:
                        if len(blocks) >= HELD:
                            blocks.clear()
                        blocks[name] = Block(name)
                    b = blocks[name]
                    for i, start, span in s.find(b, slop):
                        owner = np.searchsorted(s.docs, start, side="right") - 1
                        np.add.at(cover, start, 1)
                        np.add.at(cover, np.minimum(start + span, s.docs[owner + 1]), -1)
                        whole[owner] |= b.size[i] == window
                        hits.append((np.unique(owner), str(b.item[i])))
                hit = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
                n_words, n_hit = np.diff(s.docs), hit[s.docs[1:]] - hit[s.docs[:-1]]
                found: dict[int, set[str]] = {}
                for owners, item_id in hits:
                    for o in owners.tolist():
                        found.setdefault(o, set()).add(item_id)
                own = [sorted(found.get(o, ())) for o in range(len(n_words))]
                ids = pa.array(s.ids, pa.int64(), mask=np.asarray(s.null))
                yield pa.record_batch(
                    [ids, pa.array(np.asarray(s.hash)), pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array((n_hit > 0) & (share * n_hit >= n_words)), pa.array(whole)],
                    names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items", "contaminated", "whole"],
                )

    schema = "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, whole boolean"
    result = workspace(spark, "contamination")
    segments.repartition(max(1, min(segments.count(), 100_000))).mapInArrow(search, schema).write.mode("overwrite").parquet(f"{result}/rows")
    remove(folder)
    return spark.read.schema(schema).parquet(f"{result}/rows")
