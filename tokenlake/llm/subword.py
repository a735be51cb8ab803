"""Quality classifier on supervised subword embeddings.

A text is the mean of the learned vectors of its hashed features: words, character n-grams of each word between its end marks, and pairs of
neighbouring words (with one feature for a word that repeats the one before).  A softmax layer on the mean gives the classes; both are trained together by
stochastic gradient descent in NumPy, in one task, on a bounded sample of labelled rows.  As the mean and the layer are linear, a feature
adds one number to a text's margin, so scoring needs one table of numbers and goes through whole texts in array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import small_batches, tidy

#: How often a pair of neighbouring words counts, as each word has many features of its own.
PAIR = 4
#: Bytes of text whose features a worker holds at once: they take some hundred times as much.
BLOCK = 1 << 18
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _characters(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8, its bytes from the lowest on, and where it begins."""
    first = (text & 0xC0) != 0x80
    value, inside = text.astype(np.uint64), np.ones(len(text), bool)
    for j in range(1, 4):
        if len(text) > j:
            inside[:-j] &= ~first[j:]
            inside[-j:] = False
            value[:-j] |= np.where(inside[:-j], text[j:].astype(np.uint64) << np.uint64(8 * j), np.uint64(0))
    at = np.flatnonzero(first)
    return value[at], at


class Features:
    """Features of a block of texts: of each distinct word its own, and of each word but the first of its text that of the pair."""

    def __init__(self, w: tv.Words, buckets: int, grams: tuple[int, ...]):
        self.w, mask = w, np.uint64(buckets - 1)
        h = w.hashes()
        unique, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        size = np.diff(w.start)[first] - 1
        begin = np.concatenate(([0], np.cumsum(size + 2)))
        at = np.arange(begin[-1]) + np.repeat(w.start[first] - begin[:-1] - 1, size + 2)
        text = w.text[np.clip(at, 0, max(len(w.text) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
        text[begin[:-1]], text[begin[1:] - 1] = 0x02, 0x03
        found, owner = [tv.mix(unique ^ _SALT[0]) & mask], [np.arange(len(unique))]
        word = np.repeat(np.arange(len(unique)), size + 2)
        value, chars = _characters(text)
        word = word[chars]
        left = np.cumsum(np.bincount(word, minlength=len(unique)))[word] - np.arange(len(word))
        value = tv.mix(value + _SALT[1])
        for n in grams:
            if len(value) >= n:
                ok = np.flatnonzero(left[: len(value) - n + 1] >= n)
                found.append(tv.mix(tv.rolling(value, n)[ok] + np.uint64(n)) & mask)
                owner.append(word[ok])
        self.bucket, self.owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
        self.types = len(unique)
        self.per_word = np.bincount(self.owner, minlength=self.types)
        inner = np.ones(w.n, bool)
        inner[w.doc[:-1][w.doc[:-1] < w.n]] = False
        self.second = np.flatnonzero(inner)
        a, b = h[self.second - 1], h[self.second]
        self.pair = np.where(a == b, np.uint64(0), tv.mix(a * _SALT[2] + b) & mask).astype(np.int64)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text, its features and how large a part of all its features each is."""
        order = np.argsort(self.owner, kind="stable")
        ends = np.concatenate(([0], np.cumsum(self.per_word)))
        out = []
        for a, b in zip(self.w.doc[:-1], self.w.doc[1:]):
            types, n = np.unique(self.of[a:b], return_counts=True)
            take = np.arange(self.per_word[types].sum()) + np.repeat(ends[types] - np.cumsum(self.per_word[types]) + self.per_word[types], self.per_word[types])
            lo, hi = np.searchsorted(self.second, (a, b))
            each = np.concatenate((self.bucket[order[take]], self.pair[lo:hi]))
            weight = np.concatenate((np.repeat(n, self.per_word[types]), np.full(hi - lo, PAIR)))
            keys, inverse = np.unique(each, return_inverse=True)
            total = np.bincount(inverse, weight, minlength=len(keys)) if len(keys) else np.zeros(0)
            out.append((keys.astype(np.int32), (total / max(total.sum(), 1)).astype(np.float32)))
        return out

    def means(self, table: np.ndarray) -> np.ndarray:
        """The mean of each text's feature values; 0 without features."""
        words = np.bincount(self.owner, table[self.bucket], minlength=self.types)
        total = np.concatenate(([0.0], np.cumsum(words[self.of])))
        number = np.concatenate(([0], np.cumsum(self.per_word[self.of])))
        pairs = np.zeros(self.w.n)
        pairs[self.second] = PAIR * table[self.pair]
        pairs = np.concatenate(([0.0], np.cumsum(pairs)))
        lo, hi = self.w.doc[:-1], self.w.doc[1:]
        n = number[hi] - number[lo] + PAIR * np.maximum(hi - lo - 1, 0)
        return (total[hi] - total[lo] + pairs[hi] - pairs[lo]) / np.maximum(n, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Trains vectors and softmax layer; returns each bucket's number and the constant of the margin (label 1 against label 0)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 1 / dim, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    squares, square_layer, square_bias = np.full(buckets, 1e-10, np.float32), np.full((2, dim), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            keys, weight = rows[i]
            own = vectors[keys]
            mean = weight @ own if len(keys) else np.zeros(dim, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            down = error @ layer
            grad = np.outer(error, mean)
            square_layer += grad * grad
            square_bias += error * error
            if len(keys):
                squares[keys] += weight * weight * float(down @ down) / dim
                vectors[keys] = own - (now * weight / np.sqrt(squares[keys]))[:, None] * down
            layer -= now * grad / np.sqrt(square_layer)
            bias -= now * error / np.sqrt(square_bias)
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def classify(
    docs: DataFrame, labels: DataFrame, held_out: str, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_rows: int = 6000, buckets: int = 1 << 18, dim: int = 12, epochs: int = 6, rate: float = 0.15, grams: tuple[int, ...] = (2, 3, 4), seed: int = 7, threshold: float = 0.7,
) -> DataFrame:
    """(row struct of `columns`, held_out, score, predicted), one row per row of docs.

    held_out: SQL condition on rows whose labels are not learnt from (null: false).  At most `train_rows` labelled rows are learnt from, those whose ids have the smallest
    hashes; labels other than 0 and 1 are ignored, and an id with several labels counts with each.  score: probability of label 1.  A null,
    empty or wordless text has no features and gets the constant's probability.  Without any label every score is 0.5.  Texts of any length are taken whole; repeated rows are
    scored alike, and learnt from each time.  An empty table gives none.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    allowed = labels.where(~F.coalesce(F.expr(held_out), F.lit(False)))
    known = allowed.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    chosen = texts.join(F.broadcast(sample), "id").select("id", "t", "y")  # train_rows rows at most

    @tidy
    def featurize(batches):
        for batch in batches:
            for lo, hi, w in tv.words_of(batch.column(1), tv.PLAIN, BLOCK):
                rows = Features(w, buckets, grams).counts()
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["id", "y", "keys", "weight"])

    @tidy
    def learn(batches):
        rows, y, ids = [], [], []
        for batch in batches:
            rows += [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.float32)) for a, b in zip(batch.column(2), batch.column(3))]
            y += batch.column(1).to_pylist()
            ids += batch.column(0).to_pylist()
        # By what the rows hold, not by how they arrived: a repeated task learns the same.
        order = sorted(range(len(ids)), key=lambda i: (ids[i], y[i], xxhash.xxh3_64_intdigest(rows[i][0].tobytes() + rows[i][1].tobytes())))
        table, constant = fit([rows[i] for i in order], np.array(y, int)[order] if y else np.zeros(0, int), buckets, dim, epochs, rate, seed) if y else (np.zeros(buckets), 0.0)
        yield pa.record_batch([pa.array([table.astype(np.float32).tobytes()], pa.binary()), pa.array([constant], pa.float64())], names=["table", "constant"])

    features = chosen.mapInArrow(featurize, "id long, y int, keys binary, weight binary")
    model = features.repartition(1).mapInArrow(learn, "table binary, constant double").first()
    held = spark.sparkContext.broadcast((np.frombuffer(bytes(model["table"]), np.float32).astype(np.float64), model["constant"]))  # 8 bytes a bucket

    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or [id_col]]).alias("row"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("t"))

    @tidy
    def run(batches):
        table, constant = held.value
        for batch in batches:
            for lo, hi, w in tv.words_of(batch.column(2), tv.PLAIN, BLOCK):
                score = 1 / (1 + np.exp(-(Features(w, buckets, grams).means(table) + constant)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "held_out", "score", "predicted"])

    schema = carried.select("row").schema.simpleString()[len("struct<row:") : -1]
    return carried.mapInArrow(run, f"row {schema}, held_out boolean, score double, predicted int")
