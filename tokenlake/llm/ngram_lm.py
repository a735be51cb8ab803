"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Words are 64-bit hashes; a word's id is its place among all sorted hashes, so a bigram is one 64-bit key of two ids, exactly.
Counting sums sorted arrays of each block of texts before they travel, in shards that follow from a hash of the first word; of
the few words that make up a large part of all tokens the pairs are spread over all shards, and their sums are put together
afterwards.  The order is two; the README has what trigram counts were measured to take.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import HashStore, pack, remove, shard_bits, shard_of, text_bytes, tidy, unpack, workspace

#: Hash of the end of a text, a token like any other.
END = np.uint64(0x9AE16A3B2F90404F)
#: A word with more than this part of all tokens is spread: at most 1 / HOT words.
HOT = 0.0005
#: Keys that a task sorts and sums at once.
KEYS = 6_000_000
#: Tokens that a task looks up at once.  Those of one block of texts touch most shards of a large input, so it takes many blocks' together.
TOKENS = 1_000_000


def tokens(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end; where each text ends."""
    count = np.diff(w.doc)
    ends = np.cumsum(count + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = w.hashes()
    return out, ends


def _sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts, np.diff(np.append(first, len(keys)))


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def _send(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """Rows (shard, keys, counts) of sorted keys inside ascending shards."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)])) if len(keys) else np.zeros(1, int)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = _narrow(counts[a:b])
        rows.append((int(shard[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0))), n.itemsize, pack(n)))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int32(), pa.binary()))], names=["shard", "keys", "width", "counts"]) if rows else None


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")]
    counts = [unpack(x.as_py(), f"u{k.as_py()}").astype(np.int64) for x, k in zip(table.column("counts"), table.column("width"))]
    return np.concatenate(keys), np.concatenate(counts)


def _gathered(batches, column: int):
    """Tokens of TOKENS tokens' blocks of texts or so, where each text ends, and the rows that they come from, as (other columns, number) for each block."""
    held, rows, n = [], [], 0
    for batch in batches:
        for lo, hi, w in tv.words_of(batch.column(column), tv.LOWER):
            t, ends = tokens(w)
            held.append((t, ends + n))
            rows.append(([c.slice(lo, hi - lo) for i, c in enumerate(batch.columns) if i != column], hi - lo))
            n += len(t)
            del w, t, ends
            if n >= TOKENS:
                yield *map(np.concatenate, zip(*held)), rows
                held, rows, n = [], [], 0
    if held:
        yield *map(np.concatenate, zip(*held)), rows


def _counted(batches, keys_of):
    """Distinct keys and counts of every KEYS keys or so: what a task sums before it sends."""
    held: list[np.ndarray] = []
    for t, ends, _ in _gathered(batches, 0):
        held.append(keys_of(t, ends))
        if sum(map(len, held)) >= KEYS:
            yield np.unique(np.concatenate(held), return_counts=True)
            held = []
    if sum(map(len, held)):
        yield np.unique(np.concatenate(held), return_counts=True)


_ROWS = "shard int, keys binary, width int, counts binary"


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of types seen once to four times; 0.5, 1, 1.5 where they don't determine it."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d[1:] > 0).all() and (d[1:] < [1, 2, 3]).all() else np.array([0, 0.5, 1.0, 1.5])


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that belong to all of them."""

    folder: str
    words: HashStore
    pairs: HashStore
    contexts: HashStore
    hot_contexts: HashStore
    follows: HashStore
    id_base: np.ndarray
    hot: np.ndarray
    train_tokens: int = 0
    vocabulary: int = 0
    pair_types: int = 0
    d1: np.ndarray = field(default_factory=lambda: np.zeros(4))
    d2: np.ndarray = field(default_factory=lambda: np.zeros(4))
    spare: float = 0.0

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted unique hashes: which are known, ids, counts."""
        found, got = self.words.lookup(hashes)
        ids = self.id_base[shard_of(hashes, self.words.bits)] + got["at"]
        return found, ids.astype(np.uint64), np.where(found, got["n"], 0).astype(np.int64)

    def shard(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        h = tv.mix(first + np.uint64(1))
        at = np.searchsorted(self.hot, first)
        at[at == len(self.hot)] = 0
        spread = self.hot[at] == first if len(self.hot) else np.zeros(len(first), bool)
        return shard_of(np.where(spread, tv.mix(second + h), h), self.pairs.bits)

    def lower(self, found: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Probability of words by the number of different words that they follow."""
        uniform = 1.0 / (self.vocabulary + 1)
        if not self.pair_types:
            return np.full(len(found), uniform)
        seen = np.where(found, follows, 0).astype(np.float64)
        return np.maximum(seen - self.d1[np.minimum(seen, 3).astype(int)], 0) / self.pair_types + self.spare * uniform


def train(texts: DataFrame) -> Model:
    """texts: (t string), every row learnt from; null counts as empty."""
    spark: SparkSession = texts.sparkSession
    folder = workspace(spark, "lm")
    size = text_bytes(texts, "t")
    bits = shard_bits(size, 32e6)
    words = HashStore(folder, "words", bits, ("n",))

    def count_words(batches):
        for keys, n in _counted(batches, lambda t, _: t):
            yield _send(shard_of(keys, bits), keys, n)

    def gather_words(key, table):
        keys, n, _ = _sum_sorted(*_received(table))
        words.write(key[0].as_py(), key=keys, n=_narrow(n))
        top = np.argsort(-n, kind="stable")[: int(1 / HOT)]
        return pa.table({"shard": [key[0].as_py()], "types": [len(keys)], "tokens": [int(n.sum())], "at": [top.tolist()], "n": [n[top].tolist()]})

    rows = texts.mapInArrow(count_words, _ROWS).groupBy("shard").applyInArrow(gather_words, "shard long, types long, tokens long, at array<long>, n array<long>").checkpoint()
    totals = rows.select("shard", "types", "tokens").collect()  # one row a shard
    base = np.zeros((1 << bits) + 1, np.int64)
    for r in totals:
        base[r["shard"] + 1] = r["types"]
    base = np.cumsum(base)
    n_tokens = sum(r["tokens"] for r in totals)
    start = int(base[-1])  # the id of the place before a text
    if start >= 0xFFFFFFFF:
        raise ValueError(f"{start} different words: ids of 32 bits don't tell them apart")
    frequent = rows.select("shard", F.explode(F.arrays_zip("at", "n")).alias("x")).where(F.col("x.n") > HOT * n_tokens).select("shard", "x.at").collect()
    hot = np.array(sorted({int(base[r["shard"]] + r["at"]) for r in frequent} | {start}), np.uint64)
    model = Model(folder, words, HashStore(folder, "pairs", bits, ("n",)), HashStore(folder, "contexts", bits, ("total", "n1", "n2", "n3")), HashStore(folder, "hot", 0, ("total", "n1", "n2", "n3")), HashStore(folder, "follows", bits, ("n",)), base, hot, n_tokens, start)
    held = model

    def count_pairs(batches):
        for keys, n in _counted(batches, lambda t, ends: pair_keys(held, t, ends)[0]):
            shard = held.shard(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF))
            order = np.argsort(shard, kind="stable")
            yield _send(shard[order], keys[order], n[order])

    def gather_pairs(key, table):
        shard = key[0].as_py()
        keys, n, _ = _sum_sorted(*_received(table))
        held.pairs.write(shard, key=keys, n=_narrow(n))
        first = keys >> np.uint64(32)
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        sums = [np.add.reduceat(x.astype(np.int64), cut) for x in (n, n == 1, n == 2, n >= 3)]
        known = first[cut]
        spread = np.isin(known, held.hot)
        held.contexts.write(shard, key=known[~spread], **{c: _narrow(s[~spread]) for c, s in zip(("total", "n1", "n2", "n3"), sums)})
        second, _, times = _sum_sorted(keys & np.uint64(0xFFFFFFFF), n)
        to = shard_of(tv.mix(second), bits)
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(second)]))
        rows = [(int(to[order[a]]), pack(np.diff(second[order[a:b]], prepend=np.uint64(0))), 8, pack(times[order[a:b]].astype(np.int64))) for a, b in zip(cuts[:-1], cuts[1:])]
        out = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int32(), pa.binary()))], names=["shard", "keys", "width", "counts"])
        few = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]
        tops = [[int(known[i]), *(int(s[i]) for s in sums)] for i in np.flatnonzero(spread)]
        stats = pa.array([few] + [None] * (len(rows) - 1), pa.list_(pa.int64()))
        tops = pa.array([tops] + [None] * (len(rows) - 1), pa.list_(pa.list_(pa.int64())))
        return out.append_column("stats", stats).append_column("tops", tops)

    sent = texts.mapInArrow(count_pairs, _ROWS).groupBy("shard").applyInArrow(gather_pairs, f"{_ROWS}, stats array<long>, tops array<array<long>>")
    sent.write.parquet(f"{folder}/sent")
    sent = spark.read.parquet(f"{folder}/sent")
    few = sent.where("stats is not null").select(*[F.sum(F.col("stats")[i]).alias(f"n{i}") for i in range(5)]).first()
    few = [int(x or 0) for x in few]
    model.d2, model.pair_types = discounts(few[:4]), few[4]
    top = sent.where("tops is not null").select(F.explode("tops").alias("x")).groupBy(F.col("x")[0].alias("id")).agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(1, 5)])
    tops = np.array([list(r) for r in top.collect()], np.int64).reshape(-1, 5)  # at most 1 / HOT + 1 rows
    tops = tops[np.argsort(tops[:, 0])]
    model.hot_contexts.write(0, key=tops[:, 0].astype(np.uint64), total=tops[:, 1], n1=tops[:, 2], n2=tops[:, 3], n3=tops[:, 4])

    def gather_follows(key, table):
        keys, n, _ = _sum_sorted(*_received(table))
        held.follows.write(key[0].as_py(), key=keys, n=_narrow(n))
        return pa.table({"few": [[int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]]})

    each = sent.select("shard", "keys", "width", "counts").groupBy("shard").applyInArrow(gather_follows, "few array<long>")
    few = [int(x or 0) for x in each.select(*[F.sum(F.col("few")[i]).alias(f"n{i}") for i in range(5)]).first()]
    model.d1 = discounts(few[:4])
    model.spare = float(model.d1[1] * few[0] + model.d1[2] * few[1] + model.d1[3] * few[4]) / max(model.pair_types, 1)
    return model


def pair_keys(model: Model, t: np.ndarray, ends: np.ndarray):
    """Bigram keys of all tokens (id 2**32 - 1: unknown), with what scoring needs besides."""
    unique, inverse = np.unique(t, return_inverse=True)
    found, ids, n = model.ids(unique)
    ids = np.where(found, ids, np.uint64(0xFFFFFFFF))
    own = ids[inverse]
    before = np.empty_like(own)
    if len(own):
        before[1:] = own[:-1]
        before[np.concatenate(([0], ends[:-1]))] = np.uint64(model.vocabulary)
    return (before << np.uint64(32)) | own, inverse, found, ids, n


def token_scores(model: Model, w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of the texts: whether it is known, its base score, the model's log10 probability."""
    return _scores(model, *tokens(w))


def _scores(model: Model, t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, inverse, found, ids, n = pair_keys(model, t, ends)
    base = np.log10((n + 0.1) / (model.train_tokens + 0.1 * (model.vocabulary + 1)))[inverse]
    order = np.argsort(tv.mix(ids), kind="stable")
    seen, got = model.follows.lookup(ids[order], shard_of(tv.mix(ids[order]), model.follows.bits)) if len(ids) else (found, {"n": n})
    low = np.empty(len(ids))
    low[order] = model.lower(seen & found[order], got["n"])
    unique, back = np.unique(keys, return_inverse=True)
    del keys
    first, second = unique >> np.uint64(32), unique & np.uint64(0xFFFFFFFF)
    shard = model.shard(first, second)
    order = np.argsort(shard, kind="stable")
    there, got = model.pairs.lookup(unique[order], shard[order])
    pairs = np.zeros(len(unique))
    pairs[order] = np.where(there, got["n"], 0)
    del second, shard, there, got
    context, of = np.unique(first, return_inverse=True)
    home = shard_of(tv.mix(context + np.uint64(1)), model.contexts.bits)
    order = np.argsort(home, kind="stable")
    sums = np.zeros((4, len(context)))
    for store, picked, where in ((model.contexts, order, home[order]), (model.hot_contexts, np.arange(len(context)), np.zeros(len(context), np.int32))):
        there, got = store.lookup(context[picked], where)
        for i, c in enumerate(("total", "n1", "n2", "n3")):
            sums[i, picked[there]] = got[c][there]
    total = np.maximum(sums[0], 1)[of]
    weight = np.where(sums[0] > 0, (model.d2[1] * sums[1] + model.d2[2] * sums[2] + model.d2[3] * sums[3]) / np.maximum(sums[0], 1), 1.0)[of]
    high = np.maximum(pairs - model.d2[np.minimum(pairs, 3).astype(int)], 0) / total
    return (n > 0)[inverse], base, np.log10(high[back] + weight[back] * low[inverse])


def score_words(model: Model, w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, known tokens, base score, the model's log10 probability."""
    return _text_scores(model, *tokens(w))


def _text_scores(model: Model, t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    known, base, probability = _scores(model, t, ends)
    count = np.diff(ends, prepend=0)
    begin = ends - count
    add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
    return count, add(known.astype(np.int64)), add(base), add(probability)


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    held_out: SQL condition on the rows that are not learnt from (null: learnt from).  score: log10 probability of the text, its end
    included; perplexity is 10 ** (-score / n_tokens).  Null text: empty, one token.  Texts of any length are taken whole, a null id's too.  Repeated rows are learnt from each time.  Without
    training rows every token is unknown and has the uniform probability.  The model is removed when all is scored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    model = train(rows.where("not held_out").select("t"))

    @tidy
    def run(batches):
        for t, ends, blocks in _gathered(batches, 1):
            n, known, base, total = _text_scores(model, t, ends)
            hi = 0
            for own, length in blocks:
                lo, hi = hi, hi + length
                yield pa.record_batch(
                    [*own, pa.array(n[lo:hi].astype(np.int64)), pa.array(known[lo:hi].astype(np.int64)), pa.array(np.full(length, model.train_tokens)), pa.array(base[lo:hi]), pa.array(total[lo:hi])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = workspace(spark, "lm-scores")
    rows.mapInArrow(run, schema).write.parquet(f"{result}/rows")
    remove(model.folder)
    return spark.read.schema(schema).parquet(f"{result}/rows")
