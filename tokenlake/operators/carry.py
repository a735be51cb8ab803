"""Exact scans of texts cut anywhere, for token sets without lag.

Where a match that has once been acceptable stays so until it ends (lag 0), the longest match is found without looking ahead: a scan is a plain run of
the automaton that begins anew where it dies.  What a piece of text does to such a run is a function from states to states.  Pieces
compute theirs apart; composing them in order, a prefix aggregate, tells the state that each piece begins in, and then all pieces are
scanned apart.  No certified byte or window is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread
from .lexer import Lexer

#: Bytes of pieces whose tokens are held at once.
BLOCK = 1 << 18


class Carry:
    """States are the automaton's; one more, the last, stands for a scan that has failed."""

    def __init__(self, lexer: Lexer):
        if lexer.nullable or lexer.lag != 0:
            raise ValueError("only a token set without lag, none of whose tokens may be empty, is scanned by carrying states")
        delta, accepting = lexer.dfa.delta, lexer.accepting
        self.failed = len(delta)
        after = np.where((delta < 0) & accepting[:, None], delta[0], delta)
        self.step = np.vstack((np.where(after < 0, self.failed, after), np.full(256, self.failed))).tolist()
        self.restarts = np.vstack(((delta < 0) & accepting[:, None], np.zeros((1, 256), bool))).tolist()
        self.kinds = [*lexer.dfa.accept.tolist(), -1]

    def effect(self, data: bytes) -> list[int]:
        """The state that each state is in after the bytes.  States that have met are followed once."""
        now = list(range(self.failed + 1))
        of = list(now)
        for i, b in enumerate(data):
            if len(now) == 1:
                return [self.run(data[i:], now[0])] * len(of)
            after = [self.step[s][b] for s in now]
            distinct = sorted(set(after))
            if len(distinct) < len(now):
                place = {s: k for k, s in enumerate(distinct)}
                of = [place[after[k]] for k in of]
                after = distinct
            now = after
        return [now[k] for k in of]

    def passage(self, data: bytes) -> tuple[list[int], list[int]]:
        """Of each state, the state after the bytes, and where in them the last token ends that ends before one of them; -1 if none does."""
        now, of, back = list(range(self.failed + 1)), list(range(self.failed + 1)), [-1] * (self.failed + 1)
        for i, b in enumerate(data):
            if len(now) == 1:
                # All go on as one.
                state, at = now[0], -1
                step, restarts = self.step, self.restarts
                for j in range(i, len(data)):
                    if restarts[state][data[j]]:
                        at = j
                    state = step[state][data[j]]
                return [state] * len(of), [at if at >= 0 else x for x in back]
            ended = [self.restarts[s][b] for s in now]
            if any(ended):
                back = [i if ended[k] else x for k, x in zip(of, back)]
            after = [self.step[s][b] for s in now]
            now = sorted(set(after))
            place = {s: k for k, s in enumerate(now)}
            of = [place[after[k]] for k in of]
        return [now[k] for k in of], back

    def run(self, data: bytes, state: int) -> int:
        step = self.step
        for b in data:
            state = step[state][b]
        return state

    def ends(self, data: bytes, state: int, last: bool) -> list[tuple[int, int]]:
        """(offset, kind) of each token that ends in these bytes, before a byte of theirs or, in a text's last piece, at their end."""
        out, step, restarts, kinds = [], self.step, self.restarts, self.kinds
        for i, b in enumerate(data):
            if restarts[state][b]:
                out.append((i, kinds[state]))
            state = step[state][b]
        if last and kinds[state] >= 0:
            out.append((len(data), kinds[state]))
        return out


def _blocks(sizes: list[int]):
    """Rows whose data make up about BLOCK bytes, one at least."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > BLOCK:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _ended(docs: DataFrame, lexer: Lexer, piece: int, key: str, data: str, tallied: bool) -> DataFrame:
    """(key, kind, start, length) of each token or, tallied, (key, kind, tokens, bytes) of each piece and kind.

    With the state, the place where the open token began is carried over the cuts, so pieces know their tokens' lengths by themselves and no token travels.
    """
    carry, key_type = Carry(lexer), docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data")).where("octet_length(data) > 0")
    count = F.ceil(F.octet_length("data") / piece).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk"), F.substring(F.col("data"), i * piece + 1, F.lit(piece)).alias("data")))
    pieces = texts.select("key", count.alias("chunks"), F.explode(cut).alias("piece")).select("key", "piece.chunk", "chunks", "piece.data")
    several = pieces.where("chunks > 1").repartition("key", "chunk")

    def effects(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_pylist()
            for lo, hi in _blocks(sizes):
                found = [carry.passage(d) for d in batch.column(2).slice(lo, hi - lo).to_pylist()]
                lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], names=["key", "chunk", "effect", "last"])

    # A text of one piece begins as it is; only those of several are composed.
    done = several.select("key", "chunk", "data").mapInArrow(effects, f"key {key_type}, chunk int, effect array<int>, last array<int>")
    listed = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "effect", "last"))).alias("all"))
    zero = F.array(F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("open")))

    def through(have, x):
        now = F.element_at(have, -1)
        at = F.element_at(x["last"], now["state"] + 1)
        began = F.when(at >= 0, x["chunk"].cast("long") * piece + at).otherwise(now["open"])
        return F.concat(have, F.array(F.struct(F.element_at(x["effect"], now["state"] + 1).alias("state"), began.alias("open"))))

    begins = listed.select("key", F.posexplode(F.aggregate("all", zero, through)).alias("chunk", "begin")).select("key", "chunk", "begin.state", "begin.open")
    placed = several.join(begins, ["key", "chunk"]).select("key", "chunk", "chunks", "data", "state", "open")
    placed = placed.unionByName(spread(pieces.where("chunks = 1")).withColumns({"state": F.lit(0), "open": F.lit(0).cast("long")}))

    def ends(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).to_pylist()
            for lo, hi in _blocks(sizes):
                part = batch.slice(lo, hi - lo)
                chunk, chunks, texts, state, opened = (part.column(i).to_pylist() for i in (1, 2, 3, 4, 5))
                found = [carry.ends(d, s, c + 1 == n) for c, n, d, s in zip(chunk, chunks, texts, state)]
                own = np.repeat(np.arange(len(found)), [len(f) for f in found])
                end, kind = (np.fromiter((t[i] for f in found for t in f), np.int64, len(own)) for i in (0, 1))
                end += np.array(chunk, np.int64)[own] * piece
                first = np.flatnonzero(np.diff(own, prepend=-1))
                start = np.concatenate(([0], end[:-1])) if len(end) else end
                start[first] = np.array(opened, np.int64)[own[first]]
                if tallied:
                    width = max(carry.kinds) + 1
                    n, size = np.bincount(own * width + kind), np.bincount(own * width + kind, end - start)
                    has = np.flatnonzero(n)
                    own, columns = has // width, [has % width, n[has], size[has].astype(np.int64)]
                else:
                    columns = [kind, start, end - start]
                yield pa.record_batch([part.column(0).take(pa.array(own)), *(pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns)], names=names)

    names = ["key", "kind", "tokens", "bytes"] if tallied else ["key", "kind", "start", "length"]
    return placed.select("key", "chunk", "chunks", "data", "state", "open").mapInArrow(ends, f"key {key_type}, " + ", ".join(f"{n} long" for n in names[1:]))


def tokenize(docs: DataFrame, lexer: Lexer, piece: int = 1 << 20, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, kind, start, length): the serial scan's tokens, from pieces of a fixed number of bytes scanned apart.

    Keys must be distinct.  A token belongs to where it ends, so one that runs over pieces is found by the piece that ends it.
    """
    return _ended(docs, lexer, piece, key, data, False).withColumnRenamed("key", key)


def kind_counts(docs: DataFrame, lexer: Lexer, piece: int = 1 << 20, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, kind, tokens, bytes) of each text and kind, from the same pieces: tallies made where the tokens are."""
    found = _ended(docs, lexer, piece, key, data, True).groupBy("key", "kind").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    return found.withColumnRenamed("key", key)
