"""Scans of DataFrames of texts: one row a text in, one row a token out.

A worker scans a whole Arrow batch at once.  Where the token set proves token boundaries close together (certified bytes; certified windows of two bytes
where every text is known to scan wholly), the pieces between them are lanes that step through the automaton together in array operations.
Where boundaries are far apart, or a lane is long, tokens are followed one by one, and a run of bytes on which the automaton stays where it is
is one step.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread
from . import native
from .lexer import Lexer
from .modes import ModalLexer, Stack

#: Steps that lanes take together; mean bytes of a lane from which on tokens are followed one by one; bytes of text scanned at once.
STEPS, LANE, BLOCK = 64, 24, 1 << 20


class BatchScanner:
    """Longest matches over many texts in one buffer.  text: the inputs are valid UTF-8."""

    def __init__(self, lexer: Lexer, text: bool = False):
        # Rows are one width apart for each class, so one addition and one look-up make a step.  State 0 is death, state 1 the start.
        self.width = lexer.table.shape[1]
        self.flat = np.ascontiguousarray(lexer.table.reshape(-1))
        self.byte_row = (lexer.byte_class * self.width).astype(np.int32)
        self.flags = lexer.flags
        self.accept = np.concatenate(([-1], lexer.dfa.accept)).astype(np.int64)
        self.cut_bytes = lexer.split_points
        self.windows = lexer.pair_windows if lexer.total or text and lexer.covers_utf8 else None
        self.lexer = lexer

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where lanes begin: each text, and each proved boundary."""
        mask = self.cut_bytes[raw]
        if self.windows is not None and len(raw) > 1:
            origin = self.windows[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(raw))]
            origin[edges - 1] = -1
            mask[1:] |= origin == 1
            mask[:-1] |= origin == 0
        mask[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(mask)

    def _lanes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, length: np.ndarray, kind: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
        """Scans all lanes together; where lanes failed, and (place, end) of lanes that are not done."""
        rows = self.byte_row[raw]
        failed: list[int] = []
        pos, head, best, won, state = start.copy(), start, start.copy(), np.zeros(len(start), np.int32), np.ones(len(start), np.int32)
        for _ in range(STEPS):
            state = self.flat[rows[pos] + state]
            alive = state > 0
            pos = pos + alive
            hit = self.flags[state]
            best, won = np.where(hit, pos, best), np.where(hit, state, won)
            done = ~alive | (pos == end)
            if done.any():
                ends = np.flatnonzero(done)
                h, e = head[ends], best[ends]
                stuck = e == h
                failed += h[stuck].tolist()
                good = ~stuck
                length[h[good]], kind[h[good]] = (e - h)[good], self.accept[won[ends[good]]]
                pos[ends] = e
                head = np.where(done, best, head)
                state[ends], won[ends] = 1, 0
                gone = np.zeros(len(pos), bool)
                gone[ends[stuck | (e >= end[ends])]] = True
                if gone.any():
                    keep = np.flatnonzero(~gone)
                    pos, head, best, won, state, end = pos[keep], head[keep], best[keep], won[keep], state[keep], end[keep]
                    if not len(keep):
                        return failed, []
        return failed, list(zip(head.tolist(), end.tolist()))

    def _one_by_one(self, data: bytes, at: int, end: int, length: np.ndarray, kind: np.ndarray) -> int:
        """Follows tokens from at to end; where the scan stopped."""
        match = self.lexer.match
        begins, sizes, kinds = [], [], []
        while at < end:
            won, n = match(data, at, end)
            if not n:
                break
            begins.append(at)
            sizes.append(n)
            kinds.append(won)
            at += n
        length[begins], kind[begins] = sizes, kinds
        return at

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """Of all texts' tokens: text, kind, start, length, in order; and the bytes consumed of each text."""
        n = len(raw)
        length, kind = np.zeros(n, np.int64), np.zeros(n, np.int64)
        stops = offsets[1:].copy()
        start = self._cuts(raw, offsets) if n else np.zeros(0, np.int64)
        if len(start) and n >= LANE * len(start):
            data = raw.tobytes()
            for t in range(len(offsets) - 1):
                stops[t] = self._one_by_one(data, int(offsets[t]), int(offsets[t + 1]), length, kind)
        elif len(start):
            failed, rest = self._lanes(raw, start, np.append(start[1:], n), length, kind)
            data = raw.tobytes() if rest else b""
            failed += [stop for at, end in rest if (stop := self._one_by_one(data, at, end, length, kind)) < end]
            if failed:
                # The scan of a text stops at its first failure, whatever lanes beyond it have found.
                failed = np.array(sorted(failed))
                text = np.searchsorted(offsets, failed, side="right") - 1
                first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                stops[text[first]] = failed[first]
                for t, stop in zip(text[first], failed[first]):
                    length[stop : offsets[t + 1]] = 0
        where = np.flatnonzero(length)
        text = np.searchsorted(offsets, where, side="right") - 1
        return text, kind[where], where - offsets[:-1][text], length[where], stops - offsets[:-1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(column.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK):
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


def _texts(docs: DataFrame, key: str, data: str) -> DataFrame:
    return spread(docs.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data")))


def tokenize(docs: DataFrame, lexer: Lexer, key: str = "doc_id", data: str = "text", lexemes: bool = False, payload: bool = False, stop: frozenset[int] = frozenset()) -> DataFrame:
    """(key, seq, kind, start, length[, lexeme][, payload]): every token of every text, up to where a text stops matching.

    stop: kinds that end a text's scan, like a sink that says no; the token itself is the last one given.
    """
    kind = docs.schema[key].dataType.simpleString()
    payloads = lexer.payloads
    scanner = BatchScanner(lexer, docs.schema[data].dataType.typeName() == "string")

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets):
                own, edges = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                text, kinds, start, length, _ = scanner.scan(own, edges)
                first = np.searchsorted(text, text)
                if stop:
                    # Tokens before which their text has had none of these kinds.
                    before = np.concatenate(([0], np.cumsum(np.isin(kinds, list(stop)))))
                    keep = before[np.arange(len(text))] == before[first]
                    text, kinds, start, length, first = text[keep], kinds[keep], start[keep], length[keep], None
                    first = np.searchsorted(text, text)
                cols = [batch.column(0).take(pa.array(text + lo)), pa.array(np.arange(len(text)) - first), pa.array(kinds), pa.array(start), pa.array(length)]
                if lexemes:
                    begin = edges[:-1][text] + start
                    ends = np.concatenate(([0], np.cumsum(length)))
                    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)
                    cols.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own[at].tobytes())]).cast(pa.binary()))
                if payload:
                    cols.append(pa.array([payloads.get(k, 0) for k in kinds.tolist()], pa.int64()))
                yield pa.record_batch(cols, names=names)

    names = ["key", "seq", "kind", "start", "length", *(["lexeme"] * lexemes), *(["payload"] * payload)]
    schema = f"key {kind}, seq long, kind long, start long, length long" + ", lexeme binary" * lexemes + ", payload long" * payload
    return _texts(docs, key, data).mapInArrow(run, schema).withColumnRenamed("key", key)


def kind_counts(docs: DataFrame, lexer: Lexer, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, kind, tokens, bytes) of each text and kind: tallies made where the tokens are, so that no token travels."""
    scanner, key_type = BatchScanner(lexer, docs.schema[data].dataType.typeName() == "string"), docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets):
                text, kinds, _, length, _ = scanner.scan(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                width = int(kinds.max()) + 1 if len(kinds) else 1
                pair = text * width + kinds
                n, size = np.bincount(pair), np.bincount(pair, length)
                has = np.flatnonzero(n)
                yield pa.record_batch([batch.column(0).take(pa.array(has // width + lo)), pa.array(has % width), pa.array(n[has]), pa.array(size[has].astype(np.int64))], names=["key", "kind", "tokens", "bytes"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, kind long, tokens long, bytes long").withColumnRenamed("key", key)


def totals(docs: DataFrame, lexer: Lexer, by: tuple[str, ...] = (), key: str = "doc_id", data: str = "text") -> DataFrame:
    """(by, kind, tokens, bytes): tallies over all texts that agree in some columns; by built-in expressions where the set has one, else by its automaton."""
    if docs.schema[data].dataType.typeName() == "string" and native.spells(lexer) is not None:
        found = native.lexemes(docs, lexer, data, by)
        return found.groupBy(*by, "kind").agg(F.count("*").alias("tokens"), F.sum("length").alias("bytes"))
    rows = docs.select(F.struct(*by, F.lit(0).alias("none")).alias("key"), data)
    each = kind_counts(rows, lexer, "key", data).select(*[F.col("key")[c].alias(c) for c in by], "kind", "tokens", "bytes")
    return each.groupBy(*by, "kind").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


def first_tokens(docs: DataFrame, lexer: Lexer, key: str = "doc_id", data: str = "text", at: str | None = None) -> DataFrame:
    """(key, token struct(token, length)): one anchored longest match a text, at its beginning or an offset column."""
    key_type = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data"), (F.col(at).cast("long") if at else F.lit(0).cast("long")).alias("at"))

    def run(batches):
        for batch in batches:
            found = [lexer.match(d or b"", a or 0) for d, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            token = pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["token", "length"])
            yield pa.record_batch([batch.column(0), token], names=["key", "token"])

    return texts.mapInArrow(run, f"key {key_type}, token struct<token: bigint, length: bigint>").withColumnRenamed("key", key)


def scan_ends(docs: DataFrame, lexer: Lexer, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, consumed, size, tokens): how far each text's scan came."""
    scanner, key_type = BatchScanner(lexer, docs.schema[data].dataType.typeName() == "string"), docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets):
                text, _, _, _, consumed = scanner.scan(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(consumed), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(np.bincount(text, minlength=hi - lo))], names=["key", "consumed", "size", "tokens"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, consumed long, size long, tokens long").withColumnRenamed("key", key)


def until(tokens: DataFrame, stop, key: str = "doc_id") -> DataFrame:
    """Tokens up to the first of each text for which the condition holds, that one included: a sink that says no."""
    stops = tokens.where(stop).groupBy(key).agg(F.min("seq").alias("stop_seq"))
    return tokens.join(stops, key, "left").where(F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq"))).drop("stop_seq")


def _planner(lexer: Lexer, windows: bool, ignoring: bool):
    """How texts are cut.  windows, ignoring: where no byte certifies exactly, by windows; by bytes certified up to ignored tokens."""
    if windows and ignoring:
        raise ValueError("a plan is by windows or up to ignored tokens, not both")
    return lexer.chunk_boundaries_with_windows if windows else partial(lexer.chunk_boundaries, ignoring=ignoring)


def plan_cost(docs: DataFrame, lexer: Lexer, chunks: int, key: str = "doc_id", data: str = "text", ignoring: bool = False) -> DataFrame:
    """(key, chunks, looked): of every text the chunks planned, and the bytes looked at between shares and cuts."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [lexer.plan_cost(d or b"", chunks, ignoring) for d in batch.column(1).to_pylist()]
            made, looked = [len(cuts) - 1 for cuts, _ in found], [n for _, n in found]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.int32()), pa.array(looked, pa.int64())], names=["key", "chunks", "looked"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, chunks int, looked long").withColumnRenamed("key", key)


def plan_chunks(docs: DataFrame, lexer: Lexer, chunks: int, key: str = "doc_id", data: str = "text", windows: bool = False, ignoring: bool = False) -> DataFrame:
    """(key, chunk, begin, end) of every chunk of every text."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            plan = _planner(lexer, windows, ignoring)
            cuts = [plan(d or b"", chunks) for d in batch.column(1).to_pylist()]
            rows = [(i, c, a, b) for i, cut in enumerate(cuts) for c, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
            own, chunk, begin, end = (pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64())))
            yield pa.record_batch([batch.column(0).take(own), chunk, begin, end], names=["key", "chunk", "begin", "end"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, chunk int, begin long, end long").withColumnRenamed("key", key)


def planned_ends(docs: DataFrame, lexer: Lexer, chunks: int, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, chunks, largest, consumed, size) of each text in one pass: its plan's chunks and how far its scan came.  A null text is one chunk without sizes."""
    scanner, key_type = BatchScanner(lexer, docs.schema[data].dataType.typeName() == "string"), docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in blocks(offsets):
                part, edges = batch.slice(lo, hi - lo), offsets[lo : hi + 1] - offsets[lo]
                own, none = raw[offsets[lo] : offsets[hi]], part.column(1).is_null().to_numpy(zero_copy_only=False)
                consumed = scanner.scan(own, edges)[-1]
                cuts = [lexer.chunk_boundaries(own[a:b].tobytes(), chunks) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                largest = np.array([max(b - a for a, b in zip(c[:-1], c[1:])) for c in cuts], np.int64)
                sizes = [pa.array(c, pa.int64(), mask=none) for c in (largest, consumed, np.diff(edges))]
                yield pa.record_batch([part.column(0), pa.array([len(c) - 1 for c in cuts], pa.int64()), *sizes], names=["key", "chunks", "largest", "consumed", "size"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, chunks long, largest long, consumed long, size long").withColumnRenamed("key", key)


def tokenize_chunks(docs: DataFrame, lexer: Lexer, chunks: int, key: str = "doc_id", data: str = "text", windows: bool = False, ignoring: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tokens (key, chunk, seq, kind, start, length; start counts in the whole text) of chunks scanned apart, and each chunk's (key, chunk, consumed, size).

    The chunks of one text may be scanned anywhere.  With certified bytes the serial tokens are always a prefix of the chunks' tokens in order, and all of
    them where every chunk was consumed; a plan by windows promises that only for texts that scan completely, one up to ignored tokens once these are deleted.  Each row is a text of its own, whatever its key.
    """
    key_type = docs.schema[key].dataType.simpleString()
    plan = _planner(lexer, windows, ignoring)

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [d or b"" for d in batch.column(1).slice(lo, 256).to_pylist()]
                rows = [(lo + i, c, a, d[a:b]) for i, d in enumerate(texts) for edges in [plan(d, chunks)] for c, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
                own, chunk, begin, piece = (pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary())))
                yield pa.record_batch([batch.column(0).take(own), chunk, begin, piece], names=["key", "chunk", "begin", "data"])

    # The only shuffle: pieces are dealt out evenly, and a long text's go to different tasks.
    pieces = _texts(docs, key, data).mapInArrow(cut, f"key {key_type}, chunk int, begin long, data binary").repartition("key", "chunk")
    piece = pieces.select(F.struct("key", "chunk", "begin").alias("id"), "data")
    tokens = tokenize(piece, lexer, "id", "data")
    tokens = tokens.select(F.col("id.key").alias(key), "id.chunk", "seq", "kind", (F.col("id.begin") + F.col("start")).alias("start"), "length")
    ends = scan_ends(piece, lexer, "id", "data").select(F.col("id.key").alias(key), "id.chunk", "consumed", "size")
    return tokens, ends


def tokenize_modal(docs: DataFrame, lexer: ModalLexer, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, seq, mode, kind, start, length): every text from mode 0 with an empty stack."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            offsets = utf8(batch.column(1))[1]
            for lo, hi in blocks(offsets):
                found = [lexer.scan(d or b"", Stack())[0] for d in batch.column(1).slice(lo, hi - lo).to_pylist()]
                count = np.array([len(f) for f in found])
                first = np.repeat(np.cumsum(count) - count, count)
                mode, kind, length = np.array([t for f in found for t in f], np.int64).reshape(-1, 3).T
                before = np.cumsum(length) - length
                own = pa.array(np.repeat(np.arange(lo, hi), count))
                start = before - before[first] if len(before) else before
                yield pa.record_batch([batch.column(0).take(own), *(pa.array(np.ascontiguousarray(c)) for c in (np.arange(len(first)) - first, mode, kind, start, length))], names=["key", "seq", "mode", "kind", "start", "length"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, seq long, mode long, kind long, start long, length long").withColumnRenamed("key", key)


def modal_ends(docs: DataFrame, lexer: ModalLexer, key: str = "doc_id", data: str = "text") -> DataFrame:
    """(key, consumed, size, mode, depth): where each modal scan stopped, and its stack there."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for d in batch.column(1).to_pylist():
                stack = Stack()
                _, used = lexer.scan(d or b"", stack)
                rows.append((used, len(d or b""), stack.current, len(stack.saved)))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4))], names=["key", "consumed", "size", "mode", "depth"])

    return _texts(docs, key, data).mapInArrow(run, f"key {key_type}, consumed long, size long, mode long, depth long").withColumnRenamed("key", key)
