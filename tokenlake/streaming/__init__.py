"""Scans of texts that arrive in parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lexer import Lexer

_OUT = "key string, start long, kind long, length long"
_STATE = "carry binary, consumed long, stopped boolean"


def settled(lexer: Lexer, data: bytes) -> tuple[list[tuple[int, int]], int, bool]:
    """Tokens of a part that no later byte can change, the bytes they take, and whether the scan can't go on.

    A match is settled once the automaton died after it; the longest match at the part's end might still grow.
    """
    delta, accept = lexer.dfa.delta, lexer.dfa.accept
    out, at = [], 0
    while at < len(data):
        state, last, kind, i = 0, at, -1, at
        while i < len(data):
            state = delta[state, data[i]]
            if state < 0:
                break
            i += 1
            if accept[state] >= 0:
                last, kind = i, int(accept[state])
        if state >= 0 and (delta[state] >= 0).any():
            break
        if last == at:
            return out, at, True
        out.append((kind, last - at))
        at = last
    return out, at, False


def stream_tokens(parts: DataFrame, lexer: Lexer) -> DataFrame:
    """parts: streaming (key string, part long, data binary, last boolean), the parts of a key in order of `part` within and across batches.

    Emits (key, start, kind, length) as soon as a token is settled; what is not yet settled is carried in the key's state, and scanned to its end
    when a row says that it is the last.  The carry is as long as the longest match still open.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, consumed, stopped = state.get if state.exists else (b"", 0, False)
        rows = pd.concat(list(frames)).sort_values("part")
        data, last = bytes(carry) + b"".join(bytes(d) for d in rows["data"] if d is not None), bool(rows["last"].any())
        tokens: list[tuple[int, int]] = []
        used = 0
        if not stopped:
            if last:
                tokens, used = lexer.scan(data)
            else:
                tokens, used, stopped = settled(lexer, data)
        starts, at = [], consumed
        for _, n in tokens:
            starts.append(at)
            at += n
        if last:
            state.remove()
        else:
            state.update((b"" if stopped else data[used:], at, stopped))
        yield pd.DataFrame({"key": [key[0]] * len(tokens), "start": pd.Series(starts, dtype="int64"), "kind": pd.Series([k for k, _ in tokens], dtype="int64"), "length": pd.Series([n for _, n in tokens], dtype="int64")})

    return parts.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
