"""Scans by the JVM's regular expressions, for token sets whose automaton a deterministic expression can spell.

A regular expression engine takes the first alternative that matches, a scan the longest match. Both agree for an expression read off the automaton itself, where
at each place the next character decides the way: alternatives begin with disjoint characters, a state's loop takes characters that no other way takes (so the
loop may keep all it has), and what may follow an accepting state is optional and greedy. Going on as long as possible and falling back to the last
accepting state is then the only way through, and that is the longest match.

Such an expression is made where the automaton, over whole characters, has no cycles but loops of single states, no longest match ends inside a character,
and the classes stay small. For all other sets there is none, and `scan` follows their automata itself.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import spread
from .lexer import Lexer

#: Code points, and ranges of an expression's classes and characters of its text beyond which there is none.
POINTS, RANGES, LENGTH = 0x110000, 400, 20_000
#: Ranges of first characters that are compared one by one.
FEW = 8


class Spelled:
    """An automaton over code points, from the automaton over bytes; `why` says what stands in the way of an expression, if anything does."""

    def __init__(self, lexer: Lexer):
        self.lexer, self.why = lexer, ""
        self.accept = lexer.dfa.accept
        self.next: dict[int, np.ndarray] = {}
        todo = [0]
        if lexer.nullable:
            self.why = "a token may be empty"
        while todo and not self.why:
            s = todo.pop()
            if s in self.next:
                continue
            self.next[s] = own = self._points(s)
            todo += np.unique(own[own >= 0]).tolist()
            if len(self.next) > 64:
                self.why = "too many states"
        self.ranges = 0
        self.ways: dict[int, dict[int, list[tuple[int, int]]]] = {}
        if not self.why:
            self.ways = {s: {int(t): self._runs(own == t) for t in np.unique(own[own >= 0])} for s, own in self.next.items()}
            self.ranges = sum(len(r) for ways in self.ways.values() for r in ways.values())
            if self.ranges > RANGES:
                self.why = "classes of too many ranges"
            elif self._cyclic():
                self.why = "cycles of several states"

    def _points(self, state: int) -> np.ndarray:
        """Of each code point, the state after its bytes; DEAD (-1) where there is none, and for surrogates."""
        delta = np.vstack((self.lexer.dfa.delta, np.full((1, 256), -1)))  # the row of -1 leads nowhere
        yes = np.append(self.lexer.accepting, False)
        out, early = np.full(POINTS, -1, np.int64), np.zeros(POINTS, bool)  # early: some token ends before the character does
        out[:0x80] = delta[state, :0x80]
        for first, last, leads in ((0x80, 0x800, slice(0xC2, 0xE0)), (0x800, 0x10000, slice(0xE0, 0xF0)), (0x10000, POINTS, slice(0xF0, 0xF5))):
            at = delta[state, leads]
            begin = 0x80 if first == 0x80 else 0
            ended = yes[at]
            for _ in range({0x80: 1, 0x800: 2, 0x10000: 3}[first]):
                before = ended
                at = delta[at][..., 0x80:0xC0]
                ended = before[..., None] | yes[at]
            passed = np.broadcast_to(before[..., None], at.shape)
            out[first:last] = at.reshape(-1)[first - begin : last - begin]
            early[first:last] = passed.reshape(-1)[first - begin : last - begin]
        out[0xD800:0xE000], early[0xD800:0xE000] = -1, False
        # A longest match never ends inside a character if it may always go on to the character's end.
        if (early & ~yes[out]).any():
            self.why = "a token may end inside a character"
        return out

    @staticmethod
    def _runs(member: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
        # Surrogates are no characters, so a run may go over them.
        out: list[tuple[int, int]] = []
        for a, b in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
            if out and out[-1][1] == 0xD7FF and a == 0xE000:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _cyclic(self) -> bool:
        done: dict[int, bool] = {}

        def visit(s: int) -> bool:
            if s in done:
                return not done[s]
            done[s] = False
            if any(visit(t) for t in self.ways[s] if t != s):
                return True
            done[s] = True
            return False

        return visit(0)

    def expression(self, kinds: frozenset[int] | None = None) -> str | None:
        """What matches the longest token at a place, or whole tokens of these kinds only; None where it would be too long."""
        good = [k >= 0 and (kinds is None or int(k) in kinds) for k in self.accept.tolist()]
        memo: dict[int, str | None] = {}

        def rest(s: int) -> str | None:
            """What may follow when the state is reached; None if nothing leads to acceptance."""
            if s in memo:
                return memo[s]
            # Alternatives are disjoint, so any order is right; what texts hold most is tried first.
            ways = [(_class(runs), rest(t)) for t, runs in sorted(self.ways[s].items(), key=lambda x: (-_weight(x[1]), x[0])) if t != s]
            ways = [c + r for c, r in ways if r is not None]
            loop = _class(self.ways[s][s]) + "*+" if s in self.ways[s] else ""
            memo[s] = None if not ways and not good[s] else loop + (f"(?:{'|'.join(ways)})" + "?" * good[s] if ways else "")
            return memo[s]

        out = rest(0)
        return out if out is not None and len(out) <= LENGTH else None


def _class(runs: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def _weight(runs: list[tuple[int, int]]) -> int:
    """Roughly how often a text's token begins with one of these: blanks, then letters, then the rest of ASCII, then all else."""
    return sum(100 * (a <= 0x20 <= b) + 4 * max(0, min(b, 0x7A) - max(a, 0x61) + 1) + (a < 0x80) for a, b in runs)


@cache
def _spelled(lexer: Lexer) -> Spelled:
    return Spelled(lexer)


def spells(lexer: Lexer) -> str | None:
    """The expression that finds the set's tokens one after another from a text's beginning, or None."""
    own = _spelled(lexer)
    token = None if own.why else own.expression()
    return None if token is None else rf"\G(?:{token})"


def kind_of(lexer: Lexer, lexeme: Column) -> Column:
    """The kind of a whole token: by its first character where that tells, else by an expression of the kind's tokens."""
    own = _spelled(lexer)
    kinds = sorted({int(k) for s, k in enumerate(own.accept) if k >= 0 and s in own.next})
    firsts = {k: np.zeros(POINTS, bool) for k in kinds}
    for t, runs in own.ways[0].items():
        for k in _reached(own, t):
            for a, b in runs:
                firsts[k][a : b + 1] = True
    by_first = {k: not any((firsts[k] & firsts[other]).any() for other in kinds if other != k) for k in kinds}
    out = None
    ranked = sorted(kinds, key=lambda k: (not by_first[k], len(own._runs(firsts[k])), k))
    for k in ranked[:-1]:
        runs = own._runs(firsts[k])
        if by_first[k] and len(runs) <= FEW:
            sure = reduce(or_, [F.ascii(lexeme).between(a, b) for a, b in runs])
        else:
            sure = lexeme.rlike("^" + _class(runs)) if by_first[k] else lexeme.rlike(rf"^(?:{own.expression(frozenset({k}))})\z")
        out = F.when(sure, F.lit(k)) if out is None else out.when(sure, F.lit(k))
    last = ranked[-1]
    return (F.lit(last) if out is None else out.otherwise(F.lit(last))).cast("long")


def _reached(own: Spelled, state: int) -> set[int]:
    seen, todo = {state}, [state]
    while todo:
        for t in own.ways[todo.pop()]:
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return {int(own.accept[s]) for s in seen if own.accept[s] >= 0}


def lexemes(docs: DataFrame, lexer: Lexer, data: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, seq, lexeme string, kind, length): every token of every text, up to where a text stops matching; ValueError if the set has no expression.

    Texts are strings; a null has no tokens. One row is one text, whatever its key; texts of any length are scanned whole. Columns built in, and no shuffle.
    """
    pattern = spells(lexer)
    if pattern is None:
        raise ValueError(f"no expression finds these tokens: {_spelled(lexer).why or 'it is too long'}")
    texts = spread(docs.select(*carried, F.col(data).alias("data")))
    found = texts.select(*carried, F.posexplode(F.regexp_extract_all("data", F.lit(pattern), F.lit(0))).alias("seq", "lexeme"))
    return found.select(*carried, F.col("seq").cast("long").alias("seq"), "lexeme", kind_of(lexer, F.col("lexeme")).alias("kind"), F.octet_length("lexeme").cast("long").alias("length"))
