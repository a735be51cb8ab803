"""Compiled token sets: tables for scanning, and what can be proved about where scans may begin."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..functions.unicode import LAST, byte_ranges, code_points
from .automaton import DEAD, Dfa, Nfa, determinize, minimize

#: Lengths of windows that plans and recovery look at.
SHORTEST_WINDOW, LONGEST_WINDOW = 2, 4
#: Decided windows that a process remembers; sequences of symbol classes that are decided beforehand.
MEMO, TABLE = 500_000, 4096


@dataclass(frozen=True)
class CertifiedStart:
    """A place where a token must begin, and the evidence (begin and end) for it: a byte at the place itself, or a window."""

    start: int
    evidence_begin: int
    evidence_end: int
    window: bool


class Lexer:
    """Immutable, and cheap to send to workers: only the arrays travel."""

    def __init__(self, dfa: Dfa, ignored: frozenset[int] = frozenset(), payloads: dict[int, int] | None = None):
        self.dfa, self.ignored, self.payloads = dfa, ignored, dict(payloads or {})
        delta, accept = dfa.delta, dfa.accept
        self.accepting = accept >= 0
        _, first, self.byte_class = np.unique(delta.T, axis=0, return_index=True, return_inverse=True)
        self.byte_class = self.byte_class.reshape(-1)
        # One row a class and one column a state; a further class, of the end of a text, leads nowhere.  State 0 of the table is death.
        self.table = np.zeros((len(first) + 1, dfa.states + 1), np.int32)
        self.table[:-1, 1:] = delta[:, first].T + 1
        self.flags = np.concatenate(([False], self.accepting))

    def __reduce__(self):
        return Lexer, (self.dfa, self.ignored, self.payloads)

    # Matching

    @property
    def nullable(self) -> bool:
        return bool(self.accepting[0])

    def match(self, data: bytes, at: int = 0, end: int | None = None) -> tuple[int | None, int]:
        """Longest match at this offset: (token, length), or (None, 0).  At the end of a text that is the start's own token, if any, and 0."""
        rows, runs, accept, end = self._rows, self._runs, self._accepts, len(data) if end is None else end
        state, i, best, length = 0, at, accept[0], 0
        while True:
            if (run := runs[state]) is not None and (found := run(data, i, end)) is not None:
                i = found.end()
                if accept[state] is not None:
                    best, length = accept[state], i - at
            if i >= end or (state := rows[state][data[i]]) < 0:
                return best, length
            i += 1
            if accept[state] is not None:
                best, length = accept[state], i - at

    @cached_property
    def _accepts(self) -> list[int | None]:
        return [int(t) if t >= 0 else None for t in self.dfa.accept]

    @cached_property
    def _runs(self) -> list:
        """Of each state, what matches a run of bytes on which it stays."""
        out = []
        for s, row in enumerate(self._rows):
            stay = [b for b in range(256) if row[b] == s]
            out.append(re.compile(b"[" + b"".join(b"\\x%02x" % b for b in stay) + b"]+").match if stay else None)
        return out

    @cached_property
    def _rows(self) -> list[list[int]]:
        return self.dfa.delta.tolist()

    def scan(self, data: bytes, sink: Callable[[int, int], bool | None] | None = None) -> tuple[list[tuple[int, int]], int]:
        """(kind, length) of each token and the bytes consumed; stops where nothing or nothing of any length matches.

        A sink is called with kind and length, and payload if it takes three; if it returns False the scan stops after that token.
        """
        takes = sink.__code__.co_argcount - (1 if hasattr(sink, "__self__") else 0) if sink is not None else 0
        out, at = [], 0
        while at < len(data):
            kind, length = self.match(data, at)
            if kind is None or not length:
                break
            out.append((kind, length))
            at += length
            if sink is not None and (sink(kind, length, self.payloads.get(kind, 0)) if takes > 2 else sink(kind, length)) is False:
                break
        return out, at

    # Liveness

    @cached_property
    def reachable(self) -> np.ndarray:
        return _closure(self.dfa.delta, [0])

    @cached_property
    def co_accessible(self) -> np.ndarray:
        return self._leading_to(self.accepting)

    def _leading_to(self, goal: np.ndarray) -> np.ndarray:
        """States from which a goal is within reach, the goals themselves included."""
        have = goal.copy()
        while True:
            more = have | (np.where(self.dfa.delta >= 0, have[self.dfa.delta], False)).any(1)
            if (more == have).all():
                return have
            have = more

    @cached_property
    def live(self) -> np.ndarray:
        return self.reachable & self.co_accessible

    @cached_property
    def reentrant(self) -> bool:
        """Some reachable transition leads back to the start."""
        return bool((self.dfa.delta[self.reachable] == 0).any())

    @cached_property
    def _live_delta(self) -> np.ndarray:
        d = self.dfa.delta
        return np.where((d >= 0) & self.live[np.maximum(d, 0)], d, DEAD)

    # Certified bytes

    @cached_property
    def split_points(self) -> np.ndarray:
        """Of each byte, whether every complete scan has a token boundary before each of its occurrences."""
        return self._certify(np.zeros(self.dfa.states, bool))

    @cached_property
    def split_points_ignoring(self) -> np.ndarray:
        """The same up to tokens of the ignored kinds: what is left after deleting these is unchanged by a cut before the byte."""
        discards = self.accepting & np.isin(self.dfa.accept, sorted(self.ignored))
        return self._certify(discards & ~self._leading_to(self.accepting & ~discards))

    def _certify(self, forgiven: np.ndarray) -> np.ndarray:
        """forgiven: states that may consume the byte, if they go where the start goes."""
        to = self.dfa.delta
        consumes = (to >= 0) & self.co_accessible[np.maximum(to, 0)]
        offends = consumes & self.reachable[:, None] & ~(forgiven[:, None] & (to == to[0]))
        if not self.reentrant:
            offends[0] = False
        return consumes[0] & ~offends.any(0)

    def is_split_point(self, b: int) -> bool:
        return bool(self.split_points[b])

    def is_split_point_ignoring(self, b: int) -> bool:
        return bool(self.split_points_ignoring[b])

    # Certified windows

    def is_split_window(self, window: bytes) -> int | None:
        """The offset in the window where every complete scan across it begins a token, the same for all histories; None otherwise.

        Follows every history at once: pairs of a state and where its token began (-1: before the window).
        """
        if not window or self.nullable:
            return None
        cloud = self._histories
        for i, b in enumerate(window):
            cloud = self._follow(cloud, i, b)
            if not cloud:
                return None
        return self._origin(cloud)

    @cached_property
    def _histories(self) -> set[tuple[int, int]]:
        return {(int(s), -1) for s in np.flatnonzero(self.live)}

    def _follow(self, cloud: set[tuple[int, int]], i: int, b: int) -> set[tuple[int, int]]:
        """The histories after the window's byte at i."""
        delta, accepting = self._live_rows, self._accepting_list
        after = {(delta[s][b], i if s == 0 and not self.reentrant else o) for s, o in cloud if delta[s][b] >= 0}
        if any(accepting[s] for s, _ in cloud) and delta[0][b] >= 0:
            after.add((delta[0][b], i))
        return after

    @staticmethod
    def _origin(cloud: set[tuple[int, int]]) -> int | None:
        origins = {o for _, o in cloud}
        return origins.pop() if len(origins) == 1 and -1 not in origins else None

    @cached_property
    def _live_rows(self) -> list[list[int]]:
        return self._live_delta.tolist()

    @cached_property
    def _accepting_list(self) -> list[bool]:
        return self.accepting.tolist()

    def certified_windows(self, length: int) -> dict[bytes, int]:
        """Every certified window of this length and its offset, by extending histories byte by byte, equal histories once."""
        if self.nullable:
            return {}
        classes = {int(self.byte_class[b]): [x for x in range(256) if self.byte_class[x] == self.byte_class[b]] for b in range(256)}
        found: dict[bytes, int] = {}
        reps = {k: v[0] for k, v in classes.items()}
        level: list[tuple[int, ...]] = [()]
        for _ in range(length):
            level = [(*w, k) for w in level for k in reps]
        for w in level:
            origin = self.is_split_window(bytes(reps[k] for k in w))
            if origin is not None:
                words = [b""]
                for k in w:
                    words = [x + bytes([b]) for x in words for b in classes[k]]
                found |= dict.fromkeys(words, origin)
        return found

    def witness(self, window: bytes) -> bytes | None:
        """An input that scans wholly and holds the window, of those that reach some live state, pass over the window, and end at the nearest acceptance."""
        ways = {0: b""} | {s: w for s, w in self._access()}
        ends = self._endings()
        for _, w in sorted(ways.items(), key=lambda x: (len(x[1]), x[1])):
            data = w + window
            # What the scan leaves open at the end is the beginning of a token, which its state's nearest acceptance completes.
            state = 0
            for b in data[self.scan(data)[1] :]:
                state = self._live_rows[state][b] if state >= 0 else DEAD
            data += ends.get(state, b"") if state > 0 else b""
            if self.scan(data)[1] == len(data):
                return data
        return None

    def _access(self) -> Iterator[tuple[int, bytes]]:
        """Each live state with a shortest word that leads to it."""
        level, seen = [(0, b"")], set()
        while level:
            after = []
            for s, w in level:
                for b in range(256):
                    t = self._live_rows[s][b]
                    if t >= 0 and t not in seen:
                        seen.add(t)
                        after.append((t, w + bytes([b])))
            yield from after
            level = after

    def _endings(self) -> dict[int, bytes]:
        """Of each live state, a shortest word to acceptance."""
        out = {s: b"" for s in range(self.dfa.states) if self.accepting[s]}
        grew = True
        while grew:
            more = {}
            for s in np.flatnonzero(self.live).tolist():
                if s not in out:
                    found = next((bytes([b]) + out[t] for b, t in enumerate(self._live_rows[s]) if t in out), None)
                    if found is not None:
                        more[s] = found
            out |= more
            grew = bool(more)
        return out

    @cached_property
    def pair_windows(self) -> np.ndarray:
        """Of each two bytes (first times 256 and second), the offset that they certify, or -1."""
        out = np.full(1 << 16, -1, np.int8)
        for w, origin in self.certified_windows(2).items():
            out[w[0] << 8 | w[1]] = origin
        return out

    @cached_property
    def total(self) -> bool:
        """Every byte is a token by itself, so every input scans wholly."""
        to = self.dfa.delta[0]
        return bool((to >= 0).all() and self.accepting[to].all())

    @cached_property
    def covers_utf8(self) -> bool:
        """Every code point is a token by itself and no token ends inside one, so every valid UTF-8 input scans wholly."""
        utf8 = minimize(determinize(Nfa().add(code_points(0, LAST), 0, 0))[0])
        whole = utf8.accept >= 0
        seen, todo = {(0, 0)}, [(0, 0)]
        while todo:
            s, u = todo.pop()
            for t, v in {*zip(self.dfa.delta[s].tolist(), utf8.delta[u].tolist())}:
                if v < 0:
                    continue
                if t < 0:
                    continue
                if self.accepting[t] and not whole[v]:
                    return False
                after = (t, 0 if whole[v] else v)
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return self._each_code_point()

    def _each_code_point(self) -> bool:
        for sequence in byte_ranges(0, LAST):
            states = {0}
            for a, b in sequence:
                states = {int(t) for s in states for t in (self.dfa.delta[s, a : b + 1] if s >= 0 else [DEAD])}
            if not all(s >= 0 and self.accepting[s] for s in states):
                return False
        return True

    def shortest_window(self, longest: int = LONGEST_WINDOW) -> tuple[bytes, int] | None:
        """A shortest certified window and its offset, the least in byte order; None if none of up to this length certifies."""
        for n in range(1, longest + 1):
            if found := self.certified_windows(n):
                w = min(found)
                return w, found[w]
        return None

    @cached_property
    def mandatory_core(self) -> bytes:
        """Bytes that stand, followed by one byte more, in every certified window; empty where none is proved.

        A live state that some history is in and that a window does not kill keeps the origin before the window alive.  So each state that every byte leaves alive for a while proposes its shortest word
        to death (without the killing byte); a proposal holds if no word that kills the state avoids it, which a search over pairs of a state and a
        matched prefix of the proposal settles.
        """
        if self.nullable:
            return b""
        delta, live = self._live_delta, np.flatnonzero(self.live)
        kills = {int(s): int(np.flatnonzero(delta[s] < 0)[0]) for s in live if (delta[s] < 0).any()}
        best = b""
        for s in live:
            word = self._death_word(int(s), kills)
            if word and len(word) > len(best) and self._unavoidable(int(s), word, kills):
                best = word
        return best

    def _death_word(self, s: int, kills: dict[int, int]) -> bytes | None:
        """Shortest word that leads from s to a state some byte kills."""
        seen, level = {s}, [(s, b"")]
        while level:
            after = []
            for t, w in level:
                if t in kills:
                    return w
                for b in range(256):
                    u = int(self._live_delta[t, b])
                    if u >= 0 and u not in seen:
                        seen.add(u)
                        after.append((u, w + bytes([b])))
            level = after
        return None

    def _unavoidable(self, s: int, word: bytes, kills: dict[int, int]) -> bool:
        """No way from s to death has the word nowhere before its last byte."""
        step = _prefix_automaton(word)
        seen, todo = {(s, 0)}, [(s, 0)]
        while todo:
            t, k = todo.pop()
            if t in kills:
                return False
            for b in range(256):
                u, m = int(self._live_delta[t, b]), step[k][b]
                if u >= 0 and m < len(word) and (u, m) not in seen:
                    seen.add((u, m))
                    todo.append((u, m))
        return True

    # Chunk plans

    def chunk_boundaries(self, data: bytes, chunks: int, ignoring: bool = False) -> list[int]:
        """Offsets 0 .. size of at most so many chunks; each cut is the first certified byte at or after its even share and past the cut before.

        ignoring: bytes certified up to ignored tokens will do; the chunks' tokens then equal the serial ones once the ignored kinds are deleted from both.
        """
        return self.plan_cost(data, chunks, ignoring)[0]

    def plan_cost(self, data: bytes, chunks: int, ignoring: bool = False) -> tuple[list[int], int]:
        """The plan, and the bytes looked at between shares and cuts; a search that finds none looks through to the end, and is the last."""
        find = self._find_ignoring if ignoring else self._find_certified
        looked, open_ = 0, find is not None

        def cut(floor: int) -> int | None:
            nonlocal looked, open_
            at = find(data, floor) if open_ else None
            looked += (at if at is not None else len(data)) - floor if open_ else 0
            open_ = at is not None
            return at

        return self._plan(len(data), chunks, cut), looked

    def chunk_boundaries_with_windows(self, data: bytes, chunks: int, use_core: bool = True) -> list[int]:
        """The same plan where a byte certifies; otherwise cuts inside the first certified window (place first, then length) at or after each share.

        Sound for inputs that the token set scans completely; for others such a plan promises nothing.
        """
        if self.split_points.any() or len(data) < 2 or self.nullable:
            return self.chunk_boundaries(data, chunks)
        core = self.mandatory_core if use_core else b""
        if len(core) + 1 > LONGEST_WINDOW:
            return [0, len(data)]

        def cut(floor: int) -> int | None:
            at = floor
            while at < len(data):
                if core:
                    hit = data.find(core, at)
                    if hit < 0:
                        return None
                    at = max(at, hit + len(core) + 1 - LONGEST_WINDOW)
                if (found := self._window_at(data, at)) is not None:
                    return found[0]
                at += 1
            return None

        return self._plan(len(data), chunks, cut)

    @cached_property
    def _find_certified(self) -> Callable[[bytes, int], int | None] | None:
        return _finder(self.split_points)

    @cached_property
    def _find_ignoring(self) -> Callable[[bytes, int], int | None] | None:
        return _finder(self.split_points_ignoring)

    @staticmethod
    def _plan(size: int, chunks: int, cut: Callable[[int], int | None]) -> list[int]:
        out, usable = [0], min(chunks, size)
        for i in range(1, usable):
            at = cut(max(size * i // usable, out[-1] + 1))
            if at is not None and at < size:
                out.append(at)
        return [*out, size]

    @cached_property
    def _decided(self) -> dict[bytes, int | None]:
        """Windows that have been decided, for all texts that this process plans."""
        return {}

    def _window_at(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(start, end of evidence) of the shortest certified window that begins here."""
        memo = self._decided
        if len(memo) > MEMO:
            memo.clear()
        for n in range(SHORTEST_WINDOW, min(LONGEST_WINDOW, len(data) - at) + 1):
            w = data[at : at + n]
            if w not in memo:
                memo[w] = self.is_split_window(w)
            if memo[w] is not None:
                return at + memo[w], at + n
        return None

    def scan_parallel(self, data: bytes, chunks: int) -> list[tuple[list[tuple[int, int]], int]]:
        """Each chunk's tokens and consumed bytes.  A chunk not consumed wholly tells where the input is malformed."""
        plan = self.chunk_boundaries(data, chunks)
        return [self.scan(data[a:b]) for a, b in zip(plan[:-1], plan[1:])]

    # Recovery and repair

    @cached_property
    def _first_certified(self):
        """Finds the next certified byte."""
        marks = b"".join(b"\\x%02x" % b for b in np.flatnonzero(self.split_points).tolist())
        return re.compile(b"[" + marks + b"]").search if marks else None

    @cached_property
    def _window_tables(self) -> list[np.ndarray | None]:
        """For each length, of each sequence of symbol classes (as digits of a number) the offset that it certifies, or -1; None where these are too many."""
        classes = len(self.table) - 1
        reps = [int(np.flatnonzero(self.byte_class == k)[0]) for k in range(classes)]
        out: list[np.ndarray | None] = []
        for n in range(SHORTEST_WINDOW, LONGEST_WINDOW + 1):
            if classes**n > TABLE:
                out.append(None)
                continue
            words = [b""]
            for _ in range(n):
                words = [w + bytes([r]) for w in words for r in reps]
            out.append(np.array([-1 if (o := self.is_split_window(w)) is None else o for w in words], np.int8))
        return out

    def _windows_from(self, codes: np.ndarray, data: bytes, at: int, n: int) -> np.ndarray:
        """Of each place of a stretch (whose symbol classes are codes) the offset that the window of n bytes there certifies, or -1."""
        classes, table = len(self.table) - 1, self._window_tables[n - SHORTEST_WINDOW]
        number = np.zeros(max(len(codes) - n + 1, 0), np.int64)
        for j in range(n):
            number = number * classes + codes[j : j + len(number)]
        if table is not None:
            return table[number]
        unique, first, back = np.unique(number, return_index=True, return_inverse=True)
        memo, found = self._decided, np.full(len(unique), -1, np.int8)
        for k, i in enumerate(first.tolist()):
            w = data[at + i : at + i + n]
            if w not in memo:
                if len(memo) > MEMO:
                    memo.clear()
                memo[w] = self.is_split_window(w)
            found[k] = -1 if memo[w] is None else memo[w]
        return found[back]

    def next_certified_evidence(self, data: bytes, at: int = 0) -> CertifiedStart | None:
        """The first certified start that evidence at or after this offset proves: bytes first, then windows by place and length.

        The next certified byte is searched for at once; windows before it are looked up for whole stretches of the text.
        """
        hit = self._first_certified(data, at) if self._first_certified else None
        end = hit.start() if hit else len(data)
        tables = self._window_tables if not self.nullable else []
        if any(t is None or (t >= 0).any() for t in tables):
            lo, size = at, 64
            while lo < end:
                hi = min(end, lo + size)
                codes = self.byte_class[np.frombuffer(data, np.uint8, min(hi + LONGEST_WINDOW - 1, len(data)) - lo, lo)].astype(np.int64)
                best = None
                for n in range(SHORTEST_WINDOW, LONGEST_WINDOW + 1):
                    origin = self._windows_from(codes, data, lo, n)[: hi - lo]
                    good = np.flatnonzero(origin >= 0)
                    if len(good) and (best is None or good[0] < best[0]):
                        best = int(good[0]), n, int(origin[good[0]])
                if best is not None:
                    place = lo + best[0]
                    return CertifiedStart(place + best[2], place, place + best[1], True)
                lo, size = hi, min(4 * size, 1 << 16)
        return CertifiedStart(end, end, end + 1, False) if hit else None

    def next_certified_start(self, data: bytes, at: int = 0) -> int | None:
        found = self.next_certified_evidence(data, at)
        return None if found is None else found.start

    @cached_property
    def lag(self) -> int | None:
        """Most states in a row that don't accept, after one that does; None if there is no bound."""
        to = self.dfa.delta
        waiting = ~self.accepting
        inside = np.zeros(self.dfa.states, bool)
        opened = to[self.accepting]
        inside[opened[opened >= 0]] = True
        inside &= waiting
        while True:
            more = to[inside]
            grown = inside.copy()
            grown[more[more >= 0]] = True
            grown &= waiting
            if (grown == inside).all():
                break
            inside = grown
        depth = {}
        left = set(np.flatnonzero(inside).tolist())
        while left:
            done = {s: 1 + max((depth[t] for t in set(to[s].tolist()) if t >= 0 and inside[t]), default=0) for s in left if all(t not in left for t in set(to[s].tolist()) if t >= 0)}
            if not done:
                return None
            depth |= done
            left -= done.keys()
        return max(depth.values(), default=0)

    @cached_property
    def rescue_free(self) -> bool:
        """Every byte that leads from accepting to waiting is dead from the start."""
        to = self.dfa.delta
        opens = (self.accepting[:, None] & (to >= 0) & ~self.accepting[np.maximum(to, 0)]).any(0)
        return not (opens & (to[0] >= 0) & self.live[np.maximum(to[0], 0)]).any()

    def _jumps(self, tail: bytes) -> tuple[list[int | None], list[bool]]:
        """Of each offset, where the token that begins there ends, and whether all of the rest tokenizes from there."""
        ends: list[int | None] = [None] * len(tail)
        whole = [False] * len(tail) + [True]
        for i in range(len(tail) - 1, -1, -1):
            kind, n = self.match(tail, i)
            if kind is not None and n:
                ends[i], whole[i] = i + n, whole[i + n]
        return ends, whole

    def _scenarios(self, tail: bytes) -> Iterator[tuple[int, bytes]]:
        """For every state a token may be in as the tail begins: the boundary it comes to, and a shortest word that leads to the state."""
        level, seen = [(0, b"")], set()
        while level:
            after = []
            for s, w in level:
                for b in range(256):
                    t = int(self.dfa.delta[s, b])
                    if t >= 0 and t not in seen:
                        seen.add(t)
                        after.append((t, w + bytes([b])))
            for s, w in after:
                last, state = 0 if self.accepting[s] else None, s
                for i, b in enumerate(tail):
                    state = int(self.dfa.delta[state, b])
                    if state < 0:
                        break
                    if self.accepting[state]:
                        last = i + 1
                if last is not None:
                    yield last, w
            level = after

    def next_anchored_start(self, tail: bytes, at: int = 0) -> int | None:
        """The first offset from `at` on where every history that completes the tail begins a token; None if none does or no history completes it."""
        if self.nullable or at >= len(tail):
            return None
        ends, whole = self._jumps(tail)
        heads = [h for h in ([0] if whole[0] else []) + [b for b, _ in self._scenarios(tail)] if whole[h]]
        votes = np.zeros(len(tail) + 1, np.int64)
        for h in heads:
            while h < len(tail):
                votes[h] += 1
                h = ends[h]
        good = np.flatnonzero(votes[at : len(tail)] == len(heads)) if heads else []
        return int(at + good[0]) if len(good) else None

    def minimal_repair(self, tail: bytes) -> bytes | None:
        """A shortest prefix that makes the tail tokenize wholly; empty if it does; None proves that there is none."""
        if self.nullable:
            return None
        whole = self._jumps(tail)[1]
        return b"" if whole[0] else min((w for b, w in self._scenarios(tail) if whole[b]), key=len, default=None)


def _finder(marked: np.ndarray) -> Callable[[bytes, int], int | None] | None:
    """Finds the first marked byte at or after a place; None where no byte is marked."""
    marks = np.flatnonzero(marked).tolist()
    if not marks:
        return None
    if len(marks) == 1:
        one = bytes(marks)
        return lambda data, at: None if (found := data.find(one, at)) < 0 else found
    search = re.compile(b"[" + b"".join(b"\\x%02x" % m for m in marks) + b"]").search
    return lambda data, at: found.start() if (found := search(data, at)) else None


def _closure(delta: np.ndarray, start: list[int]) -> np.ndarray:
    have = np.zeros(len(delta), bool)
    have[start] = True
    while True:
        to = delta[have]
        more = have.copy()
        more[to[to >= 0]] = True
        if (more == have).all():
            return have
        have = more


def _prefix_automaton(word: bytes) -> list[list[int]]:
    """Of each matched prefix length and byte, the longest prefix matched then."""
    return [[max((k for k in range(min(n + 1, len(word)), -1, -1) if (word[:n] + bytes([b])).endswith(word[:k])), default=0) for b in range(256)] for n in range(len(word))]
