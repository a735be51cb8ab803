"""Token sets: registration, compilation, diagnosis."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.pattern import Pattern, to_json
from .automaton import Dfa, Nfa, determinize, minimize
from .lexer import Lexer


@dataclass(frozen=True)
class Rule:
    token: int
    pattern: Pattern
    priority: int
    dfa: Dfa


@dataclass
class Diagnosis:
    """dead_tokens: ids that never win, in order of registration; ties: ascending pairs of ids that meet at the winner's priority."""

    dead_tokens: list[int] = field(default_factory=list)
    ties: list[tuple[int, int]] = field(default_factory=list)


class TokenSet:
    """Patterns with token ids and priorities: the longest match wins, then the lowest priority, then the lowest id."""

    def __init__(self, state_limit: int = 0):
        self.rules: list[Rule] = []
        self.ignored: frozenset[int] = frozenset()
        self.payloads: dict[int, int] = {}
        self.state_limit = state_limit

    def add_token(self, pattern: Pattern, token: int, priority: int = 0) -> TokenSet:
        """Several patterns may have one token.  Each pattern's own automaton is minimized before it meets the others."""
        if token < 0 or priority < 0:
            raise ValueError("token ids and priorities are not negative")
        own = minimize(determinize(Nfa().add(pattern, priority, token), self.state_limit)[0])
        self.rules.append(Rule(int(token), pattern, int(priority), own))
        return self

    def set_ignored_tokens(self, tokens: Iterable[int]) -> TokenSet:
        """Kinds that the caller deletes from the stream: they matter to the relaxed certificate only."""
        self.ignored = frozenset(tokens)
        return self

    def set_token_payload(self, token: int, payload: int) -> TokenSet:
        """A word delivered with each match of the token; the last one set counts, 0 is none."""
        self.payloads[token] = payload
        return self

    def nfa(self) -> Nfa:
        out = Nfa()
        for r in self.rules:
            out.add_dfa(r.dfa, r.priority, r.token)
        return out

    def compile(self) -> Lexer:
        return Lexer(minimize(determinize(self.nfa(), self.state_limit)[0]), self.ignored, self.payloads)

    def candidates(self) -> list[frozenset[tuple[int, int]]]:
        """(priority, token) pairs that meet in one reachable subset."""
        return [c for c in determinize(self.nfa(), self.state_limit)[1] if c]

    def diagnose(self) -> Diagnosis:
        sets = self.candidates()
        winners = {min(c)[1] for c in sets}
        ties = {(a, b) for c in sets for a in [t for p, t in c if p == min(c)[0]] for b in [t for p, t in c if p == min(c)[0]] if a < b}
        return Diagnosis([t for t in dict.fromkeys(r.token for r in self.rules) if t not in winners], sorted(ties))

    def rows(self) -> list[tuple[int, int, str, int, bool]]:
        """(token_id, priority, pattern, payload, ignored): the rules relation."""
        return [(r.token, r.priority, to_json(r.pattern), self.payloads.get(r.token, 0), r.token in self.ignored) for r in self.rules]
