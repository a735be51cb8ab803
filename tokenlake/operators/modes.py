"""Modal token sets: one lexer a mode, and a stack that tokens move.

A modal scan can't be cut inside a text: which mode a byte is in depends on all before it.  Texts are scanned in parallel, each by one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.pattern import Pattern
from .lexer import Lexer
from .tokenset import Diagnosis, TokenSet

STAY, GO_TO, PUSH, POP = range(4)
NAMES = ("stay", "go_to", "push", "pop")


@dataclass(frozen=True)
class Action:
    kind: int = STAY
    target: int = 0

    def pack(self) -> int:
        return self.kind | self.target << 2

    @classmethod
    def unpack(cls, word: int) -> Action:
        return cls(word & 3, word >> 2)


def stay() -> Action:
    return Action()


def go_to(mode: int) -> Action:
    return Action(GO_TO, mode)


def push(mode: int) -> Action:
    return Action(PUSH, mode)


def pop() -> Action:
    return Action(POP)


@dataclass
class Stack:
    """The caller's: the current mode and those to return to."""

    current: int = 0
    saved: list[int] = field(default_factory=list)

    def apply(self, action: Action) -> bool:
        """False, and nothing changes, where there is nothing to pop."""
        if action.kind == POP:
            if not self.saved:
                return False
            self.current = self.saved.pop()
        elif action.kind != STAY:
            if action.kind == PUSH:
                self.saved.append(self.current)
            self.current = action.target
        return True


@dataclass
class ModalDiagnosis:
    per_mode: list[Diagnosis]
    unreachable_modes: list[int]
    inescapable_modes: list[int]


class ModalTokenSet:
    def __init__(self, state_limit: int = 0):
        self.state_limit = state_limit
        self.sets: list[TokenSet] = []
        self.actions: dict[tuple[int, int], Action] = {}

    def add_token(self, mode: int, pattern: Pattern, token: int, priority: int = 0, action: Action = Action()) -> ModalTokenSet:
        """Within one mode a token has one action; going to its own mode is staying."""
        if token < 0 or mode < 0 or not STAY <= action.kind <= POP or action.target < 0:
            raise ValueError("mode, token, action or target is out of range")
        action = Action() if action == Action(GO_TO, mode) else Action(action.kind, action.target if action.kind in (GO_TO, PUSH) else 0)
        if self.actions.get((mode, token), action) != action:
            raise ValueError(f"token {token} has another action in mode {mode}")
        own = TokenSet(self.state_limit)
        own.add_token(pattern, token, priority)
        while len(self.sets) <= mode:
            self.sets.append(TokenSet(self.state_limit))
        self.sets[mode].rules += own.rules
        self.actions[mode, token] = action
        return self

    @property
    def modes(self) -> int:
        return len(self.sets)

    def compile(self) -> ModalLexer:
        if not self.sets:
            raise ValueError("there is no mode")
        for mode, s in enumerate(self.sets):
            if not s.rules:
                raise ValueError(f"mode {mode} has no token")
        for (mode, token), action in self.actions.items():
            if action.kind in (GO_TO, PUSH) and action.target >= self.modes:
                raise ValueError(f"token {token} of mode {mode} leads to mode {action.target}, which there is not")
            if action.kind != STAY and any(r.token == token and r.dfa.accept[0] >= 0 for r in self.sets[mode].rules):
                raise ValueError(f"token {token} of mode {mode} may be empty and has an action")
        return ModalLexer([s.compile() for s in self.sets], dict(self.actions))

    def diagnose(self) -> ModalDiagnosis:
        """Modes that no live action enters from mode 0; modes that no live action leaves, a pop counting where a frame can name another mode."""
        per_mode = [s.diagnose() for s in self.sets]
        moves = [(m, a) for (m, t), a in self.actions.items() if a.kind != STAY and t not in per_mode[m].dead_tokens]
        entered, grew = {0}, True
        while grew:
            more = {a.target for m, a in moves if m in entered and a.kind in (GO_TO, PUSH) and a.target < self.modes}
            grew = not more <= entered
            entered |= more
        frames: dict[int, set[int]] = {m: set() for m in range(self.modes)}
        grew = True
        while grew:
            grew = False
            for m, a in moves:
                if m in entered and a.kind in (GO_TO, PUSH) and a.target < self.modes:
                    add = frames[m] | ({m} if a.kind == PUSH else set())
                    grew |= not add <= frames[a.target]
                    frames[a.target] |= add
        leaves = {m for m, a in moves if (a.target != m if a.kind in (GO_TO, PUSH) else frames[m] - {m})}
        every = range(self.modes)
        return ModalDiagnosis(per_mode, [m for m in every if m not in entered], [m for m in every if m not in leaves])


class ModalLexer:
    def __init__(self, lexers: list[Lexer], actions: dict[tuple[int, int], Action]):
        self.lexers, self.actions = lexers, actions

    @property
    def modes(self) -> int:
        return len(self.lexers)

    def mode(self, i: int) -> Lexer:
        """Its certificates hold within the mode only."""
        return self.lexers[i]

    def match(self, data: bytes, stack: Stack, at: int = 0) -> tuple[int | None, int]:
        """One token in the current mode, its action applied; a pop without a frame is no match, and an empty token has no action."""
        if not 0 <= stack.current < self.modes:
            raise ValueError(f"the stack is in mode {stack.current} of {self.modes}")
        kind, n = self.lexers[stack.current].match(data, at)
        if kind is not None and n:
            if not all(0 <= m < self.modes for m in stack.saved[-1:]):
                raise ValueError("the stack names a mode that there is not")
            if not stack.apply(self.actions.get((stack.current, kind), Action())):
                return None, 0
        return kind, n

    def scan(self, data: bytes, stack: Stack | None = None) -> tuple[list[tuple[int, int, int]], int]:
        """(mode, kind, length) of each token and the bytes consumed; the stack is left as it was where the scan stopped."""
        stack = stack if stack is not None else Stack()
        out, at = [], 0
        while at < len(data):
            mode = stack.current
            kind, n = self.match(data, stack, at)
            if kind is None or not n:
                break
            out.append((mode, kind, n))
            at += n
        return out, at
