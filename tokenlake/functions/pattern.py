"""Patterns over bytes: immutable values, without behaviour of their own.

Deliberately absent, as a longest-match scanner has no use for them: captures, back-references, look-around, unanchored
search, and shortest or first match.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from .charset import Charset


@dataclass(frozen=True)
class AnyOf:
    """One byte of a set; an empty set matches nothing."""

    set: Charset


@dataclass(frozen=True)
class Text:
    """Exactly these bytes; none match the empty input."""

    data: bytes


@dataclass(frozen=True)
class Concat:
    parts: tuple[Pattern, ...]


@dataclass(frozen=True)
class Choice:
    parts: tuple[Pattern, ...]


@dataclass(frozen=True)
class Repeat:
    """`low` times or more, up to `high` (None: without end)."""

    part: Pattern
    low: int
    high: int | None


Pattern = AnyOf | Text | Concat | Choice | Repeat


def any_of(members: Charset | str | bytes) -> Pattern:
    return AnyOf(members if isinstance(members, Charset) else Charset.of(members))


def text(data: str | bytes) -> Pattern:
    return Text(data.encode() if isinstance(data, str) else bytes(data))


def _parts(parts: tuple[Pattern, ...], what: str) -> tuple[Pattern, ...]:
    if not parts:
        raise ValueError(f"{what} needs at least one pattern")
    return tuple(parts)


def concat(*parts: Pattern) -> Pattern:
    return Concat(_parts(parts, "concat"))


def choice(*parts: Pattern) -> Pattern:
    """Any of the patterns, none of them preferred."""
    return parts[0] if len(parts) == 1 else Choice(_parts(parts, "choice"))


def repeat(part: Pattern, low: int, high: int | None) -> Pattern:
    if low < 0 or high is not None and high < low:
        raise ValueError(f"no pattern repeats {low} to {high} times")
    return Repeat(part, low, high)


def kleene(part: Pattern) -> Pattern:
    return repeat(part, 0, None)


def plus(part: Pattern) -> Pattern:
    return repeat(part, 1, None)


def optional(part: Pattern) -> Pattern:
    return repeat(part, 0, 1)


def exact(part: Pattern, n: int) -> Pattern:
    return repeat(part, n, n)


def at_least(part: Pattern, n: int) -> Pattern:
    return repeat(part, n, None)


def identifier() -> Pattern:
    """`[A-Za-z_][A-Za-z0-9_]*`"""
    return concat(any_of(Charset.alpha() + "_"), kleene(any_of(Charset.alphanum() + "_")))


def decimal_integer() -> Pattern:
    """`[0-9]+`"""
    return plus(any_of(Charset.digits()))


def decimal_float() -> Pattern:
    r"""`[0-9]+\.[0-9]+`"""
    return concat(decimal_integer(), text("."), decimal_integer())


def to_json(p: Pattern) -> str:
    """A pattern for inspection, as a column of rules holds it."""

    def node(p: Pattern):
        match p:
            case AnyOf(s):
                return {"any_of": s.symbols()}
            case Text(d):
                return {"text": list(d)}
            case Concat(parts):
                return {"concat": [node(x) for x in parts]}
            case Choice(parts):
                return {"choice": [node(x) for x in parts]}
            case Repeat(part, low, high):
                return {"repeat": node(part), "low": low, "high": high}

    return json.dumps(node(p))
