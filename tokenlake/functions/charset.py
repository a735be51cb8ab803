"""Sets of bytes, as 256-bit masks."""

from __future__ import annotations

from dataclasses import dataclass

_FULL = (1 << 256) - 1


def _byte(x: int | str | bytes) -> int:
    if isinstance(x, int):
        return x & 0xFF
    raw = x.encode("latin-1") if isinstance(x, str) else x
    if len(raw) != 1:
        raise ValueError(f"one byte is wanted, not {x!r}")
    return raw[0]


@dataclass(frozen=True)
class Charset:
    """A set of bytes; `+` is union and `-` difference, with a set or one byte on either side."""

    mask: int = 0

    @classmethod
    def of(cls, *members: int | str | bytes) -> Charset:
        """These bytes; a longer string stands for each of its bytes."""
        mask = 0
        for m in members:
            for b in [m & 0xFF] if isinstance(m, int) else (m.encode("latin-1") if isinstance(m, str) else m):
                mask |= 1 << b
        return cls(mask)

    @classmethod
    def range(cls, first: int | str | bytes, last: int | str | bytes) -> Charset:
        """From first to last, both included, in unsigned byte order."""
        a, b = _byte(first), _byte(last)
        if b < a:
            raise ValueError(f"the range {a}..{b} is reversed")
        return cls((1 << (b + 1)) - (1 << a))

    @classmethod
    def digits(cls) -> Charset:
        return cls.range("0", "9")

    @classmethod
    def alpha(cls) -> Charset:
        return cls.range("A", "Z") + cls.range("a", "z")

    @classmethod
    def alphanum(cls) -> Charset:
        return cls.alpha() + cls.digits()

    @classmethod
    def printable(cls) -> Charset:
        return cls.range(0x20, 0x7E)

    @classmethod
    def escape(cls) -> Charset:
        return cls.of("\n\t\r'\"\\")

    @classmethod
    def newline(cls) -> Charset:
        return cls.of("\n\r")

    @classmethod
    def whitespace(cls) -> Charset:
        """Space and tab; line ends are `newline`."""
        return cls.of(" \t")

    @classmethod
    def all(cls) -> Charset:
        return cls(_FULL)

    def __add__(self, other: Charset | int | str | bytes) -> Charset:
        return Charset(self.mask | _mask(other))

    __radd__ = __add__

    def __sub__(self, other: Charset | int | str | bytes) -> Charset:
        return Charset(self.mask & ~_mask(other) & _FULL)

    def __contains__(self, b: int | str | bytes) -> bool:
        return bool(self.mask >> _byte(b) & 1)

    def __len__(self) -> int:
        return self.mask.bit_count()

    def symbols(self) -> list[int]:
        return [b for b in range(256) if self.mask >> b & 1]


def _mask(x: Charset | int | str | bytes) -> int:
    return x.mask if isinstance(x, Charset) else 1 << _byte(x)
