"""Code points as patterns over UTF-8 bytes, and the identifier classes of UAX #31."""

from __future__ import annotations

import functools
import sys

from .charset import Charset
from .pattern import Pattern, any_of, choice, concat

LAST = 0x10FFFF
# Surrogates have no UTF-8 form; the last code point of each length.
SURROGATES = (0xD800, 0xDFFF)
LENGTH_ENDS = (0x7F, 0x7FF, 0xFFFF, LAST)


def _spell(cp: int) -> bytes:
    return chr(cp).encode("utf-8")


def byte_ranges(first: int, last: int) -> list[list[tuple[int, int]]]:
    """Sequences of byte ranges that spell exactly the code points first..last, in ascending order."""
    if not 0 <= first <= last <= LAST:
        raise ValueError(f"no code points {first:#x}..{last:#x}")
    spans = [(first, min(last, SURROGATES[0] - 1)), (max(first, SURROGATES[1] + 1), last)]
    out: list[list[tuple[int, int]]] = []
    for a, b in spans:
        if a > b:
            continue
        low = 0
        for end in LENGTH_ENDS:
            lo, hi = max(a, low), min(b, end)
            if lo <= hi:
                out += _same_length(_spell(lo), _spell(hi))
            low = end + 1
    if not out:
        raise ValueError(f"{first:#x}..{last:#x} holds surrogates only")
    return out


def _same_length(lo: bytes, hi: bytes) -> list[list[tuple[int, int]]]:
    """Splits where the leading bytes differ, until all trailing bytes run over their whole range."""
    if len(lo) == 1:
        return [[(lo[0], hi[0])]]
    if lo[0] == hi[0]:
        return [[(lo[0], lo[0]), *rest] for rest in _same_length(lo[1:], hi[1:])]
    least, most = b"\x80" * (len(lo) - 1), b"\xbf" * (len(lo) - 1)
    out, a, b = [], lo[0], hi[0]
    if lo[1:] != least:
        out += [[(a, a), *rest] for rest in _same_length(lo[1:], most)]
        a += 1
    tail = []
    if hi[1:] != most:
        tail = [[(b, b), *rest] for rest in _same_length(least, hi[1:])]
        b -= 1
    if a <= b:
        out.append([(a, b), *[(0x80, 0xBF)] * (len(lo) - 1)])
    return out + tail


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint ranges, adjacent ones as one; ValueError where they are empty, unsorted or overlap."""
    if not ranges:
        raise ValueError("no ranges")
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if a > b or b > LAST or out and a <= out[-1][1]:
            raise ValueError(f"the range {a:#x}..{b:#x} is not in order")
        if out and a == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def code_points(first: int, last: int) -> Pattern:
    return code_point_ranges([(first, last)])


def code_point_ranges(ranges: list[tuple[int, int]]) -> Pattern:
    sequences = [s for a, b in merged(ranges) for s in byte_ranges(a, b)]
    return choice(*[concat(*[any_of(Charset.range(a, b)) for a, b in s]) for s in sequences])


# Letters and marks that version 18.0.0 of the character database assigned first.
NEW_IN_18 = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x18CD6, 0x18CD6), (0x18D1F, 0x18D20), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x2B81E, 0x2B81E), (0x3D000, 0x3FC3F), (0x0B53, 0x0B54), (0x10ECB, 0x10ECF), (0x18CD7, 0x18CDA), (0x1D127, 0x1D128),
    (0x1D250, 0x1D252), (0x1D25B, 0x1D25C), (0x1D25F, 0x1D25F), (0x1D280, 0x1D281),
)


@functools.cache
def property_ranges(name: str) -> tuple[tuple[int, int], ...]:
    """Code point ranges of a Unicode property as of version 17.0.0, from the database that the installed `regex` package carries."""
    import regex

    later = {c for a, b in NEW_IN_18 for c in range(a, b + 1)}
    has = regex.compile(rf"\p{{{name}}}").match
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if SURROGATES[0] <= c <= SURROGATES[1] or c in later or not has(chr(c)):
            continue
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return tuple((a, b) for a, b in out)


def xid_start() -> Pattern:
    """Code points that may begin an identifier (the underscore is not one)."""
    return code_point_ranges(list(property_ranges("XID_Start")))


def xid_continue() -> Pattern:
    return code_point_ranges(list(property_ranges("XID_Continue")))


def version() -> str:
    """Of the character database that the properties follow."""
    return "17.0.0"
