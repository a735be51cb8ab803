"""Words of an Arrow batch of texts as NumPy arrays: boundaries, hashes, shingles.

All work is done on the UTF-8 bytes of the whole batch at once.  A `Words` keeps the words of all texts in one buffer, each
followed by one space, so any run of words of a text is one slice of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .shared import forget

SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E)))).encode()
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LOW = 1 << 16


def lut(separators: bytes, lower: bool) -> np.ndarray:
    """Byte to byte; every separator becomes a space (0x20)."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 0x20
    return out


PLAIN = lut(SPACE, False)
LOWER = lut(SPACE, True)
#: Everything in ASCII but digits and letters separates.
ALNUM = lut(bytes(x for x in range(128) if not (48 <= x < 58 or 65 <= x < 91 or 97 <= x < 123)), True)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = [_powers(b, _LOW) for b in _BASES]


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    array = array.cast(pa.large_string()) if pa.types.is_string(array.type) or pa.types.is_null(array.type) else array
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_large_binary(array.type) else b"")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], np.int64, n + 1, array.offset * 8) if n else np.zeros(1, np.int64)
    data = array.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of a batch of texts.

    `text`: bytes of all words, each with a space after it; `start`: where each word starts in it (one entry more than words, so word i is
    text[start[i] : start[i + 1] - 1]); `doc`: first word of each text (one entry more than texts).
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        mapped = table[raw]
        word = mapped != 0x20
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0], before[1:] = True, ~word[:-1]
        first = np.flatnonzero(word & (before | edge[:-1]))
        after = np.empty(len(raw), bool)
        if len(raw):
            after[-1], after[:-1] = True, ~word[1:]
        last = np.flatnonzero(word & (after | edge[1:]))
        del before, after, word, edge
        size = last - first + 2
        self.n = len(first)
        self.start = np.zeros(self.n + 1, np.int64)
        np.cumsum(size, out=self.start[1:])
        total = int(self.start[-1])
        if total == len(raw) + 1 and offsets[-1] == len(raw) and len(offsets) == 2:
            self.text = np.append(mapped, np.uint8(0x20))
        else:
            at = np.arange(total, dtype=np.int64)
            at += np.repeat(first - self.start[:-1], size)
            if total:
                np.minimum(at, len(raw) - 1, out=at)
            self.text = mapped[at]
        self.text[self.start[1:] - 1] = 0x20
        self.doc = np.searchsorted(first, offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: sum of table[byte] * base ** place, mixed with the length."""
        if not self.n:
            return np.zeros(0, np.uint64)
        rel = np.arange(len(self.text), dtype=np.int64)
        rel -= np.repeat(self.start[:-1], np.diff(self.start))
        powers = _POW[which]
        value = _TABLES[which][self.text]
        if rel.max() < _LOW:
            value *= powers[rel]
        else:
            value *= powers[rel % _LOW]
            value *= _powers(powers[-1] * powers[1], int(rel.max() // _LOW) + 1)[rel // _LOW]
        value[self.start[1:] - 1] = 0
        out = np.add.reduceat(value, self.start[:-1])
        return mix(out + np.diff(self.start).astype(np.uint64))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of k words inside one text, and the number of runs of each text."""
        each = np.maximum(np.diff(self.doc) - k + 1, 0)
        total = int(each.sum())
        base = np.repeat(self.doc[:-1] - np.concatenate(([0], np.cumsum(each)[:-1])), each)
        return np.arange(total, dtype=np.int64) + base, each

    def slice(self, first: int, last: int) -> bytes:
        """Words first .. last - 1 joined by one space."""
        return self.text[self.start[first] : max(self.start[last] - 1, self.start[first])].tobytes()


def rolling(h: np.ndarray, k: int, at: np.ndarray | None = None, base: np.uint64 = _BASES[1]) -> np.ndarray:
    """Hash of each run of k entries of h (starting at `at`, all by default), order-dependent."""
    if at is None:
        n = max(len(h) - k + 1, 0)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out *= base
            out += h[j : j + n]
        return mix(out)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out *= base
        out += h[at + j]
    return mix(out)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(text: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of text[start : start + length] for many slices at once, slices of equal length together."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    lanes8 = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    lanes4 = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(padded) - 3,), (1,))
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1, [len(order)]))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            which, n = order[lo:hi], int(ordered[lo])
            at = start[which]
            if n > 1024 or hi - lo < 8:
                out[which] = [xxhash.xxh64_intdigest(text[a : a + n].tobytes(), seed) for a in at]
                continue
            done = 0
            if n >= 32:
                acc = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while done + 32 <= n:
                    for j in range(4):
                        acc[j] = _round(acc[j], lanes8[at + (done + 8 * j)])
                    done += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
            else:
                h = np.full(len(at), s + _P5, np.uint64)
            h = h + np.uint64(n)
            while done + 8 <= n:
                h = _rotl(h ^ _round(np.uint64(0), lanes8[at + done]), 27) * _P1 + _P4
                done += 8
            if done + 4 <= n:
                h = _rotl(h ^ (lanes4[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _rotl(h ^ (padded[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[which] = h ^ (h >> np.uint64(32))
    return out


def blocks(offsets: np.ndarray, most: int = 2 << 20):
    """Ranges of texts of a batch with at most so many bytes each, or one text: what is held at once stays bounded."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def words_of(array, table: np.ndarray, most: int = 2 << 20):
    """Yields (first row, rows, Words) over a string column, in blocks of bounded size."""
    forget()
    raw, offsets = column(array)
    for lo, hi in blocks(offsets, most):
        yield lo, hi, Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
