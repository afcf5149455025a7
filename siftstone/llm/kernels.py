"""Vectorised text kernels over Arrow string columns: words, their hashes, and rolling hashes of word windows.

All hashes are 64 bits wide. A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, which in UTF-8 is the
same as the run of code points.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers of the polynomial hashes, the second for windows that are to be told apart by more bits.
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes, or words, that are hashed at a time; memory per worker is some ten times 8 bytes of it.
SPAN = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 1 << 15

_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of ``base``, and of its inverse modulo 2**64."""
    if base not in _held or len(_held[base][0]) < n:
        steps = np.full(max(n, SPAN + LONG_WORD + 1), base, np.uint64), np.full(max(n, SPAN + LONG_WORD + 1), pow(base, -1, 1 << 64), np.uint64)
        steps[0][0] = steps[1][0] = 1
        _held[base] = np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)
    return _held[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings laid end to end, and where each begins (one more than there are strings)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of all texts: ``starts`` and ``ends`` in bytes; text d has words ``of[d]`` to ``of[d + 1]``."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False):
        data, self.offsets = string_bytes(column)
        self.raw = data
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(IS_SPACE[data], out=inside[1:-1])
        # a text's first byte begins a word even when the text before it ends in one
        edge = inside[1:] != inside[:-1]
        begin, end = edge & inside[1:], edge & inside[:-1]
        borders = self.offsets[1:-1]
        joined = borders[inside[borders] & inside[borders + 1]]
        begin[joined] = end[joined] = True
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end)
        self.of = np.searchsorted(self.starts, self.offsets)
        self.lower = lower

    def text(self, d: int) -> bytes:
        return self.raw[self.offsets[d] : self.offsets[d + 1]].tobytes()

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def hashes(self) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        first = 0
        while first < len(starts):
            last = int(np.searchsorted(starts, starts[first] + SPAN, "right"))
            s, e = starts[first:last], ends[first:last]
            short = e - s <= LONG_WORD
            at = s[0]
            data = self.raw[at : int(e[short].max(initial=at))]
            if self.lower:
                data = TO_LOWER[data]
            powers, inverses = _tables(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
            s, e = np.where(short, s - at, 0), np.where(short, e - at, 0)
            out[first:last] = mix((total[e] - total[s]) * inverses[s])
            first = last
        for k in long:
            word = self.raw[starts[k] : ends[k]]
            word = TO_LOWER[word] if self.lower else word
            out[k] = int.from_bytes(blake2b(word.tobytes(), digest_size=8).digest(), "little")
        return out

    def windows(self, size: int, hashes: np.ndarray | None = None, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of every window of ``size`` words, and the index of each window's first word."""
        h = self.hashes() if hashes is None else hashes
        room = np.repeat(self.of[1:], np.diff(self.of)) - np.arange(len(h)) >= size
        at = np.flatnonzero(room)
        out = np.empty(len(h), np.uint64)
        powers, inverses = _tables(SPAN + size + 1, base)
        for first in range(0, len(h), SPAN):
            part = h[first : first + SPAN + size - 1]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers[: len(part)], out=total[1:])
            n = min(SPAN, len(part) - size + 1)
            if n > 0:
                out[first : first + n] = (total[size : size + n] - total[:n]) * inverses[:n]
        return mix(out[at]), at

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``size`` words and the text of each; a shorter text with words is one window."""
        h = self.hashes()
        keys, at = self.windows(size, h)
        docs = np.searchsorted(self.of, at, "right") - 1
        n = np.diff(self.of)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for k, d in enumerate(short):
                part = h[self.of[d] : self.of[d + 1]]
                extra[k] = (part * _tables(len(part))[0][: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
            keys = np.concatenate([keys, mix(extra)])
            docs = np.concatenate([docs, short])
            order = np.argsort(docs, kind="stable")
            keys, docs = keys[order], docs[order]
        return keys, docs


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, laid out byte plane by byte plane, so that the codec of a shuffle shrinks them."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
