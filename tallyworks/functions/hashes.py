"""The numbers of scalars.hash_uniform in numpy: MD5 of many texts at once, which differ by what follows them only."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa

_U = np.uint32
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16, 32)], *[(3 * i + 5) % 16 for i in range(32, 48)], *[7 * i % 16 for i in range(48, 64)]]
#: Bytes of a text that fit in MD5's one block beside its end mark and length.
BLOCK = 55


def _md5(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of n digests; of the sixteen words of their blocks some are arrays, the others numbers that all share."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, s, _U) for s in start)
    f, r = np.empty(n, _U), np.empty(n, _U)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        m = words[_WORDS[i]]
        if isinstance(m, int):
            f += _U((m + _K[i]) & 0xFFFFFFFF)
        else:
            f += np.add(m, _U(_K[i]), out=r)
        np.left_shift(f, _U(_SHIFTS[i]), out=r)
        f >>= _U(32 - _SHIFTS[i])
        r |= f
        r += b
        a, d, c, b, r = d, c, b, r, a
    return a + _U(start[0]), b + _U(start[1])


class Texts:
    """Texts of one column, to each of which the same ending is put before it is hashed."""

    def __init__(self, texts: pa.Array, longest: int) -> None:
        """longest is the number of bytes of the longest ending."""
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.n, size = len(texts), np.diff(ends)
        self.groups, self.long = [], []
        for k in np.unique(size):
            rows = np.flatnonzero(size == k)
            if k + longest > BLOCK:
                self.long += [(i, data[ends[i]:ends[i + 1]].tobytes()) for i in rows]
                continue
            block = np.zeros((len(rows), 64), np.uint8)
            block[:, :k] = data[ends[rows][:, None] + np.arange(k)]
            self.groups.append((rows, int(k), np.ascontiguousarray(block.view("<u4").T)))

    def words(self, ending: str) -> tuple[np.ndarray, np.ndarray]:
        """The first two words (little-endian) of the digest of each text with the ending."""
        tail = ending.encode()
        first, second = np.empty(self.n, _U), np.empty(self.n, _U)
        for rows, k, block in self.groups:
            end = np.frombuffer((b"\0" * k + tail + b"\x80").ljust(56, b"\0") + (8 * (k + len(tail))).to_bytes(8, "little"), "<u4").tolist()
            words = [end[j] if 4 * j >= k else block[j] | _U(end[j]) if end[j] else block[j] for j in range(16)]
            a, b = _md5(words, len(rows))
            if len(rows) == self.n:
                return a, b
            first[rows], second[rows] = a, b
        for i, text in self.long:
            first[i], second[i] = np.frombuffer(hashlib.md5(text + tail).digest()[:8], "<u4")
        return first, second

    def bits(self, ending: str) -> np.ndarray:
        """hash_uniform times 2^52, whole numbers."""
        return _bits(*self.words(ending))


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.byteswap().astype(np.int64) << 20) | (b.byteswap() >> _U(12)).astype(np.int64)


class Steps:
    """How many of some rising numbers in (0, 1) are at most hash_uniform: read off the first two bytes, where these decide."""

    def __init__(self, edges: list[float]) -> None:
        self.least = np.array([math.ceil(Fraction(e) * 2**52) for e in edges], np.int64)
        head = np.arange(1 << 16, dtype=np.int64)
        low, high = (np.searchsorted(self.least, x, "right") for x in (head << 36, ((head + 1) << 36) - 1))
        found = np.where(low == high, low, 255).astype(np.uint8)
        self.by_head = found[head.astype(np.uint16).byteswap()]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.by_head[a.view(np.uint16)[::2]]
        open_ = np.flatnonzero(out == 255)
        if len(open_):
            out[open_] = np.searchsorted(self.least, _bits(a[open_], b[open_]), "right")
        return out
