"""Hashes of words and of runs of words, computed for whole batches with numpy.

A word's hash is a polynomial of its bytes modulo 2**64 with random odd base, then mixed; a run's
hash is a polynomial of its words' hashes, mixed again. Both come from prefix sums, so a hash
costs the same however long the run is, and doesn't depend on where the run stands.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd bases, and the inverses modulo 2**64 that move a run to position zero.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
#: Bytes whose words are hashed at a time.
BLOCK = 1 << 20

#: Word bytes: everything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: ASCII letters and digits, and all bytes of other characters.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    ALPHANUMERIC[_a:_b] = True

_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, dtype=_U)
        have[0] = 1
        filled = 1
        while filled < size:
            step = _U(pow(base, filled, 1 << 64))
            have[filled : 2 * filled] = have[:filled] * step
            filled *= 2
        _tables[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole number."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def spans(data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = word_bytes[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), dtype=_U)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = data[base : ends[hi - 1]]
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(
            (part.astype(_U) + _U(1)) * _powers(_BYTE_BASE, len(part)), out=sums[1:]
        )
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[b] - sums[a]) * _powers(_inverse(_BYTE_BASE), len(part))[a]
        # The length tells words apart that differ by trailing parts of hash zero.
        out[lo:hi] = mix(out[lo:hi] ^ (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
        lo = hi
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (``len(words) - n + 1`` of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=_U)
    out = np.empty(count, dtype=_U)
    for lo in range(0, count, BLOCK):
        hi = min(count, lo + BLOCK)
        part = words[lo : hi + n - 1]
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(part * _powers(_WORD_BASE, len(part)), out=sums[1:])
        at = np.arange(hi - lo)
        out[lo:hi] = (sums[n : n + hi - lo] - sums[at]) * _powers(_inverse(_WORD_BASE), len(part))[at]
    return mix(out)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word runs ``[start, end)``, which may differ in length."""
    if not len(starts):
        return np.empty(0, dtype=_U)
    sums = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * _powers(_WORD_BASE, len(words)), out=sums[1:])
    moved = (sums[ends] - sums[starts]) * _powers(_inverse(_WORD_BASE), len(words))[starts]
    return mix(moved ^ mix((ends - starts).astype(_U)))
