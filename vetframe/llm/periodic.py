"""Periodic runs: stretches of words that repeat with one period, found by internal pattern matching.

A *run* is a stretch of consecutive words with smallest period ``p`` and a length of at least
``max(min_length, 3 p)`` that no neighbouring word extends. ``find_runs`` returns all of them, exactly.

How a run is found. Every text has a suffix array, sorted by prefix doubling. On the way, blocks of
``L = base, 2 base, 4 base ...`` words at multiples of ``L`` get the interval of the array that holds all
places of the same words; blocks whose words stand nowhere else in the text are dropped there. A
wavelet tree over the array answers "the first place at or after ``x`` in this interval", so a block
asks where its words stand in the windows that follow it:

* A run of period ``p`` in ``[L, 2L)`` holds a block ``s`` whose words stand at ``s + p`` again. The
  places from ``s + L`` to ``s + 2L`` form one arithmetic progression. With one or two members, each
  member gives a candidate. With three, its difference ``d`` is the period of the block itself, and
  the stretch of period ``d`` around ``s`` ends, on one side at least, inside the run: the distance
  from that end to the like end of the stretch around the progression is the only candidate of its side.
* A run of period ``p < base`` is at least ``min_length >= 3 base`` long. It holds a block of ``base``
  words, which stand again first at ``s + p``.

Each candidate is extended to both sides by comparing words. A stretch that is already known is
never compared again, and one that is no run is shorter than three periods, so the comparisons of a
level are linear in the text. Blocks that lie in a known run of a period up to ``L`` with all their
windows can't belong to another run of their level and are left out.

Texts are handled one by one inside a task (many short ones in one array); nothing is shuffled. Memory
is about 60 bytes for each word of the texts handled at a time: ``STRIP`` words or one longer text.

Nulls, ties, repeats: a null text has no words and no runs; a null id stays null; every row is
judged by itself, so repeated rows give equal results. Extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import utf8

#: Shortest run, in words.
MIN_LENGTH = 24
#: A run holds its period at least so many times; the search for candidates rests on it.
REPEATS = 3
#: Words whose suffixes are sorted together; a longer text is handled by itself.
STRIP = 1 << 18


class WaveletTree:
    """Range queries on an array of numbers below ``2**bits``, for many ranges at once.

    One packed bit row for each bit from the top, zeros moved before ones (a wavelet matrix), with a
    count of ones before each 64 bits.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self._rows = []
        for b in reversed(range(self.bits)):
            ones = ((values >> b) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            self._rows.append((b, words, before, len(values) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits of a row."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Numbers below ``x`` in ``[lo, hi)``."""
        beyond = x >= 1 << self.bits
        size, out = hi - lo, np.zeros(len(lo), dtype=np.int64)
        for b, words, before, zeros in self._rows:
            a, z = self._ones(words, before, lo), self._ones(words, before, hi)
            up = ((x >> b) & 1).astype(bool)
            out += np.where(up, (hi - z) - (lo - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return np.where(beyond, size, out)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones (by place) in ``[lo, hi)``."""
        out = np.zeros(len(lo), dtype=np.int64)
        for b, words, before, zeros in self._rows:
            a, z = self._ones(words, before, lo), self._ones(words, before, hi)
            down = (hi - z) - (lo - a)
            up = k >= down
            out |= up.astype(np.int64) << b
            k = np.where(up, k - down, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The smallest number in ``[lo, hi)`` that is at least ``x``, else ``none``."""
        out = np.full(len(lo), none, dtype=np.int64)
        k = self.below(lo, hi, x)
        there = np.flatnonzero(k < hi - lo)
        out[there] = self.smallest(lo[there], hi[there], k[there])
        return out


def repeated_blocks(
    words: np.ndarray, first: np.ndarray, base: int
) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of some texts in a row, and by length the blocks that stand again in their
    text: start, and the interval of the array that holds all their places.

    Texts follow each other in the array as they do in ``words``. It is sorted only as far as blocks
    need it, which moves no suffix out of its block's interval.
    """
    n = len(words)
    lengths = np.diff(first)
    begin, end = np.repeat(first[:-1], lengths), np.repeat(first[1:], lengths)
    longest = int(lengths.max(initial=0))
    key = begin * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    sa, slots, keys = order.copy(), np.arange(n), key[order]
    rank = np.empty(n, dtype=np.int64)
    blocks = {}
    width = 1
    while len(slots):
        # Suffixes that agree so far form a class and have the slot of its first one as rank.
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(heads, len(slots)))
        at = sa[slots]
        rank[at] = np.repeat(slots[heads], sizes)
        several = np.repeat(sizes > 1, sizes)
        if width >= base:
            whole = several & ((at - begin[at]) % width == 0)
            whole &= REPEATS * width <= end[at] - begin[at]
            if whole.any():
                s = at[whole]
                by_start = np.argsort(s)
                s, size = s[by_start], np.repeat(sizes, sizes)[whole][by_start]
                blocks[width] = (s, rank[s], rank[s] + size)
        if 2 * width * REPEATS > longest and width >= base:
            break
        slots, at = slots[several], at[several]
        follow = at + width
        inside = follow < end[at]
        keys = rank[at] * (n + 1)
        keys[inside] += rank[follow[inside]] + 1
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        sa[slots] = at[order]
        width *= 2
    return sa, blocks


class _Stretches:
    """Stretches of words with a given period; the runs among them are kept by period."""

    def __init__(self, words: np.ndarray, first: np.ndarray, min_length: int):
        self.words, self.first, self.min_length = words, first, min_length
        self.known: dict[int, list[tuple[int, int]]] = {}

    def around(self, s: int, p: int) -> tuple[int, int]:
        """The longest stretch of period ``p`` that holds ``s`` and ``s + p``, which are equal."""
        runs = self.known.get(p, [])
        i = bisect_right(runs, (s, len(self.words))) - 1
        if i >= 0 and s + p < runs[i][1]:
            return runs[i]
        text = bisect_right(self.first, s) - 1
        low, high = self.first[text], self.first[text + 1]
        found = (s - self._equal(s - 1, s - 1 + p, s - low, -1),
                 s + p + self._equal(s, s + p, high - s - p, 1))
        if found[1] - found[0] >= max(self.min_length, REPEATS * p):
            insort(self.known.setdefault(p, []), found)
        return found

    def _equal(self, a: int, b: int, most: int, step: int) -> int:
        """How many words from ``a`` and ``b`` on are equal, at most ``most``, forwards or backwards."""
        done, size = 0, 16
        while done < most:
            size = min(size, most - done)
            if step > 0:
                left, right = self.words[a : a + size], self.words[b : b + size]
            else:
                left, right = self.words[a - size + 1 : a + 1][::-1], self.words[b - size + 1 : b + 1][::-1]
            other = left != right
            at = int(other.argmax())
            if other[at]:
                return done + at
            done, a, b = done + size, a + step * size, b + step * size
            size *= 4
        return done

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` by start, then period. A stretch is found for multiples of its
        period as well; the smallest counts."""
        least: dict[tuple[int, int], int] = {}
        for p in sorted(self.known, reverse=True):
            least.update(dict.fromkeys(self.known[p], p))
        return sorted((a, b - a, p) for (a, b), p in least.items())


def find_runs(
    words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH
) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each of some texts in a row, by start, then period.

    ``words`` has a number for each word, equal for equal words; ``first`` where each text begins, and
    the end of the last. Starts count from the begin of the text.
    """
    out: list[list] = [[] for _ in range(len(first) - 1)]
    base = 1
    while 2 * base * REPEATS <= min_length:
        base *= 2
    sa, blocks = repeated_blocks(words, first, base)
    if not blocks:
        return out
    # Only texts with repeated blocks go on, moved together.
    text_of = lambda s: np.searchsorted(first, s, side="right") - 1
    texts = np.unique(text_of(np.concatenate([b[0] for b in blocks.values()])))
    lengths = first[texts + 1] - first[texts]
    begins = np.append(0, np.cumsum(lengths))
    shift = np.zeros(len(first), dtype=np.int64)
    shift[texts] = first[texts] - begins[:-1]
    moved = np.repeat(shift[texts], lengths)
    from_ = np.arange(begins[-1]) + moved
    tree, n = WaveletTree(sa[from_] - moved), int(begins[-1])
    seen = _Stretches(words[from_], begins.tolist(), min_length)
    for width in sorted(blocks):
        by = shift[text_of(blocks[width][0])]
        s, lo, hi = (c - by for c in blocks[width])
        if width == base:
            again = tree.successor(lo, hi, s + 1, 2 * n)
            for i in np.flatnonzero(again - s < width).tolist():
                seen.around(int(s[i]), int(again[i] - s[i]))
        stay = np.ones(len(s), dtype=bool)
        for p, runs in seen.known.items():
            for a, b in runs if p <= width else ():
                if b - a >= 3 * width:
                    stay[np.searchsorted(s, a) : np.searchsorted(s, b - 3 * width, side="right")] = False
        s, lo, hi = s[stay], lo[stay], hi[stay]
        places = [tree.successor(lo, hi, s + width, 2 * n)]
        near = places[0] < s + 2 * width
        s, lo, hi, places = s[near], lo[near], hi[near], [places[0][near]]
        for _ in range(2):
            places.append(tree.successor(lo, hi, places[-1] + 1, 2 * n))
        for at, one, two, three in zip(s.tolist(), *(c.tolist() for c in places)):
            if three < at + 2 * width:
                here, there = seen.around(at, two - one), seen.around(one, two - one)
                candidates = {there[0] - here[0], there[1] - here[1]}
            else:
                candidates = {one - at, two - at}
            for p in candidates:
                if width <= p < 2 * width and seen.words[at] == seen.words[at + p]:
                    seen.around(at, p)
    for start, length, period in seen.runs():
        t = bisect_right(seen.first, start) - 1
        out[texts[t]].append((start - seen.first[t], length, period))
    return out


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest ``length / period``, exactly; of equal ones that with the smallest start,
    then period. Two such numbers differ by more than ``2**-63`` for periods below ``2**31``."""
    return max(runs, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]), default=None)


def _strips(texts: list) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts at a time."""
    held, size = [], 0
    for t in texts:
        held.append(utf8(t).split())
        size += len(held[-1])
        if size >= STRIP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum([0] + [len(t) for t in texts])
    number: dict[bytes, int] = {}
    for t in texts:
        for w in dict.fromkeys(t):
            number.setdefault(w, len(number))
    at = number.__getitem__
    words = np.fromiter((i for t in texts for i in map(at, t)), dtype=np.int64, count=first[-1])
    return words, first


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "struct<start: long, length: long, period: long>"


def detect(
    docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, runs, strongest, text)`` for each row: all runs as an array of (start, length,
    period) in words, by start, then period; the run with the greatest exponent (else null); and the
    words that stay when every run is cut to its first period, joined by one space."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "runs", "strongest", "text"]
        for batch in batches:
            done = 0
            for texts in _strips(batch.column(1).to_pylist()):
                found = find_runs(*_numbered(texts), min_length)
                kept = [
                    b" ".join(compress(t, collapsed(len(t), r).tolist()) if r else t).decode(
                        "utf-8", "surrogatepass")
                    for t, r in zip(texts, found)
                ]
                columns = [
                    batch.column(0).slice(done, len(texts)),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[dict(zip(_RUN.names, r)) for r in rs] for rs in found], pa.list_(_RUN)),
                    pa.array([r and dict(zip(_RUN.names, r)) for r in map(strongest, found)], _RUN),
                    pa.array(kept, pa.string()),
                ]
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<{_RUN_DDL}>, strongest {_RUN_DDL}, text string"
    )


def as_lines(runs):
    """A column of runs as one line ``start,length,period`` each."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
