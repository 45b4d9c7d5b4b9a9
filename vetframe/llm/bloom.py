"""Two Bloom filters over a corpus: which hashes were seen once, and which were seen again.

Each task fills its own pair of bit arrays and passes on their non-empty segments, compressed; the
segments of all tasks are merged where they meet. A bit that two tasks have set is set in the
twice-seen filter: a hash that occurs in both has set all its bits in both, so none is missed. The
merged twice-seen filter has a fixed number of bits, at most ``MAX_BITS`` (64 MB), which bounds
what is broadcast. With more hashes than it has room for, it lets more once-seen hashes through;
the exact confirmation that follows then has more to do, and its result stays the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import batch_of

#: Bits of a filter, at most; a power of two.
MAX_BITS = 1 << 29
MIN_BITS = 1 << 16
BITS_PER_HASH = 16
#: Bits of a segment, the unit that is merged.
SEGMENT_BITS = 1 << 20

_loaded: dict[str, np.ndarray] = {}


def filter_bits(hashes: int, max_bits: int = MAX_BITS) -> int:
    """Bits for a number of hashes: a power of two, within the bounds."""
    wanted = max(MIN_BITS, BITS_PER_HASH * max(1, hashes))
    return min(max_bits, 1 << (wanted - 1).bit_length())


def _positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(
        filter_, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    )


class Filters:
    """The pair of filters of one task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, dtype=np.uint8)
        self.twice = np.zeros(bits // 8, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Take in hashes; one that stands here several times was seen several times."""
        if not len(hashes):
            return
        values, counts = np.unique(hashes, return_counts=True)
        a, b = _positions(values, self.bits)
        again = (counts > 1) | (_has(self.once, a) & _has(self.once, b))
        for at in (a, b):
            _put(self.twice, at[again])
            _put(self.once, at)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = min(SEGMENT_BITS, self.bits) // 8
        for k in range(0, self.bits // 8, size):
            once, twice = self.once[k : k + size], self.twice[k : k + size]
            if once.any():
                yield (
                    k // size, zlib.compress(once.tobytes(), 1),
                    zlib.compress(twice.tobytes(), 1) if twice.any() else b"",
                )


_SEGMENTS = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def twice_seen(
    df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int
) -> dict[int, bytes]:
    """The merged twice-seen filter of a table as compressed segments.

    ``hashes_of`` yields arrays of unsigned 64-bit hashes of a batch; a hash counts once for each
    time it stands in them.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            for hashes in hashes_of(batch):
                filters.add(hashes)
        for segment, once, twice in filters.segments():
            yield batch_of(_SEGMENTS, segment=[segment], once=[once], twice=[twice])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(SEGMENT_BITS, bits) // 8
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def plain(z: bytes) -> np.ndarray:
            return np.frombuffer(zlib.decompress(z), dtype=np.uint8)

        for batch in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if s not in held:
                    held[s] = (np.zeros(size, np.uint8), np.zeros(size, np.uint8))
                o, t = held[s]
                new = plain(once)
                t |= o & new
                if twice:
                    t |= plain(twice)
                o |= new
        for s, (_, t) in held.items():
            if t.any():
                z = zlib.compress(t.tobytes(), 1)
                yield batch_of(_SEGMENTS, segment=[s], once=[None], twice=[z])

    ddl = "segment int, once binary, twice binary"
    merged = df.mapInArrow(fill, ddl).repartition("segment").mapInArrow(merge, ddl)
    return {r["segment"]: bytes(r["twice"]) for r in merged.select("segment", "twice").collect()}


class Probe:
    """Tests hashes against a merged filter; made on the driver, unpacked once in each worker."""

    def __init__(self, spark, name: str, segments: dict[int, bytes], bits: int):
        self.name, self.bits = name, bits
        self._sent = spark.sparkContext.broadcast(segments)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.name not in _loaded:
            _loaded.clear()
            size = min(SEGMENT_BITS, self.bits) // 8
            whole = np.zeros(self.bits // 8, dtype=np.uint8)
            for s, z in self._sent.value.items():
                whole[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(z), np.uint8)
            _loaded[self.name] = whole
        whole = _loaded[self.name]
        a, b = _positions(hashes, self.bits)
        return _has(whole, a) & _has(whole, b)
