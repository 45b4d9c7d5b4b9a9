"""Benchmark passages inside documents.

Documents and benchmark items are compared as words (letters and digits in lower case) by their
shingles of five words; an item of fewer words is one shingle. A document is contaminated by an
item if some window of as many words as the item has (or the whole document, if that is shorter)
reaches a weighted shingle similarity of ``SIMILARITY``: the sum of the smaller over the sum of the
larger counts of all shingles.

Search. The windows of a document that are as long as an item get a SimHash of their words, rolled on
from prefix sums. The SimHashes of the items of one length stand in eight tables by their bytes
(``Tables``): two fingerprints within ``RADIUS`` bits differ in a byte of the eight by ``RADIUS // 8``
bits at most, so looking up each byte and its neighbours by so many bits finds every item within the
radius. The pairs found are compared exactly. Windows that share fewer shingles with all items
together than the similarity takes are passed over before; that loses nothing.

The similarity doesn't bound the bits in which two windows differ: at the limit of 0.8 they are ten
on average, and a radius of 23 keeps what is measured in ``tests/llm/test_texts.py``. ``radius=None``
asks for the exact search instead: an inverted index from shingles to items counts what every window
shares with every item, and each pair that shares enough is compared.

Items are read in blocks of ``BLOCK_ITEMS`` items; a block is what a job broadcasts, so its size
has a bound, and each block goes over all documents.

Nulls, ties, repeats: null texts are empty and match nothing; items without words match nothing;
repeated rows give repeated results; of equally similar windows the first one is reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import batch_of, chunks, utf8
from .wordhash import ALPHANUMERIC, run_hashes, spans, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits in which the SimHashes of a window and an item differ at most. None: no SimHash, but what
#: windows and items share, counted.
RADIUS = 23
#: Items of a block, and their words at most (a longer item makes a block of its own).
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 4_000_000
#: Sign rows that are summed up at a time.
STRIP = 1 << 14
#: Pairs of a place and an item that are counted at a time; more if one window has more.
PAIRS = 1 << 20


def text_words(text: str | None) -> np.ndarray:
    """The hashes of a text's words."""
    data = np.frombuffer(utf8((text or "").lower()), dtype=np.uint8)
    return word_hashes(data, *spans(data, ALPHANUMERIC))


def signs(words: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    bits = np.unpackbits(
        words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of 64 sums: the bit is 1 where the sum is positive."""
    bits = np.packbits(sums > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted similarity of two shingle counts."""
    smaller = sum(min(n, b[s]) for s, n in a.items() if s in b)
    larger = sum(a.values()) + sum(b.values()) - smaller
    return smaller / larger if larger else 0.0


class Tables:
    """SimHashes of items, found again by any byte of the eight."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        #: What to flip in a byte: all masks of as many bits as the nearest byte differs by at most.
        self.flips = np.flatnonzero(np.bitwise_count(np.arange(256)) <= radius // 8).astype(np.uint8)
        of_byte = np.ascontiguousarray(prints.astype("<u8")).view(np.uint8).reshape(-1, 8)
        #: By byte: places in ``prints`` by the byte's value, and where each value begins.
        self.places = [np.argsort(of_byte[:, b], kind="stable") for b in range(8)]
        self.first = [np.searchsorted(of_byte[p, b], np.arange(257)) for b, p in enumerate(self.places)]

    def within(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, place)`` of all pairs within the radius: rows of ``fingerprints``, places in
        ``prints``, both ascending."""
        asked = np.ascontiguousarray(fingerprints.astype("<u8")).view(np.uint8).reshape(-1, 8)
        met = [np.zeros(0, dtype=np.int64)]
        for byte, (places, first) in enumerate(zip(self.places, self.first)):
            values = (asked[:, byte, None] ^ self.flips).ravel()
            n = first[1:][values] - first[values]
            rows = np.repeat(np.arange(len(asked)), n.reshape(len(asked), -1).sum(axis=1))
            at = places[np.arange(n.sum()) + np.repeat(first[values] - np.cumsum(n) + n, n)]
            close = np.bitwise_count(fingerprints[rows] ^ self.prints[at]) <= self.radius
            met.append(rows[close] * len(self.prints) + at[close])
        return np.divmod(np.unique(np.concatenate(met)), max(1, len(self.prints)))


class Items:
    """A block of benchmark items: shingles with their items, and the tables of fingerprints of the
    items of each size (without a radius: the items of each shingle)."""

    def __init__(self, items: list[tuple[object, np.ndarray]], shingle: int, radius: int | None):
        self.shingle, self.radius = shingle, radius
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(w) for _, w in items], dtype=np.int64)
        #: By shingle length (five, or fewer for short items): item numbers, sorted shingles.
        self.by_length: dict[int, tuple[list[int], np.ndarray]] = {}
        self.counts: list[Counter] = []
        held: dict[int, list[np.ndarray]] = {}
        for n, (_, w) in enumerate(items):
            k = min(shingle, len(w))
            h = run_hashes(w, k)
            self.counts.append(Counter(h.tolist()))
            held.setdefault(k, []).append(h)
            self.by_length.setdefault(k, ([], None))[0].append(n)
        for k, hs in held.items():
            self.by_length[k] = (self.by_length[k][0], np.unique(np.concatenate(hs)))
        #: By item size: item numbers and the tables of their fingerprints.
        self.tables: dict[int, tuple[np.ndarray, Tables]] = {}
        #: By item size: sorted shingles, where the items of each begin, item numbers.
        self.holders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if radius is not None:
            prints = [packed(signs(w).sum(axis=0, keepdims=True))[0] for _, w in items]
            self.prints = np.array(prints, dtype=np.uint64)
        for size in np.unique(self.sizes).tolist():
            numbers = np.flatnonzero(self.sizes == size)
            if radius is not None:
                self.tables[size] = (numbers, Tables(self.prints[numbers], radius))
                continue
            own = [np.array(list(self.counts[n]), dtype=np.uint64) for n in numbers.tolist()]
            grams = np.concatenate(own)
            order = np.argsort(grams, kind="stable")
            known, first = np.unique(grams[order], return_index=True)
            self.holders[size] = (
                known, np.append(first, len(grams)),
                np.repeat(numbers, [len(g) for g in own])[order],
            )

    def near(self, fingerprint: int) -> np.ndarray:
        """Numbers of all items within the radius."""
        asked = np.array([fingerprint], dtype=np.uint64)
        return np.sort(np.concatenate([n[t.within(asked)[1]] for n, t in self.tables.values()]))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values if len(among) else np.zeros(len(values), dtype=bool)


def _matches(words: np.ndarray, items: Items, k: int, least: float) -> dict[int, tuple]:
    """Best window of a document for each item whose shingles have ``k`` words:
    ``{item number: (similarity, start, words)}``."""
    numbers, known = items.by_length[k]
    grams = run_hashes(words, k)
    hit = _member(grams, known)
    if not hit.any():
        return {}
    before = np.zeros(len(hit) + 1, dtype=np.int64)
    np.cumsum(hit, out=before[1:])
    best: dict[int, tuple] = {}
    for size in np.unique(items.sizes[numbers]).tolist():
        window = min(size, len(words))
        m = window - k + 1
        # smaller / (m + own - smaller) >= least, with own shingles of the item
        own = size - k + 1
        need = least * (m + own) / (1 + least) - 1e-9
        if need > m:
            continue
        n_windows = len(words) - window + 1
        shared = before[m : m + n_windows] - before[:n_windows]
        starts = np.flatnonzero(shared >= need)
        if not len(starts):
            continue
        if items.radius is None:
            pairs = _sharing(grams, starts, m, items.holders[size], need)
        else:
            pairs = _near(words, starts, window, items, size)
        for s, n in pairs:
            if n in best and best[n][0] == 1.0:
                continue
            # All but ``m - need`` of the window's shingles are the item's: so is one of the first.
            if not any(g in items.counts[n] for g in grams[s : s + int(m - need) + 1].tolist()):
                continue
            x = similarity(Counter(grams[s : s + m].tolist()), items.counts[n])
            if x >= least and (n not in best or x > best[n][0]):
                best[n] = (x, s, window)
    return best


def _sharing(
    grams: np.ndarray, starts: np.ndarray, m: int, holders: tuple, need: float
) -> Iterator[tuple[int, int]]:
    """``(start, item number)``, by ascending starts for each item: windows of ``m`` shingles at
    ascending ``starts``, of which ``need`` or more are the item's."""
    known, first, numbers = holders
    at = np.searchsorted(known, grams)
    at[at == len(known)] = 0
    n_items = np.where(known[at] == grams, first[at + 1] - first[at], 0)
    upto = np.concatenate([[0], np.cumsum(n_items)])
    lo = 0
    while lo < len(starts):
        begin = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(upto[starts + m], upto[begin] + PAIRS, side="right")))
        windows = starts[lo:hi]
        places = begin + np.flatnonzero(n_items[begin : int(windows[-1]) + m])
        times = n_items[places]
        # Row by row, the items of the shingle at each place.
        rows = np.arange(times.sum()) + np.repeat(first[at[places]] - np.cumsum(times) + times, times)
        who, where = numbers[rows], np.repeat(places, times)
        order = np.argsort(who, kind="stable")
        who, where = who[order], where[order]
        found, begins, counts = np.unique(who, return_index=True, return_counts=True)
        for i in np.flatnonzero(counts >= need).tolist():
            own = where[begins[i] : begins[i] + counts[i]]
            shared = np.searchsorted(own, windows + m) - np.searchsorted(own, windows)
            for s in windows[shared >= need].tolist():
                yield s, int(found[i])
        lo = hi


def _near(
    words: np.ndarray, starts: np.ndarray, window: int, items: Items, size: int
) -> Iterator[tuple[int, int]]:
    """``(start, item number)``: windows with a SimHash within the radius of an item's of ``size``."""
    prints = window_prints(words, starts, window)
    numbers, tables = items.tables[size]
    step = max(1, PAIRS // len(numbers))
    for lo in range(0, len(starts), step):
        rows, places = tables.within(prints[lo : lo + step])
        yield from zip(starts[lo + rows].tolist(), numbers[places].tolist())


def window_prints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of ``size`` words at ascending ``starts``, strip by strip; words that
    lie in no window are skipped."""
    out = np.empty(len(starts), dtype=np.uint64)
    borders = np.append(np.flatnonzero(np.diff(starts) > size) + 1, len(starts)).tolist()
    lo = 0
    for end in borders:
        while lo < end:
            first = int(starts[lo])
            hi = min(end, int(np.searchsorted(starts, first + STRIP, side="right")))
            last = int(starts[hi - 1]) + size
            sums = np.zeros((last - first + 1, 64), dtype=np.int32)
            np.cumsum(signs(words[first:last]), axis=0, out=sums[1:])
            at = starts[lo:hi] - first
            out[lo:hi] = packed(sums[at + size] - sums[at])
            lo = hi
    return out


def blocks(benchmark: DataFrame, shingle: int, radius: int | None) -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size, one at a time on the driver."""
    held: list = []
    n_words = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = text_words(row["text"])
        if not len(words):
            continue
        if held and (len(held) >= BLOCK_ITEMS or n_words + len(words) > BLOCK_WORDS):
            yield Items(held, shingle, radius)
            held, n_words = [], 0
        held.append((row["item_id"], words))
        n_words += len(words)
    if held:
        yield Items(held, shingle, radius)


_MATCHES = pa.schema(
    [("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()),
     ("n_words", pa.int64())]
)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = SIMILARITY,
    shingle: int = SHINGLE_WORDS,
    radius: int | None = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, similarity, start, n_words)``: the most similar window of each document
    for every item it holds; ``start`` counts words from 0."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = slim.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {ids}, item_id long, similarity double, start long, n_words long"

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                owners: list[int] = []
                rows: dict[str, list] = {f.name: [] for f in _MATCHES}
                texts = batch.column(1).to_pylist()
                for lo, hi in chunks(texts):
                    for row, words in _documents(texts, lo, hi, items):
                        found: dict[int, tuple] = {}
                        for k in items.by_length:
                            found.update(_matches(words, items, k, least))
                        for n, (x, start, size) in sorted(found.items()):
                            owners.append(row)
                            rows["item_id"].append(items.ids[n])
                            rows["similarity"].append(x)
                            rows["start"].append(start)
                            rows["n_words"].append(size)
                out = batch_of(_MATCHES, **rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owners, pa.int64())), *out.columns],
                    names=["doc_id", *_MATCHES.names],
                )

        return run

    out = None
    for items in blocks(benchmark, shingle, radius):
        found = slim.mapInArrow(search(spark.sparkContext.broadcast(items)), ddl)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], ddl)


def _documents(texts: list, lo: int, hi: int, items: Items) -> Iterator[tuple[int, np.ndarray]]:
    """Word hashes of those documents of a run that share a shingle with an item.

    All texts of the run are hashed at once; shingles that reach over the end of a document can
    only let a document through in vain.
    """
    parts = [utf8((t or "").lower()) for t in texts[lo:hi]]
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    if not len(data):
        return
    starts, ends = spans(data, ALPHANUMERIC)
    words = word_hashes(data, starts, ends)
    borders = np.cumsum([0] + [len(p) + 1 for p in parts])
    first = np.searchsorted(starts, borders)
    hot = np.zeros(len(words) + 1, dtype=np.int64)
    for k, (_, known) in items.by_length.items():
        hit = _member(run_hashes(words, k), known)
        hot[1 : len(hit) + 1] |= hit
    hot = np.cumsum(hot)
    for i in np.flatnonzero(hot[first[1:]] > hot[first[:-1]]).tolist():
        yield lo + i, words[first[i] : first[i + 1]]


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns.

    Decided row by row, in the same pass that reads the text: rows are not joined by their id.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")
    least = options.get("least", SIMILARITY)

    def keeper(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), dtype=bool)
                for lo, hi in chunks(texts):
                    for row, words in _documents(texts, lo, hi, items):
                        keep[row] = not any(
                            _matches(words, items, k, least) for k in items.by_length
                        )
                yield batch.filter(pa.array(keep))

        return run

    shingle = options.get("shingle", SHINGLE_WORDS)
    for items in blocks(benchmark, shingle, options.get("radius", RADIUS)):
        docs = docs.mapInArrow(keeper(spark.sparkContext.broadcast(items)), docs.schema)
    return docs
