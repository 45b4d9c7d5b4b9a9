"""Duplicate passages inside and across documents, by relative Lempel-Ziv parsing.

Every window of ``WINDOW`` words that also starts earlier (in a document with a smaller id, or
before in the same one) is a seed of a factor; the words under it are duplicates. Documents are
parsed against the windows' first occurrences: from a seed, a factor goes on as long as the next
window first occurs one word after the last one's place in the same reference document. Where that
ends, the next window is looked up again, so repeats that lie across the border of two factors are
found as well, and the parse covers exactly the words that the rule names.

The reference index is spread over the cluster in blocks, by the hash of the window; a document's
windows are looked up in every block that may hold them. Two things keep this small:

* An *anchor* is the word run of ``ANCHOR`` words with the smallest hash in a window; equal windows
  have equal anchors, and about seven windows in a row share one. Only anchors are counted over
  the corpus; windows whose anchor occurs once are never shuffled. Repeated anchors go into a Bloom
  filter of bounded size. What it lets through in vain is found to be single by the index.
* Of the windows of an Arrow batch that are equal, only the first goes to the index, so a passage
  that stands in a third of all documents reaches it once for each batch, not for each document.

Windows are compared by 96 bits of hash, which differ from those that choose the blocks' bits.

First and repeated windows of a batch leave the same pass over the texts, so both come from one
cut into batches, whatever order the rows were read in.

Nulls, ties, repeats: a null text has no words; a null id comes before all others; rows that share
an id are one document with several texts, told apart by a hash of the text, and of windows that
start at the same word of both, neither is earlier. Texts of fewer words than a window stay whole. Extra columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import broadcast_if_small
from . import bloom
from .base import chunks, stored, utf8
from .wordhash import NOT_SPACE, run_hashes, spans, word_hashes

WINDOW = 20
ANCHOR = 6
#: Words handled at a time; positions within fit into the low bits of a sort key.
STRIP = 1 << 20
_LOWEST = -(1 << 63)


def _words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts in a row, and where each text's words begin (and the last end)."""
    parts = [utf8(t) for t in texts]
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    starts, ends = spans(data, NOT_SPACE)
    borders = np.cumsum([0] + [len(p) + 1 for p in parts])
    return word_hashes(data, starts, ends), np.searchsorted(starts, borders)


def window_anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest hash (the leftmost, by its upper bits) in each ``span`` of grams."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    low = np.uint64(STRIP - 1)
    for lo in range(0, n, STRIP - span):
        hi = min(n, lo + STRIP - span)
        part = grams[lo : hi + span - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = span - width
        if rest:
            key = np.minimum(key[: len(key) - rest], key[rest:])
        out[lo:hi] = (key[: hi - lo] & low).astype(np.int64) + lo
    return out


def _windows(words: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """Starts of the windows inside one text each, and the hashes of their anchors."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = run_hashes(words, anchor)
    at = window_anchors(grams, window - anchor + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    return starts, grams[at[starts]], at[starts]


def _anchors(texts: list, window: int, anchor: int) -> np.ndarray:
    words, first = _words(texts)
    if len(words) < window:
        return np.empty(0, dtype=np.uint64)
    starts, hashes, at = _windows(words, first, window, anchor)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    return hashes[new]


def repeated_anchors(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(a)``: anchors that stand at two places of the corpus or more."""
    schema = pa.schema([("a", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            held = [_anchors(values[lo:hi], window, anchor) for lo, hi in chunks(values)]
            a, n = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))],
                schema=schema,
            )

    counted = texts.select("text").mapInArrow(run, "a long, n int")
    return counted.groupBy("a").agg(F.sum("n").alias("n")).where("n >= 2").select("a")


#: First windows of a batch go to the index by ``h``; repeated ones, ``n`` in a row, only pass by.
_SEEN = "h long, n int, doc long, t long, x long, ref_doc long, ref_x long"
_FOUND = "doc long, t long, s long, n int, ref_doc long, ref_s long"


def _suspect_windows(batch: pa.RecordBatch, probe, window: int, anchor: int):
    """Windows of a batch whose anchor may be repeated: hash, document, text number, check bits
    and start."""
    docs, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    texts = batch.column(2).to_pylist()
    held = []
    for lo, hi in chunks(texts):
        words, first = _words(texts[lo:hi])
        if len(words) < window:
            continue
        starts, hashes, at = _windows(words, first, window, anchor)
        if not len(starts):
            continue
        keep = probe(hashes)
        starts, at = starts[keep], at[keep]
        if not len(starts):
            continue
        owner = np.searchsorted(first, starts, side="right") - 1
        h = run_hashes(words, window)[starts]
        # Further bits from the two halves of the window.
        half = run_hashes(words, window // 2)
        check = (half[starts] ^ (half[starts + window - window // 2] << np.uint64(1))) >> np.uint64(33)
        x = (check.astype(np.int64) << 32) | (starts - first[owner])
        held.append((h.view(np.int64), docs[lo + owner], numbers[lo + owner], x))
    if not held:
        return (np.empty(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*held))


def _in_order(h, doc, t, x):
    """Sort by window, then document and start; where a window's group begins."""
    check = x >> 32
    order = np.lexsort((x, doc, check, h))
    h, doc, t, x, check = h[order], doc[order], t[order], x[order], check[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    return h, doc, t, x, new


def _runs(doc, t, s, ref_doc, ref_s):
    """Repeated windows that follow each other, as their references do, as one row with their
    number."""
    order = np.lexsort((s, t, doc))
    columns = [c[order] for c in (doc, t, s, ref_doc, ref_s)]
    goes_on = np.ones(max(0, len(order) - 1), dtype=bool)
    for c, step in zip(columns, (0, 0, 1, 0, 1)):
        goes_on &= c[1:] == c[:-1] + step
    first = np.flatnonzero(np.append(True, ~goes_on)[: len(order)])
    n = np.diff(np.append(first, len(order))).astype(np.int32)
    return [c[first] for c in columns], n


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_bits: int = bloom.MAX_BITS
) -> DataFrame:
    """``(doc, t, s, n, ref_doc, ref_s)``: windows with an earlier occurrence, ``n`` in a row from
    the one that starts at word ``s``.

    ``docs`` has ``doc`` (long, not null), ``t`` (long, not null: tells texts of one document
    apart) and ``text``.
    """
    spark = docs.sparkSession
    repeated = stored(repeated_anchors(docs, window, anchor), "anchors")
    bits = bloom.filter_bits(repeated.count(), max_bits)

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        a = batch.column(0).to_numpy().view(np.uint64)
        yield np.concatenate([a, a])  # each is known to be repeated

    probe = bloom.Probe(
        spark, uuid.uuid4().hex, bloom.twice_seen(repeated, hashes_of, bits), bits
    )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc, t, x, new = _in_order(*_suspect_windows(batch, probe, window, anchor))
            ref = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else new.astype(np.int64)
            s, ref_s = x & 0xFFFFFFFF, x[ref] & 0xFFFFFFFF
            later = ~new & ((doc != doc[ref]) | (s != ref_s))
            run, n = _runs(doc[later], t[later], s[later], doc[ref[later]], ref_s[later])
            # They need no index; they are spread by document and start.
            away = (run[0] ^ run[2]) * np.int64(-7046029254386353131)
            none = np.arange(int(new.sum()) + len(n)) < int(new.sum())
            held = [(h[new], away), (np.zeros(int(new.sum()), np.int32), n)]
            held += list(zip((doc[new], t[new], x[new]), run[:3]))
            held += [(np.zeros(int(new.sum()), np.int64), c) for c in run[3:]]
            values = [np.concatenate(c) for c in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in values[:5]] + [pa.array(c, mask=none) for c in values[5:]],
                names=["h", "n", "doc", "t", "x", "ref_doc", "ref_x"],
            )

    def found(doc, t, x, n, ref_doc, ref_x) -> pa.RecordBatch:
        s, ref_s = x & 0xFFFFFFFF, ref_x & 0xFFFFFFFF
        later = (doc != ref_doc) | (s != ref_s)
        return pa.RecordBatch.from_arrays(
            [pa.array(c[later]) for c in (doc, t, s, n, ref_doc, ref_s)],
            names=["doc", "t", "s", "n", "ref_doc", "ref_s"],
        )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # window and first occurrence of the group that the last batch ended in
        for batch in batches:
            repeats = pc.greater(batch.column(1), 0)
            if batch.num_rows and repeats[batch.num_rows - 1].as_py():
                passing = batch.filter(repeats)
                yield found(*(passing.column(i).to_numpy() for i in (2, 3, 4, 1, 5, 6)))
                batch = batch.filter(pc.invert(repeats))
            h, doc, t, x = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
            if not len(h):
                continue
            check = x >> 32
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            new[0] = last is None or (h[0], check[0]) != last[0]
            if not new[0]:
                doc, t, x = (np.append(o, c) for o, c in zip(last[1:], (doc, t, x)))
                new = np.append(True, new)
            ref = np.flatnonzero(new)[np.cumsum(new) - 1]
            one = np.ones(int((~new).sum()), dtype=np.int32)
            yield found(doc[~new], t[~new], x[~new], one, doc[ref[~new]], x[ref[~new]])
            last = ((h[-1], check[-1]), doc[ref[-1]], t[ref[-1]], x[ref[-1]])

    return (
        docs.mapInArrow(seen, _SEEN)
        .repartition("h")
        # First windows come before those that only pass.
        .sortWithinPartitions("n", "h", F.shiftright("x", 32), "doc", "x")
        .mapInArrow(look_up, _FOUND)
    )


def parse(s: np.ndarray, ref_doc: np.ndarray, ref_s: np.ndarray, window: int) -> np.ndarray:
    """Factors ``(start, length, reference document, reference start)`` from repeated windows in
    ascending order: each is continued while the reference continues."""
    if not len(s):
        return np.empty((0, 4), dtype=np.int64)
    goes_on = (s[1:] == s[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1]) & (ref_s[1:] == ref_s[:-1] + 1)
    first = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(first[1:], len(s)) - 1
    return np.column_stack([s[first], s[last] - s[first] + window, ref_doc[first], ref_s[first]])


def deduplicate(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, factors)``: ``kept`` is the text of the words that stay,
    joined by one space; ``factors`` the duplicate spans as an array of (start, length, ref_doc,
    ref_start), in words. A null reference id reads as the lowest number."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = slim.withColumn("doc", F.coalesce("doc_id", F.lit(_LOWEST)))
    # Texts get a number of their own only where several rows share an id.
    shared = stored(named.groupBy("doc").count().where("count > 1").select("doc"), "shared-ids")
    shared = broadcast_if_small(shared.withColumn("_shared", F.lit(True)))
    numbered = named.join(shared, "doc", "left").select(
        "doc_id", "doc", "text",
        F.when(F.col("_shared"), F.xxhash64("text")).otherwise(F.lit(0)).alias("t"),
    )
    repeated = (
        repeated_windows(numbered.select("doc", "t", "text"), window, anchor, max_bits)
        .groupBy("doc", "t")
        .agg(F.collect_list(F.struct("s", "n", "ref_doc", "ref_s")).alias("seeds"))
    )
    joined = numbered.join(repeated, ["doc", "t"], "left").select("doc_id", "text", "seeds")
    factor = pa.struct([("start", pa.int64()), ("length", pa.int64()),
                        ("ref_doc", pa.int64()), ("ref_start", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept", pa.string()), ("factors", pa.list_(factor))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, factors = [], [], [], []
            for text, seeds in zip(batch.column(1), batch.column(2)):
                words = utf8(text.as_py()).split()
                stays = words
                spans_found: list[dict] = []
                if seeds.values is not None and len(seeds.values):
                    s, n, ref_doc, ref_s = (c.to_numpy() for c in seeds.values.flatten())
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    s, ref_s = np.repeat(s, n) + step, np.repeat(ref_s, n) + step
                    ref_doc = np.repeat(ref_doc, n)
                    # Rows with the same id and text give each of their windows several times.
                    order = np.lexsort((ref_s, ref_doc, s))
                    order = order[np.append(True, np.diff(s[order]) > 0)]
                    s, ref_doc, ref_s = s[order], ref_doc[order], ref_s[order]
                    parsed = parse(s, ref_doc, ref_s, window)
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, np.minimum(parsed[:, 0], len(words)), 1)
                    np.add.at(change, np.minimum(parsed[:, 0] + parsed[:, 1], len(words)), -1)
                    covered = np.cumsum(change[:-1]) > 0
                    stays = [words[i] for i in np.flatnonzero(~covered).tolist()]
                    spans_found = [
                        dict(zip(("start", "length", "ref_doc", "ref_start"), f))
                        for f in parsed.tolist()
                    ]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stays))
                kept.append(b" ".join(stays).decode("utf-8", "surrogatepass"))
                factors.append(spans_found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(factors, pa.list_(factor))],
                schema=schema,
            )

    return joined.mapInArrow(
        run,
        "doc_id long, n_words long, n_removed long, kept string, factors array<struct<"
        "start: long, length: long, ref_doc: long, ref_start: long>>",
    )
