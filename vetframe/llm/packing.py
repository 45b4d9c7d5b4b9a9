"""Packing of documents into sequences of a fixed number of tokens, by the sum-of-squares rule.

``tokenize`` turns documents into pieces of at most ``capacity`` tokens, ``plan`` gives every piece
a sequence and an offset, ``sequences`` builds the token sequences themselves.

How a plan is made. Only the lengths of the pieces travel: pieces of full length are sequences of
their own; the others are dealt by hash to shards. A shard places one piece after another. With
``N(g)`` the number of open sequences that have ``g`` tokens left, the sum of ``N(g)**2`` changes
by ``2 (N(g - s) - N(g) + 1)`` when a piece of ``s`` tokens goes to a sequence with gap ``g > s``;
the gap with the smallest change is taken, and a new sequence competes under the same rule. A
sequence that ends up less than ``keep`` full is taken apart, and its pieces are dealt to fewer
shards in the next round, until one last shard holds what is left. The number of pieces that one
shard holds is bounded by ``shard_rows``. A round takes apart at most half of its pieces, those in
the sequences with the largest gaps, so the rounds end, and many nearly full sequences (where
lengths don't add up) never keep the emptier ones from being packed again.

Nulls, ties, repeats: a null text is an empty one and has the closing token alone; a null id
counts as an id; repeated rows are packed once for each row. Extra columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import batch_of, chunks, stored, utf8
from .wordhash import word_hashes

#: Tokens of a sequence.
CAPACITY = 4096
#: Closes every document.
END_TOKEN = 1
#: Pieces packed by one shard.
SHARD_ROWS = 40_000
#: A sequence filled less than this is taken apart for the next round.
KEEP = 0.998
#: Pieces whose tokens a worker remembers (about 120 MB).
CACHE_PIECES = 500_000
#: Characters of text that are split at a time.
TEXT_BYTES = 4 << 20

_tokenizers: dict = {}


class WordTokenizer:
    """Token ids of texts, by the pieces that the tokenizer splits them into.

    The vocabulary's tokenizer lowers the case, splits at white space, and splits words into runs
    of letters and runs of marks, before it merges the bytes of each piece. Pieces repeat, so the
    distinct ones of a whole run of texts are found first (by hashes), and the ids of a bounded
    number of pieces are remembered. The bytes of letters and marks are merged by rank, which the
    byte-pair merges of this kind of vocabulary come down to. Whatever is not plainly Latin letters
    and ASCII marks (digits, apostrophes, other scripts, special tokens) goes to the tokenizer
    itself, word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._merge = _merger(path)
        self._pieces: dict[bytes, bytes] = {}
        self._words: dict[bytes, bytes] = {}

    def many(self, texts: list) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        for lo, hi in chunks(texts, TEXT_BYTES):
            part = [t or "" for t in texts[lo:hi]]
            if self._merge is None:
                yield from map(self._slow, part)
                continue
            lower = [_lower(t) for t in part]
            fast = self._fast([b for b in lower if b is not None])
            for t, b in zip(part, lower):
                yield self._slow(t) if b is None else next(fast)

    def _slow(self, text: str) -> np.ndarray:
        words = utf8(text).split()
        known = self._words
        if len(known) > CACHE_PIECES:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self._encoded(w)
        return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")

    def _encoded(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        return _numbers(self._model.encode(text, add_special_tokens=False).ids)

    def _fast(self, parts: list[bytes]) -> Iterator[np.ndarray]:
        whole = b"\n".join(parts)
        data = np.frombuffer(whole, dtype=np.uint8)
        starts, ends, odd = _split(data)
        borders = np.cumsum([0] + [len(p) + 1 for p in parts])
        _, at, which = np.unique(
            word_hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        known, merge = self._pieces, self._merge
        if len(known) > CACHE_PIECES:
            known.clear()
        pieces = [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        ids = [known.get(p) for p in pieces]
        for i in [i for i, found in enumerate(ids) if found is None]:
            piece = pieces[i]
            ids[i] = known[piece] = (
                self._encoded(piece) if odd[at[i]] else _numbers(merge(piece + _WORD_END))
            )
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        begins = np.cumsum(lengths) - lengths
        n = lengths[which]
        upto = np.append(0, np.cumsum(n))
        # Token t of piece p stands at begins[p] + (t - first token of p).
        out = flat[np.repeat(begins[which] - upto[:-1], n) + np.arange(upto[-1])]
        tokens = upto[np.searchsorted(starts, borders)]
        for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist()):
            yield out[a:b]


def _numbers(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Stands for the end of a word; no UTF-8 text has this byte.
_WORD_END = b"\xff"
#: Bytes: white space 0, letters 1, marks 2, all others 3.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[0x80:0xC9] = 1
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 2


def _lower(text: str) -> bytes | None:
    """Lower-case UTF-8 of a text below U+0240 without special tokens, and without a letter whose
    lower case depends on more than itself; else nothing."""
    if "<|" in text or "\u0130" in text or "\u03a3" in text:
        return None
    lower = utf8(text.lower())
    if text.isascii() or np.frombuffer(lower, dtype=np.uint8).max() < 0xC9:
        return lower
    return None


def _split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces in lower-case UTF-8 below U+0240, and whether a piece is a
    whole word that is not made of letters and marks only."""
    kind = np.zeros(len(data) + 2, dtype=np.uint8)
    kind[1:-1] = _KIND[data]
    # U+0080 to U+00BF and the signs of multiplication and division are no letters (or few are).
    for i in np.flatnonzero(data == 0xC2).tolist():
        kind[i + 1 : i + 3] = 3
    for i in np.flatnonzero(data[:-1] == 0xC3).tolist() if (data == 0xC3).any() else ():
        if data[i + 1] in (0x97, 0xB7):
            kind[i + 1 : i + 3] = 3
    others = np.flatnonzero(kind == 3)
    if len(others):
        space = kind == 0
        word_starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        word_ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        for w in np.unique(np.searchsorted(word_starts, others, side="right") - 1).tolist():
            kind[word_starts[w] : word_ends[w]] = 3
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    kinds = kind[change[:-1]]
    pieces = kinds != 0
    return change[:-1][pieces] - 1, change[1:][pieces] - 1, kinds[pieces] == 3


def _merger(path: str):
    """Byte-pair merging by rank for a vocabulary file, if its kind allows that."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
        return None
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(vocabulary) - len(pairs)
    if any(vocabulary.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
        return None  # ids aren't in the order of the merges
    alphabet = {c: b for b, c in enumerate(_byte_letters())}
    ranks = {}
    for token, rank in vocabulary.items():
        end = token.endswith("</w>")
        plain = bytes(alphabet[c] for c in (token[:-4] if end else token))
        ranks[plain + _WORD_END if end else plain] = rank
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    merging = tiktoken.Encoding(
        "words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
    )
    return merging._core_bpe.encode_single_piece


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: printable Latin-1
    bytes stand for themselves, the others are numbered from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenize(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_token: int = END_TOKEN,
    with_ids: bool = True,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the pieces of every whole text.

    ``vocabulary`` is a tokenizer file that splits at white space; every executor needs it at that
    path. ``ids`` is a binary column of little-endian 32-bit ids; ``ids_crc32`` its checksum.
    """
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))
    closing = np.array([end_token], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).many
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.concatenate([ids, closing])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    rows["doc_id"].append(doc)
                    rows["piece"].append(k)
                    rows["start"].append(at)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        rows["ids"].append(part)
            yield batch_of(schema, **rows)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(run, ddl + (", ids binary" if with_ids else ""))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares placement in the given order: bin and offset of each piece, fill of each bin.

    ``open_bins[g]`` is a stack of the bins with ``g`` tokens left, ``counts[g]`` its height.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    # cost[g]: change of the sum for a gap without open bins is never looked at.
    never = np.iinfo(np.int64).max // 4
    for i, s in enumerate(lengths.tolist()):
        # A closed bin (gap 0) isn't counted, so an exact fit only lowers N(s).
        after = counts[: capacity + 1 - s].copy()
        after[0] = 0
        before = counts[s:]
        change = np.where(before > 0, 2 * (after - before) + 2, never)
        if before[0] > 0:
            change[0] = 1 - 2 * before[0]
        new = 1 + 2 * counts[capacity - s] if s < capacity else 0
        g = int(change.argmin())
        if change[g] <= new and change[g] != never:
            gap = g + s
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap = capacity
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets, np.array(fill, dtype=np.int64)


_PLACED = "doc_id long, piece int, row long, length long, sequence_id long, offset long, fill long"


def _pack_shards(pieces: DataFrame, shards: int, round_no: int, capacity: int) -> DataFrame:
    """Pack every shard on its own; sequence ids are (round, shard, bin) in one number."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("row", pa.int64()), ("length", pa.int64()),
         ("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())]
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        # A repeatable order that does not depend on the length or on how rows arrive.
        table = table.sort_by([("_order", "ascending"), ("doc_id", "ascending"),
                               ("piece", "ascending"), ("row", "ascending")])
        bins, offsets, fill = place(table["length"].to_numpy(), capacity)
        base = ((round_no << 40) + shard) << 18
        return pa.table(
            [table["doc_id"], table["piece"], table["row"], table["length"],
             pa.array(bins + base), pa.array(offsets), pa.array(fill[bins])],
            schema=schema,
        )

    order = F.xxhash64("doc_id", "piece", "row", F.lit(round_no))
    return (
        pieces.select("doc_id", "piece", "row", "length", order.alias("_order"))
        .withColumn("_shard", F.pmod(F.shiftright("_order", 20), F.lit(shards)))
        .groupBy("_shard")
        .applyInArrow(run, _PLACED)
    )


def plan(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    keep: float = KEEP,
) -> DataFrame:
    """``pieces`` (doc_id, piece, length, …) with ``sequence_id`` and ``offset``.

    ``pieces`` is stored first, because its rows are numbered (``row``) to tell repeated rows
    apart, and the rounds read their lengths again.
    """
    held = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = held.select("doc_id", "piece", "row", "length").where(F.col("length") < capacity)
    n = rest.count()
    done: list[DataFrame] = []
    round_no = 1
    while True:
        shards = max(1, -(-n // shard_rows))
        packed = stored(_pack_shards(rest, shards, round_no, capacity), "packed")
        if shards == 1:
            done.append(packed)
            break
        by_fill = packed.where(F.col("fill") < int(keep * capacity)).groupBy("fill").count()
        # The emptiest sequences first, as long as they hold half of the pieces at most.
        limit, left = 0, 0
        for fill, count in sorted(map(tuple, by_fill.collect())):  # at most ``capacity`` rows
            if left + count > 0.5 * n:
                break
            limit, left = fill + 1, left + count
        good = F.col("fill") >= limit
        done.append(packed.where(good))
        rest = packed.where(~good).select("doc_id", "piece", "row", "length")
        if not left:
            break
        n, round_no = left, round_no + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    placed = placed.select(F.col("row").alias("_row"), "sequence_id", "offset")
    full = F.col("length") >= capacity
    alone = held.where(full).select(
        *pieces.columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # Row numbers use up to 63 bits; ids of shards are kept apart from them by their sign.
    shared = held.where(~full).join(placed, F.col("row") == F.col("_row")).select(
        *pieces.columns, (-1 - F.col("sequence_id")).alias("sequence_id"), "offset"
    )
    return alone.unionByName(shared)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenize and plan in one step, without the ids themselves."""
    return plan(tokenize(docs, vocabulary, capacity=capacity, with_ids=False, **options), capacity)


def sequences(planned: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)`` of a plan whose pieces carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return planned.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
