"""Byte-level BPE with a vocabulary of ranks, run by a sentencepiece model that is written from it.

``model`` turns a rank file into a serialised sentencepiece model. Every token becomes a piece: each of
its bytes is mapped to one printable letter, the score is the negative rank, so the model merges
the pair of the lowest rank first, the leftmost of equal ones, as rank vocabularies are defined.
The normaliser is the identity: no folding, no dummy prefix, no handling of blanks. The order of the
pieces is the order of the ids.

``encode`` cuts texts by the vocabulary's pattern and encodes each match (a *pre-token*) by itself. One that
is a token as a whole has its id, as the rank rules say; others go to the model. Pre-tokens repeat,
so a worker remembers the ids of a bounded number of them. ``decode`` maps ids back to pieces and pieces
back to bytes, by the model alone.

The model goes to the executors as a broadcast; it is as large as the vocabulary (about one megabyte), whatever
the corpus. Letters that Unicode has added since the rank library's tables were made (version 17) count as letters
here already. Long texts are cut in strips where no match can cross: before white space that follows
something else. Nothing is shuffled.

Nulls, ties, repeats: a null text is an empty one and has no ids; null ids decode to no bytes; repeated
rows give equal results, each its own. Other columns stay as they came, but for those that bear the
names of the new ones, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import utf8

#: Characters of a text that are cut at a time, about.
STRIP = 1 << 18
#: Pre-tokens whose ids a worker remembers (about 120 MB).
CACHE = 500_000
#: Pre-tokens that one call of the model encodes.
GROUP = 200

_ranked: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in filter(None, pairs)}


# ---------------------------------------------------------------- the model


def byte_letters() -> str:
    """A printable letter for each byte, none of them white space or special to the model: printable
    Latin-1 bytes stand for themselves, the others are numbered from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One field of a protocol buffer message: a text or message, a float or a non-negative number."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + bytes([value]))


# Field numbers and kinds of the public model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _KIND, _UNKNOWN = 1, 2, 3, 2
_MODEL_TYPE, _BPE = 3, 2
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5
#: Letter of the piece that the format demands for unknown letters. No byte has it, so no text does.
_NO_BYTE = "∅"


def model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ``r`` is the token of rank ``r``.

    Ranks must be 0, 1, 2 ... without gaps, below 2**24 (scores have 24 bits), and every byte must
    be a token, so that any text can be encoded.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or len(tokens) >= 1 << 24:
        raise ValueError("ranks must be consecutive from 0 and below 2**24")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be a token")
    letters = byte_letters()
    pieces = [
        _field(_PIECE, t.decode("latin-1").translate(letters)) + _field(_SCORE, -float(r))
        for r, t in enumerate(tokens)
    ]
    pieces.append(_field(_PIECE, _NO_BYTE) + _field(_SCORE, 0.0) + _field(_KIND, _UNKNOWN))
    normalizer = _field(_NAME, "identity") + b"".join(
        _field(option, 0) for option in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES)
    )
    return (
        b"".join(_field(_PIECES, p) for p in pieces)
        + _field(_TRAINER, _field(_MODEL_TYPE, _BPE))
        + _field(_NORMALIZER, normalizer)
    )


# ---------------------------------------------------------------- texts


class Codec:
    """Ids of texts and bytes of ids, by a model of :func:`model` and the pattern of its pre-tokens."""

    def __init__(self, serialised: bytes, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_proto=serialised)
        self._cut = regex.compile(pattern)
        self._border = regex.compile(r"(?<=\S)\s")
        self._letters = byte_letters()
        back = {ord(c): b for b, c in enumerate(self._letters)}
        size = self._model.get_piece_size() - 1
        pieces = self._model.id_to_piece(list(range(size)))
        self._bytes = [p.translate(back).encode("latin-1") for p in pieces]
        self._whole = {token: struct.pack("<I", i) for i, token in enumerate(self._bytes)}
        self._ids: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        known = self._ids
        return b"".join(b"".join(map(known.__getitem__, p)) for p in self._pre_tokens(text or ""))

    def _pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a strip at a time, with their ids in the memory."""
        start = 0
        while start < len(text):
            border = self._border.search(text, start + STRIP)
            end = border.start() if border else len(text)
            found = self._cut.findall(text, start, end)
            self._learn(set(found))
            yield found
            start = end

    def _learn(self, wanted: set[str]) -> None:
        known = self._ids
        if len(known) + len(wanted) > CACHE:
            known.clear()
        new = [p for p in wanted if p not in known]
        merged = []
        for p in new:
            token = utf8(p)
            if token in self._whole:
                known[p] = self._whole[token]
            else:
                merged.append((p, token.decode("latin-1").translate(self._letters)))
        for lo in range(0, len(merged), GROUP):
            part = merged[lo : lo + GROUP]
            # One call for many: no piece holds the letter between them, so nothing merges across.
            ids = np.array(self._model.encode(_NO_BYTE.join(m for _, m in part)), dtype="<u4")
            borders = np.append(np.flatnonzero(ids == len(self._bytes)), len(ids)).tolist()
            start = 0
            for (p, _), end in zip(part, borders):
                known[p] = ids[start:end].tobytes()
                start = end + 1

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of some ids."""
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def _codec(serialised, digest: str, pattern: str) -> Codec:
    """The codec of a broadcast model, built once in each worker."""
    if (digest, pattern) not in _ranked:
        _ranked[digest, pattern] = Codec(serialised.value, pattern)
    return _ranked[digest, pattern]


def _per_row(df: DataFrame, source: str, columns: dict[str, tuple[pa.DataType, str]], ranks, pattern,
             make) -> DataFrame:
    """Add columns that ``make(codec, values)`` computes from a column, batch by batch."""
    proto = model(ranks)
    shared, digest = df.sparkSession.sparkContext.broadcast(proto), hashlib.sha256(proto).hexdigest()
    kept = [c for c in df.columns if c not in columns]
    slim = df.select(*[F.col(f"`{c}`") for c in kept], F.col(source).alias("_source"))
    ddl = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in kept]
        + [f"{name} {kind}" for name, (_, kind) in columns.items()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, digest, pattern)
        for batch in batches:
            made = make(codec, batch.column(len(kept)))
            new = [pa.array(m, kind) for m, (kind, _) in zip(made, columns.values())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(kept)] + new, names=kept + list(columns))

    return slim.mapInArrow(run, ddl)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """The rows with ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit numbers)."""

    def make(codec: Codec, texts: pa.Array):
        ids = [codec.encode(t.as_py()) for t in texts]
        return [len(i) // 4 for i in ids], ids

    columns = {"n_tokens": (pa.int64(), "long"), "ids": (pa.binary(), "binary")}
    return _per_row(docs, text_col, columns, ranks, pattern, make)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the bytes (binary) that the ids stand for."""

    def make(codec: Codec, ids: pa.Array):
        return ([codec.decode(i.as_py()) for i in ids],)

    return _per_row(encoded, ids_col, {"decoded": (pa.binary(), "binary")}, ranks, pattern, make)
