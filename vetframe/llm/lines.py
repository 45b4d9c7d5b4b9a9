"""Removal of lines that many documents share.

A line's key is the line without white space at its ends and with A-Z in lower case. Two Bloom
filters tell which keys may occur in more than one document; only those lines are shuffled, to
count their documents exactly and to find their first occurrence.

* A null or empty text is one empty line. An empty key is never a repeated line.
* Documents are told apart by their id: rows that share an id (a null id is one, too) are one
  document, and each row comes back with its own lines dropped. Lines that repeat inside one
  document only are not shared.
* Ties: the first occurrence is the one with the smallest id (null first), then line number.
* All columns of the table stay; ``n_lines`` and ``n_dropped`` are added (and replaced, if the
  table has columns of these names).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bloom
from .base import batch_of, null_safe, stored, utf8

#: Documents that must share a line.
MIN_DOCUMENTS = 10


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys, as UTF-8."""
    lines = utf8(text).split(b"\n")
    return lines, [line.strip().lower() for line in lines]


def _digests(keys: list[bytes]) -> list[bytes]:
    """128-bit digests; the chance that two of 10**12 different keys share one is below 10**-14."""
    digest = xxhash.xxh3_128_digest
    return [digest(k) if k else b"" for k in keys]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2]


def shared_lines(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = bloom.MAX_BITS,
) -> tuple[DataFrame, DataFrame]:
    """``(suspects, shared)``: ``suspects`` (doc_id, key, line) has the lines that passed the
    filter, once for each document and key, with the first line number; ``shared``
    (key, n_documents, first_doc, first_line) those keys that really occur in ``min_documents``
    documents or more (at least 2)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = texts.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
    bits = bloom.filter_bits(n_lines, max_bits)

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held: list[bytes] = []
        for text in batch.column(0):
            held += set(_digests(line_keys(text.as_py())[1])) - {b""}
            if len(held) > 50_000:
                yield _hashes(held)
                held = []
        yield _hashes(held)

    segments = bloom.twice_seen(texts.select("text"), hashes_of, bits)
    probe = bloom.Probe(spark, uuid.uuid4().hex, segments, bits)
    schema = pa.schema([("key", pa.binary()), ("line", pa.int64())])
    ids = texts.schema["doc_id"].dataType.simpleString()

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, owners = [], [], []
            for row, text in enumerate(batch.column(1)):
                first: dict[bytes, int] = {}
                for at, d in enumerate(_digests(line_keys(text.as_py())[1])):
                    if d:
                        first.setdefault(d, at)
                if first:
                    found = list(first)
                    for j in np.flatnonzero(probe(_hashes(found))).tolist():
                        keys.append(found[j])
                        lines.append(first[found[j]])
                        owners.append(row)
            out = batch_of(schema, key=keys, line=lines)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *out.columns],
                names=["doc_id", "key", "line"],
            )

    suspects = stored(
        texts.mapInArrow(suspect, f"doc_id {ids}, key binary, line long"), "suspects"
    )
    # One row for each document and key first, so that rows sharing an id count once. A key of
    # very many documents is spread by the document and then counted in parts.
    shared = (
        suspects.groupBy("key", "doc_id")
        .agg(F.min("line").alias("line"))
        .groupBy("key")
        .agg(
            F.count("*").alias("n_documents"),
            F.min(F.struct("doc_id", "line")).alias("_first"),
        )
        .where(F.col("n_documents") >= max(2, min_documents))
        .select(
            "key", "n_documents", F.col("_first.doc_id").alias("first_doc"),
            F.col("_first.line").alias("first_line"),
        )
    )
    return suspects, shared


def drop_shared_lines(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """The table without the lines that ``min_documents`` documents share.

    ``keep_first`` leaves the first occurrence of each such line. The other lines stay as they
    are, joined by line feeds; a null text becomes an empty one.
    """
    suspects, shared = shared_lines(docs, min_documents, id_col, text_col, max_bits)
    # Stored, so that the join below has two plain sides, and a key of very many documents is cut
    # into several tasks.
    shared = stored(shared, "shared")
    # The line that stays, for the document that has the first occurrence.
    stays = F.when(F.col("doc_id").eqNullSafe(F.col("first_doc")), F.col("first_line"))
    drops = (
        suspects.join(shared, "key")
        .select("doc_id", "key", F.coalesce(stays if keep_first else F.lit(None), F.lit(-1))
                .cast("long").alias("stays"))
        .groupBy(F.col("doc_id").alias("_drop_id"))
        .agg(F.collect_set(F.struct("key", "stays")).alias("_drops"))
    )
    docs = docs.drop("n_lines", "n_dropped", "_drop_id", "_drops")
    joined = docs.join(drops, null_safe(docs, drops, {id_col: "_drop_id"}), "left").drop("_drop_id")
    at_text, at_drops = joined.columns.index(text_col), joined.columns.index("_drops")
    kept_columns = [i for i, c in enumerate(joined.columns) if c != "_drops"]
    names = [joined.columns[i] for i in kept_columns] + ["n_lines", "n_dropped"]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(at_text), batch.column(at_drops)):
                gone = drops.as_py()
                value = text.as_py() or ""
                if not gone:
                    n_lines.append(value.count("\n") + 1)
                    n_dropped.append(0)
                    texts.append(value)
                    continue
                lines, keys = line_keys(value)
                stay = {g["key"]: g["stays"] for g in gone}
                kept = [
                    line for i, (line, d) in enumerate(zip(lines, _digests(keys)))
                    if d not in stay or stay[d] == i
                ]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            columns = [
                pa.array(texts, pa.string()) if i == at_text else batch.column(i)
                for i in kept_columns
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=names,
            )

    out = ", ".join(
        f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names[:-2]
    )
    return joined.mapInArrow(drop, f"{out}, n_lines long, n_dropped long")
