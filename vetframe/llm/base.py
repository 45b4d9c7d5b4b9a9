"""Helpers the operators share: tables in the shared folder, null-safe joins, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import ensure_checkpoint_dir

#: Rows of an Arrow batch handled at a time hold about this many bytes of text.
CHUNK_BYTES = 1 << 20


def find_package(spark) -> None:
    """Let local Python workers import this package whatever the working folder is."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_path(spark, name: str) -> str:
    """A new path in the folder that all executors see (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the copy.

    Lineage ends there: a lost executor costs a read of the copy, not a new computation, and two
    readers do not compute it twice. Parquet keeps it small and lets later steps read only the
    columns they need.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    """Join condition in which null equals null (``pairs``: left column -> right column)."""
    condition = F.lit(True)
    for a, b in pairs.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def utf8(value: str | None) -> bytes:
    """UTF-8 of a text; a null text is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs ``[from, to)`` of about ``limit`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type)
            for n, c in ((f.name, columns[f.name]) for f in schema)
        ],
        schema=schema,
    )
