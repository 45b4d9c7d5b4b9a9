"""Writing results: flat tables, one JSON document per report, fairness tables by attribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import nan_to_null, quoted

FORMATS = ("parquet", "json", "csv")


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested values; write them as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    """Write a result; NaN becomes missing, as JSON has no NaN."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    clean = nan_to_null(df)
    writer = (_flat(clean) if kind == "csv" else clean).write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    getattr(writer, kind)(path)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Write the tables of a report next to each other."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", kind)


def as_documents(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key…, document)``: each row's remaining columns as one JSON document."""
    rest = [c for c in df.columns if c not in key]
    options = {"ignoreNullFields": "false"}
    return nan_to_null(df).select(
        *key, F.to_json(F.struct(*[quoted(c) for c in rest]), options).alias("document")
    )


def write_fairness(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Fairness tables, split into one folder per attribute where they have one."""
    for name, df in tables.items():
        by = ("attribute",) if "attribute" in df.columns else ()
        write_table(df, f"{folder}/{name}", kind, by)
