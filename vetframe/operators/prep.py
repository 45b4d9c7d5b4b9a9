"""Column selection, label encodings and dataset descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import count_where, name_has, nan_to_null, quoted
from ..functions.ordering import lookup, running_totals

#: Name parts that mark an identifier column.
ID_TOKENS = ("id", "uuid", "guid", "hash")


def drop_id_like(
    df: DataFrame, tokens: Sequence[str] = ID_TOKENS, match: str = "contains"
) -> DataFrame:
    """Drop columns whose name looks like an identifier."""
    return df.drop(*[c for c in df.columns if name_has(c, tokens, match)])


def drop_empty(df: DataFrame, label: str) -> DataFrame:
    """Drop columns without any value, then rows without a label."""
    clean = nan_to_null(df)
    filled = clean.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    row = filled.first()
    empty = [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]
    return clean.drop(*empty).filter(quoted(label).isNotNull())


def _label_facts(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels, smallest and largest, and whether all are whole; one row.

    Grouping by the label first combines repeated labels on the map side; the final distinct count
    is a sum over already distinct rows.
    """
    clean = nan_to_null(df.select(quoted(label).alias("y"))).groupBy("y").agg(
        F.count("*").alias("n")
    )
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    y = F.col("y").cast("double") if numeric else F.lit(None).cast("double")
    whole = F.min(F.when(F.col("y").isNotNull(), (y == F.floor(y)).cast("int")))
    return clean.agg(
        F.count("y").alias("classes"),
        F.min(y).alias("low"),
        F.max(y).alias("high"),
        F.coalesce(whole, F.lit(0)).alias("whole"),
        F.coalesce(F.min(F.when(F.col("y").isNotNull(), F.col("n"))), F.lit(0)).alias("smallest"),
    )


def infer_task(df: DataFrame, label: str, max_classes: int = 10) -> DataFrame:
    """``(label, task)``: few whole numbers, or any text, is classification."""
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    few = (F.col("classes") <= max_classes) & ((F.col("whole") == 1) | (F.col("classes") == 0))
    task = (
        F.when(few, "classification").otherwise("regression")
        if numeric
        else F.lit("classification")
    )
    return _label_facts(df, label).select(F.lit(label).alias("label"), task.alias("task"))


def task_type(df: DataFrame, label: str, max_classes: int = 50) -> DataFrame:
    """``(label, task)`` with task binary, multiclass or regression."""
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    binary = (F.col("classes") == 2) & (F.col("low") == 0) & (F.col("high") == 1)
    few = (F.col("classes") <= max_classes) & ((F.col("whole") == 1) | (F.col("classes") == 0))
    task = (
        F.when(binary, "binary").when(few, "multiclass").otherwise("regression")
        if numeric
        else F.lit("multiclass")
    )
    return _label_facts(df, label).select(F.lit(label).alias("label"), task.alias("task"))


def min_class_count(df: DataFrame, label: str) -> DataFrame:
    """``(label, min_class_count)`` over the non-null labels."""
    return _label_facts(df, label).select(
        F.lit(label).alias("label"), F.col("smallest").alias("min_class_count")
    )


def label_codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Add the rank of the label among the sorted distinct labels, -1 where it is missing."""
    distinct = df.select(quoted(label).alias("_label")).filter(F.col("_label").isNotNull())
    ranked = running_totals(distinct.distinct(), [F.col("_label")], {"_rank": F.lit(1)})
    ranked = lookup(ranked)
    return df.join(ranked, df[label] == F.col("_label"), "left").select(
        *[df[c] for c in df.columns],
        F.coalesce(F.col("_rank") - 1, F.lit(-1)).cast("int").alias(code),
    )


def binarize_label(column: Column, positive: str | None) -> Column:
    """1 where the label equals the positive class, 0 elsewhere; numeric labels pass through."""
    if positive is None:
        return column.cast("int")
    return F.coalesce((column == F.lit(positive)).cast("int"), F.lit(0))


def threshold_score(score: Column, threshold: float) -> Column:
    return F.coalesce((score >= F.lit(float(threshold))).cast("int"), F.lit(0))


def describe_dataset(df: DataFrame, label: str) -> DataFrame:
    """One row: shape, label column, its type and its number of distinct values."""
    rows = df.groupBy(quoted(label).alias("y")).agg(F.count("*").alias("n"))
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.lit(label).alias("label"),
        F.lit(df.schema[label].dataType.simpleString()).alias("label_type"),
        F.count("y").alias("label_classes"),
    )


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows in an explicit order."""
    return df.orderBy(*order_by).limit(rows)


def rate(condition: Column) -> Column:
    """Share of rows that satisfy a condition, NULL without rows."""
    return F.try_divide(count_where(condition).cast("double"), F.count("*").cast("double"))
