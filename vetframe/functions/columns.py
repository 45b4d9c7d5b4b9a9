"""Column helpers shared by every operator: null handling, safe division, long-form results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Columns aggregated per job. Beyond this the generated aggregation code gets too large to
#: compile, and a wide table is profiled in several column-pruned passes instead.
COLUMN_BATCH = 50


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns; booleans do not count as numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def name_has(name: str, tokens: Sequence[str], match: str = "contains") -> bool:
    """Does a column name mention one of the tokens?

    ``contains`` looks anywhere in the lower-cased name; ``token`` only accepts whole words
    between underscores, so that ``page`` does not count as ``age``.
    """
    lowered = name.lower()
    if match == "token":
        words = lowered.replace("-", "_").replace(" ", "_").split("_")
        return any(t in words for t in tokens)
    return any(t in lowered for t in tokens)


def quoted(name: str) -> Column:
    """A column reference that survives dots and spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing, as pandas does."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def row_array(items: Sequence[Column], schema: str) -> Column:
    """An array of the given structs; typed, so that it may also be empty."""
    return F.array(*items).cast(f"array<struct<{schema}>>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL on a zero denominator instead of raising."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def count_where(condition: Column) -> Column:
    """How many rows satisfy the condition; 0, not NULL, on an empty input."""
    return F.count(F.when(condition, F.lit(1)))


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    metrics: Callable[[str, Column], dict[str, Column]],
    schema: str,
) -> DataFrame:
    """One aggregation over many columns, returned with one row per column.

    ``metrics`` builds the aggregates of a column; all of them run in the same job, without a
    shuffle beyond the single-row partial aggregates. ``schema`` types the result, and is what an
    empty column list returns.
    """
    columns = list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    parts = []
    for start in range(0, len(columns), COLUMN_BATCH):
        batch = columns[start : start + COLUMN_BATCH]
        wide = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    *[m.alias(k) for k, m in metrics(c, quoted(c)).items()],
                ).alias(f"m{i}")
                for i, c in enumerate(batch)
            ]
        )
        parts.append(wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(batch))]))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, n)`` over the string forms of the columns.

    One scan and one shuffle for all columns; the map-side combine collapses repeated values, so a
    value that holds most of the rows reaches the shuffle once per task.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count("*").alias("n"))
