"""Rule-based repair: fill missing values, clip outliers, compare before and after."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import COLUMN_BATCH, count_where, nan_to_null, quoted
from ..functions.ranks import BUFFER_LIMIT
from .profile import iqr_outliers, missing_values, outlier_fences

#: Fixed value: what a column without any value is filled with.
UNKNOWN = "Unknown"


def is_repairable_number(data_type: T.DataType) -> bool:
    """64-bit numbers and decimals are averaged and clipped; narrower ones are not."""
    return isinstance(data_type, (T.LongType, T.DoubleType, T.DecimalType))


def most_common_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The commonest value per column, the smallest among ties; absent for an empty column.

    Columns of one type are counted together in one job. Counting before choosing keeps the
    distinct values on the executors: only the winner of each column comes back.
    """
    by_type: dict[str, list[str]] = defaultdict(list)
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        by_type[types[c].simpleString()].append(c)
    out: dict[str, object] = {}
    for names in by_type.values():
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column_name"), quoted(c).alias("value")) for c in names]
        )
        winners = (
            df.select(F.inline(pairs))
            .filter("value is not null")
            .groupBy("column_name", "value")
            .agg(F.count("*").alias("n"))
            .groupBy("column_name")
            .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
        )
        out.update({row["column_name"]: row["value"] for row in winners.collect()})
    return out


def _facts(clean: DataFrame, fences: dict[str, tuple[float, float, float, float]]) -> dict:
    """Missing values, mean and number of outliers of each column, one pass per column batch."""
    out = {}
    fields = clean.schema.fields
    for lo in range(0, len(fields), COLUMN_BATCH):
        batch = fields[lo : lo + COLUMN_BATCH]

        def facts(f):
            c, number = quoted(f.name), is_repairable_number(f.dataType)
            low, high = fences[f.name][2:] if f.name in fences else (None, None)
            outside = (c < F.lit(low)) | (c > F.lit(high)) if low is not None else F.lit(False)
            mean = F.avg(c).cast("double") if number else F.lit(None).cast("double")
            return F.struct(
                count_where(c.isNull()).alias("missing"), mean.alias("mean"),
                count_where(outside).alias("outliers"),
            )

        row = clean.agg(*[facts(f).alias(f"f{i}") for i, f in enumerate(batch)]).first()
        out |= {f.name: row[f"f{i}"] for i, f in enumerate(batch)}
    return out


def fill_values(df: DataFrame, facts: dict | None = None) -> dict[str, object]:
    """What to put in place of the missing values of each column that has any.

    ``facts`` are the columns' missing values and means, if they are known already.
    """
    clean = nan_to_null(df)
    facts = _facts(clean, {}) if facts is None else facts
    fills: dict[str, object] = {}
    others = []
    for f in df.schema.fields:
        if facts[f.name]["missing"] == 0:
            continue
        if is_repairable_number(f.dataType):
            if facts[f.name]["mean"] is not None:
                fills[f.name] = float(facts[f.name]["mean"])
        else:
            others.append(f.name)
    common = most_common_values(clean, others)
    for name in others:
        if name in common:
            fills[name] = common[name]
        elif isinstance(df.schema[name].dataType, T.StringType):
            fills[name] = UNKNOWN
    return fills


def fill_missing(df: DataFrame, fills: dict[str, object] | None = None) -> DataFrame:
    """Replace missing numbers by the mean and anything else by the commonest value.

    A whole-number column that takes a mean becomes a double.
    """
    fills = fill_values(df) if fills is None else fills

    def filled(f) -> Column:
        c = quoted(f.name)
        if f.name not in fills:
            return c
        if is_repairable_number(f.dataType):
            return F.coalesce(c.cast("double"), F.lit(fills[f.name])).alias(f.name)
        return F.coalesce(c, F.lit(fills[f.name]).cast(f.dataType)).alias(f.name)

    return nan_to_null(df).select(*[filled(f) for f in df.schema.fields])


def clip_columns(
    df: DataFrame, fences: dict[str, tuple[float, float, float, float]]
) -> DataFrame:
    """Pull values outside the fences onto them; a missing value stays missing."""

    def clipped(name) -> Column:
        c = quoted(name)
        if name not in fences:
            return c
        _, _, low, high = fences[name]
        x = c.cast("double")
        return (
            F.when(x < F.lit(low), F.lit(low))
            .when(x > F.lit(high), F.lit(high))
            .otherwise(x)
            .alias(name)
        )

    return df.select(*[clipped(c) for c in df.columns])


@dataclass
class Repair:
    """A repaired table and what was done to it."""

    table: DataFrame
    fills: dict[str, object] = field(default_factory=dict)
    fences: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)


def repair(df: DataFrame, buffer_limit: int = BUFFER_LIMIT) -> Repair:
    """Fill, then clip. The result is one lazy projection over the input.

    Columns are clipped if they had outliers before the fill; the fences are those after it. A fill
    can't move the quartiles of a column without missing values, so those are found once; missing
    values, means and outliers come from one pass.
    """
    first = outlier_fences(df, buffer_limit=buffer_limit)
    facts = _facts(nan_to_null(df), first)
    fills = fill_values(df, facts)
    whole = fill_missing(df, fills)
    columns = [
        f.name
        for f in whole.schema.fields
        if facts[f.name]["outliers"] > 0 and is_repairable_number(f.dataType)
    ]
    moved = [c for c in columns if c in fills]
    fences = {c: first[c] for c in columns if c not in fills}
    if moved:
        fences |= outlier_fences(whole, moved, buffer_limit=buffer_limit)
    return Repair(clip_columns(whole, fences), fills, fences)


def comparison(
    before: DataFrame, after: DataFrame, buffer_limit: int = BUFFER_LIMIT
) -> DataFrame:
    """Missing values and outliers per column before and after a repair."""

    def facts(df, suffix):
        return (
            missing_values(df)
            .select("column_name", F.col("missing_count").alias(f"missing_{suffix}"))
            .join(
                iqr_outliers(df, buffer_limit=buffer_limit).select(
                    "column_name", F.col("outlier_count").alias(f"outliers_{suffix}")
                ),
                "column_name",
                "left",
            )
            .na.fill(0, [f"outliers_{suffix}"])
        )

    return facts(before, "before").join(facts(after, "after"), "column_name")
