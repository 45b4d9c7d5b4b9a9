"""Table profile: missing values, outliers, distributions, duplicates, formats and ranges.

Every operator is a column-wise aggregate over one scan. Checks that need a bound first (quantile
fences, histogram edges) fetch those few numbers and use them as literals in the second scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    count_where,
    name_has,
    nan_to_null,
    numeric_columns,
    per_column,
    quoted,
    ratio,
    row_array,
    string_columns,
    value_counts,
)
from ..functions.ordering import settle
from ..functions.parsing import EMAIL, PHONE, is_iso_date
from ..functions.ranks import BUFFER_LIMIT, exact_quantiles

# Severity thresholds in percent, fence factor, score deductions, name hints.
MISSING_WARNING, MISSING_CRITICAL, MISSING_FINDING = 5.0, 20.0, 30.0
FENCE_FACTOR, Z_LIMIT = 1.5, 3.0
HISTOGRAM_BINS = 20
ERROR_PENALTY, WARNING_PENALTY, NEGATIVE_PENALTY = 40.0, 20.0, 10.0
MAX_TEXT_CLASSES = 200
NON_NEGATIVE_TOKENS = ("amount", "income", "balance", "score", "term", "tenure", "credit")
RANGE_RULES = (("age", 0.0, 150.0), ("score", 0.0, 100.0))
PERCENTAGE_RULES = (("percent", 0.0, 100.0),)
FORMAT_RULES = (("email", "email"), ("date", "date"))
QUALITY_BANDS = ((90.0, "EXCELLENT"), (70.0, "GOOD"), (50.0, "MODERATE"))

_FINDINGS = "agent string, severity string, code string, column_name string, message string"


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


# ---------------------------------------------------------------- missing values


def missing_values(df: DataFrame) -> DataFrame:
    """``(column_name, missing_count, missing_percent)`` for every column."""
    return per_column(
        nan_to_null(df),
        df.columns,
        lambda name, c: {
            "missing_count": count_where(c.isNull()),
            "missing_percent": _percent(count_where(c.isNull()), F.count("*")),
            "total_rows": F.count("*"),
        },
        "column_name string, missing_count long, missing_percent double, total_rows long",
    )


def missing_totals(missing: DataFrame) -> DataFrame:
    """Missing cells of the whole table, and their share of all cells."""
    return missing.agg(
        F.sum("missing_count").alias("total_missing"),
        _percent(F.sum("missing_count"), F.sum("total_rows")).alias("total_percent"),
    )


def missing_severity(
    missing: DataFrame,
    warning: float = MISSING_WARNING,
    critical: float = MISSING_CRITICAL,
    top: int | None = None,
) -> DataFrame:
    """Grade each column; ``top`` keeps the columns that miss most, as the report shows them."""
    graded = missing.withColumn(
        "severity",
        F.when(F.col("missing_percent") >= critical, "critical")
        .when(F.col("missing_percent") >= warning, "warning")
        .otherwise("ok"),
    )
    if top is None:
        return graded
    return graded.orderBy(F.col("missing_percent").desc(), "column_name").limit(top)


def missing_matrix(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key and a 0/1 missing flag per column."""
    return nan_to_null(df).select(
        *key, *[quoted(c).isNull().cast("int").alias(c) for c in df.columns if c not in key]
    )


def co_missing(df: DataFrame) -> DataFrame:
    """How often two columns are missing together; the heat map at any table size."""
    clean = nan_to_null(df)
    columns = df.columns
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    out = None
    for start in range(0, len(pairs), 400):
        batch = pairs[start : start + 400]
        wide = clean.agg(
            *[
                count_where(quoted(a).isNull() & quoted(b).isNull()).alias(f"p{i}")
                for i, (a, b) in enumerate(batch)
            ]
        )
        part = wide.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(a).alias("column_a"),
                            F.lit(b).alias("column_b"),
                            F.col(f"p{i}").alias("missing_together"),
                        )
                        for i, (a, b) in enumerate(batch)
                    ]
                )
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- outliers


def outlier_fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    factor: float = FENCE_FACTOR,
    buffer_limit: int = BUFFER_LIMIT,
) -> dict[str, tuple[float, float, float, float]]:
    """Quartiles and fences ``(q1, q3, low, high)`` per numeric column with values."""
    columns = numeric_columns(df) if columns is None else list(columns)
    quartiles = exact_quantiles(nan_to_null(df), columns, [0.25, 0.75], buffer_limit)
    return {
        c: (q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        for c, (q1, q3) in quartiles.items()
        if q1 is not None
    }


def _outside(c: Column, low: float, high: float) -> Column:
    return (c < F.lit(low)) | (c > F.lit(high))


def iqr_outliers(
    df: DataFrame, factor: float = FENCE_FACTOR, buffer_limit: int = BUFFER_LIMIT
) -> DataFrame:
    """Values outside the interquartile fences, as count and share of all rows."""
    fences = outlier_fences(df, factor=factor, buffer_limit=buffer_limit)

    def metrics(name, c):
        if name not in fences:
            none = F.lit(None).cast("double")
            return {
                "lower_fence": none, "upper_fence": none,
                "outlier_count": F.lit(0).cast("long"), "outlier_percent": F.lit(0.0),
            }
        _, _, low, high = fences[name]
        return {
            "lower_fence": F.lit(low),
            "upper_fence": F.lit(high),
            "outlier_count": count_where(_outside(c, low, high)),
            "outlier_percent": _percent(count_where(_outside(c, low, high)), F.count("*")),
        }

    return per_column(
        nan_to_null(df),
        numeric_columns(df),
        metrics,
        "column_name string, lower_fence double, upper_fence double,"
        " outlier_count long, outlier_percent double",
    )


def zscore_outliers(df: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Values further than ``limit`` sample deviations from the mean."""
    clean = nan_to_null(df)
    columns = numeric_columns(df)
    row = clean.agg(
        *[
            F.struct(F.avg(quoted(c)).alias("m"), F.stddev_samp(quoted(c)).alias("s")).alias(f"z{i}")
            for i, c in enumerate(columns)
        ]
    ).first() if columns else None
    moments = {c: row[f"z{i}"] for i, c in enumerate(columns)}

    def metrics(name, c):
        mean, deviation = moments[name]["m"], moments[name]["s"]
        if mean is None or deviation is None:
            far = F.lit(False)
        else:
            far = F.abs(c - F.lit(float(mean))) > F.lit(limit * float(deviation))
        return {
            "mean": F.lit(mean).cast("double"),
            "std": F.lit(deviation).cast("double"),
            "outlier_count": count_where(far),
            "outlier_percent": _percent(count_where(far), F.count("*")),
        }

    return per_column(
        clean, columns, metrics,
        "column_name string, mean double, std double, outlier_count long, outlier_percent double",
    )


def box_plot(df: DataFrame, buffer_limit: int = BUFFER_LIMIT) -> DataFrame:
    """Five numbers per numeric column: extremes, quartiles, median, and the fences."""
    clean = nan_to_null(df)
    columns = numeric_columns(df)
    numbers = exact_quantiles(clean, columns, [0.0, 0.25, 0.5, 0.75, 1.0], buffer_limit)
    names = ("min_value", "q1", "median", "q3", "max_value")
    rows = [
        (c, *[None if v is None else float(v) for v in numbers[c]]) for c in columns
    ]
    schema = "column_name string, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema).select(
        "*",
        (F.col("q1") - FENCE_FACTOR * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
        (F.col("q3") + FENCE_FACTOR * (F.col("q3") - F.col("q1"))).alias("upper_fence"),
    )


def outlier_points(
    df: DataFrame, key: Sequence[str], buffer_limit: int = BUFFER_LIMIT
) -> DataFrame:
    """``(key…, column_name, value)`` for every value outside its fences."""
    columns = [c for c in numeric_columns(df) if c not in key]
    fences = outlier_fences(df, columns, buffer_limit=buffer_limit)
    found = row_array(
        [
            F.when(
                _outside(quoted(c), fences[c][2], fences[c][3]),
                F.struct(F.lit(c).alias("column_name"), quoted(c).cast("double").alias("value")),
            )
            for c in columns
            if c in fences
        ],
        "column_name: string, value: double",
    )
    return nan_to_null(df).select(*key, F.inline(F.array_compact(found)))


# ---------------------------------------------------------------- distributions


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness; NULL below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(g1)


def adjusted_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis; NULL below four values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g2 = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n < 4, F.lit(None)).when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(g2)


def distributions(df: DataFrame, kurtosis: bool = False) -> DataFrame:
    """Mean, sample deviation, extremes and skewness per numeric column, in one pass."""

    def metrics(name, c):
        c = c.cast("double")
        out = {
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min_value": F.min(c),
            "max_value": F.max(c),
            "skewness": adjusted_skewness(c),
        }
        return {**out, "kurtosis": adjusted_kurtosis(c)} if kurtosis else out

    schema = (
        "column_name string, mean double, std double, min_value double, max_value double,"
        " skewness double" + (", kurtosis double" if kurtosis else "")
    )
    return per_column(nan_to_null(df), numeric_columns(df), metrics, schema)


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and text columns; the last three come from the schema."""
    return df.agg(
        F.count("*").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(string_columns(df))).cast("long").alias("categorical_columns"),
    )


def histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(column_name, bin, bin_start, bin_end, n)`` with equal-width bins per numeric column."""
    clean = nan_to_null(df)
    columns = numeric_columns(df)
    schema = "column_name string, bin int, bin_start double, bin_end double, n long"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    row = clean.agg(
        *[
            F.struct(
                F.min(quoted(c)).cast("double").alias("lo"),
                F.max(quoted(c)).cast("double").alias("hi"),
            ).alias(f"r{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    ranges = {c: row[f"r{i}"] for i, c in enumerate(columns) if row[f"r{i}"]["lo"] is not None}
    if not ranges:
        return df.sparkSession.createDataFrame([], schema)

    def bin_of(c):
        lo, hi = ranges[c]["lo"], ranges[c]["hi"]
        width = (hi - lo) / bins
        x = quoted(c).cast("double")
        index = F.lit(0) if width == 0 else F.least(
            F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)
        )
        return F.when(x.isNotNull(), index.cast("int"))

    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                bin_of(c).alias("bin"),
                F.lit(ranges[c]["lo"]).alias("lo"),
                F.lit((ranges[c]["hi"] - ranges[c]["lo"]) / bins).alias("width"),
            )
            for c in ranges
        ]
    )
    return (
        clean.select(F.inline(pairs))
        .filter("bin is not null")
        .groupBy("column_name", "bin", "lo", "width")
        .agg(F.count("*").alias("n"))
        .select(
            "column_name",
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "n",
        )
    )


#: Rows that are looked at for a value near the middle of each column.
CENTRE_ROWS = 100


def correlations(df: DataFrame) -> DataFrame:
    """``(column_a, column_b, correlation)`` of numeric columns, pairwise complete.

    One scan for any number of columns. A row becomes a vector of its values (0 for a missing one), their
    squares, and flags for what is there; the sum of the vectors' outer products holds, for each
    pair of columns, the count, sums, squares and products over the rows that have both. The sums
    are merged in a tree, and the driver gets one matrix. Values are taken relative to one of their
    own column first, so that large ones with a small spread keep their digits.
    """
    columns = numeric_columns(df)
    schema = "column_a string, column_b string, correlation double"
    clean = nan_to_null(df.select(*[quoted(c).cast("double").alias(c) for c in columns]))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    row = clean.limit(CENTRE_ROWS).agg(
        *[F.first(quoted(c), ignorenulls=True).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    values = [quoted(c) - F.lit(row[i] or 0.0) for i, c in enumerate(columns)]
    parts = [
        *[F.coalesce(v, F.lit(0.0)) for v in values],
        *[F.coalesce(v * v, F.lit(0.0)) for v in values],
        *[v.isNotNull().cast("double") for v in values],
    ]
    vectors = clean.select(array_to_vector(F.array(*parts)).alias("v"))
    k = len(columns)
    outer = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), numCols=3 * k)
    sums = outer.computeGramianMatrix().toArray()
    product, square, there = sums[:k, :k], sums[k : 2 * k, 2 * k :], sums[2 * k :, 2 * k :]
    total = sums[:k, 2 * k :]  # of a column over the rows that have the other one as well
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = square - total**2 / there
        # What rounding leaves of a constant's squares is no spread.
        spread = np.where(spread > 1e-13 * square, spread, np.nan)
        r = (product - total * total.T / there) / np.sqrt(spread * spread.T)
    rows = [
        (a, columns[j], None if np.isnan(r[i, j]) else float(min(1.0, max(-1.0, r[i, j]))))
        for i, a in enumerate(columns)
        for j in range(i + 1, k)
    ]
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------- duplicates and constants


def _canonical(c: Column, kind: T.DataType) -> Column:
    """A value's text after its length; ``-`` for a missing one. Equal just for equal values.

    Arrays hold the texts of their items, structs those of their fields, maps those of their entries
    in order, whatever they are nested in.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = (c + F.lit(0.0).cast(kind)).cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(c, lambda item: _canonical(item, kind.elementType)), "")
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_canonical(e["key"], kind.keyType), _canonical(e["value"], kind.valueType))
        text = F.array_join(F.array_sort(F.transform(F.map_entries(c), entry)), "")
    elif isinstance(kind, T.StructType):
        parts = [_canonical(c.getField(f.name), f.dataType) for f in kind.fields]
        text = F.when(c.isNotNull(), F.concat(*parts) if parts else F.lit(""))
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def duplicate_rows(
    df: DataFrame, columns: Sequence[str] | None = None, by_digest: bool = True
) -> DataFrame:
    """How many rows repeat an earlier row; NULLs count as equal.

    Rows are grouped by a SHA-256, so that long texts are read once and only 32 bytes per row reach
    the shuffle. The digest covers every value in full, nested ones too: its length and its text,
    timestamps to the microsecond, 0.0 and -0.0 alike. ``by_digest=False`` groups by the values.
    """
    columns = list(columns or df.columns)
    clean = nan_to_null(df.select(*[quoted(c) for c in columns]))
    if by_digest:
        row = F.concat(*[_canonical(quoted(c), clean.schema[c].dataType) for c in columns])
        groups = clean.select(F.unhex(F.sha2(row, 256)).alias("digest")).groupBy("digest")
    else:
        groups = clean.groupBy(*[quoted(c) for c in columns])
    return (
        groups.agg(F.count("*").alias("_rows"))
        .agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def _one_value(c: Column) -> Column:
    return F.coalesce(F.min(c) == F.max(c), F.lit(False))


def _is_constant(c: Column) -> Column:
    """At most one distinct value, NULL included."""
    return (F.count(c) == 0) | (_one_value(c) & (F.count(c) == F.count("*")))


def constant_columns(df: DataFrame, mode: str = "distinct") -> DataFrame:
    """``(column_name, is_constant)`` by one of three rules.

    ``distinct``: at most one distinct value, a missing value being a value of its own;
    ``std``: numeric columns whose deviation is zero or undefined;
    ``text``: text columns with a single non-null value in a table of more than one row.
    Smallest equals largest says the same as one distinct value, without a distinct aggregate.
    """
    clean = nan_to_null(df)

    def metrics(name, c):
        if mode == "std":
            flag = F.coalesce(F.stddev_samp(c), F.lit(0.0)) == 0
        elif mode == "text":
            flag = _one_value(c) & (F.count("*") > 1)
        else:
            flag = _is_constant(c)
        return {"is_constant": flag.cast("int")}

    columns = {"std": numeric_columns, "text": string_columns}.get(mode, lambda d: d.columns)(df)
    return per_column(clean, columns, metrics, "column_name string, is_constant int")


# ---------------------------------------------------------------- label, consistency


def label_checks(df: DataFrame, label: str, max_classes: int = MAX_TEXT_CLASSES) -> DataFrame:
    """Findings on the label: a single class is an error, too many text classes a warning."""
    classes = (
        nan_to_null(df.select(quoted(label).alias("y")))
        .groupBy("y").agg(F.count("*").alias("n"))
        .agg(F.count("y").alias("classes"))
    )
    numeric = label in numeric_columns(df)
    return classes.select(
        F.lit(label).alias("column_name"),
        "classes",
        F.when(F.col("classes") == 1, "error")
        .when((F.col("classes") > max_classes) & F.lit(not numeric), "warning")
        .otherwise("ok")
        .alias("severity"),
    )


def negative_values(
    df: DataFrame, tokens: Sequence[str] = NON_NEGATIVE_TOKENS, match: str = "contains"
) -> DataFrame:
    """Share of negative values in columns that should not have any."""
    columns = [c for c in numeric_columns(df) if name_has(c, tokens, match)]
    return per_column(
        nan_to_null(df),
        columns,
        lambda name, c: {
            "negative_count": count_where(c < 0),
            "negative_share": ratio(count_where(c < 0), F.count("*")),
        },
        "column_name string, negative_count long, negative_share double",
    )


def consistency_score(negatives: DataFrame) -> DataFrame:
    """100, or 90 when any column that should not be negative is."""
    suspects = count_where(F.col("negative_count") > 0)
    return negatives.agg(
        F.lit("consistency").alias("agent"),
        suspects.alias("suspect_columns"),
        F.when(suspects > 0, 100.0 - NEGATIVE_PENALTY).otherwise(100.0).alias("score"),
    )


# ---------------------------------------------------------------- formats and ranges


def _valid(kind: str, c: Column) -> Column:
    text = c.cast("string")
    if kind == "email":
        return text.rlike(EMAIL)
    if kind == "phone":
        return text.rlike(PHONE)
    if kind == "date":
        return is_iso_date(text)
    return text.rlike(kind)


def _format_columns(df, rules, match):
    chosen = {}
    for c in df.columns:
        for token, kind in rules:
            if name_has(c, (token,), match):
                chosen[c] = kind
                break
    return chosen


def format_issues(
    df: DataFrame, rules: Sequence[tuple[str, str]] = FORMAT_RULES, match: str = "contains"
) -> DataFrame:
    """Non-null values that break the format their column name promises.

    A rule is (name part, kind): kind is ``email``, ``phone``, ``date`` or a regular expression;
    the first rule that matches a column applies.
    """
    chosen = _format_columns(df, rules, match)

    def metrics(name, c):
        bad = c.isNotNull() & ~_valid(chosen[name], c)
        return {
            "invalid_count": count_where(bad),
            "invalid_percent": _percent(count_where(bad), F.count("*")),
        }

    return per_column(
        nan_to_null(df), list(chosen), metrics,
        "column_name string, invalid_count long, invalid_percent double",
    )


def format_entries(
    df: DataFrame,
    key: Sequence[str],
    rules: Sequence[tuple[str, str]] = FORMAT_RULES,
    match: str = "contains",
) -> DataFrame:
    """``(key…, column_name, value)`` of every value that breaks its format."""
    chosen = _format_columns(df, rules, match)
    found = row_array(
        [
            F.when(
                quoted(c).isNotNull() & ~_valid(kind, quoted(c)),
                F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")),
            )
            for c, kind in chosen.items()
        ],
        "column_name: string, value: string",
    )
    return nan_to_null(df).select(*key, F.inline(F.array_compact(found)))


def _range_columns(df, rules, match):
    chosen = {}
    for c in numeric_columns(df):
        for token, low, high in rules:
            if name_has(c, (token,), match):
                chosen[c] = (low, high)
                break
    return chosen


def range_issues(
    df: DataFrame,
    rules: Sequence[tuple[str, float, float]] = RANGE_RULES,
    match: str = "contains",
) -> DataFrame:
    """Numeric values outside the range their column name promises."""
    chosen = _range_columns(df, rules, match)

    def metrics(name, c):
        bad = _outside(c, *chosen[name])
        return {
            "low": F.lit(chosen[name][0]),
            "high": F.lit(chosen[name][1]),
            "invalid_count": count_where(bad),
            "invalid_percent": _percent(count_where(bad), F.count("*")),
        }

    return per_column(
        nan_to_null(df), list(chosen), metrics,
        "column_name string, low double, high double, invalid_count long, invalid_percent double",
    )


def range_entries(
    df: DataFrame,
    key: Sequence[str],
    rules: Sequence[tuple[str, float, float]] = RANGE_RULES,
    match: str = "contains",
) -> DataFrame:
    """``(key…, column_name, value)`` of every value outside its range."""
    chosen = _range_columns(df, rules, match)
    found = row_array(
        [
            F.when(
                _outside(quoted(c), low, high),
                F.struct(F.lit(c).alias("column_name"), quoted(c).cast("double").alias("value")),
            )
            for c, (low, high) in chosen.items()
        ],
        "column_name: string, value: double",
    )
    return nan_to_null(df).select(*key, F.inline(F.array_compact(found)))


# ---------------------------------------------------------------- verdicts over the profile


def quality_band(score: Column) -> Column:
    """Name of the quality band a 0..100 score falls into."""
    band = F.lit("POOR")
    for limit, name in reversed(QUALITY_BANDS):
        band = F.when(score >= limit, name).otherwise(band)
    return band


def validation_summary(
    missing: DataFrame, outliers: DataFrame, formats: DataFrame
) -> DataFrame:
    """``(check, status)``: Pass, Warning or Fail from the totals of the three checks."""

    def status(df, column, name, failed):
        total = F.coalesce(F.sum(column), F.lit(0))
        return df.agg(
            F.lit(name).alias("check"),
            F.when(total == 0, "Pass").otherwise(failed).alias("status"),
            total.alias("issues"),
        )

    return (
        status(missing, "missing_count", "Missing Values", "Fail")
        .unionByName(status(outliers, "outlier_count", "Outliers", "Warning"))
        .unionByName(status(formats, "invalid_count", "Format Issues", "Fail"))
    )


def integrity_findings(df: DataFrame, label: str | None = None) -> DataFrame:
    """Findings on the table as flat rows ``(agent, severity, code, column_name, message)``.

    Missing shares and constants come from one pass; duplicates and label classes need a shuffle
    each.
    """
    agent = F.lit("data_integrity").alias("agent")
    facts = settle(
        per_column(
            nan_to_null(df),
            df.columns,
            lambda name, c: {
                "missing_percent": _percent(count_where(c.isNull()), F.count("*")),
                "is_constant": _is_constant(c).cast("int"),
            },
            "column_name string, missing_percent double, is_constant int",
        )
    )
    worst = facts.agg(
        F.max_by("column_name", F.struct("missing_percent", "column_name")).alias("column_name"),
        F.max("missing_percent").alias("share"),
    ).filter(F.col("share") > MISSING_FINDING)
    parts = [
        worst.select(
            agent, F.lit("warning").alias("severity"), F.lit("missing").alias("code"),
            "column_name", F.format_string("%.1f%% of the values are missing", "share").alias("message"),
        ),
        duplicate_rows(df, by_digest=True).filter("duplicate_rows > 0").select(
            agent, F.lit("warning").alias("severity"), F.lit("duplicates").alias("code"),
            F.lit(None).cast("string").alias("column_name"),
            F.format_string("%d rows repeat an earlier row", "duplicate_rows").alias("message"),
        ),
        facts.filter("is_constant = 1").select(
            agent, F.lit("info").alias("severity"), F.lit("constant").alias("code"),
            "column_name", F.lit("the column holds a single value").alias("message"),
        ),
    ]
    if label is not None:
        parts.append(
            label_checks(df, label).filter("severity <> 'ok'").select(
                agent, "severity", F.lit("label").alias("code"), "column_name",
                F.format_string("the label has %d distinct values", "classes").alias("message"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def integrity_score(findings: DataFrame) -> DataFrame:
    """100, less 40 for any error and 20 for any warning."""
    errors = count_where(F.col("severity") == "error")
    warnings = count_where(F.col("severity") == "warning")
    return findings.agg(
        F.lit("data_integrity").alias("agent"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        (
            F.lit(100.0)
            - F.when(errors > 0, ERROR_PENALTY).otherwise(0.0)
            - F.when(warnings > 0, WARNING_PENALTY).otherwise(0.0)
        ).alias("score"),
    )


#: The checks a strategy may name; the summary always runs.
CHECKS = ("missing_values", "outliers", "distributions", "formats", "ranges", "consistency")


def validate(
    df: DataFrame,
    checks: Sequence[str] = ("missing_values", "outliers", "distributions"),
    buffer_limit: int = BUFFER_LIMIT,
) -> DataFrame:
    """Run the named checks and return one long profile ``(check, column_name, metric, value)``.

    Missing values, fences, moments, formats, ranges and constants of a column are aggregates over
    the same scan, so they share a single job however many checks are named; only the quartiles
    behind the fences have to be known before it.
    """
    unknown = set(checks) - set(CHECKS)
    if unknown:
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    clean = nan_to_null(df)
    numeric, text = set(numeric_columns(df)), set(string_columns(df))
    fences = outlier_fences(df, buffer_limit=buffer_limit) if "outliers" in checks else {}
    formats = _format_columns(df, FORMAT_RULES, "contains") if "formats" in checks else {}
    ranges = _range_columns(df, RANGE_RULES, "contains") if "ranges" in checks else {}

    def entries(name):
        c = quoted(name)
        out = []

        def add(check, metric, value):
            out.append(
                F.struct(
                    F.lit(check).alias("check"),
                    F.lit(name).alias("column_name"),
                    F.lit(metric).alias("metric"),
                    value.cast("double").alias("value"),
                )
            )

        def add_share(check, label, condition):
            add(check, f"{label}_count", count_where(condition))
            add(check, f"{label}_percent", _percent(count_where(condition), F.count("*")))

        if "missing_values" in checks:
            add_share("missing_values", "missing", c.isNull())
        if name in fences:
            add_share("outliers", "outlier", _outside(c, fences[name][2], fences[name][3]))
        if "distributions" in checks and name in numeric:
            x = c.cast("double")
            add("distributions", "mean", F.avg(x))
            add("distributions", "std", F.stddev_samp(x))
            add("distributions", "min_value", F.min(x))
            add("distributions", "max_value", F.max(x))
            add("distributions", "skewness", adjusted_skewness(x))
        if name in formats:
            add_share("formats", "invalid", c.isNotNull() & ~_valid(formats[name], c))
        if name in ranges:
            add_share("ranges", "invalid", _outside(c, *ranges[name]))
        if "consistency" in checks and name in text:
            constant = F.coalesce(F.min(c) == F.max(c), F.lit(False)) & (F.count("*") > 1)
            add("consistency", "is_constant", constant.cast("int"))
        return out

    def summary(metric, value):
        return F.struct(
            F.lit("summary").alias("check"),
            F.lit(None).cast("string").alias("column_name"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
        )

    first = [
        summary("total_rows", F.count("*")),
        summary("total_columns", F.lit(len(df.columns))),
        summary("numeric_columns", F.lit(len(numeric))),
        summary("categorical_columns", F.lit(len(text))),
    ]
    out = None
    names = df.columns
    for start in range(0, max(len(names), 1), 50):
        batch = [e for n in names[start : start + 50] for e in entries(n)]
        batch = (first if start == 0 else []) + batch
        if not batch:
            continue
        part = clean.agg(*[e.alias(f"e{i}") for i, e in enumerate(batch)]).select(
            F.inline(F.array(*[F.col(f"e{i}") for i in range(len(batch))]))
        )
        out = part if out is None else out.unionByName(part)
    return out
