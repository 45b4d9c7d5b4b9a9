"""Semantic column types, schema validation and cell-level violations.

The type of a column follows from the shares of its values that look like a boolean, number, date
and so on. All shares and the number of distinct values come from one scan. Types are judged on every value of the column, or on a repeatable
sample when ``sample_size`` is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import parsing as P
from ..functions.columns import count_where, nan_to_null, per_column, quoted, ratio, row_array
from ..functions.ordering import hash_order, settle
from ..functions.ranks import BUFFER_LIMIT, exact_quantiles

# Shares a column must exceed, and the confidence each verdict carries.
BOOLEAN_SHARE, NUMERIC_SHARE, HALF_SHARE, INTEGER_SHARE = 0.8, 0.8, 0.5, 0.9
DATETIME_SHARE, PATTERN_SHARE, MENTION_SHARE = 0.3, 0.7, 0.3
CATEGORICAL_RATIO, CATEGORICAL_VALUES, TRUSTED = 0.1, 50, 0.7
CONFIDENCE = {
    "unknown": 0.0, "boolean": 0.95, "percentage": 0.9, "currency": 0.9, "integer": 0.95,
    "float": 0.9, "datetime": 0.9, "date": 0.85, "email": 0.95, "phone": 0.9, "url": 0.9,
    "categorical": 0.8, "string": 0.7,
}
NUMERIC_TYPES = ("integer", "float", "currency", "percentage")
#: Which detected types satisfy an expected one.
COMPATIBLE = {
    "integer": ("integer", "float"),
    "float": ("float", "integer"),
    "string": ("string", "categorical", "email", "phone", "url"),
    "boolean": ("boolean",),
    "date": ("date", "datetime"),
    "datetime": ("datetime", "date"),
    "email": ("email",),
    "phone": ("phone",),
    "url": ("url",),
    "categorical": ("categorical", "string"),
}
SAMPLE_VALUES = 10
#: Values with more characters are grouped by a digest.
LONG_VALUE = 64


def text_frame(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns in text form, the way the patterns expect it."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    return nan_to_null(df).select(
        *[P.as_text(quoted(c), fields[c]).alias(c) for c in (columns or df.columns)]
    )


def hash_sample(df: DataFrame, key: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """A repeatable sample: the rows with the smallest key hashes."""
    return df.orderBy(hash_order(key, seed), *[quoted(k) for k in key]).limit(size)


def _cells(text: DataFrame) -> DataFrame:
    """``(column_name, value)`` rows of all columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), quoted(c).alias("value")) for c in text.columns]
    )
    return text.select(F.inline(pairs))


def _facts(c: Column) -> dict[str, Column]:
    """What a value in text form looks like."""
    number = P.to_number(c)
    return {
        **{f"{k}_matches": c.rlike(p) for k, p in P.PATTERNS.items()},
        "numeric_values": P.is_number(c),
        "integer_values": number == F.floor(number),
        "date_values": P.is_date(c),
    }


def _counted(name: str, condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).alias(name)


def pattern_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each column look like what; one row per column, no value shuffled.

    The cells are unpivoted, so the matching code is generated once, not once per column, and the
    shuffle carries one partial row per task and column.
    """
    c, one = F.col("value"), F.lit(1).cast("long")
    return _cells(text_frame(df, columns)).groupBy("column_name").agg(
        _counted("null_count", c.isNull(), one),
        _counted("n", c.isNotNull(), one),
        *[_counted(k, fact, one) for k, fact in _facts(c).items()],
    )


def _mask(c: Column) -> Column:
    """The facts of a value as bits."""
    bits = [F.when(fact, 1 << i).otherwise(0) for i, fact in enumerate(_facts(c).values())]
    return sum(bits[1:], bits[0])


def column_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """``pattern_counts`` with ``unique_count``, from one scan.

    Equal values of a column are brought together, in each task first, and matched once; how often
    they occur is their weight. Long values, which hardly repeat, are matched where they are read,
    and only a digest and what they look like travels. The approximate way shuffles no values:
    patterns meet every cell, and a sketch counts the distinct ones.
    """
    cells = _cells(text_frame(df, columns))
    if approximate:
        distinct = cells.groupBy("column_name").agg(
            F.approx_count_distinct("value").alias("unique_count")
        )
        counts = pattern_counts(df, columns)
        return counts.join(distinct, "column_name", "left").na.fill(0, ["unique_count"])
    value, long = F.col("value"), F.length("value") > LONG_VALUE
    facts = F.coalesce("_mask", F.when(value.isNotNull(), _mask(value))).alias("_facts")
    values = (
        cells.select(
            "column_name",
            F.when(long, F.md5("value")).otherwise(value).alias("value"),
            F.when(long, _mask(value)).alias("_mask"),
        )
        .groupBy("column_name", "value", "_mask")
        .agg(F.count("*").alias("_n"))
        # Matched here and not within the sums below, which would match again for each fact.
        .select("column_name", "_n", "value", facts)
    )
    n = F.col("_n")
    return values.groupBy("column_name").agg(
        _counted("null_count", value.isNull(), n),
        _counted("n", value.isNotNull(), n),
        *[
            _counted(k, F.col("_facts").bitwiseAND(F.lit(1 << i)) != 0, n)
            for i, k in enumerate(_facts(value))
        ],
        F.count("value").alias("unique_count"),
    )


def detected_type() -> Column:
    """The cascade of checks, over the columns of ``column_counts``."""

    def share(name):
        return ratio(F.col(name), F.col("n"))

    def number():
        return (
            F.when(share("percentage_matches") > HALF_SHARE, "percentage")
            .when(share("currency_matches") > HALF_SHARE, "currency")
            .when(share("integer_values") > INTEGER_SHARE, "integer")
            .otherwise("float")
        )

    few = (share("unique_count") < CATEGORICAL_RATIO) & (
        F.col("unique_count") < CATEGORICAL_VALUES
    )
    return (
        F.when(F.col("n") == 0, "unknown")
        .when(share("boolean_matches") > BOOLEAN_SHARE, "boolean")
        .when(share("numeric_values") > NUMERIC_SHARE, number())
        .when(
            share("date_values") > HALF_SHARE,
            F.when(share("datetime_matches") > DATETIME_SHARE, "datetime").otherwise("date"),
        )
        .when(share("email_matches") > PATTERN_SHARE, "email")
        .when(share("phone_matches") > PATTERN_SHARE, "phone")
        .when(share("url_matches") > PATTERN_SHARE, "url")
        .when(few, "categorical")
        .otherwise("string")
    )


def _confidence(type_column: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(type_column == name, F.lit(value)).otherwise(out)
    return out


def column_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approximate: bool = False,
    sample_size: int | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """``(column_name, detected_type, confidence, null_count, unique_count)`` per column."""
    source = df if sample_size is None else hash_sample(df, key, sample_size)
    return _typed(column_counts(source, columns, approximate))


def _typed(counts: DataFrame) -> DataFrame:
    return counts.withColumn("detected_type", detected_type()).select(
        "column_name",
        "detected_type",
        _confidence(F.col("detected_type")).alias("confidence"),
        "null_count",
        "unique_count",
    )


def column_patterns(counts: DataFrame) -> DataFrame:
    """``(column_name, patterns)``: names of the patterns more than 30 % of the values match.

    ``counts`` is the result of ``pattern_counts``.
    """
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    ratio(F.col(f"{k}_matches"), F.col("n")) > MENTION_SHARE, F.lit(k)
                )
                for k in P.PATTERNS
            ]
        )
    )
    return counts.select("column_name", found.alias("patterns"))


def sample_values(
    df: DataFrame, columns: Sequence[str] | None = None, size: int = SAMPLE_VALUES
) -> DataFrame:
    """``(column_name, sample_values)``: the first distinct values in sort order.

    The rank filter is applied before the shuffle as well, so each task contributes at most
    ``size`` values per column.
    """
    distinct = _cells(text_frame(df, columns)).filter("value is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    return (
        distinct.withColumn("_rank", rank)
        .filter(F.col("_rank") <= size)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    )


def range_info(
    df: DataFrame, columns: Sequence[str] | None = None, buffer_limit: int = BUFFER_LIMIT
) -> DataFrame:
    """Extremes, mean, deviation and quartiles of the values that read as plain numbers."""
    text = text_frame(df, columns)
    numbers = text.select(*[P.plain_number(quoted(c)).alias(c) for c in text.columns])
    quartiles = exact_quantiles(numbers, numbers.columns, [0.25, 0.75], buffer_limit)

    def metrics(name, c):
        q25, q75 = quartiles[name]
        return {
            "values": F.count(c),
            "min_value": F.min(c),
            "max_value": F.max(c),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "q25": F.lit(q25).cast("double"),
            "q75": F.lit(q75).cast("double"),
        }

    rows = per_column(
        numbers, numbers.columns, metrics,
        "column_name string, values long, min_value double, max_value double, mean double,"
        " std double, q25 double, q75 double",
    )
    return rows.filter("values > 0").drop("values")


def format_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, detected_format, format_confidence)``: the commonest date format."""
    counted = (
        _cells(text_frame(df, columns))
        .select("column_name", P.date_format_of(F.col("value")).alias("format"))
        .filter("format is not null")
        .groupBy("column_name", "format")
        .agg(F.count("*").alias("n"))
    )
    return counted.groupBy("column_name").agg(
        F.min_by("format", F.struct(-F.col("n"), F.col("format"))).alias("detected_format"),
        ratio(F.max("n"), F.sum("n")).alias("format_confidence"),
    )


def column_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Everything known about each column: type, samples, patterns, range and date format.

    Range and format are only kept where the detected type calls for them.
    """
    counts = settle(column_counts(df, columns))
    info = (
        _typed(counts)
        .join(sample_values(df, columns), "column_name", "left")
        .join(column_patterns(counts), "column_name", "left")
        .join(range_info(df, columns), "column_name", "left")
        .join(format_info(df, columns), "column_name", "left")
    )
    numeric = F.col("detected_type").isin(*NUMERIC_TYPES)
    dated = F.col("detected_type").isin("date", "datetime")
    return info.select(
        "column_name", "detected_type", "confidence",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "unique_count", "null_count", "patterns",
        F.when(
            numeric & F.col("min_value").isNotNull(),
            F.struct("min_value", "max_value", "mean", "std", "q25", "q75"),
        ).alias("range_info"),
        F.when(
            dated & F.col("detected_format").isNotNull(),
            F.struct("detected_format", "format_confidence"),
        ).alias("format_info"),
    )


def suggest_schema(types: DataFrame) -> DataFrame:
    """``(column_name, suggested_type)``: the detected type where it is trusted, else string."""
    return types.select(
        "column_name",
        F.when(F.col("confidence") > TRUSTED, F.col("detected_type"))
        .otherwise("string")
        .alias("suggested_type"),
    )


def is_compatible(expected: Column, detected: Column) -> Column:
    out = F.lit(False)
    for name, accepted in COMPATIBLE.items():
        out = F.when(expected == name, detected.isin(*accepted)).otherwise(out)
    return out


def _cell_reason(text: Column, expected: str) -> Column:
    """Why a cell breaks its declared type; NULL when it does not, or when it is missing."""
    if expected == "email":
        return F.when(~text.rlike(P.EMAIL), F.lit("Not an email"))
    if expected == "date":
        valid = F.lit(False)
        for name in P.COLUMN_DATE_FORMATS:
            valid = valid | P.parses_as(text, name)
        return F.when(~valid, F.lit("Not a date"))
    number = P.to_number(text)
    readable = number.isNotNull() | F.translate(text, ",", "").rlike(P.SPECIAL_NUMBER)
    reason = F.when(~readable, F.lit("Not a number"))
    if expected == "integer":
        whole = F.coalesce(number == F.floor(number), F.lit(False))
        reason = reason.when(~whole, F.lit("Not an integer"))
    return F.when(text.isNotNull(), reason)


CHECKED_TYPES = ("email", "date", "integer", "float")


def cell_violations(df: DataFrame, expected: dict[str, str], key: Sequence[str]) -> DataFrame:
    """``(key…, column_name, value, reason)`` of every cell that breaks its declared type."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    checked = [c for c, t in expected.items() if c in fields and t in CHECKED_TYPES]
    found = row_array(
        [
            F.struct(
                F.lit(c).alias("column_name"),
                P.as_text(quoted(c), fields[c]).alias("value"),
                _cell_reason(P.as_text(quoted(c), fields[c]), expected[c]).alias("reason"),
            )
            for c in checked
        ],
        "column_name: string, value: string, reason: string",
    )
    return nan_to_null(df).select(*key, F.inline(found)).filter("reason is not null")


def schema_differences(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``(column_name, status)``: missing and extra columns."""
    rows = [(c, "missing") for c in sorted(set(expected) - set(df.columns))]
    rows += [(c, "extra") for c in sorted(set(df.columns) - set(expected))]
    return df.sparkSession.createDataFrame(rows, "column_name string, status string")


def validate_schema(
    df: DataFrame, expected: dict[str, str], approximate: bool = False
) -> DataFrame:
    """One row per expected column that exists: expected and detected type and the verdict.

    ``type_ok`` compares the types; ``cells_ok`` says whether every cell fits, where cells are
    checked. ``valid`` is the cell verdict if there is one, else the type verdict.
    """
    present = [c for c in expected if c in df.columns]
    declared = df.sparkSession.createDataFrame(
        [(c, expected[c]) for c in present], "column_name string, expected_type string"
    )
    text = text_frame(df, present)
    checked = [c for c in present if expected[c] in CHECKED_TYPES]
    violations = per_column(
        text, checked,
        lambda name, c: {"violations": count_where(_cell_reason(c, expected[name]).isNotNull())},
        "column_name string, violations long",
    )
    type_ok = is_compatible(F.col("expected_type"), F.col("detected_type"))
    return (
        column_types(df, present, approximate)
        .join(declared, "column_name")
        .join(violations, "column_name", "left")
        .select(
            "column_name",
            "expected_type",
            "detected_type",
            "confidence",
            type_ok.cast("int").alias("type_ok"),
            (F.col("violations") == 0).cast("int").alias("cells_ok"),
            "violations",
        )
        .withColumn("valid", F.coalesce("cells_ok", "type_ok"))
    )


def schema_verdict(df: DataFrame, expected: dict[str, str], validation: DataFrame) -> DataFrame:
    """One row: is the whole schema valid, and how many columns are missing, extra or invalid."""
    missing = len(set(expected) - set(df.columns))
    extra = len(set(df.columns) - set(expected))
    invalid = count_where(F.col("valid") == 0)
    return validation.agg(
        F.lit(missing).cast("long").alias("missing_columns"),
        F.lit(extra).cast("long").alias("extra_columns"),
        invalid.alias("invalid_columns"),
        ((invalid == 0) & F.lit(missing == 0)).cast("int").alias("overall_valid"),
    )


