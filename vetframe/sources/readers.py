"""Reading tables, folders of tables and whole text files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import count_where, nan_to_null, numeric_columns, quoted, ratio, string_columns
from ..functions.ordering import lookup, running_totals, settle
from ..operators.profile import FENCE_FACTOR, adjusted_skewness
from ..operators.text import title_from_file


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a csv, json or parquet file by its ending. Give a schema to save the inference pass."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ending == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if ending == "json":
        return reader.json(path, multiLine=True)
    if ending == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported file format: .{ending}")


@dataclass
class Folder:
    """The files of a folder: tables of files with the same columns, and what became of each file."""

    #: One table for each set of columns, with a ``file`` column.
    tables: list[DataFrame]
    #: ``(file, status, reason)``: ``read`` or ``failed``.
    status: DataFrame

    def together(self) -> DataFrame | None:
        """All tables as one, columns matched by name."""
        out = None
        for table in self.tables:
            out = table if out is None else out.unionByName(table, allowMissingColumns=True)
        return out

    def profile(self) -> DataFrame | None:
        """``(file, column_name, metric, value)``: the profile of every file."""
        out = None
        for table in self.tables:
            part = profile_by(table)
            out = part if out is None else out.unionByName(part)
        return out


def _file_name() -> Column:
    return F.col("_metadata.file_name").alias("file")


def open_folder(
    spark: SparkSession, folder: str, pattern: str = "*.csv", schema: str | None = None
) -> Folder:
    """Read the matching files of a folder, each by its own columns.

    Files with the same columns form one table. A csv file's columns are those of its first line,
    in its order; types are inferred for each table, or taken by name from ``schema``. A file that
    cannot be opened is recorded as failed with the reason, and the others are read without it.
    """
    ending = pattern.rsplit(".", 1)[-1].lower()
    if ending not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported file format: .{ending}")
    sizes = _listed(spark, folder, pattern)
    failed: dict[str, str] = {}
    groups: dict[object, list[str]] = {}
    headers = _csv_headers(spark, folder, pattern) if ending == "csv" and any(sizes.values()) else {}
    for path, size in sizes.items():
        name = path.rsplit("/", 1)[-1]
        try:
            if ending == "csv":
                columns: object = headers.get(name)
                if not columns:
                    raise ValueError("the file has no header")
            elif size == 0:
                raise ValueError("the file is empty")
            else:
                columns = read_table(spark, path).schema.simpleString()
        except Exception as problem:  # recorded for the caller, who decides what to do
            failed[name] = str(problem).strip().splitlines()[0][:200]
            continue
        groups.setdefault(columns, []).append(path)
    given = _schema_of(spark, schema)
    tables = []
    for columns, members in groups.items():
        if ending == "csv":
            df = spark.read.csv(members, header=True, inferSchema=not given, enforceSchema=False)
        elif ending == "json":
            df = spark.read.json(members, multiLine=True)
        else:
            df = spark.read.parquet(*members)
        typed = [
            quoted(c).cast(given[c]).alias(c) if c in given else quoted(c) for c in df.columns
        ]
        tables.append(df.select(*typed, _file_name()))
    rows = [
        (n, "failed" if n in failed else "read", failed.get(n))
        for n in (p.rsplit("/", 1)[-1] for p in sizes)
    ]
    return Folder(tables, spark.createDataFrame(rows, "file string, status string, reason string"))


def _listed(spark: SparkSession, folder: str, pattern: str) -> dict[str, int]:
    """Sizes of the matching files by path, in order; empty files, which no reader sees, included."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(where, pattern))
    files = {s.getPath().toString(): s.getLen() for s in found or () if s.isFile()}
    return {p: files[p] for p in sorted(files) if p.rsplit("/", 1)[-1][0] not in "._"}


def _schema_of(spark: SparkSession, schema: str | None) -> dict:
    if schema is None:
        return {}
    return {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}


def _csv_headers(spark: SparkSession, folder: str, pattern: str) -> dict[str, str]:
    """The first line of every file, by file name."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    first = (
        lines.filter("_metadata.file_block_start = 0 AND trim(value) <> ''")
        .select(_file_name(), "value", F.monotonically_increasing_id().alias("at"))
        .groupBy("file")
        .agg(F.min_by("value", "at").alias("header"))
    )
    return {unquote(r["file"]): r["header"] for r in first.collect()}


def read_folder(
    spark: SparkSession, folder: str, pattern: str = "*.csv", schema: str | None = None
) -> DataFrame:
    """The matching files of a folder as one table with a ``file`` column, columns matched by name.

    Files that cannot be opened are left out; ``open_folder`` names them.
    """
    found = open_folder(spark, folder, pattern, schema).together()
    if found is None:
        raise ValueError(f"no readable file {pattern} in {folder}")
    return found


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of whole text files, the title taken from the file name."""
    return spark.read.text(path, wholetext=True).select(
        title_from_file(F.col("_metadata.file_name")).alias("title"),
        F.col("value").alias("text"),
    )


def profile_by(df: DataFrame, by: str = "file", columns: Sequence[str] | None = None) -> DataFrame:
    """``(by, column_name, metric, value)``: the table profile per file, for all files at once.

    Counts and moments are one grouped aggregation. Quartiles per file and column come from the
    running count of distinct values over ranges of (file, column, value), so a file that holds
    most of the rows is spread over several tasks.
    """
    numeric = [c for c in (columns or numeric_columns(df)) if c != by]
    others = [c for c in df.columns if c != by]
    clean = nan_to_null(df)
    entries = []

    def add(name, metric, value):
        entries.append(
            F.struct(
                F.lit(name).cast("string").alias("column_name"), F.lit(metric).alias("metric"),
                value.cast("double").alias("value"),
            )
        )

    for name in others:
        c = quoted(name)
        add(name, "missing_count", count_where(c.isNull()))
        add(name, "missing_percent", 100 * ratio(count_where(c.isNull()), F.count("*")))
    for name in numeric:
        x = quoted(name).cast("double")
        add(name, "mean", F.avg(x))
        add(name, "std", F.stddev_samp(x))
        add(name, "min_value", F.min(x))
        add(name, "max_value", F.max(x))
        add(name, "skewness", adjusted_skewness(x))
    for metric, value in (
        ("total_rows", F.count("*")),
        ("total_columns", F.lit(len(others))),
        ("numeric_columns", F.lit(len([c for c in numeric_columns(df) if c != by]))),
        ("categorical_columns", F.lit(len([c for c in string_columns(df) if c != by]))),
    ):
        add(None, metric, value)
    moments = (
        clean.groupBy(quoted(by).alias("by"))
        .agg(*[e.alias(f"e{i}") for i, e in enumerate(entries)])
        .select("by", F.inline(F.array(*[F.col(f"e{i}") for i in range(len(entries))])))
    )
    return moments.unionByName(_outliers_by(clean, by, numeric)).withColumnRenamed("by", by)


def _outliers_by(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), quoted(c).cast("double").alias("x"))
            for c in columns
        ]
    )
    keys = ["by", "column_name"]
    counts = settle(
        df.select(quoted(by).alias("by"), F.inline(pairs))
        .groupBy(*keys, "x")
        .agg(F.count("*").alias("n"))
    )
    rows = counts.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    present = counts.filter("x is not null")
    known = settle(running_totals(present, [F.col("x")], {"upto": F.col("n")}, keys))
    totals = lookup(present.groupBy(*keys).agg(F.sum("n").alias("total")))

    def quartile(share):
        position = F.lit(share) * (F.col("total") - 1)
        low, high = F.floor(position), F.ceil(position)
        before = F.col("upto") - F.col("n")
        at = [F.max(F.when((r >= before) & (r < F.col("upto")), F.col("x"))) for r in (low, high)]
        part = F.max(position - low)
        return at[0] + part * (at[1] - at[0])

    fences = lookup(
        known.join(totals, keys)
        .groupBy(*keys)
        .agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
        .withColumn("low", F.col("q1") - FENCE_FACTOR * (F.col("q3") - F.col("q1")))
        .withColumn("high", F.col("q3") + FENCE_FACTOR * (F.col("q3") - F.col("q1")))
    )
    outside = (F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))
    found = known.join(fences, keys).groupBy(*keys).agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("_found")
    )
    result = rows.join(found, keys, "left")
    count = F.coalesce("_found", F.lit(0))
    return result.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("outlier_count").alias("metric"), count.cast("double").alias("value")),
                F.struct(
                    F.lit("outlier_percent").alias("metric"),
                    (100 * ratio(count, F.col("_rows"))).alias("value"),
                ),
            )
        ),
    )
