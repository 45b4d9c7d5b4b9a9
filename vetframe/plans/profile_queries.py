"""Queries on tables: sources, preparation, profile, semantic types, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modeling, prep, profile, repair, semantic
from ..sources import readers
from . import views as V
from .views import DIRTY, DIRTY_COLUMNS, DIRTY_NUMBERS, DIRTY_TEXT, STR_COLUMNS, STRS, r6, union_all

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _null_count(c):
    return f"CAST(count(*) - count({c}) AS BIGINT)"


def _pct(part, whole="count(*)"):
    return f"100e0 * {part} / {whole}"


# ---------------------------------------------------------------- sources and preparation


@query(
    "read_parquet",
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total"
    " FROM orders GROUP BY 1",
)
def read_parquet(spark, sf_dir):
    df = readers.read_table(spark, f"{sf_dir}/orders.parquet")
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def _group_profile_sql(source, by, columns, numbers, text_count):
    """Long profile per group in SQL."""
    rows = []

    def add(name, metric, value):
        label = f"'{name}'" if name else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT {by}, {label} AS column_name, '{metric}' AS metric, {r6(value)} AS value"
            f" FROM {source} GROUP BY {by}"
        )

    for c in columns:
        add(c, "missing_count", f"count(*) - count({c})")
        add(c, "missing_percent", f"100e0 * (count(*) - count({c})) / count(*)")
    for c in numbers:
        x = f"CAST({c} AS DOUBLE)"
        add(c, "mean", f"avg({x})")
        add(c, "std", f"stddev_samp({x})")
        add(c, "min_value", f"min({x})")
        add(c, "max_value", f"max({x})")
        add(c, "skewness", f"skewness({x})")
        fence = (
            f"SELECT {by} AS g, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3"
            f" FROM {source} GROUP BY {by}"
        )
        out = (
            f"{x} < f.q1 - 1.5e0 * (f.q3 - f.q1) OR {x} > f.q3 + 1.5e0 * (f.q3 - f.q1)"
        )
        for metric, value in (
            ("outlier_count", f"count(*) FILTER (WHERE {out})"),
            ("outlier_percent", f"100e0 * count(*) FILTER (WHERE {out}) / count(*)"),
        ):
            rows.append(
                f"SELECT {by}, '{c}' AS column_name, '{metric}' AS metric, {r6(value)} AS value"
                f" FROM {source} JOIN ({fence}) f ON {source}.{by} = f.g GROUP BY {by}"
            )
    add(None, "total_rows", "count(*)")
    add(None, "total_columns", str(len(columns)))
    add(None, "numeric_columns", str(len(numbers)))
    add(None, "categorical_columns", str(text_count))
    return union_all(rows)


#: Tables read as the files of one folder: all columns, numeric columns.
FOLDER = {
    "nation": (["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey", "n_regionkey"]),
    "region": (["r_regionkey", "r_name"], ["r_regionkey"]),
    "supplier": (
        ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["s_suppkey", "s_nationkey", "s_acctbal"],
    ),
}


@query(
    "folder_profile",
    "WITH " + ", ".join(f"src_{t} AS (SELECT *, '{t}.parquet' AS file FROM {t})" for t in FOLDER)
    + "\n" + union_all(
        _group_profile_sql(f"src_{t}", "file", columns, numbers, len(columns) - len(numbers))
        for t, (columns, numbers) in FOLDER.items()
    ),
)
def folder_profile(spark, sf_dir):
    """Files with different columns, one profile each."""
    found = readers.open_folder(spark, sf_dir, "{" + ",".join(FOLDER) + "}.parquet")
    return V.rounded(found.profile())


@query(
    "folder_status",
    union_all(f"SELECT '{t}.parquet' AS file, 'read' AS status, CAST(count(*) AS BIGINT) AS n_rows"
              f" FROM {t}" for t in FOLDER),
)
def folder_status(spark, sf_dir):
    found = readers.open_folder(spark, sf_dir, "{" + ",".join(FOLDER) + "}.parquet")
    rows = found.together().groupBy("file").agg(F.count("*").alias("n_rows"))
    return found.status.join(rows, "file", "left").select("file", "status", "n_rows")


@query(
    "grouped_profile",
    "WITH " + DIRTY + "\n"
    + _group_profile_sql(
        "dirty", "l_linestatus", [c for c in DIRTY_COLUMNS if c != "l_linestatus"],
        DIRTY_NUMBERS, 2,
    ),
)
def grouped_profile(spark, sf_dir):
    return V.rounded(readers.profile_by(V.dirty(spark, sf_dir), "l_linestatus"))


@query(
    "drop_id_like",
    "SELECT user_id_less.* FROM (SELECT ts, event_type, value, props FROM events) user_id_less",
)
def drop_id_like(spark, sf_dir):
    return prep.drop_id_like(V.table(spark, sf_dir, "events"))


@query(
    "drop_empty",
    "WITH " + STRS + " SELECT o_orderkey, status, whole, age FROM strs WHERE whole IS NOT NULL",
)
def drop_empty(spark, sf_dir):
    columns = ["o_orderkey", "status", "whole", "nothing", "age"]
    return prep.drop_empty(V.strs(spark, sf_dir).select(*columns), "whole")


_TASK_LABELS = [
    ("lineitem", "l_linenumber"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"),
    ("lineitem", "l_returnflag"), ("labels", "quality"),
]


def _label_sql(table, label, value):
    return (
        f"SELECT '{label}' AS label, {value} FROM (SELECT count(DISTINCT {label}) AS k,"
        f" min({label}) AS lo, max({label}) AS hi,"
        f" bool_and({{whole}}) AS whole FROM {table})"
    )


def _task_sql(value, text_value):
    rows = []
    for t, label in _TASK_LABELS:
        if label == "l_returnflag":
            rows.append(f"SELECT '{label}' AS label, '{text_value}' AS task")
        else:
            whole = f"CAST({label} AS DOUBLE) = floor(CAST({label} AS DOUBLE))"
            rows.append(_label_sql(t, label, value + " AS task").replace("{whole}", whole))
    return union_all(rows)


@query(
    "infer_task",
    _task_sql("CASE WHEN k <= 10 AND whole THEN 'classification' ELSE 'regression' END", "classification"),
)
def infer_task(spark, sf_dir):
    out = None
    for t, label in _TASK_LABELS:
        row = prep.infer_task(V.table(spark, sf_dir, t), label)
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "task_type",
    _task_sql(
        "CASE WHEN k = 2 AND lo = 0 AND hi = 1 THEN 'binary' WHEN k <= 50 AND whole"
        " THEN 'multiclass' ELSE 'regression' END",
        "multiclass",
    ),
)
def task_type(spark, sf_dir):
    out = None
    for t, label in _TASK_LABELS:
        row = prep.task_type(V.table(spark, sf_dir, t), label)
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "label_codes",
    "WITH " + DIRTY + """, codes AS (
  SELECT l_returnflag AS label, row_number() OVER (ORDER BY l_returnflag) - 1 AS code
  FROM (SELECT DISTINCT l_returnflag FROM dirty WHERE l_returnflag IS NOT NULL))
SELECT l_returnflag, CAST(coalesce(code, -1) AS INTEGER) AS code, CAST(count(*) AS BIGINT) AS n
FROM dirty LEFT JOIN codes ON l_returnflag = label GROUP BY 1, 2""",
)
def label_codes(spark, sf_dir):
    coded = prep.label_codes(V.dirty(spark, sf_dir), "l_returnflag")
    return coded.groupBy("l_returnflag", "code").agg(F.count("*").alias("n"))


@query(
    "binarize_and_threshold",
    "WITH " + DIRTY + """
SELECT CAST(coalesce(CAST(l_returnflag = 'R' AS INTEGER), 0) AS INTEGER) AS y_true,
  CAST(coalesce(CAST(l_quantity >= 3e1 AS INTEGER), 0) AS INTEGER) AS y_pred,
  CAST(count(*) AS BIGINT) AS n FROM dirty GROUP BY 1, 2""",
)
def binarize_and_threshold(spark, sf_dir):
    return (
        V.dirty(spark, sf_dir)
        .select(
            prep.binarize_label(F.col("l_returnflag"), "R").alias("y_true"),
            prep.threshold_score(F.col("l_quantity"), 30.0).alias("y_pred"),
        )
        .groupBy("y_true", "y_pred")
        .agg(F.count("*").alias("n"))
    )


@query(
    "describe_dataset",
    """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(6 AS BIGINT) AS total_columns,
  'o_orderpriority' AS label, 'string' AS label_type,
  CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS label_classes FROM orders""",
)
def describe_dataset(spark, sf_dir):
    return prep.describe_dataset(V.table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "preview",
    "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def preview(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    return prep.preview(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query(
    "min_class_count",
    "WITH " + DIRTY + """ SELECT 'l_returnflag' AS label, CAST(min(n) AS BIGINT) AS min_class_count
FROM (SELECT count(*) AS n FROM dirty WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag)""",
)
def min_class_count(spark, sf_dir):
    return prep.min_class_count(V.dirty(spark, sf_dir), "l_returnflag")


# ---------------------------------------------------------------- profile

_MISSING_SQL = union_all(
    f"SELECT '{c}' AS column_name, {_null_count(c)} AS missing_count,"
    f" {r6(_pct('(count(*) - count(' + c + '))'))} AS missing_percent,"
    f" CAST(count(*) AS BIGINT) AS total_rows FROM dirty"
    for c in DIRTY_COLUMNS
)


@query("missing_values", "WITH " + DIRTY + "\n" + _MISSING_SQL)
def missing_values(spark, sf_dir):
    return V.rounded(profile.missing_values(V.dirty(spark, sf_dir)))


@query(
    "missing_totals",
    "WITH " + DIRTY + ", m AS (" + _MISSING_SQL + ") SELECT CAST(sum(missing_count) AS BIGINT)"
    " AS total_missing, round(100e0 * sum(missing_count) / sum(total_rows), 6) AS total_percent FROM m",
)
def missing_totals(spark, sf_dir):
    return V.rounded(profile.missing_totals(profile.missing_values(V.dirty(spark, sf_dir))))


@query(
    "missing_severity",
    "WITH " + DIRTY + ", m AS (" + _MISSING_SQL + ") SELECT *, CASE WHEN missing_percent >= 20"
    " THEN 'critical' WHEN missing_percent >= 5 THEN 'warning' ELSE 'ok' END AS severity FROM m",
)
def missing_severity(spark, sf_dir):
    missing = profile.missing_values(V.dirty(spark, sf_dir))
    return V.rounded(profile.missing_severity(missing))


@query(
    "missing_matrix",
    "WITH " + DIRTY + " SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in DIRTY_COLUMNS[4:])
    + " FROM dirty",
)
def missing_matrix(spark, sf_dir):
    return profile.missing_matrix(V.dirty(spark, sf_dir), DIRTY_COLUMNS[:4])


@query(
    "co_missing",
    "WITH " + DIRTY + "\n"
    + union_all(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b,"
        f" CAST(count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS BIGINT)"
        f" AS missing_together FROM dirty"
        for i, a in enumerate(DIRTY_COLUMNS)
        for b in DIRTY_COLUMNS[i:]
    ),
)
def co_missing(spark, sf_dir):
    return profile.co_missing(V.dirty(spark, sf_dir))


_FENCES = "fences AS (" + union_all(
    f"SELECT '{c}' AS c, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,"
    f" quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM dirty"
    for c in DIRTY_NUMBERS
) + ")"
_LOW, _HIGH = "(q1 - 1.5e0 * (q3 - q1))", "(q3 + 1.5e0 * (q3 - q1))"
_OUTLIER_ROWS = [
    f"SELECT '{c}' AS column_name, any_value({_LOW}) AS lo, any_value({_HIGH}) AS hi,"
    f" CAST(count(*) FILTER (WHERE {c} < {_LOW} OR {c} > {_HIGH}) AS BIGINT) AS outlier_count,"
    f" count(*) AS n FROM dirty, fences WHERE fences.c = '{c}'"
    for c in DIRTY_NUMBERS
]
_OUTLIERS = _FENCES + ", outliers AS (" + union_all(_OUTLIER_ROWS) + ")"


@query(
    "iqr_outliers",
    "WITH " + DIRTY + ", " + _OUTLIERS
    + f" SELECT column_name, {r6('lo')} AS lower_fence, {r6('hi')} AS upper_fence, outlier_count,"
    f" {r6('100e0 * outlier_count / n')} AS outlier_percent FROM outliers",
)
def iqr_outliers(spark, sf_dir):
    return V.rounded(profile.iqr_outliers(V.dirty(spark, sf_dir)))


@query(
    "zscore_outliers",
    "WITH " + DIRTY + "\n"
    + union_all(
        f"SELECT '{c}' AS column_name, {r6('any_value(m)')} AS mean, {r6('any_value(s)')} AS std,"
        f" CAST(count(*) FILTER (WHERE abs({c} - m) > 3e0 * s) AS BIGINT) AS outlier_count,"
        f" {r6(f'100e0 * count(*) FILTER (WHERE abs({c} - m) > 3e0 * s) / count(*)')}"
        f" AS outlier_percent FROM dirty,"
        f" (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS s FROM dirty)"
        for c in DIRTY_NUMBERS
    ),
)
def zscore_outliers(spark, sf_dir):
    return V.rounded(profile.zscore_outliers(V.dirty(spark, sf_dir)))


@query(
    "box_plot",
    "WITH " + DIRTY + "\n"
    + union_all(
        f"SELECT '{c}' AS column_name, {r6(f'min({c})')} AS min_value, {r6('any_value(q1)')} AS q1,"
        f" {r6(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median, {r6('any_value(q3)')} AS q3,"
        f" {r6(f'max({c})')} AS max_value, {r6(f'any_value({_LOW})')} AS lower_fence,"
        f" {r6(f'any_value({_HIGH})')} AS upper_fence FROM dirty,"
        f" (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,"
        f" quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM dirty)"
        for c in DIRTY_NUMBERS
    ),
)
def box_plot(spark, sf_dir):
    return V.rounded(profile.box_plot(V.dirty(spark, sf_dir)))


@query(
    "outlier_points",
    "WITH " + DIRTY + ", " + _FENCES + "\n"
    + union_all(
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{c}' AS column_name,"
        f" CAST({c} AS DOUBLE) AS value FROM dirty, fences"
        f" WHERE fences.c = '{c}' AND ({c} < {_LOW} OR {c} > {_HIGH})"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def outlier_points(spark, sf_dir):
    return profile.outlier_points(
        V.dirty(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    )


def _moments_sql(source, columns, kurtosis=False):
    extra = ", {k} AS kurtosis" if kurtosis else ""
    return union_all(
        f"SELECT '{c}' AS column_name, {r6(f'avg({x})')} AS mean, {r6(f'stddev_samp({x})')} AS std,"
        f" {r6(f'min({x})')} AS min_value, {r6(f'max({x})')} AS max_value,"
        f" {r6(f'skewness({x})')} AS skewness" + extra.format(k=r6(f"kurtosis({x})"))
        + f" FROM {source}"
        for c, x in ((c, f"CAST({c} AS DOUBLE)") for c in columns)
    )


@query("distributions", "WITH " + DIRTY + "\n" + _moments_sql("dirty", DIRTY_NUMBERS))
def distributions(spark, sf_dir):
    return V.rounded(profile.distributions(V.dirty(spark, sf_dir)))


@query(
    "kurtosis",
    _moments_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], True),
)
def kurtosis(spark, sf_dir):
    return V.rounded(profile.distributions(V.table(spark, sf_dir, "customer"), kurtosis=True))


@query(
    "table_summary",
    "SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(11 AS BIGINT) AS total_columns,"
    " CAST(8 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns FROM lineitem",
)
def table_summary(spark, sf_dir):
    return profile.table_summary(V.table(spark, sf_dir, "lineitem"))


_DUPLICATE_SQL = (
    "SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows"
    " FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})"
)


@query(
    "duplicate_rows",
    "WITH " + DIRTY + " "
    + _DUPLICATE_SQL.format(t="dirty", c="l_quantity, l_returnflag, l_discount"),
)
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(
        V.dirty(spark, sf_dir), ["l_quantity", "l_returnflag", "l_discount"], by_digest=False
    )


@query(
    "duplicate_rows_by_digest",
    "SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM"
    " (SELECT count(*) AS n FROM (SELECT date_trunc('day', ts) + to_microseconds(event_id % 2) AS t,"
    " event_type, CASE WHEN event_id % 3 = 0 THEN 0e0 ELSE round(value) END AS v FROM events)"
    " GROUP BY t, event_type, v)",
)
def duplicate_rows_by_digest(spark, sf_dir):
    """Times one microsecond apart differ; 0.0 and -0.0 don't."""
    micros = F.unix_micros(F.date_trunc("day", "ts")) + F.col("event_id") % 2
    zero = F.when(F.col("event_id") % 4 < 2, F.lit(0.0)).otherwise(F.lit(-0.0))
    rows = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.timestamp_micros(micros).alias("t"), "event_type",
        F.when(F.col("event_id") % 3 == 0, zero).otherwise(F.round("value")).alias("v"),
    )
    return profile.duplicate_rows(rows, by_digest=True)


@query(
    "duplicate_rows_nested",
    "SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM"
    " (SELECT count(*) AS n FROM events GROUP BY event_id % 40, event_type, event_id % 7 = 0)",
)
def duplicate_rows_nested(spark, sf_dir):
    """Arrays, maps and structs: microseconds, the order of a map's keys and signed zeros."""
    at = F.timestamp_micros(F.col("event_id") % 40)
    kind, zero = F.col("event_type"), F.when(F.col("event_id") % 2 > 0, F.lit(0.0)).otherwise(F.lit(-0.0))
    pairs = [F.struct(F.lit(k).alias("key"), F.array(zero).alias("value")) for k in "ab"]
    forwards, backwards = F.map_from_entries(F.array(*pairs)), F.map_from_entries(F.array(*pairs[::-1]))
    missing = F.when(F.col("event_id") % 7 > 0, kind)
    rows = V.table(spark, sf_dir, "events").select(
        F.array(at).alias("times"), F.when(F.col("event_id") % 3 > 0, forwards).otherwise(backwards).alias("m"),
        F.struct(kind.alias("k"), missing.alias("v")).alias("s"),
    )
    return profile.duplicate_rows(rows)


@query("duplicate_documents", _DUPLICATE_SQL.format(t="documents", c="text, lang"))
def duplicate_documents(spark, sf_dir):
    return profile.duplicate_rows(
        V.table(spark, sf_dir, "documents"), ["text", "lang"], by_digest=True
    )


@query(
    "constant_columns",
    "WITH " + DIRTY + "\n"
    + union_all(
        [
            f"SELECT 'distinct' AS mode, '{c}' AS column_name, CAST(count(DISTINCT {c})"
            f" + CAST(count(*) > count({c}) AS INTEGER) <= 1 AS INTEGER) AS is_constant FROM dirty"
            for c in DIRTY_COLUMNS
        ]
        + [
            f"SELECT 'std' AS mode, '{c}' AS column_name,"
            f" CAST(coalesce(stddev_samp({c}), 0) = 0 AS INTEGER) AS is_constant FROM dirty"
            for c in DIRTY_NUMBERS
        ]
        + [
            f"SELECT 'text' AS mode, '{c}' AS column_name,"
            f" CAST(count(DISTINCT {c}) = 1 AND count(*) > 1 AS INTEGER) AS is_constant FROM dirty"
            for c in DIRTY_TEXT
        ]
    ),
)
def constant_columns(spark, sf_dir):
    out = None
    for mode in ("distinct", "std", "text"):
        part = profile.constant_columns(V.dirty(spark, sf_dir), mode).select(
            F.lit(mode).alias("mode"), "*"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "label_checks",
    "WITH " + DIRTY + ", " + STRS + """
SELECT 'fixed' AS column_name, CAST(count(DISTINCT fixed) AS BIGINT) AS classes,
  CASE WHEN count(DISTINCT fixed) = 1 THEN 'error' ELSE 'ok' END AS severity FROM dirty
UNION ALL SELECT 'note', CAST(count(DISTINCT note) AS BIGINT),
  CASE WHEN count(DISTINCT note) > 200 THEN 'warning' ELSE 'ok' END FROM strs
UNION ALL SELECT 'l_orderkey', CAST(count(DISTINCT l_orderkey) AS BIGINT), 'ok' FROM dirty""",
)
def label_checks(spark, sf_dir):
    dirty = V.dirty(spark, sf_dir)
    return (
        profile.label_checks(dirty, "fixed")
        .unionByName(profile.label_checks(V.strs(spark, sf_dir), "note"))
        .unionByName(profile.label_checks(dirty, "l_orderkey"))
    )


@query(
    "negative_values",
    "WITH " + V.BALANCES + "\n"
    + union_all(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT)"
        f" AS negative_count, {r6(f'1e0 * count(*) FILTER (WHERE {c} < 0) / count(*)')}"
        f" AS negative_share FROM balances"
        for c in ("balance", "term")
    ),
)
def negative_values(spark, sf_dir):
    return V.rounded(profile.negative_values(V.balances(spark, sf_dir)))


@query(
    "consistency_score",
    """SELECT 'consistency' AS agent, CAST(k AS BIGINT) AS suspect_columns,
  CASE WHEN k > 0 THEN 90e0 ELSE 100e0 END AS score
FROM (SELECT CAST(count(*) FILTER (WHERE c_acctbal < 0) > 0 AS INTEGER)
  + CAST(count(*) FILTER (WHERE c_nationkey < 0) > 0 AS INTEGER) AS k FROM customer)""",
)
def consistency_score(spark, sf_dir):
    return profile.consistency_score(profile.negative_values(V.balances(spark, sf_dir)))


_EMAIL_SQL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
_PHONE_SQL = r"^\+?1?[0-9]{9,15}$"


def _date_ok(c, fmt="%Y-%m-%d", shape=r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"):
    return f"(regexp_matches({c}, '{shape}') AND try_strptime({c}, '{fmt}') IS NOT NULL)"


_FORMAT_BAD = {
    "email": f"NOT regexp_matches(email, '{_EMAIL_SQL}')",
    "date_iso": f"NOT {_date_ok('date_iso')}",
    "date_mixed": f"NOT {_date_ok('date_mixed')}",
    "phone": f"NOT regexp_matches(phone, '{_PHONE_SQL}')",
}


@query(
    "format_issues",
    "WITH " + STRS + "\n"
    + union_all(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT)"
        f" AS invalid_count, {r6(f'100e0 * count(*) FILTER (WHERE {bad}) / count(*)')}"
        f" AS invalid_percent FROM strs"
        for c, bad in _FORMAT_BAD.items()
    ),
)
def format_issues(spark, sf_dir):
    rules = (*profile.FORMAT_RULES, ("phone", "phone"))
    return V.rounded(profile.format_issues(V.strs(spark, sf_dir), rules))


@query(
    "format_entries",
    "WITH " + STRS + "\n"
    + union_all(
        f"SELECT o_orderkey, '{c}' AS column_name, {c} AS value FROM strs WHERE {bad}"
        for c, bad in _FORMAT_BAD.items()
        if c != "phone"
    ),
)
def format_entries(spark, sf_dir):
    return profile.format_entries(V.strs(spark, sf_dir), ["o_orderkey"])


_RANGES = {"age": (0, 150), "score": (0, 100), "percent_done": (0, 100)}


@query(
    "range_issues",
    "WITH " + STRS + "\n"
    + union_all(
        f"SELECT '{c}' AS column_name, {lo}e0 AS low, {hi}e0 AS high,"
        f" CAST(count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS BIGINT) AS invalid_count,"
        f" {r6(f'100e0 * count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) / count(*)')}"
        f" AS invalid_percent FROM strs"
        for c, (lo, hi) in _RANGES.items()
    ),
)
def range_issues(spark, sf_dir):
    rules = (*profile.RANGE_RULES, *profile.PERCENTAGE_RULES)
    return V.rounded(profile.range_issues(V.strs(spark, sf_dir), rules))


@query(
    "range_entries",
    "WITH " + STRS + "\n"
    + union_all(
        f"SELECT o_orderkey, '{c}' AS column_name, {c} AS value FROM strs"
        f" WHERE {c} < {lo} OR {c} > {hi}"
        for c, (lo, hi) in list(_RANGES.items())[:2]
    ),
)
def range_entries(spark, sf_dir):
    return profile.range_entries(V.strs(spark, sf_dir), ["o_orderkey"])


@query(
    "histogram",
    "WITH " + DIRTY + "\n"
    + union_all(
        f"SELECT '{c}' AS column_name, bin, {r6('lo + bin * w')} AS bin_start,"
        f" {r6('lo + (bin + 1) * w')} AS bin_end, CAST(count(*) AS BIGINT) AS n"
        f" FROM (SELECT lo, w, CAST(least(floor((CAST({c} AS DOUBLE) - lo) / w), 19) AS INTEGER)"
        f" AS bin FROM dirty, (SELECT CAST(min({c}) AS DOUBLE) AS lo,"
        f" (CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)) / 20 AS w FROM dirty)"
        f" WHERE {c} IS NOT NULL) GROUP BY bin, lo, w"
        for c in DIRTY_NUMBERS
    ),
)
def histogram(spark, sf_dir):
    return V.rounded(profile.histogram(V.dirty(spark, sf_dir)))


@query(
    "correlations",
    "WITH " + DIRTY + "\n"
    + union_all(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS correlation"
        f" FROM dirty"
        for i, a in enumerate(DIRTY_NUMBERS)
        for b in DIRTY_NUMBERS[i + 1 :]
    ),
)
def correlations(spark, sf_dir):
    return V.rounded(profile.correlations(V.dirty(spark, sf_dir)))


@query(
    "validation_summary",
    "WITH " + DIRTY + ", " + STRS + ", " + _OUTLIERS + ", m AS (" + _MISSING_SQL + "), totals AS ("
    " SELECT 'Missing Values' AS \"check\", 'Fail' AS bad, CAST(sum(missing_count) AS BIGINT) AS issues FROM m"
    " UNION ALL SELECT 'Outliers', 'Warning', CAST(sum(outlier_count) AS BIGINT) FROM outliers"
    f" UNION ALL SELECT 'Format Issues', 'Fail', CAST(sum(k) AS BIGINT) FROM ("
    + union_all(
        f"SELECT count(*) FILTER (WHERE {bad}) AS k FROM strs"
        for c, bad in _FORMAT_BAD.items()
        if c != "phone"
    )
    + ")) SELECT \"check\", CASE WHEN issues = 0 THEN 'Pass' ELSE bad END AS status, issues FROM totals",
)
def validation_summary(spark, sf_dir):
    dirty = V.dirty(spark, sf_dir)
    return profile.validation_summary(
        profile.missing_values(dirty),
        profile.iqr_outliers(dirty),
        profile.format_issues(V.strs(spark, sf_dir)),
    )


@query(
    "quality_bands",
    """SELECT CASE WHEN s >= 90 THEN 'EXCELLENT' WHEN s >= 70 THEN 'GOOD'
  WHEN s >= 50 THEN 'MODERATE' ELSE 'POOR' END AS band, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l_quantity * 2 AS s FROM lineitem) GROUP BY 1""",
)
def quality_bands(spark, sf_dir):
    score = F.col("l_quantity") * 2
    return (
        V.table(spark, sf_dir, "lineitem")
        .select(profile.quality_band(score).alias("band"))
        .groupBy("band")
        .agg(F.count("*").alias("n"))
    )


def _validate_sql():
    rows = []

    def add(check, name, metric, value):
        label = f"'{name}'" if name else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT '{check}' AS \"check\", {label} AS column_name, '{metric}' AS metric,"
            f" {r6(value)} AS value FROM dirty"
        )

    add("summary", None, "total_rows", "count(*)")
    add("summary", None, "total_columns", f"any_value({len(DIRTY_COLUMNS)})")
    add("summary", None, "numeric_columns", f"any_value({len(DIRTY_NUMBERS)})")
    add("summary", None, "categorical_columns", f"any_value({len(DIRTY_TEXT)})")
    for c in DIRTY_COLUMNS:
        add("missing_values", c, "missing_count", f"count(*) - count({c})")
        add("missing_values", c, "missing_percent", f"100e0 * (count(*) - count({c})) / count(*)")
    for c in DIRTY_NUMBERS:
        x = f"CAST({c} AS DOUBLE)"
        for metric, value in (
            ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min_value", f"min({x})"),
            ("max_value", f"max({x})"), ("skewness", f"skewness({x})"),
        ):
            add("distributions", c, metric, value)
        rows.append(
            f"SELECT 'outliers', '{c}', 'outlier_count', CAST(outlier_count AS DOUBLE)"
            f" FROM outliers WHERE column_name = '{c}'"
        )
        rows.append(
            f"SELECT 'outliers', '{c}', 'outlier_percent', {r6('100e0 * outlier_count / n')}"
            f" FROM outliers WHERE column_name = '{c}'"
        )
    for c in DIRTY_TEXT:
        add("consistency", c, "is_constant", f"CAST(count(DISTINCT {c}) = 1 AS INTEGER)")
    return "WITH " + DIRTY + ", " + _OUTLIERS + "\n" + union_all(rows)


@query("validate", _validate_sql())
def validate(spark, sf_dir):
    return V.rounded(profile.validate(V.dirty(spark, sf_dir), profile.CHECKS))


_FINDINGS_SQL = "WITH " + DIRTY + ", m AS (" + _MISSING_SQL + """),
found AS (
  SELECT 'warning' AS severity, 'missing' AS code, arg_max(column_name, missing_percent) AS column_name
  FROM m HAVING max(missing_percent) > 30
  UNION ALL SELECT 'warning', 'duplicates', NULL
  FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL) HAVING sum(n - 1) > 0
  UNION ALL SELECT 'info', 'constant', 'fixed' FROM dirty HAVING count(DISTINCT fixed) <= 1
  UNION ALL SELECT 'error', 'label', 'fixed' FROM dirty HAVING count(DISTINCT fixed) = 1)"""
_FINDINGS_SQL = _FINDINGS_SQL.replace(
    "(SELECT count(*) AS n FROM dirty GROUP BY ALL)",
    "(SELECT count(*) AS n FROM dirty GROUP BY " + ", ".join(DIRTY_COLUMNS) + ")",
)


@query("integrity_findings", _FINDINGS_SQL + " SELECT 'data_integrity' AS agent, * FROM found")
def integrity_findings(spark, sf_dir):
    return profile.integrity_findings(V.dirty(spark, sf_dir), "fixed").drop("message")


@query(
    "integrity_score",
    _FINDINGS_SQL + """ SELECT 'data_integrity' AS agent, CAST(e AS BIGINT) AS errors,
  CAST(w AS BIGINT) AS warnings,
  100e0 - CASE WHEN e > 0 THEN 40 ELSE 0 END - CASE WHEN w > 0 THEN 20 ELSE 0 END AS score
FROM (SELECT count(*) FILTER (WHERE severity = 'error') AS e,
  count(*) FILTER (WHERE severity = 'warning') AS w FROM found)""",
)
def integrity_score(spark, sf_dir):
    return profile.integrity_score(profile.integrity_findings(V.dirty(spark, sf_dir), "fixed"))


@query(
    "impute_median",
    "WITH " + DIRTY + " SELECT "
    + ", ".join(
        f"{r6(f'coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM dirty))')} AS {c}"
        for c in DIRTY_NUMBERS
    )
    + " FROM dirty",
)
def impute_median(spark, sf_dir):
    return V.rounded(modeling.impute_median(V.dirty(spark, sf_dir)))


# ---------------------------------------------------------------- semantic types

_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_PATTERN_SQL = {
    "email": _EMAIL_SQL,
    "phone": _PHONE_SQL,
    "url": (
        r"^https?://(?:[-\p{L}\p{N}_.])+(?:[:0-9]+)?"
        r"(?:/(?:[\p{L}\p{N}_/.])*(?:\?(?:[\p{L}\p{N}_&=%.])*)?(?:#(?:[\p{L}\p{N}_.])*)?)?$"
    ),
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T\s][0-9]{2}:[0-9]{2}:[0-9]{2}",
    "currency": r"^[$€£¥]?\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?$",
    "percentage": r"^[0-9]+(?:\.[0-9]+)?%$",
    "boolean": r"(?i)^(true|false|yes|no|1|0|t|f|y|n)$",
}
_T = " [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_DATE_SQL = [
    ("%Y-%m-%d", "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("%d/%m/%Y", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("%m/%d/%Y", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("%Y/%m/%d", "^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("%d-%m-%Y", "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("%m-%d-%Y", "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("%Y-%m-%d %H:%M:%S", f"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}{_T}$"),
    ("%d/%m/%Y %H:%M:%S", f"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_T}$"),
    ("%m/%d/%Y %H:%M:%S", f"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_T}$"),
]
_FIRST_FORMAT = (
    "CASE "
    + " ".join(f"WHEN {_date_ok('v', f, s)} THEN '{f}'" for f, s in _DATE_SQL)
    + " END"
)
_CELLS = "cells AS (" + union_all(
    f"SELECT o_orderkey, '{c}' AS column_name, {c} AS v FROM strs" for c in STR_COLUMNS
) + ")"
_PLAIN = "replace(v, ',', '')"
_BARE = "replace(replace(replace(v, ',', ''), '$', ''), '%', '')"


def _share_where(condition):
    return f"count(*) FILTER (WHERE {condition}) / CAST(nullif(count(v), 0) AS DOUBLE)"


_STATS = (
    "stats AS (SELECT column_name, CAST(count(*) - count(v) AS BIGINT) AS null_count,"
    " CAST(count(v) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS unique_count, "
    + ", ".join(
        f"{_share_where(f'''regexp_matches(v, '{p}')''')} AS s_{k}" for k, p in _PATTERN_SQL.items()
    )
    + f", {_share_where(f'''regexp_matches({_BARE}, '{_NUMBER}')''')} AS s_numeric"
    + f", {_share_where(f'''regexp_matches({_PLAIN}, '{_NUMBER}') AND TRY_CAST({_PLAIN} AS DOUBLE) = floor(TRY_CAST({_PLAIN} AS DOUBLE))''')} AS s_integer"
    + f", {_share_where(f'({_FIRST_FORMAT}) IS NOT NULL')} AS s_dated"
    + " FROM cells GROUP BY column_name)"
)
_TYPES = """types AS (SELECT *, CASE WHEN detected_type IN ('boolean', 'integer', 'email') THEN 95e-2
    WHEN detected_type = 'date' THEN 85e-2 WHEN detected_type = 'categorical' THEN 8e-1
    WHEN detected_type = 'string' THEN 7e-1 WHEN detected_type = 'unknown' THEN 0e0 ELSE 9e-1 END
    AS confidence
  FROM (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN s_boolean > 0.8 THEN 'boolean'
    WHEN s_numeric > 0.8 THEN CASE WHEN s_percentage > 0.5 THEN 'percentage'
      WHEN s_currency > 0.5 THEN 'currency' WHEN s_integer > 0.9 THEN 'integer' ELSE 'float' END
    WHEN s_dated > 0.5 THEN CASE WHEN s_datetime > 0.3 THEN 'datetime' ELSE 'date' END
    WHEN s_email > 0.7 THEN 'email' WHEN s_phone > 0.7 THEN 'phone' WHEN s_url > 0.7 THEN 'url'
    WHEN unique_count / CAST(n AS DOUBLE) < 0.1 AND unique_count < 50 THEN 'categorical'
    ELSE 'string' END AS detected_type FROM stats))"""
_TYPE_CTES = "WITH " + ", ".join((STRS, _CELLS, _STATS, _TYPES))


@query(
    "column_types",
    _TYPE_CTES + " SELECT column_name, detected_type, confidence, null_count, unique_count FROM types",
)
def column_types(spark, sf_dir):
    return semantic.column_types(V.strs(spark, sf_dir), STR_COLUMNS)


@query(
    "pattern_counts",
    _TYPE_CTES + " SELECT column_name, null_count, n, "
    + ", ".join(f"CAST(round(coalesce(s_{k} * n, 0)) AS BIGINT) AS {k}_matches" for k in _PATTERN_SQL)
    + ", CAST(round(coalesce(s_numeric * n, 0)) AS BIGINT) AS numeric_values,"
    " CAST(round(coalesce(s_integer * n, 0)) AS BIGINT) AS integer_values,"
    " CAST(round(coalesce(s_dated * n, 0)) AS BIGINT) AS date_values FROM types",
)
def pattern_counts(spark, sf_dir):
    return semantic.pattern_counts(V.strs(spark, sf_dir), STR_COLUMNS)


@query(
    "numeric_column_types",
    """WITH c AS (
  SELECT 'l_orderkey' AS column_name, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem
  UNION ALL SELECT 'l_shipdate', CAST(l_shipdate AS VARCHAR) FROM lineitem),
s AS (SELECT column_name, CAST(count(DISTINCT v) AS BIGINT) AS unique_count,
  avg(CAST(regexp_matches(v, '(?i)^(true|false|yes|no|1|0|t|f|y|n)$') AS INTEGER)) AS b,
  avg(CAST(regexp_matches(v, '^[0-9]{1,3}(,[0-9]{3})*(\\.[0-9]{2})?$') AS INTEGER)) AS cur,
  avg(CAST(TRY_CAST(v AS DOUBLE) IS NOT NULL AS INTEGER)) AS num,
  avg(CAST(coalesce(TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)), false) AS INTEGER)) AS whole,
  avg(CAST(regexp_matches(v, '^[0-9]{4}-') AS INTEGER)) AS dated FROM c GROUP BY column_name)
SELECT column_name, CASE WHEN b > 0.8 THEN 'boolean'
  WHEN num > 0.8 THEN CASE WHEN cur > 0.5 THEN 'currency' WHEN whole > 0.9 THEN 'integer' ELSE 'float' END
  WHEN dated > 0.5 THEN 'datetime' ELSE 'categorical' END AS detected_type, unique_count FROM s""",
)
def numeric_column_types(spark, sf_dir):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    types = semantic.column_types(V.table(spark, sf_dir, "lineitem"), columns)
    return types.select("column_name", "detected_type", "unique_count")


@query(
    "column_patterns",
    _TYPE_CTES + " SELECT column_name, concat_ws('|', "
    + ", ".join(f"CASE WHEN s_{k} > 0.3 THEN '{k}' END" for k in _PATTERN_SQL)
    + ") AS patterns FROM types",
)
def column_patterns(spark, sf_dir):
    counts = semantic.pattern_counts(V.strs(spark, sf_dir), STR_COLUMNS)
    found = semantic.column_patterns(counts)
    return found.select("column_name", F.array_join("patterns", "|").alias("patterns"))


@query(
    "sample_values",
    "WITH " + STRS + ", " + _CELLS + """ SELECT column_name, string_agg(v, '|' ORDER BY v) AS sample_values
FROM (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS r
  FROM (SELECT DISTINCT column_name, v FROM cells WHERE v IS NOT NULL)) WHERE r <= 10 GROUP BY 1""",
)
def sample_values(spark, sf_dir):
    found = semantic.sample_values(V.strs(spark, sf_dir), STR_COLUMNS)
    return found.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


@query(
    "range_info",
    "WITH " + STRS + ", " + _CELLS + f""", nums AS (
  SELECT column_name, CAST(v AS DOUBLE) AS x FROM cells WHERE regexp_matches(v, '{_NUMBER}'))
SELECT column_name, {r6('min(x)')} AS min_value, {r6('max(x)')} AS max_value, {r6('avg(x)')} AS mean,
  {r6('stddev_samp(x)')} AS std, {r6('quantile_cont(x, 0.25)')} AS q25,
  {r6('quantile_cont(x, 0.75)')} AS q75 FROM nums GROUP BY 1""",
)
def range_info(spark, sf_dir):
    return V.rounded(semantic.range_info(V.strs(spark, sf_dir), STR_COLUMNS))


@query(
    "format_info",
    "WITH " + STRS + ", " + _CELLS + f""", f AS (
  SELECT column_name, fmt, count(*) AS n FROM (SELECT column_name, {_FIRST_FORMAT} AS fmt FROM cells)
  WHERE fmt IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS total,
  row_number() OVER (PARTITION BY column_name ORDER BY n DESC, fmt) AS r FROM f)
SELECT column_name, fmt AS detected_format, round(CAST(n AS DOUBLE) / total, 6) AS format_confidence
FROM t WHERE r = 1""",
)
def format_info(spark, sf_dir):
    return V.rounded(semantic.format_info(V.strs(spark, sf_dir), STR_COLUMNS))


@query(
    "column_info",
    _TYPE_CTES + """ SELECT column_name, detected_type, unique_count, null_count,
  CAST(detected_type IN ('integer', 'float') AS INTEGER) AS has_range,
  CAST(detected_type IN ('date', 'datetime') AS INTEGER) AS has_format FROM types""".replace(
        "('integer', 'float')", "('integer', 'float', 'currency') AND column_name <> 'price'"
    ),
)
def column_info(spark, sf_dir):
    info = semantic.column_info(V.strs(spark, sf_dir), STR_COLUMNS)
    return info.select(
        "column_name", "detected_type", "unique_count", "null_count",
        F.col("range_info").isNotNull().cast("int").alias("has_range"),
        F.col("format_info").isNotNull().cast("int").alias("has_format"),
    )


@query(
    "suggest_schema",
    _TYPE_CTES + " SELECT column_name, CASE WHEN confidence > 0.7 THEN detected_type ELSE 'string' END"
    " AS suggested_type FROM types",
)
def suggest_schema(spark, sf_dir):
    return semantic.suggest_schema(semantic.column_types(V.strs(spark, sf_dir), STR_COLUMNS))


EXPECTED = {
    "email": "email", "date_iso": "date", "date_mixed": "date", "stamp": "datetime",
    "price": "float", "flag": "boolean", "link": "url", "whole": "integer",
    "fraction": "integer", "status": "string", "note": "categorical", "absent": "string",
}
_OK_DATE = " OR ".join(_date_ok("v", f, s) for f, s in _DATE_SQL[:3])
_IS_NUM = f"regexp_matches({_PLAIN}, '{_NUMBER}')"
_VIOLATIONS = f"""reasons AS (SELECT o_orderkey, column_name, v AS value, CASE
    WHEN v IS NULL THEN NULL
    WHEN column_name = 'email' AND NOT regexp_matches(v, '{_EMAIL_SQL}') THEN 'Not an email'
    WHEN column_name IN ('date_iso', 'date_mixed') AND NOT ({_OK_DATE}) THEN 'Not a date'
    WHEN column_name IN ('price', 'whole', 'fraction') AND NOT {_IS_NUM} THEN 'Not a number'
    WHEN column_name IN ('whole', 'fraction')
      AND TRY_CAST({_PLAIN} AS DOUBLE) <> floor(TRY_CAST({_PLAIN} AS DOUBLE)) THEN 'Not an integer'
    END AS reason FROM cells)"""
_COMPAT = {
    "integer": "('integer', 'float')", "float": "('float', 'integer')",
    "string": "('string', 'categorical', 'email', 'phone', 'url')", "boolean": "('boolean')",
    "date": "('date', 'datetime')", "datetime": "('datetime', 'date')", "email": "('email')",
    "phone": "('phone')", "url": "('url')", "categorical": "('categorical', 'string')",
}
_DECLARED = "declared(c, expected_type) AS (VALUES " + ", ".join(
    f"('{c}', '{t}')" for c, t in EXPECTED.items() if c != "absent"
) + ")"
_VALIDATION = f"""validation AS (
  SELECT column_name, expected_type, detected_type, confidence, type_ok,
    CAST(violations = 0 AS INTEGER) AS cells_ok, violations,
    coalesce(CAST(violations = 0 AS INTEGER), type_ok) AS valid
  FROM (SELECT t.column_name, expected_type, detected_type, confidence,
    CAST(CASE {' '.join(f"WHEN expected_type = '{e}' THEN detected_type IN {l}" for e, l in _COMPAT.items())}
      ELSE false END AS INTEGER) AS type_ok,
    CASE WHEN expected_type IN ('email', 'date', 'integer', 'float')
      THEN (SELECT CAST(count(reason) AS BIGINT) FROM reasons r WHERE r.column_name = t.column_name)
      END AS violations
    FROM types t JOIN declared ON t.column_name = c))"""
_SCHEMA_CTES = ", ".join((_TYPE_CTES, _VIOLATIONS, _DECLARED, _VALIDATION))


@query("validate_schema", _SCHEMA_CTES + " SELECT * FROM validation")
def validate_schema(spark, sf_dir):
    return semantic.validate_schema(V.strs(spark, sf_dir).select("o_orderkey", *STR_COLUMNS), EXPECTED)


@query(
    "schema_verdict",
    _SCHEMA_CTES + f""" SELECT CAST(1 AS BIGINT) AS missing_columns,
  CAST({len(STR_COLUMNS) + 1 - len(EXPECTED) + 1} AS BIGINT) AS extra_columns,
  CAST(count(*) FILTER (WHERE valid = 0) AS BIGINT) AS invalid_columns,
  CAST(0 AS INTEGER) AS overall_valid FROM validation""",
)
def schema_verdict(spark, sf_dir):
    df = V.strs(spark, sf_dir).select("o_orderkey", *STR_COLUMNS)
    return semantic.schema_verdict(df, EXPECTED, semantic.validate_schema(df, EXPECTED))


@query(
    "cell_violations",
    "WITH " + ", ".join((STRS, _CELLS, _VIOLATIONS))
    + " SELECT * FROM reasons WHERE reason IS NOT NULL",
)
def cell_violations(spark, sf_dir):
    return semantic.cell_violations(V.strs(spark, sf_dir), EXPECTED, ["o_orderkey"])


# ---------------------------------------------------------------- repair

def _filled_sql():
    columns = []
    for c in DIRTY_COLUMNS:
        if c in ("l_quantity", "l_discount"):
            columns.append(f"coalesce({c}, (SELECT avg({c}) FROM dirty)) AS {c}")
        elif c == "l_returnflag":
            columns.append(
                f"coalesce({c}, (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}"
                f" ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
            )
        else:
            columns.append(c)
    return "filled AS MATERIALIZED (SELECT " + ", ".join(columns) + " FROM dirty)"


_CLIPPED = ["l_extendedprice"]


def _clip_sql():
    quartiles = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in _CLIPPED
    )
    columns = [
        f"least(greatest({c}, {c}_q1 - 1.5e0 * ({c}_q3 - {c}_q1)),"
        f" {c}_q3 + 1.5e0 * ({c}_q3 - {c}_q1)) AS {c}"
        if c in _CLIPPED
        else c
        for c in DIRTY_COLUMNS
    ]
    return (
        f"q AS (SELECT {quartiles} FROM filled), repaired AS MATERIALIZED (SELECT "
        + ", ".join(columns) + " FROM filled, q)"
    )


_REPAIR_CTES = "WITH " + DIRTY.replace("dirty AS (", "dirty AS MATERIALIZED (") + ", " + _filled_sql() + ", " + _clip_sql()
_ROUND_REPAIRED = ", ".join(
    f"{r6(c)} AS {c}" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else c
    for c in DIRTY_COLUMNS
)


@query("fill_missing", _REPAIR_CTES + f" SELECT {_ROUND_REPAIRED} FROM filled")
def fill_missing(spark, sf_dir):
    return V.rounded(repair.fill_missing(V.dirty(spark, sf_dir)))


@query("repair_table", _REPAIR_CTES + f" SELECT {_ROUND_REPAIRED} FROM repaired")
def repair_table(spark, sf_dir):
    return V.rounded(repair.repair(V.dirty(spark, sf_dir)).table)


def _facts_sql(source):
    parts = []
    for c in DIRTY_COLUMNS:
        if c in DIRTY_NUMBERS:
            q = (
                f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,"
                f" quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"
            )
            parts.append(
                f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing,"
                f" CAST(count(*) FILTER (WHERE {c} < {_LOW} OR {c} > {_HIGH}) AS BIGINT) AS outliers"
                f" FROM {source}, {q}"
            )
        else:
            parts.append(
                f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing,"
                f" CAST(0 AS BIGINT) AS outliers FROM {source}"
            )
    return union_all(parts)


@query(
    "repair_comparison",
    _REPAIR_CTES + f", b AS ({_facts_sql('dirty')}), a AS ({_facts_sql('repaired')})"
    " SELECT b.column_name, b.missing AS missing_before, b.outliers AS outliers_before,"
    " a.missing AS missing_after, a.outliers AS outliers_after"
    " FROM b JOIN a ON b.column_name = a.column_name",
)
def repair_comparison(spark, sf_dir):
    dirty = V.dirty(spark, sf_dir)
    return repair.comparison(dirty, repair.repair(dirty).table)
