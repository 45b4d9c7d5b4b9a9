"""Profile, preparation, semantic types and repair on small frames with planted defects."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetframe.functions import parsing
from vetframe.operators import prep, profile, repair, semantic

NAN = float("nan")


def _rows(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def _demo(spark, missing=None):
    ages = [30.0, 32.0, missing, 35.0, 36.0, 150.0, 31.0, missing]
    emails = ["a@b.com", "bad", None, "c@d.org", "e@f.net", "x@y", "g@h.io", ""]
    rows = [(i, ages[i], emails[i], "2023-01-%02d" % (i + 1) if i % 2 else "13/45/2023") for i in range(8)]
    return spark.createDataFrame(rows, "id long, age double, email string, join_date string")


def test_nan_counts_as_missing(spark):
    for value in (None, NAN):
        df = _demo(spark, value)
        found = _rows(profile.missing_values(df))
        assert found["age"]["missing_count"] == 2 and found["age"]["missing_percent"] == 25.0
        moments = _rows(profile.distributions(df))["age"]
        assert abs(moments["mean"] - 314 / 6) < 1e-9 and moments["max_value"] == 150.0
        assert _rows(profile.iqr_outliers(df))["age"]["outlier_count"] == 1


def test_empty_frame_is_guarded(spark):
    df = _demo(spark).limit(0)
    assert _rows(profile.missing_values(df))["age"]["missing_percent"] == 0.0
    assert _rows(profile.iqr_outliers(df))["age"]["outlier_count"] == 0
    assert _rows(profile.zscore_outliers(df))["age"]["outlier_count"] == 0
    assert profile.duplicate_rows(df).first().duplicate_rows == 0
    assert profile.histogram(df).count() == 0


def test_moments_of_short_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "short double, same double")
    assert _rows(profile.distributions(df, True))["short"]["skewness"] is None
    df = spark.createDataFrame([(float(i), 5.0) for i in range(5)], "x double, same double")
    got = _rows(profile.distributions(df, True))
    assert got["same"]["skewness"] == 0.0 and got["same"]["kurtosis"] == 0.0
    assert abs(got["x"]["skewness"]) < 1e-12 and abs(got["x"]["kurtosis"] + 1.2) < 1e-9


def test_formats_ranges_and_name_matching(spark):
    df = _demo(spark)
    got = _rows(profile.format_issues(df))
    assert got["email"]["invalid_count"] == 3 and got["join_date"]["invalid_count"] == 4
    assert {r.value for r in profile.format_entries(df, ["id"]).collect()} == {"bad", "x@y", "", "13/45/2023"}
    pages = spark.createDataFrame([(200.0, 151.0)], "page_count double, age double")
    assert set(_rows(profile.range_issues(pages))) == {"page_count", "age"}
    assert set(_rows(profile.range_issues(pages, match="token"))) == {"age"}
    assert [r.column_name for r in profile.range_entries(pages, [], match="token").collect()] == ["age"]


def test_two_digit_years_are_no_dates(spark):
    df = spark.createDataFrame([("2023-1-5",), ("23-01-15",), ("2023-02-30",), ("2024-02-29",)], "d string")
    assert [r[0] for r in df.select(parsing.is_iso_date(F.col("d"))).collect()] == [True, False, False, True]


def test_duplicates_by_value_and_by_digest(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1), ("b", 1), (None, None)], "t string, n int")
    for by_digest in (False, True):
        assert profile.duplicate_rows(df, by_digest=by_digest).first().asDict() == {
            "total_rows": 5, "duplicate_rows": 1,
        }


def test_digests_of_nested_values(spark):
    """Values that differ in one nested place only, and values that are equal in another form."""
    differ = [
        "array(timestamp_micros(1))", "array(timestamp_micros(2))", "array(timestamp_micros(1), null)", "array()",
        "null",
    ]
    texts = ["array('a', 'b')", "array('a,b')", "array('a1:b')", "array('a', null)", "array('ab')", "array('', 'ab')"]
    maps = ["map('a', 1, 'b', 2)", "map('a', 2, 'b', 1)", "map('a', 1)", "map()", "map('a', null)"]
    structs = ["named_struct('x', 1, 'y', null)", "named_struct('x', null, 'y', 1)", "null",
               "named_struct('x', null, 'y', null)"]
    for kind, values in (("array<timestamp>", differ), ("array<string>", texts), ("map<string, int>", maps),
                         ("struct<x: int, y: int>", structs)):
        rows = " UNION ALL ".join(f"SELECT CAST({v} AS {kind}) AS v" for v in values)
        assert profile.duplicate_rows(spark.sql(rows)).first().duplicate_rows == 0
    equal = [("array(0.0D)", "array(-0.0D)"), ("map('a', 1, 'b', 2)", "map('b', 2, 'a', 1)"),
             ("named_struct('x', array(map(1, -0.0D)))", "named_struct('x', array(map(1, 0.0D)))")]
    for a, b in equal:
        assert profile.duplicate_rows(spark.sql(f"SELECT {a} AS v UNION ALL SELECT {b}")).first().duplicate_rows == 1


def test_correlations_are_pairwise_complete(spark):
    """Missing values, constants on the common rows, and large numbers with a small spread."""
    rng = random.Random(8)
    rows = []
    for i in range(500):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((
            None if i % 7 == 0 else a, a + b if i % 5 else float("nan"), 1e9 + a / 1000, 3.25,
            4.0 if i % 7 else float(i), i if i % 11 else None, None,
        ))
    df = spark.createDataFrame(rows, "a double, b double, far double, c double, d double, i long, e double")
    got = {(r.column_a, r.column_b): r.correlation for r in profile.correlations(df.repartition(5)).collect()}
    table = pd.DataFrame(rows, columns=df.columns).astype(float)
    want = table.assign(far=table["far"] - 1e9).corr()
    assert len(got) == 21
    for (x, y), value in got.items():
        both = table[[x, y]].dropna()
        if both.empty or both[x].nunique() < 2 or both[y].nunique() < 2:
            assert value is None
        else:
            assert value == pytest.approx(want.loc[x, y], abs=1e-9)


def test_findings_and_score(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "x", 1), (1.0, "x", 1)], "a double, c string, y int")
    found = profile.integrity_findings(df, "y")
    assert {(r.severity, r.code, r.column_name) for r in found.collect()} == {
        ("warning", "missing", "a"), ("warning", "duplicates", None),
        ("info", "constant", "c"), ("info", "constant", "y"), ("error", "label", "y"),
    }
    assert profile.integrity_score(found).first().score == 40.0


def test_validate_runs_only_named_checks(spark):
    got = {r.check for r in profile.validate(_demo(spark), ["formats"]).collect()}
    assert got == {"summary", "formats"}


def test_wide_tables_are_profiled_in_batches(spark):
    df = spark.range(10).select(*[(F.col("id") + i).cast("double").alias(f"c{i}") for i in range(120)])
    assert profile.missing_values(df).count() == 120
    assert profile.validate(df).filter("check = 'missing_values'").count() == 240


def test_tasks_and_codes(spark):
    df = spark.createDataFrame([("b", 1.5, 0), ("a", 2.0, 1), (None, 3.0, 1)], "t string, x double, y int")
    assert prep.infer_task(df, "x").first().task == "regression"
    assert prep.task_type(df, "y").first().task == "binary"
    assert prep.task_type(df, "t").first().task == "multiclass"
    assert {(r.t, r.code) for r in prep.label_codes(df, "t").collect()} == {("a", 0), ("b", 1), (None, -1)}
    assert prep.drop_id_like(df.withColumn("Paid", F.lit(1))).columns == ["t", "x", "y"]
    dirty = df.withColumn("empty", F.lit(NAN))
    assert prep.drop_empty(dirty, "t").columns == ["t", "x", "y"]


def _types(spark, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return semantic.column_types(df).first()


def test_type_cascade(spark):
    assert _types(spark, ["yes", "No", "TRUE", "0"]).detected_type == "boolean"
    assert _types(spark, ["12%", "3.5%"]).detected_type == "percentage"
    assert _types(spark, ["$1,234.50", "99"]).detected_type == "currency"
    assert _types(spark, [12.0, 140.0, 999.0], "double").detected_type == "integer"
    assert _types(spark, [12, 140, 999], "long").detected_type == "currency"
    assert _types(spark, [0, 1, 1], "long").detected_type == "boolean"
    assert _types(spark, ["1d", "2f", "x", "y"]).detected_type == "string"
    assert _types(spark, ["2023-01-01 10:00:00"]).detected_type == "datetime"
    assert _types(spark, ["01/02/2023", "2023/1/9"]).detected_type == "date"
    assert _types(spark, ["a@b.co", "c@d.org"]).detected_type == "email"
    assert _types(spark, ["http://a.b/c?d=1#e"]).detected_type == "url"
    assert _types(spark, ["+15550001111"]).detected_type == "integer"
    assert _types(spark, ["red", "blue"] * 30).detected_type == "categorical"
    assert _types(spark, [None]).asDict() == {
        "column_name": "c", "detected_type": "unknown", "confidence": 0.0, "null_count": 1,
        "unique_count": 0,
    }


def test_large_doubles_keep_their_digits(spark):
    df = spark.createDataFrame([(12345678.5,), (1.0e7,), (0.0005,), (1.5,)], "x double")
    text = df.select(parsing.as_text(F.col("x"), df.schema["x"].dataType))
    assert [r[0] for r in text.collect()] == ["12345678.5", "10000000.0", "0.0005", "1.5"]


def test_schema_verdict_lets_clean_cells_cancel_a_mismatch(spark):
    df = spark.createDataFrame([("1",), ("0",)], "flag string")
    row = semantic.validate_schema(df, {"flag": "integer"}).first()
    assert (row.detected_type, row.type_ok, row.cells_ok, row.valid) == ("boolean", 0, 1, 1)
    assert semantic.schema_differences(df, {"x": "date"}).count() == 2
    verdict = semantic.schema_verdict(df, {"flag": "integer"}, semantic.validate_schema(df, {"flag": "integer"}))
    assert verdict.first().overall_valid == 1


def test_sampled_types_are_repeatable(spark):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("c"))
    a = semantic.column_types(df, ["c"], sample_size=50, key=["id"]).first()
    b = semantic.column_types(df.repartition(9), ["c"], sample_size=50, key=["id"]).first()
    assert a == b and a.unique_count == 50


def test_repair_fills_and_clips(spark):
    rows = [(float(i), "a" if i % 3 else "b", None, i) for i in range(20)] + [(None, None, None, 7), (900.0, "b", None, 8)]
    df = spark.createDataFrame(rows, "x double, t string, e string, k int")
    fixed = repair.repair(df)
    assert fixed.fills["t"] == "a" and fixed.fills["e"] == "Unknown"
    assert math.isclose(fixed.fills["x"], (190 + 900) / 21)
    got = _rows(repair.comparison(df, fixed.table))
    assert got["x"] == {"column_name": "x", "missing_before": 1, "outliers_before": 1, "missing_after": 0, "outliers_after": 0}
    assert all(r["missing_after"] == 0 for r in got.values())


def test_most_common_value_prefers_the_smallest_of_a_tie(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, None)], "k int, t string")
    assert repair.most_common_values(df, ["k", "t"]) == {"k": 9, "t": "a"}
