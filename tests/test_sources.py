"""Reading and writing files."""

import json

import pytest
from pyspark.sql import functions as F

from vetframe.operators import fairness
from vetframe.sources import readers, writers


def test_formats_and_unknown_endings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,\n")
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "a"}, {"x": 2, "y": null}]')
    for name in ("a.csv", "a.json"):
        df = readers.read_table(spark, str(tmp_path / name))
        assert df.count() == 2 and df.filter("y is null").count() == 1
    assert readers.read_table(spark, str(tmp_path / "a.csv"), "x long, y string").schema["x"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.xlsx")


def test_folder_profile_matches_single_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("v\n" + "\n".join(str(i) for i in [1, 2, 3, 4, 100]) + "\n")
    (tmp_path / "two.csv").write_text("v\n" + "\n".join(str(i) for i in range(10)) + "\n\n")
    (tmp_path / "skip.txt").write_text("no")
    df = readers.read_folder(spark, str(tmp_path), "*.csv", "v double")
    got = {(r.file, r.column_name, r.metric): r.value for r in readers.profile_by(df).collect()}
    assert got[("one.csv", "v", "outlier_count")] == 1 and got[("two.csv", "v", "outlier_count")] == 0
    assert got[("one.csv", "v", "mean")] == 22.0 and got[("two.csv", None, "total_rows")] == 10


def test_columns_go_by_their_names(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two.csv").write_text("b,a\n3,30\n")
    (tmp_path / "three.csv").write_text("b,z\n5,x\n")
    (tmp_path / "none.csv").write_text("\n \n")
    got = {r.file: r for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert (got["two.csv"].a, got["two.csv"].b) == (30, 3)
    assert (got["three.csv"].a, got["three.csv"].b, got["three.csv"].z) == (None, 5, "x")
    found = readers.open_folder(spark, str(tmp_path))
    assert {(r.file, r.status) for r in found.status.collect()} == {
        ("one.csv", "read"), ("two.csv", "read"), ("three.csv", "read"), ("none.csv", "failed"),
    }
    profile = {(r.file, r.column_name, r.metric): r.value for r in found.profile().collect()}
    assert profile["two.csv", "a", "mean"] == 30 and ("three.csv", "a", "mean") not in profile


def test_corrupt_files_are_skipped(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "good"))
    good = next((tmp_path / "good").glob("*.parquet"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").write_bytes(good.read_bytes())
    (tmp_path / "in" / "b.parquet").write_bytes(b"not parquet at all")
    df = readers.read_folder(spark, str(tmp_path / "in"), "*.parquet", "id long")
    assert df.agg(F.sum("id")).first()[0] == 3
    status = readers.open_folder(spark, str(tmp_path / "in"), "*.parquet").status.collect()
    assert {(r.file, r.status) for r in status} == {("a.parquet", "read"), ("b.parquet", "failed")}
    assert all((r.reason is None) == (r.status == "read") for r in status)


def test_empty_files_are_recorded(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "_d.csv").write_text("x\n1\n")
    status = {r.file: (r.status, r.reason) for r in readers.open_folder(spark, str(tmp_path)).status.collect()}
    assert status == {"a b.csv": ("read", None), "c.csv": ("failed", "the file has no header")}
    assert readers.open_folder(spark, str(tmp_path), "c.csv").together() is None
    (tmp_path / "e.json").write_text("")
    only = readers.open_folder(spark, str(tmp_path), "*.json")
    assert [tuple(r) for r in only.status.collect()] == [("e.json", "failed", "the file is empty")]


def test_chapters(spark, tmp_path):
    (tmp_path / "Chapter_03_Early days.md").write_text("a\n\nb")
    row = readers.read_chapters(spark, str(tmp_path)).first()
    assert (row.title, row.text) == ("Chapter 03 Early days", "a\n\nb")


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), ["x", "y"])], "k string, v double, c array<string>").coalesce(1)
    writers.write_tables({"t": df}, str(tmp_path / "json"), "json")
    assert json.loads(next((tmp_path / "json" / "t").glob("*.json")).read_text()) == {"k": "a", "c": ["x", "y"]}
    writers.write_table(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first().c == '["x","y"]'
    assert json.loads(writers.as_documents(df, ["k"]).first().document) == {"v": None, "c": ["x", "y"]}
    preds = spark.createDataFrame([("m", 1, 1), ("f", 1, 0)], "g string, y_true int, y_pred int")
    writers.write_fairness(fairness.fairness_report(preds, ["g"]), str(tmp_path / "fair"))
    assert (tmp_path / "fair" / "criteria" / "attribute=g").is_dir()
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path / "x"), "xlsx")
