"""The registered queries, and a sample of them against DuckDB at the smallest scale."""

import math
import os

import pytest

import __spark_entry__ as entry_point
from vetframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
#: Queries that train a model or draw at random: checked elsewhere.
WITHOUT_SQL = {
    "baseline_classifier", "baseline_regressor", "fairness_baseline",
    "cross_val_predict", "robustness", "robustness_regression",
    "robustness_curve", "permutation_importance", "falsification", "validate_model",
    "background_sample", "shapley_values", "shapley_interactions",
}
SAMPLE = (
    "missing_values", "iqr_outliers", "distributions", "correlations", "column_types",
    "repair_table", "diversity", "inclusion_gaps", "fairness_criteria", "fairness_tradeoffs",
    "ranking_metrics_fine", "calibration_error", "compare_models", "retrieve", "statements", "paragraph_chunks",
    "batch_verdicts", "evaluate_verdicts",
)

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL
    assert set(registry.QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@needs_data
def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 3


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SF)
    relation = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)

    def ordered(rows, columns):
        at = [columns.index(c) for c in sorted(columns)]
        return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)

    assert ordered(df.collect(), df.columns) == ordered(relation.fetchall(), names)
