"""Queries whose result follows from a property of the operator, whatever a model has learnt.

Models can't be said in SQL; what must hold of them can: a linear scorer has known attributions,
noise of size zero flips nothing, a constant column has no importance, every row is predicted once.
Written tables and saved indexes must come back as they were.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import ensure_checkpoint_dir
from ..operators import attribution, evaluation, fairness, modeling, retrieval, splits
from ..sources import readers, writers
from . import group_queries, model_queries, text_queries, views as V
from .model_queries import FEATURES, WEIGHTS
from .views import LINE_KEY

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _new_folder(spark) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- attribution


def _scorer(value):
    """A scorer for feature arrays from a column expression."""

    def score(df: DataFrame, column: str) -> DataFrame:
        return df.select(*df.columns, value(F.col(column)).alias("_value"))

    return score


def _linear(x: Column) -> Column:
    return sum((F.get(x, F.lit(i)) * F.lit(w) for i, w in enumerate(WEIGHTS.values())), F.lit(0.0))


@query("shapley_linear", model_queries.ORACLES["linear_attributions"])
def shapley_linear(spark, sf_dir):
    """Against the mean row, a linear scorer has the attributions weight x (value - mean)."""
    preds = V.preds(spark, sf_dir)
    means = preds.agg(*[F.avg(f).alias(f) for f in FEATURES])
    phi = attribution.shapley_values(preds, LINE_KEY, list(WEIGHTS), means, _scorer(_linear))
    return phi.select(*LINE_KEY, "feature", (F.round("phi", 6) + 0.0).alias("phi"))


@query(
    "interactions_of_products",
    "WITH " + V.PREDS + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES)
    + " FROM preds), v AS (SELECT (l_quantity - m_l_quantity) * (l_discount - m_l_discount) AS x"
    " FROM preds, m) SELECT 'l_quantity' AS feature_a, 'l_discount' AS feature_b,"
    " round(avg(abs(x)), 6) AS mean_abs_interaction, round(avg(x), 6) AS mean_interaction FROM v"
    + "".join(
        f" UNION ALL SELECT '{a}', '{b}', 0, 0" for a, b in combinations(FEATURES, 2)
        if (a, b) != ("l_quantity", "l_discount")
    ),
)
def interactions_of_products(spark, sf_dir):
    """The first two features interact as their product does; the third only adds."""
    preds = V.preds(spark, sf_dir)
    means = preds.agg(*[F.avg(f).alias(f) for f in FEATURES])

    def value(x):
        return F.get(x, F.lit(0)) * F.get(x, F.lit(1)) + 3 * F.get(x, F.lit(2))

    found = attribution.shapley_interactions(
        preds, LINE_KEY, FEATURES, list(combinations(FEATURES, 2)), means, _scorer(value)
    )
    return found.select(
        "feature_a", "feature_b",
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_abs_interaction", "mean_interaction")],
    )


@query(
    "background_rows",
    "SELECT CAST(least(100, count(*)) AS BIGINT) AS n_rows, CAST(least(100, count(*)) AS BIGINT)"
    " AS known_rows FROM lineitem",
)
def background_rows(spark, sf_dir):
    """A background has 100 different rows, all of them from the table."""
    preds = V.preds(spark, sf_dir)
    picked = attribution.background_sample(preds, LINE_KEY).select(*LINE_KEY, F.lit(1).alias("_in"))
    known = preds.join(picked, LINE_KEY, "left_semi").select(*LINE_KEY).distinct()
    return picked.agg(F.count("*").alias("n_rows")).withColumn(
        "known_rows", known.agg(F.count("*")).scalar()
    )


# ---------------------------------------------------------------- models


def _separable(spark, sf_dir) -> DataFrame:
    lines = V.table(spark, sf_dir, "lineitem")
    half = (F.col("l_quantity") > 25).cast("int")
    return lines.select(
        *LINE_KEY, "l_quantity", F.lit(1.0).alias("constant"), half.alias("y"),
        F.when(half == 1, "high").otherwise("low").alias("level"),
    )


@query("separable_classes", "SELECT 1 AS right_side FROM lineitem LIMIT 1")
def separable_classes(spark, sf_dir):
    """A classifier on a feature that separates the classes."""
    rows = modeling.class_weights(_separable(spark, sf_dir), "y")
    model = modeling.baseline_classifier(["l_quantity"], "y", rows.count()).fit(rows)
    rates = evaluation.binary_metrics(modeling.predict(model, rows), "y", "y_pred")
    return rates.select((F.col("accuracy") > 0.99).cast("int").alias("right_side"))


@query("separable_categories", "SELECT 1 AS right_order FROM lineitem LIMIT 1")
def separable_categories(spark, sf_dir):
    """A one-hot encoded column that gives the class away ranks every row rightly."""
    rows = _separable(spark, sf_dir).select("y", "level", "constant")
    model = modeling.fairness_baseline(rows, "y", rows.count()).fit(rows)
    ranked = evaluation.ranking_metrics(modeling.predict(model, rows), "y", "score")
    return ranked.select((F.col("roc_auc") > 0.999).cast("int").alias("right_order"))


@query("regressor_follows_the_data", "SELECT 1 AS close FROM part LIMIT 1")
def regressor_follows_the_data(spark, sf_dir):
    """Trees grown to single rows follow a function of two columns closely."""
    part = V.table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", (F.col("p_size") * 3 + F.col("p_partkey") % 7).cast("double").alias("y")
    )
    estimator = modeling.baseline_regressor(["p_partkey", "p_size"], "y", trees=20)
    fit = evaluation.regression_metrics(modeling.predict(estimator.fit(part), part), "y", "y_pred")
    return fit.select((F.col("r2") > 0.95).cast("int").alias("close"))


@query(
    "one_prediction_each",
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS keys FROM lineitem",
)
def one_prediction_each(spark, sf_dir):
    """Out-of-fold predictions hold every row once."""
    rows = modeling.class_weights(_separable(spark, sf_dir), "y")
    folded = splits.assign_folds(rows, LINE_KEY, stratify="y")
    estimator = modeling.baseline_classifier(["l_quantity"], "y", folded.count())
    predicted = modeling.cross_val_predict(folded, estimator, splits.FOLDS)
    return predicted.agg(
        F.count("y_pred").alias("n_rows"), F.count_distinct(*LINE_KEY).alias("keys")
    )


@query("no_noise_no_flips", "SELECT 0e0 AS sigma, 0e0 AS flip_rate FROM lineitem LIMIT 1")
def no_noise_no_flips(spark, sf_dir):
    rows = modeling.class_weights(_separable(spark, sf_dir), "y")
    model = modeling.baseline_classifier(["l_quantity"], "y", rows.count()).fit(rows)
    return modeling.noise_flips(model, rows, LINE_KEY, ["l_quantity"], (0.0,), modeling.TRIALS)


@query(
    "importance_of_a_constant",
    "SELECT 'constant' AS feature, 0e0 AS importance_mean, 0e0 AS importance_std, 1 AS other_matters"
    " FROM lineitem LIMIT 1",
)
def importance_of_a_constant(spark, sf_dir):
    """A constant column has no importance at all, the separating one nearly half the accuracy."""
    rows = modeling.class_weights(_separable(spark, sf_dir), "y")
    features = ["l_quantity", "constant"]
    model = modeling.baseline_classifier(features, "y", rows.count()).fit(rows)
    found = modeling.permutation_importance(model, rows, LINE_KEY, features, "y").cache()
    other = found.filter("feature = 'l_quantity'").agg(F.max("importance_mean")).scalar()
    return found.filter("feature = 'constant'").select(
        "feature", "importance_mean", "importance_std", (other > 0.4).cast("int").alias("other_matters")
    )


# ---------------------------------------------------------------- written and read again

_ORDERS = "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus FROM orders"


def _written(kind):
    def run(spark, sf_dir):
        folder = _new_folder(spark)
        orders = V.table(spark, sf_dir, "orders").select(
            "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderstatus"
        )
        writers.write_table(orders, f"{folder}/orders.{kind}", kind)
        schema = "o_orderkey long, o_totalprice double, o_orderstatus string"
        if kind == "json":  # one object a line
            return spark.read.schema(schema).json(f"{folder}/orders.json")
        return readers.read_table(spark, f"{folder}/orders.{kind}", schema)

    return run


for _kind in writers.FORMATS:
    query(f"written_{_kind}", _ORDERS)(_written(_kind))


@query(
    "written_documents",
    "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer",
)
def written_documents(spark, sf_dir):
    """Each row as one JSON document, parsed again."""
    customers = V.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal")
    )
    parsed = F.from_json("document", "c_name string, c_acctbal double").alias("d")
    return writers.as_documents(customers, ["c_custkey"]).select("c_custkey", parsed).select(
        "c_custkey", "d.c_name", "d.c_acctbal"
    )


@query("written_fairness", group_queries.ORACLES["fairness_criteria"])
def written_fairness(spark, sf_dir):
    """Fairness tables by attribute, read back."""
    folder = _new_folder(spark)
    counts = group_queries._line_counts(spark, sf_dir)
    criteria = V.rounded(fairness.fairness_criteria(counts))
    writers.write_fairness({"criteria": criteria}, folder, "parquet")
    return spark.read.schema(criteria.schema).parquet(f"{folder}/criteria").select(*criteria.columns)


@query("saved_index", text_queries.ORACLES["index_postings"])
def saved_index(spark, sf_dir):
    folder = _new_folder(spark)
    text_queries._index(spark, sf_dir).save(folder)
    return V.rounded(retrieval.Index.load(spark, folder).postings)
