"""Queries on models: splits, evaluation, robustness, attribution and the overall score."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import attribution, evaluation, modeling, scoring, splits
from . import views as V
from .views import LINE_KEY, PREDS, r6, union_all

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


FEATURES = ["l_quantity", "l_discount", "l_tax"]
WEIGHTS = {"l_quantity": 0.0317313, "l_discount": -4.5171391, "l_tax": 2.2519373}
SECOND_WEIGHTS = {"l_quantity": -0.0113171, "l_tax": 6.0131733}
_WITH = "WITH " + PREDS

# ---------------------------------------------------------------- evaluation


@query(
    "confusion_matrix",
    _WITH + " SELECT y_true, y_pred, CAST(count(*) AS BIGINT) AS n FROM preds GROUP BY 1, 2",
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(V.preds(spark, sf_dir))


_BINARY = """b AS (SELECT avg(CAST(y_true = y_pred AS INTEGER)) AS accuracy,
    sum(y_true * y_pred) / CAST(nullif(sum(y_pred), 0) AS DOUBLE) AS precision,
    sum(y_true * y_pred) / CAST(nullif(sum(y_true), 0) AS DOUBLE) AS recall,
    2e0 * sum(y_true * y_pred) / nullif(sum(y_true) + sum(y_pred), 0) AS f1 FROM preds)"""
_RANKED = """s AS (SELECT score, CAST(sum(y_true) AS DOUBLE) AS pos,
    CAST(count(*) - sum(y_true) AS DOUBLE) AS neg FROM preds GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""
_RANKING = """k AS (SELECT sum(neg * (tp - pos / 2)) / any_value(p * n) AS roc_auc,
    sum(pos * tp / (tp + fp)) / any_value(p) AS average_precision FROM c)"""


@query(
    "binary_metrics",
    f"{_WITH}, {_BINARY} SELECT {r6('accuracy')} AS accuracy, {r6('precision')} AS precision,"
    f" {r6('recall')} AS recall, {r6('f1')} AS f1 FROM b",
)
def binary_metrics(spark, sf_dir):
    return V.rounded(evaluation.binary_metrics(V.preds(spark, sf_dir)))


@query(
    "ranking_metrics",
    f"{_WITH}, {_RANKED}, {_RANKING} SELECT {r6('roc_auc')} AS roc_auc,"
    f" {r6('average_precision')} AS average_precision FROM k",
)
def ranking_metrics(spark, sf_dir):
    return V.rounded(evaluation.ranking_metrics(V.preds(spark, sf_dir)))


@query(
    "ranking_metrics_fine",
    _WITH.replace("l_quantity / 50e0 AS score", "l_extendedprice AS score")
    + f", {_RANKED}, {_RANKING} SELECT {r6('roc_auc')} AS roc_auc,"
    f" {r6('average_precision')} AS average_precision FROM k",
)
def ranking_metrics_fine(spark, sf_dir):
    fine = V.preds(spark, sf_dir).withColumn("score", F.col("l_extendedprice"))
    return V.rounded(evaluation.ranking_metrics(fine))


@query(
    "roc_curve",
    f"{_WITH}, {_RANKED} SELECT {r6('score')} AS threshold, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr FROM c",
)
def roc_curve(spark, sf_dir):
    return V.rounded(evaluation.roc_curve(V.preds(spark, sf_dir)))


@query(
    "precision_recall_curve",
    f"{_WITH}, {_RANKED} SELECT {r6('score')} AS threshold, {r6('tp / (tp + fp)')} AS precision,"
    f" {r6('tp / p')} AS recall FROM c",
)
def precision_recall_curve(spark, sf_dir):
    return V.rounded(evaluation.precision_recall_curve(V.preds(spark, sf_dir)))


_REGRESSION = """g AS (SELECT sqrt(avg((y - p) * (y - p))) AS rmse,
    1 - avg((y - p) * (y - p)) / var_pop(y) AS r2
  FROM (SELECT l_extendedprice / 1e4 AS y, l_quantity / 5e0 + l_tax AS p FROM lineitem))"""


@query(
    "regression_metrics",
    f"WITH {_REGRESSION} SELECT {r6('rmse')} AS rmse, {r6('r2')} AS r2,"
    f" {r6('greatest(0, least(1, (r2 + 1) / 2))')} AS base_score FROM g",
)
def regression_metrics(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1e4).alias("y_true"),
        (F.col("l_quantity") / 5.0 + F.col("l_tax")).alias("y_pred"),
    )
    return V.rounded(evaluation.regression_metrics(rows))


_EDGES = "e AS (SELECT " + ", ".join(
    f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(11)
) + " FROM preds)"


@query(
    "calibration_curve",
    f"{_WITH}, {_EDGES}\n"
    + union_all(
        f"SELECT CAST({i} AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n,"
        f" {r6('avg(score)')} AS mean_score, {r6('avg(y_true)')} AS observed FROM preds, e"
        f" WHERE score >= e{i} AND score < e{i + 1} + 1e-12 HAVING count(*) > 0"
        for i in range(10)
    ),
)
def calibration_curve(spark, sf_dir):
    return V.rounded(evaluation.calibration_curve(V.preds(spark, sf_dir)))


_ECE = "x AS (SELECT avg(gap) AS ece, CAST(count(*) AS BIGINT) AS bins FROM (SELECT " + " + ".join(
    f"CAST(score > e{i} AS INTEGER)" for i in range(1, 10)
) + " AS bin, abs(avg(y_true) - avg(score)) AS gap FROM preds, e GROUP BY 1))"


@query(
    "calibration_error",
    f"{_WITH}, {_EDGES}, {_ECE} SELECT {r6('ece')} AS ece, bins,"
    f" {r6('greatest(0, 100 * (1 - least(5 * ece, 1)))')} AS score,"
    f" CASE WHEN ece > 0.05 THEN 'warning' ELSE 'info' END AS severity FROM x",
)
def calibration_error(spark, sf_dir):
    return V.rounded(evaluation.calibration_error(V.preds(spark, sf_dir)))


@query(
    "binary_performance",
    f"{_WITH}, {_BINARY}, {_RANKED}, {_RANKING}, t AS (SELECT *,"
    " 100 * (accuracy + f1 + precision + recall + roc_auc) / 5 AS score FROM b, k)"
    f" SELECT 'performance' AS agent, {r6('accuracy')} AS accuracy, {r6('f1')} AS f1,"
    f" {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('roc_auc')} AS auc,"
    f" {r6('score')} AS score, CASE WHEN score < 70 THEN 'error' WHEN score < 85 THEN 'warning'"
    " ELSE 'info' END AS severity FROM t",
)
def binary_performance(spark, sf_dir):
    return V.rounded(evaluation.binary_performance(V.preds(spark, sf_dir)))


@query(
    "model_accuracy",
    f"""{_WITH} SELECT model, round(avg(CAST(CAST(s > 0.5 AS INTEGER) = y_true AS INTEGER)), 6) AS accuracy
FROM (SELECT 'quantity' AS model, score AS s, y_true FROM preds
  UNION ALL SELECT 'discount', l_discount * 10, y_true FROM preds) GROUP BY 1""",
)
def model_accuracy(spark, sf_dir):
    rows = V.preds(spark, sf_dir).select(
        "y_true",
        F.inline(
            F.array(
                F.struct(F.lit("quantity").alias("model"), F.col("score").alias("s")),
                F.struct(F.lit("discount").alias("model"), (F.col("l_discount") * 10).alias("s")),
            )
        ),
    )
    return V.rounded(evaluation.model_accuracy(rows, score="s"))


# ---------------------------------------------------------------- splits


def _lines(spark, sf_dir):
    return V.preds(spark, sf_dir).select(*LINE_KEY, "y_true", *FEATURES, "l_returnflag", "a1")


@query(
    "train_test_split",
    """WITH c AS (SELECT l_returnflag, count(*) AS n, round(count(*) * 25e-2) AS t FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'test' AS split, CAST(t AS BIGINT) AS n FROM c
UNION ALL SELECT l_returnflag, 'train', CAST(n - t AS BIGINT) FROM c""",
)
def train_test_split(spark, sf_dir):
    split = splits.train_test_split(_lines(spark, sf_dir), LINE_KEY, stratify="l_returnflag")
    return split.groupBy("l_returnflag", "split").agg(F.count("*").alias("n"))


@query(
    "random_split",
    """WITH c AS (SELECT count(*) AS n, round(count(*) * 25e-2) AS t FROM lineitem)
SELECT 'test' AS split, CAST(t AS BIGINT) AS n FROM c
UNION ALL SELECT 'train', CAST(n - t AS BIGINT) FROM c""",
)
def random_split(spark, sf_dir):
    split = splits.train_test_split(_lines(spark, sf_dir), LINE_KEY)
    return split.groupBy("split").agg(F.count("*").alias("n"))


@query(
    "class_shares",
    f"""{_WITH}, c AS (SELECT l_returnflag AS label, CAST(count(*) AS BIGINT) AS n_all,
  CAST(count(*) FILTER (WHERE l_linenumber > 2) AS BIGINT) AS n_train,
  CAST(count(*) FILTER (WHERE l_linenumber <= 2) AS BIGINT) AS n_test FROM preds GROUP BY 1)
SELECT *, round(abs(CAST(n_all AS DOUBLE) / sum(n_all) OVER ()
  - CAST(n_test AS DOUBLE) / sum(n_test) OVER ()), 6) AS drift FROM c""",
)
def class_shares(spark, sf_dir):
    return V.rounded(splits.class_shares(_given_split(spark, sf_dir), "l_returnflag"))


def _given_split(spark, sf_dir):
    return V.preds(spark, sf_dir).withColumn(
        "split", F.when(F.col("l_linenumber") <= 2, "test").otherwise("train")
    )


@query(
    "sampling_score",
    f"""{_WITH}, c AS (SELECT l_returnflag, count(*) AS a, count(*) FILTER (WHERE l_linenumber <= 2) AS t
  FROM preds GROUP BY 1),
d AS (SELECT max(abs(a / s - t / u)) AS drift FROM c,
  (SELECT CAST(sum(a) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS u FROM c))
SELECT 'sampling' AS agent, round(drift, 6) AS test_class_ratio_drift,
  CASE WHEN drift > 0.1 THEN 'warning' ELSE 'ok' END AS severity,
  CASE WHEN drift > 0.1 THEN 85e0 ELSE 100e0 END AS score FROM d""",
)
def sampling_score(spark, sf_dir):
    shares = splits.class_shares(_given_split(spark, sf_dir), "l_returnflag")
    return V.rounded(splits.sampling_score(shares))


@query(
    "assign_folds",
    f"""{_WITH}, c AS (SELECT y_true, count(*) AS n FROM preds GROUP BY 1)
SELECT y_true, CAST(i AS INTEGER) AS fold,
  CAST(ceil(n * (i + 1) / 5e0) - ceil(n * i / 5e0) AS BIGINT) AS n FROM c, range(5) r(i)""",
)
def assign_folds(spark, sf_dir):
    folded = splits.assign_folds(_lines(spark, sf_dir), LINE_KEY, stratify="y_true")
    return folded.groupBy("y_true", "fold").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- models


def _fitted(spark, sf_dir):
    lines = modeling.class_weights(_lines(spark, sf_dir), "y_true")
    rows = lines.count()
    estimator = modeling.baseline_classifier(FEATURES, "y_true", rows)
    return lines, estimator, estimator.fit(lines)


@query("baseline_classifier")
def baseline_classifier(spark, sf_dir):
    lines, _, model = _fitted(spark, sf_dir)
    return V.rounded(evaluation.binary_metrics(modeling.predict(model, lines)))


@query("baseline_regressor")
def baseline_regressor(spark, sf_dir):
    part = modeling.spread(V.table(spark, sf_dir, "part"), ["p_partkey"])
    estimator = modeling.baseline_regressor(["p_partkey", "p_size"], "p_retailprice")
    predicted = modeling.predict(estimator.fit(part), part)
    return V.rounded(evaluation.regression_metrics(predicted, "p_retailprice"))


@query("fairness_baseline")
def fairness_baseline(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("y_true", "a1", *FEATURES)
    model = modeling.fairness_baseline(lines, "y_true", lines.count()).fit(lines)
    return V.rounded(evaluation.ranking_metrics(modeling.predict(model, lines)))


@query(
    "mixed_features",
    "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year,"
    " CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month, CAST(day(o_orderdate) AS DOUBLE)"
    " AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dow,"
    " CAST(hour(o_orderdate) AS DOUBLE) AS o_orderdate_hour, CAST(1 + 5 + 64 + (SELECT"
    " count(DISTINCT o_orderpriority) FROM orders) AS INTEGER) AS width, round((o_totalprice -"
    " (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6)"
    " AS scaled_price FROM orders",
)
def mixed_features(spark, sf_dir):
    from pyspark.ml import Pipeline

    orders = V.table(spark, sf_dir, "orders").withColumn(
        "open", (F.col("o_orderstatus") == "O").cast("int")
    ).drop("o_orderstatus")
    prepared, stages, inputs = modeling.mixed_features(
        orders.withColumn("clerk", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))),
        "open", exclude=["o_orderkey", "o_custkey"],
    )
    fitted = Pipeline(stages=[*stages, modeling.assembled(inputs)]).fit(prepared)
    vectors = fitted.transform(prepared)
    values = _array("features")
    return vectors.select(
        "o_orderkey", "o_totalprice", *modeling.date_part_names("o_orderdate"),
        F.size(values).alias("width"), F.round(values[0], 6).alias("scaled_price"),
    )


def _array(column):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


@query("cross_val_predict")
def cross_val_predict(spark, sf_dir):
    lines = modeling.class_weights(_lines(spark, sf_dir), "y_true")
    folded = splits.assign_folds(lines, LINE_KEY, stratify="y_true")
    estimator = modeling.baseline_classifier(FEATURES, "y_true", folded.count())
    predicted = modeling.cross_val_predict(folded, estimator, splits.FOLDS)
    return V.rounded(evaluation.binary_performance(predicted))


@query("robustness")
def robustness(spark, sf_dir):
    lines, _, model = _fitted(spark, sf_dir)
    return V.rounded(modeling.robustness_classification(model, lines, LINE_KEY, FEATURES))


@query("robustness_regression")
def robustness_regression(spark, sf_dir):
    part = modeling.spread(V.table(spark, sf_dir, "part"), ["p_partkey"])
    features = ["p_partkey", "p_size"]
    estimator = modeling.baseline_regressor(features, "p_retailprice")
    return V.rounded(
        modeling.robustness_regression(
            estimator.fit(part), part, ["p_partkey"], features, "p_retailprice"
        )
    )


@query("robustness_curve")
def robustness_curve(spark, sf_dir):
    lines, _, model = _fitted(spark, sf_dir)
    return V.rounded(modeling.noise_flips(model, lines, LINE_KEY, FEATURES))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    lines, _, model = _fitted(spark, sf_dir)
    found = modeling.permutation_importance(model, lines, LINE_KEY, FEATURES, "y_true")
    return V.rounded(modeling.top_importances(found))


@query(
    "corrupt",
    """WITH c AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 5e-2)) AS t FROM lineitem)
SELECT CAST(1 AS INTEGER) AS corrupted, CAST(t AS BIGINT) AS n FROM c
UNION ALL SELECT 0, CAST(n - t AS BIGINT) FROM c""",
)
def corrupt(spark, sf_dir):
    dirty = modeling.corrupt(_lines(spark, sf_dir), LINE_KEY, FEATURES[:2])
    return dirty.groupBy("corrupted").agg(F.count("*").alias("n"))


@query("falsification")
def falsification(spark, sf_dir):
    lines, estimator, model = _fitted(spark, sf_dir)
    return V.rounded(
        modeling.falsification(lines, estimator, LINE_KEY, FEATURES, "y_true", model=model)
    )


@query("validate_model")
def validate_model(spark, sf_dir):
    lines = _lines(spark, sf_dir).drop("l_returnflag")
    found = scoring.validate_model(lines, "y_true", LINE_KEY, sensitive=["a3"], drop_ids=False)
    none = F.lit(None).cast("string")
    scores = found.results.select(
        "agent", F.lit("score").alias("metric"), none.alias("item"), F.col("score").alias("value")
    )
    warnings = found.findings.select(
        "agent", F.concat(F.lit("finding: "), "code").alias("metric"),
        F.col("column_name").alias("item"), F.lit(None).cast("double").alias("value"),
    )
    return V.rounded(scores.unionByName(found.metrics).unionByName(warnings))


_SCORES = """r AS (SELECT 'data_integrity' AS agent, 100e0 - 20 * CAST(count(DISTINCT l_quantity) < 60
    AS INTEGER) AS score FROM lineitem
  UNION ALL SELECT 'performance', 100 * avg(y_pred) FROM preds
  UNION ALL SELECT 'fairness', 100 * avg(score) FROM preds
  UNION ALL SELECT 'unknown', 100e0 FROM preds HAVING count(*) > 0)"""


@query(
    "overall_score",
    f"{_WITH}, {_SCORES}, t AS (SELECT sum(score * CASE agent WHEN 'data_integrity' THEN 0.1e0"
    " WHEN 'performance' THEN 0.35e0 WHEN 'fairness' THEN 0.15e0 ELSE 0 END) AS s,"
    " CAST(count(*) AS BIGINT) AS agents FROM r) SELECT round(s, 2) AS score,"
    " CASE WHEN s >= 90 THEN 'pass' WHEN s >= 70 THEN 'needs_review' ELSE 'fail' END AS status,"
    " agents FROM t",
)
def overall_score(spark, sf_dir):
    preds = V.preds(spark, sf_dir)
    results = (
        preds.agg(
            F.array(
                F.struct(
                    F.lit("data_integrity").alias("agent"),
                    (100.0 - 20 * (F.countDistinct("l_quantity") < 60).cast("int")).alias("score"),
                ),
                F.struct(F.lit("performance").alias("agent"), (100 * F.avg("y_pred")).alias("score")),
                F.struct(F.lit("fairness").alias("agent"), (100 * F.avg("score")).alias("score")),
                F.struct(F.lit("unknown").alias("agent"), F.lit(100.0).alias("score")),
            ).alias("rows")
        )
        .select(F.inline("rows"))
    )
    return scoring.overall_score(results)


# ---------------------------------------------------------------- attribution


def _means(spark, sf_dir):
    return attribution.background_means(V.preds(spark, sf_dir), FEATURES)


_MEANS = "means AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in FEATURES) + " FROM preds)"


def _phi_sql(weights, extra=""):
    return union_all(
        f"SELECT {', '.join(LINE_KEY)}, '{f}' AS feature, ({f} - m_{f}) * ({w!r}::DOUBLE) AS phi{extra}"
        f" FROM preds, means"
        for f, w in weights.items()
    )


@query("background_sample")
def background_sample(spark, sf_dir):
    return attribution.background_sample(V.preds(spark, sf_dir), LINE_KEY).select(*LINE_KEY, *FEATURES)


@query(
    "linear_attributions",
    f"{_WITH}, {_MEANS}, phi AS ({_phi_sql(WEIGHTS)}) SELECT {', '.join(LINE_KEY)}, feature,"
    " round(phi, 6) AS phi FROM phi",
)
def linear_attributions(spark, sf_dir):
    phi = attribution.linear_attributions(
        V.preds(spark, sf_dir), LINE_KEY, WEIGHTS, _means(spark, sf_dir)
    )
    return phi.withColumn("phi", F.round("phi", 6))


@query(
    "global_importance",
    f"{_WITH}, {_MEANS}, phi AS ({_phi_sql(WEIGHTS)}) SELECT feature,"
    f" {r6('avg(abs(phi))')} AS mean_abs_phi FROM phi GROUP BY 1",
)
def global_importance(spark, sf_dir):
    phi = attribution.linear_attributions(
        V.preds(spark, sf_dir), LINE_KEY, WEIGHTS, _means(spark, sf_dir)
    )
    return V.rounded(attribution.global_importance(phi))


_BASE = "-0.251371319717e0 + " + " + ".join(f"({w!r}::DOUBLE) * m_{f}" for f, w in WEIGHTS.items())


@query(
    "local_explanations",
    f"""{_WITH}, {_MEANS}, phi AS ({_phi_sql(WEIGHTS, f", {_BASE} AS base")}), ranked AS (
  SELECT *, row_number() OVER w AS position, base + sum(phi) OVER w AS after FROM phi
  WINDOW w AS (PARTITION BY {', '.join(LINE_KEY)} ORDER BY abs(phi) DESC, feature
    ROWS UNBOUNDED PRECEDING))
SELECT {', '.join(LINE_KEY)}, CAST(position AS INTEGER) AS position, feature, round(phi, 6) AS phi,
  round(after - phi, 6) AS margin_before, round(after, 6) AS margin_after FROM ranked""",
)
def local_explanations(spark, sf_dir):
    rows = attribution.local_explanations(
        V.preds(spark, sf_dir), LINE_KEY, WEIGHTS, _means(spark, sf_dir), -0.251371319717
    )
    return rows.select(
        *LINE_KEY, "position", "feature",
        *[F.round(c, 6).alias(c) for c in ("phi", "margin_before", "margin_after")],
    )


@query(
    "compare_models",
    f"""{_WITH}, {_MEANS}, a AS ({_phi_sql(WEIGHTS)}), b AS ({_phi_sql(SECOND_WEIGHTS)}),
f AS (SELECT feature, avg(abs(phi)) AS x FROM a GROUP BY 1),
g AS (SELECT feature AS gf, avg(abs(phi)) AS y FROM b GROUP BY 1)
SELECT coalesce(feature, gf) AS feature, round(coalesce(x, 0), 6) AS first_model,
  round(coalesce(y, 0), 6) AS second_model, round((coalesce(x, 0) + coalesce(y, 0)) / 2, 6) AS average
FROM f FULL OUTER JOIN g ON feature = gf""",
)
def compare_models(spark, sf_dir):
    preds, means = V.preds(spark, sf_dir), _means(spark, sf_dir)
    phi = None
    for name, weights in (("first_model", WEIGHTS), ("second_model", SECOND_WEIGHTS)):
        part = attribution.linear_attributions(preds, LINE_KEY, weights, means).select(
            F.lit(name).alias("model"), "feature", "phi"
        )
        phi = part if phi is None else phi.unionByName(part)
    return V.rounded(attribution.compare_models(phi, ["first_model", "second_model"]))


def _background(lines):
    return attribution.background_sample(lines, LINE_KEY)


@query("shapley_values")
def shapley_values(spark, sf_dir):
    lines, _, model = _fitted(spark, sf_dir)
    phi = attribution.shapley_values(
        lines, LINE_KEY, FEATURES, _background(lines), modeling.margin_scorer(model)
    )
    return V.rounded(attribution.global_importance(phi))


@query("shapley_interactions")
def shapley_interactions(spark, sf_dir):
    lines, _, model = _fitted(spark, sf_dir)
    return V.rounded(
        attribution.shapley_interactions(
            lines, LINE_KEY, FEATURES, list(combinations(FEATURES, 2)), _background(lines),
            modeling.margin_scorer(model),
        )
    )
