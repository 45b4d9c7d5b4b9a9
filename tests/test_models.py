"""Splits, evaluation, models and attributions; random operators are tested by their bounds."""

import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vetframe.operators import attribution, evaluation, modeling, scoring, splits

FEATURES = ["x1", "x2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        x1, x2 = rng.gauss(0, 1), rng.gauss(5, 2)
        rows.append((i, x1, x2, "u" if rng.random() < 0.7 else "v", int(x1 + 0.05 * rng.gauss(0, 1) > 0)))
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, g string, y int").persist()


def test_splits_do_not_depend_on_the_partitioning(table):
    a = splits.train_test_split(table, ["id"], stratify="g").orderBy("id").collect()
    b = splits.train_test_split(table.repartition(11), ["id"], stratify="g").orderBy("id").collect()
    assert a == b
    for g in "uv":
        n = sum(r.g == g for r in a)
        assert sum(r.g == g and r.split == "test" for r in a) == round(n * 0.25 + 1e-9)
    assert splits.train_test_split(table, ["id"], 0.9).filter("split = 'test'").count() == 60


def test_folds_are_even_within_classes(table):
    rows = splits.assign_folds(table, ["id"], 4, stratify="y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r.y == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert splits.fold_count(3) == 3 and splits.fold_count(1) == 2


def test_auc_and_precision_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.4, 0.4, 0.7, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "y_true int, score double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = evaluation.ranking_metrics(df).first()
    assert math.isclose(got.roc_auc, wins / (len(pos) * len(neg)))
    average, reached = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        average += (tp / len(pos) - reached) * tp / (tp + fp)
        reached = tp / len(pos)
    assert math.isclose(got.average_precision, average)
    assert evaluation.roc_curve(df).agg(F.max("tpr"), F.max("fpr")).first()[:] == (1.0, 1.0)
    assert evaluation.ranking_metrics(df.filter("y_true = 1")).first().roc_auc is None


def test_calibration_edges_count_twice_in_the_curve(spark):
    df = spark.createDataFrame([(i % 2, i / 10) for i in range(11)], "y_true int, score double")
    curve = evaluation.calibration_curve(df, bins=5)
    assert curve.agg(F.sum("n")).first()[0] == 11 + 4
    assert evaluation.calibration_error(df, bins=5).first().bins == 5


def test_metrics_of_degenerate_predictions(spark):
    df = spark.createDataFrame([(0, 0, 0.2)], "y_true int, y_pred int, score double")
    got = evaluation.binary_metrics(df).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (1.0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def model(table):
    weighted = modeling.class_weights(table, "y")
    return modeling.baseline_classifier(FEATURES, "y", 600, iterations=30).fit(weighted)


def test_noise_and_importance(table, model):
    flips = {r.sigma: r.flip_rate for r in modeling.noise_flips(model, table, ["id"], FEATURES, (0.0, 1.0)).collect()}
    assert flips[0.0] == 0.0 and flips[1.0] > 0.1
    again = modeling.noise_flips(model, table.repartition(9), ["id"], FEATURES, (0.0, 1.0))
    assert {r.sigma: r.flip_rate for r in again.collect()} == flips
    runs = []
    for rows in (40, 10_000):  # ranges are a plan, not part of the result
        found = modeling.permutation_importance(
            model, table, ["id"], {"x1": ["x1"], "x2": ["x2"], "both": FEATURES}, "y", repeats=2,
            range_rows=rows,
        )
        runs.append({r.feature: r.importance_mean for r in modeling.top_importances(found).collect()})
    assert runs[0] == runs[1]
    assert runs[0]["x1"] > 0.3 and runs[0]["both"] > 0.3 and abs(runs[0]["x2"]) < 0.05
    assert modeling.top_importances(found, 1).count() == 1


def test_like_rows_are_shuffled_side_by_side_for_a_permutation(spark, table):
    model = modeling.baseline_classifier(FEATURES, "y", 600, weight=None, iterations=5).fit(table)
    found = modeling.permutation_importance(model, table, ["id"], FEATURES, "y", repeats=2, range_rows=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window, copies, sort = plan.index("Window"), plan.rindex("Generate explode("), plan.index("Sort [y")
    assert window < copies < sort  # from the top: sorted first, then copied for the repeats, then shuffled
    other = modeling.permutation_importance(
        model, table.repartition(7, "x2").orderBy("x1"), ["id"], FEATURES, "y", repeats=2, range_rows=1000
    )
    assert sorted(found.collect()) == sorted(other.collect())


def test_a_forest_is_asked_once_for_each_cell_of_its_thresholds(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 40), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame([(*r, r[1] * r[2]) for r in rows], "id long, a int, b double, y double")
    model = modeling.baseline_regressor(["a", "b"], "y", trees=5).fit(df)
    cuts = modeling.forest_cuts(model)
    edges = [x for at in cuts.values() for x in at]
    odd = [(0, None, 0.5), (1, 7, math.nan), (2, 7, None), (3, -5, math.inf), (4, 99, -math.inf), (5, 0, -0.0)]
    odd += [(10 + i, i % 40, x) for i, x in enumerate(edges)]
    odd = [*odd, *odd]  # keys come twice
    asked = df.select("id", "a", "b").unionByName(spark.createDataFrame(odd, "id long, a int, b double"))
    own = model.transform(asked).select("id", "a", "b", "prediction")
    found = modeling.with_prediction(model, asked)
    assert found.columns == ["id", "a", "b", "prediction"]
    assert found.exceptAll(own).count() == 0 and own.exceptAll(found).count() == 0
    assert "UDF" not in found._jdf.queryExecution().executedPlan().toString()
    assert modeling.predict(model, asked).columns == ["id", "a", "b", "y_pred", "score"]
    assert modeling.forest_cuts(model, cells=10) is None
    # The same number as asking for every noisy copy.
    got = modeling.robustness_regression(model, df, ["id"], ["a", "b"], "y").first()
    noisy = modeling._noisy_predictions(model, df, ["id"], ["a", "b"], (0.01,), 20, 42)
    each = model.transform(noisy.drop("prediction", "base_prediction", "features")).groupBy("trial")
    error = each.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("e")).collect()
    clean = model.transform(df).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert math.isclose(got.avg_rmse_drift, sum(abs(r.e - clean) for r in error) / 20, abs_tol=1e-9)


def test_a_table_in_one_task_is_spread_for_a_forest(spark):
    df = spark.range(12_000).select("id", (F.col("id") % 7).alias("v")).coalesce(1)
    parts = modeling.spread(df, ["id"])
    assert parts.rdd.getNumPartitions() == 3 and parts.exceptAll(df).count() == 0 and parts.count() == 12_000
    assert modeling.spread(df.limit(100), ["id"]).rdd.getNumPartitions() == 1
    assert modeling.spread(df, ["id"], 10**9).rdd.getNumPartitions() == modeling.SPREAD_PARTS
    forest = modeling.baseline_regressor(["v"], "id").getStages()[-1]
    assert forest.getCacheNodeIds()


def test_linear_models_are_scored_by_columns_as_by_the_model(table):
    df = table.withColumn("x1", F.when(F.col("id") % 50 != 0, F.col("x1")))
    prepared, stages, inputs = modeling.mixed_features(table, "y", exclude=["id"])
    learner = modeling.LogisticRegression(labelCol="y", regParam=0.01)
    fitted = modeling.Pipeline(stages=[*stages, modeling.assembled(inputs), learner]).fit(prepared)
    plain = modeling.baseline_classifier(FEATURES, "y", 600, None, 30).fit(table)
    for model, rows in ((fitted, prepared), (fitted, prepared.withColumn("g", F.lit("new"))), (plain, table)):
        assert modeling.linear_margin(model) is not None
        own = modeling.predict(model, rows).select("id", "y_pred", "score")
        theirs = modeling.positive_score(model.transform(rows)).select("id", "prediction", F.col("score").alias("s"))
        bad = own.join(theirs, "id").filter("y_pred <> prediction OR abs(score - s) > 1e-9")
        assert own.count() == 600 and bad.count() == 0
    assert modeling.predict(plain, df).filter("id % 50 = 0 AND (y_pred <> 0 OR NOT isnan(score))").count() == 0


def test_hybrids_side_by_side_equal_rows_of_their_own(table, model, monkeypatch):
    few, score = table.filter("id < 30"), modeling.margin_scorer(model)
    background = attribution.background_sample(table, ["id"], 7)
    found = []
    for limit in (attribution.IN_PLACE, 0):
        monkeypatch.setattr(attribution, "IN_PLACE", limit)
        phi = attribution.shapley_values(few, ["id"], FEATURES, background, score)
        pairs = attribution.shapley_interactions(few, ["id"], FEATURES, [("x2", "x1")], background, score)
        values = sorted((r.id, r.feature, round(r.phi, 9)) for r in phi.collect())
        found.append((values, [round(pairs.first()[c], 9) for c in ("mean_abs_interaction", "mean_interaction")]))
    assert found[0] == found[1] and len(found[0][0]) == 60


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interactions_shuffle_rows_once_before_they_are_multiplied(table, model):
    background, score = attribution.background_sample(table, ["id"], 3), modeling.margin_scorer(model)
    pairs = attribution.shapley_interactions(table, ["id"], FEATURES, [("x1", "x2")], background, score)
    plan = _executed(pairs)
    # By the pair (few rows), and, below what multiplies the rows, by the key.
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count("Generate explode(") == 1
    assert plan.index("Generate explode(") < plan.index("Exchange hashpartitioning(id")
    assert "UDF" not in plan


def test_shapley_values_shuffle_rows_once_before_they_are_multiplied(table, model):
    background = attribution.background_sample(table, ["id"], 3)
    plan = _executed(attribution.shapley_values(table, ["id"], FEATURES, background, modeling.margin_scorer(model)))
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("Generate explode(") == 1
    assert plan.index("Generate explode(") < plan.index("Exchange hashpartitioning(id")
    assert "UDF" not in plan


def test_noisy_copies_are_scored_where_they_are_made(table, model):
    plan = _executed(modeling.robustness_classification(model, table, ["id"], FEATURES))
    # One shuffle, of the counts by level; the copies and the vectors of a model's stages are none of it.
    assert plan.count("Exchange ") == 1 and plan.index("Exchange hashpartitioning(sigma") < plan.index("Generate inline(")
    assert plan.count("Generate ") == 1 and "UDF" not in plan


def test_corruption_hits_the_wanted_share(table):
    dirty = modeling.corrupt(table, ["id"], ["x1"])
    assert dirty.filter("corrupted = 1").count() == 30
    assert dirty.filter("corrupted = 1").select("x1").distinct().count() == 1
    assert modeling.corrupt(table.limit(5), ["id"], ["x1"]).filter("corrupted = 1").count() == 1


def test_linear_attributions_add_up(table):
    weights, means = {"x1": 2.0, "x2": -0.5}, attribution.background_means(table, FEATURES)
    phi = attribution.linear_attributions(table, ["id"], weights, means)
    base = attribution.base_value(weights, means, 0.3)
    total = phi.groupBy("id").agg((F.sum("phi") + base).alias("m")).join(table, "id")
    worst = total.agg(F.max(F.abs(F.col("m") - (2 * F.col("x1") - 0.5 * F.col("x2") + 0.3)))).first()[0]
    assert worst < 1e-9
    local = attribution.local_explanations(table, ["id"], weights, means, 0.3).filter("id = 7").orderBy("position").collect()
    assert local[0].margin_before == base and abs(local[0].phi) >= abs(local[1].phi)
    assert math.isclose(local[1].margin_after, base + local[0].phi + local[1].phi)


def test_shapley_values_add_up_to_the_prediction(table, model):
    few = table.filter("id < 40")
    background = attribution.background_sample(table, ["id"], 1)
    score = modeling.margin_scorer(model)
    phi = attribution.shapley_values(few, ["id"], FEATURES, background, score, permutations=3)
    base = modeling.predict(model, background).first().score
    total = phi.groupBy("id").agg(F.sum("phi").alias("s")).join(modeling.predict(model, few), "id")
    assert total.agg(F.max(F.abs(F.col("s") + base - F.col("score")))).first()[0] < 1e-9
    pair = attribution.shapley_interactions(few, ["id"], FEATURES, [("x1", "x2")], background, score, 1)
    assert pair.count() == 1
    assert attribution.background_sample(table, ["id"]).count() == 100


def test_model_comparison_fills_absent_features(spark):
    phi = spark.createDataFrame([("a", "x", 1.0), ("a", "y", -3.0), ("b", "x", 2.0)], "model string, feature string, phi double")
    got = attribution.compare_models(phi, ["a", "b"]).collect()
    assert [(r.feature, r.average) for r in got] == [("x", 1.5), ("y", 1.5)]


def test_mixed_features_take_every_kind_of_column(table):
    df = table.withColumn("when_date", F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    df = df.withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    prepared, stages, inputs = modeling.mixed_features(df, "y", exclude=["id"])
    assert "when_date_dow" in inputs and "_hashed" in inputs and "_g_onehot" in inputs
    assert prepared.filter("when_date_day is null").count() == 0 and len(stages) == 5


def test_the_caller_names_the_encoding(table):
    df = table.select("x1", "g", F.col("id").cast("string").alias("name"), "y")
    widths = []
    for encoding in (None, {"name": "hash"}):
        fitted = modeling.fairness_baseline(df, "y", 600, encoding).fit(df)
        assert modeling.predict(fitted, df).filter("score is null").count() == 0
        widths.append(fitted.stages[-1].numFeatures)
    assert widths[0] < 700 and widths[1] > 2**18
    with pytest.raises(ValueError):
        modeling.fairness_baseline(df, "y", 600, {"x1": "hash"})


def test_a_background_may_have_any_size(table, model):
    """With the whole table as background the values still add up to f(x) less some f(b)."""
    few, score = table.filter("id < 5"), modeling.margin_scorer(model)
    phi = attribution.shapley_values(few, ["id"], FEATURES, table, score, permutations=1)
    sums = phi.groupBy("id").agg(F.sum("phi").alias("s")).join(modeling.predict(model, few), "id")
    known = {round(r.score, 9) for r in modeling.predict(model, table).collect()}
    assert all(round(r.score - r.s, 9) in known for r in sums.collect())
    with pytest.raises(ValueError):
        attribution.shapley_values(few, ["id"], FEATURES, table.limit(0), score)


def test_full_validation_has_nine_scores(table):
    df = table.withColumn("g", F.when(F.col("id") % 10 != 0, F.col("g")))
    df = df.withColumn("when_date", F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    found = scoring.validate_model(df, "y", ["id"], ["g", "absent"], folds=2, trials=2, repeats=1)
    scores = {r.agent: r.score for r in found.results.collect()}
    assert set(scores) == set(scoring.AGENT_WEIGHTS) and all(0 <= s <= 100 for s in scores.values())
    assert scores["performance"] > 85
    overall = scoring.overall_score(found.results).first()
    assert overall.status in ("pass", "needs_review") and overall.agents == 9
    codes = {(r.agent, r.code, r.column_name) for r in found.findings.collect()}
    assert ("fairness", "missing_column", "absent") in codes
    metrics = {(r.agent, r.metric, r.item): r.value for r in found.metrics.collect()}
    assert metrics["explainability", "importance_mean", "x1"] > 0.3
    assert {i for a, m, i in metrics if a == "explainability"} == {"x1", "x2", "g", "when_date"}
    assert metrics["performance", "accuracy", None] > 0.85


def test_groups_are_not_imputed(table):
    """Rows without a group stay out of the gaps: here only they are predicted wrongly."""
    df = table.withColumn("g", F.when(F.col("y") == F.when(F.col("x1") > 0, 1).otherwise(0), F.col("g")))
    found = scoring.validate_model(df, "y", ["id"], ["g"], folds=2, trials=1, repeats=1)
    gap = found.metrics.filter("metric = 'subgroup_accuracy_gap'").first().value
    assert gap < 0.06


def _mixed(table):
    """Rows with folds, gaps and text; the estimator of the complete validation."""
    df = table.withColumn("x2", F.when(F.col("id") % 13 != 0, F.col("x2")))
    df = df.withColumn("g", F.when(F.col("id") % 10 != 0, F.col("g"))).withColumn("one", F.lit(2.5))
    prepared, stages, inputs = modeling.mixed_features(df, "y", exclude=["id"])
    learner = LogisticRegression(labelCol="y", maxIter=200, tol=1e-4, regParam=1 / 600, standardization=False)
    estimator = Pipeline(stages=[*stages, modeling.assembled(inputs), learner])
    return prepared.withColumn("fold", (F.col("id") % 3).cast("int")), estimator


def test_folds_are_fitted_without_a_vector_for_each_stage(table, monkeypatch):
    folded, estimator = _mixed(table)
    plain = [estimator.fit(folded.filter(F.col("fold") != i)) for i in range(3)]
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: seen.append(df.columns) or fit(self, df, *a))
    got = modeling.cross_val_predict(folded, estimator, 3)
    assert seen == [["y", "features"]] * 3
    for i, model in enumerate(plain):
        right = model.transform(folded.filter(F.col("fold") == i)).select("id", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        both = right.join(got, "id")
        assert both.count() == right.count() > 0
        assert both.filter("prediction <> y_pred OR abs(p - score) > 1e-9").count() == 0


def test_missing_numbers_are_refused_as_by_the_stages(table):
    folded, estimator = _mixed(table)
    broken = folded.withColumn("x1", F.when(F.col("id") != 5, F.col("x1")))
    with pytest.raises(Exception, match="missing value in column x1"):
        modeling.fit(estimator, broken)
    # Stages that leave out rows are not passed over.
    lenient = estimator.copy()
    lenient.getStages()[0].setHandleInvalid("skip")
    assert modeling.fit(lenient, broken).stages[-1].numFeatures > 3


def test_permuted_features_of_a_linear_model_are_scored_in_their_row(table, model, monkeypatch):
    found = modeling.permutation_importance(model, table, ["id"], FEATURES, "y", repeats=2, range_rows=50)
    copies = [p for p in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in p]
    assert len(copies) == 1, "rows are copied for the repeats only, not for the features"
    got = {r.feature: (r.importance_mean, r.importance_std) for r in found.collect()}
    monkeypatch.setattr(modeling, "linear_margin", lambda *a: None)
    general = modeling.permutation_importance(model, table, ["id"], FEATURES, "y", repeats=2, range_rows=50)
    assert got == {r.feature: (r.importance_mean, r.importance_std) for r in general.collect()}


def test_validation_stores_its_table_once(table, monkeypatch):
    stored, persist = [], type(table).persist
    monkeypatch.setattr(type(table), "persist", lambda self, *a: stored.append(self.columns) or persist(self, *a))
    found = scoring.validate_model(table, "y", ["id"], ["g"], folds=2, trials=1, repeats=1)
    assert found.results.count() == 9 and len(stored) == 1 and "fold" in stored[0]
