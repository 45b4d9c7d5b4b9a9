"""Weighted overall score and the complete validation of a table and its baseline model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import nan_to_null, numeric_columns, quoted
from ..functions.ordering import settle
from . import evaluation, fairness, modeling, prep, profile, splits

# The weight of each agent and the limits of the overall status.
AGENT_WEIGHTS = {
    "data_integrity": 0.10,
    "sampling": 0.07,
    "consistency": 0.08,
    "performance": 0.35,
    "fairness": 0.15,
    "robustness": 0.10,
    "explainability": 0.05,
    "calibration": 0.05,
    "falsification": 0.05,
}
PASS_LIMIT, REVIEW_LIMIT = 90.0, 70.0
EXPLAINED_SCORE, SKIPPED_SCORE = 100.0, 100.0


def overall_score(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(score, status, agents)`` from rows ``(agent, score)``; an agent without weight adds 0."""
    weight = F.lit(0.0)
    for agent, value in (weights or AGENT_WEIGHTS).items():
        weight = F.when(F.col("agent") == agent, F.lit(value)).otherwise(weight)
    total = F.sum(weight * F.col("score"))
    return results.agg(
        F.round(total, 2).alias("score"),
        F.when(total >= PASS_LIMIT, "pass")
        .when(total >= REVIEW_LIMIT, "needs_review")
        .otherwise("fail")
        .alias("status"),
        F.count("*").alias("agents"),
    )


def data_agents(df: DataFrame, label: str | None, split: DataFrame | None = None) -> DataFrame:
    """``(agent, score)`` of the agents that need no model."""
    out = profile.integrity_score(profile.integrity_findings(df, label)).select("agent", "score")
    out = out.unionByName(
        profile.consistency_score(profile.negative_values(df)).select("agent", "score")
    )
    if split is not None and label is not None:
        shares = splits.class_shares(split, label)
        out = out.unionByName(splits.sampling_score(shares).select("agent", "score"))
    return out


@dataclass
class Validation:
    """What the agents found, as flat tables."""

    #: ``(agent, score)``
    results: DataFrame
    #: ``(agent, severity, code, column_name, message)``
    findings: DataFrame
    #: ``(agent, metric, item, value)``; ``item`` names a feature, group attribute or class.
    metrics: DataFrame


_FINDING = "agent string, severity string, code string, column_name string, message string"
_METRIC = "agent string, metric string, item string, value double"


class _Report:
    """Collects the agents' tables."""

    def __init__(self, spark):
        self.spark = spark
        self.results: list[DataFrame] = []
        self.findings: list[DataFrame] = []
        self.metrics: list[DataFrame] = []

    def agent(self, row: DataFrame, name: str | None = None) -> None:
        """A one-row table with the score, other numbers as metrics, and perhaps a severity."""
        if name is not None:
            row = row.withColumn("agent", F.lit(name))
        row = settle(row)
        self.results.append(row.select("agent", F.col("score").cast("double").alias("score")))
        numbers = [c for c in numeric_columns(row) if c != "score"]
        if numbers:
            pairs = [
                F.struct(F.lit(c).alias("metric"), quoted(c).cast("double").alias("value"))
                for c in numbers
            ]
            none = F.lit(None).cast("string").alias("item")
            self.metrics.append(
                row.select("agent", F.inline(F.array(*pairs))).select("agent", "metric", none, "value")
            )
        if "severity" in row.columns:
            bad = row.filter("severity IN ('warning', 'error')")
            message = F.concat_ws(
                ", ", *[F.concat(F.lit(f"{c} "), F.format_number(quoted(c), 4)) for c in numbers]
            )
            self.findings.append(
                bad.select(
                    "agent", "severity", F.col("agent").alias("code"),
                    F.lit(None).cast("string").alias("column_name"), message.alias("message"),
                )
            )

    def fixed(self, agent: str, score: float) -> None:
        self.results.append(self.spark.createDataFrame([(agent, score)], "agent string, score double"))

    def finding(self, agent, severity, code, column, message) -> None:
        self.findings.append(
            self.spark.createDataFrame([(agent, severity, code, column, message)], _FINDING)
        )

    def items(self, agent: str, rows: DataFrame, item: str, values: Sequence[str]) -> None:
        """Metrics of several features, attributes or classes."""
        pairs = [F.struct(F.lit(v).alias("metric"), quoted(v).cast("double").alias("value")) for v in values]
        self.metrics.append(
            rows.select(quoted(item).cast("string").alias("item"), F.inline(F.array(*pairs))).select(
                F.lit(agent).alias("agent"), "metric", "item", "value"
            )
        )

    def settled(self) -> Validation:
        def all_of(parts, schema):
            out = self.spark.createDataFrame([], schema)
            for part in parts:
                out = out.unionByName(part)
            return settle(out)

        return Validation(
            all_of(self.results, "agent string, score double"),
            all_of(self.findings, _FINDING),
            all_of(self.metrics, _METRIC),
        )


def validate_model(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    sensitive: Sequence[str] = (),
    folds: int = splits.FOLDS,
    trials: int = modeling.TRIALS,
    repeats: int = modeling.REPEATS,
    trees: int = modeling.TREES,
    drop_ids: bool = True,
    depth: int = modeling.TREE_DEPTH,
) -> Validation:
    """All nine agents on a table and a baseline model: scores, findings and metrics.

    The prepared features with their folds are persisted while the agents work, and so are the
    out-of-fold predictions of a model that isn't linear; they are released then, whatever happens.
    The model is fitted once per fold, once in full and once on corrupted data. Groups are those of
    the sensitive columns as they came; rows without a group
    are left out of the gaps, and a sensitive column that the table lacks is a finding.
    """
    report = _Report(df.sparkSession)
    for c in sensitive:
        if c not in df.columns:
            report.finding("fairness", "warning", "missing_column", c, "the sensitive column is not in the table")
    sensitive = [c for c in sensitive if c in df.columns]
    clean = prep.drop_empty(df, label)
    if drop_ids:
        kept = [
            c
            for c in clean.columns
            if c in (label, *key, *sensitive) or not prep.name_has(c, prep.ID_TOKENS)
        ]
        clean = clean.select(*kept)
    task = prep.infer_task(clean, label).first()["task"]
    kind = prep.task_type(clean, label).first()["task"]
    target = "_target"
    if task == "classification" and not modeling.is_numeric_label(clean, label):
        coded = prep.label_codes(clean, label, target)
        classes = coded.agg(F.max(target)).first()[0] + 1
        kind = "binary" if classes == 2 else "multiclass"
    else:
        coded = clean.withColumn(target, F.col(label).cast("double"))
    coded = coded.withColumn(target, F.col(target).cast("double"))
    untouched = {c: f"_group_{c}" for c in sensitive}
    raw = nan_to_null(coded)
    coded = raw.select("*", *[quoted(c).alias(g) for c, g in untouched.items()])
    prepared, stages, inputs = modeling.mixed_features(
        coded, target, exclude=[label, *key, *untouched.values()]
    )
    strata, k = None, folds
    if task == "classification":
        prepared = modeling.class_weights(prepared, target)
        smallest = prep.min_class_count(prepared, target).first()["min_class_count"]
        strata, k = target if smallest >= 2 else None, splits.fold_count(smallest, folds)
    # The table is stored once, with its folds; they follow from the keys alone.
    folded = splits.assign_folds(prepared, key, k, stratify=strata)
    if task != "classification":
        folded = modeling.spread(folded, key)
    held = [folded.persist()]
    try:
        _model_agents(
            report, df, coded, folded, stages, inputs, held, label=label, key=key, target=target,
            task=task, kind=kind, untouched=untouched, strata=strata, folds=k, trials=trials,
            repeats=repeats, trees=trees, depth=depth,
        )
        return report.settled()
    finally:
        for shared in reversed(held):
            shared.unpersist()


def _model_agents(
    report, df, coded, folded, stages, inputs, held, *, label, key, target, task, kind, untouched,
    strata, folds, trials, repeats, trees, depth,
) -> None:
    rows, prepared = folded.count(), folded.drop("fold")
    features = [
        c for c in numeric_columns(df) if c not in (label, *key) and c in prepared.columns
    ]
    if task == "classification":
        learner = LogisticRegression(
            labelCol=target, weightCol="weight", maxIter=modeling.ITERATIONS, tol=1e-4,
            regParam=1.0 / max(rows, 1), standardization=False,
        )
    else:
        learner = RandomForestRegressor(labelCol=target, numTrees=trees, seed=42, maxDepth=depth)
    estimator = Pipeline(stages=[*stages, modeling.assembled(inputs), learner])
    model = modeling.fit(estimator, prepared)

    out_of_fold = modeling.cross_val_predict(folded, estimator, folds).select(
        target, "y_pred", "score", *[quoted(g) for g in untouched.values()]
    )
    if modeling.linear_margin(model) is None:  # else it is arithmetic on the stored table
        held.append(out_of_fold.persist())

    split = splits.train_test_split(coded, key, stratify=strata)
    integrity = settle(profile.integrity_findings(df, label))
    report.findings.append(integrity.select("agent", "severity", "code", "column_name", "message"))
    report.agent(profile.integrity_score(integrity))
    negative = profile.negative_values(df)
    report.agent(profile.consistency_score(negative))
    report.items("consistency", negative, "column_name", ["negative_share"])
    shares = splits.class_shares(split, label)
    report.agent(splits.sampling_score(shares))
    if task == "classification":
        report.items("sampling", shares, "label", ["drift"])
    _performance(report, out_of_fold, target, kind)
    _fairness(report, out_of_fold, target, kind, untouched)
    if not features:
        report.fixed("robustness", 85.0)
        report.fixed("falsification", 85.0)
    else:
        if task == "classification":
            robust = modeling.robustness_classification(model, prepared, key, features, trials=trials)
        else:
            robust = modeling.robustness_regression(
                model, prepared, key, features, target, trials=trials
            )
        report.agent(robust)
        report.agent(
            modeling.falsification(prepared, estimator, key, features, target, task, model=model)
        )
    report.fixed("explainability", EXPLAINED_SCORE)
    report.items(
        "explainability",
        modeling.permutation_importance(
            model, prepared, key, _input_columns(df, prepared, label, key), target, task,
            repeats=repeats,
        ),
        "feature", ["importance_mean", "importance_std"],
    )
    if kind == "binary":
        scored = modeling.predict(model, prepared)
        report.agent(evaluation.calibration_error(scored, target, "score"), "calibration")
    else:
        report.fixed("calibration", SKIPPED_SCORE)


def _input_columns(df: DataFrame, prepared: DataFrame, label: str, key: Sequence[str]) -> dict:
    """Every input of the model by its column in the table; a date's parts belong together."""
    out = {}
    for c in df.columns:
        if c in (label, *key) or c not in prepared.columns:
            continue
        parts = [p for p in modeling.date_part_names(c) if p in prepared.columns]
        out[c] = parts or [c]
    return out


def _performance(report: _Report, predicted: DataFrame, target: str, kind: str) -> None:
    if kind == "binary":
        report.agent(evaluation.binary_performance(predicted, target, "y_pred", "score"))
        return
    if kind == "multiclass":
        base = evaluation.binary_metrics(predicted, target, "y_pred").select(
            F.col("accuracy").alias("base_score")
        )
    else:
        base = evaluation.regression_metrics(predicted, target, "y_pred")
    score = evaluation.performance_score(F.col("base_score"))
    report.agent(
        base.select(
            F.lit("performance").alias("agent"), *base.columns, score.alias("score"),
            evaluation.performance_severity(score).alias("severity"),
        )
    )


def _fairness(report: _Report, predicted: DataFrame, target: str, kind: str, untouched: dict) -> None:
    if kind == "regression" or not untouched:
        score = SKIPPED_SCORE if kind == "regression" else fairness.UNCHECKED_SCORE
        report.fixed("fairness", score)
        return
    # The groups as they came, under their own names; the imputed copies are features only.
    grouped = predicted.drop(*untouched)
    for c, kept in untouched.items():
        grouped = grouped.withColumnRenamed(kept, c)
    gaps = fairness.subgroup_gaps(fairness.group_counts(grouped, list(untouched), target, "y_pred"))
    if kind != "binary":
        gaps = gaps.filter("metric = 'subgroup_accuracy_gap'")
    gaps = settle(gaps)
    report.agent(fairness.fairness_score(gaps))
    report.findings.append(
        gaps.filter("severity = 'warning'").select(
            F.lit("fairness").alias("agent"), "severity", F.col("metric").alias("code"),
            F.col("attribute").alias("column_name"),
            F.format_string("%s is %.4f", "metric", "gap").alias("message"),
        )
    )
    report.metrics.append(
        gaps.select(F.lit("fairness").alias("agent"), "metric", F.col("attribute").alias("item"),
                    F.col("gap").cast("double").alias("value"))
    )
