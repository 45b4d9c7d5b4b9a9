"""Model evaluation over a predictions table: confusion, rates, curves, calibration, regression."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, nan_to_null, quoted, ratio
from ..functions.ordering import running_totals
from ..functions.ranks import BUFFER_LIMIT, exact_quantiles

# Bins, score factors and limits of the calibration and performance findings.
CALIBRATION_BINS, EDGE_SLACK = 10, 1e-12
ECE_LIMIT, ECE_FACTOR = 0.05, 5.0
WEAK, MODERATE = 70.0, 85.0


def confusion_matrix(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``(y_true, y_pred, n)``."""
    return preds.groupBy(quoted(y_true).alias("y_true"), quoted(y_pred).alias("y_pred")).agg(
        F.count("*").alias("n")
    )


def binary_metrics(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Accuracy, precision, recall and F1, each 0 when its denominator is."""
    truth, chosen = quoted(y_true) == 1, quoted(y_pred) == 1
    sums = preds.agg(
        F.count("*").alias("n"),
        count_where(quoted(y_true) == quoted(y_pred)).alias("correct"),
        count_where(truth & chosen).alias("tp"),
        count_where(chosen).alias("selected"),
        count_where(truth).alias("positives"),
    )
    zero = F.lit(0.0)
    return sums.select(
        F.coalesce(ratio(F.col("correct"), F.col("n")), zero).alias("accuracy"),
        F.coalesce(ratio(F.col("tp"), F.col("selected")), zero).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("positives")), zero).alias("recall"),
        F.coalesce(
            ratio(2 * F.col("tp"), F.col("selected") + F.col("positives")), zero
        ).alias("f1"),
    )


def score_counts(preds: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score; ties share a row, however many they are."""
    return (
        preds.filter(quoted(score).isNotNull())
        .groupBy(quoted(score).cast("double").alias("score"))
        .agg(
            count_where(quoted(y_true) == 1).alias("pos"),
            count_where(quoted(y_true) != 1).alias("neg"),
        )
    )


def cumulative_scores(
    preds: DataFrame, y_true: str = "y_true", score: str = "score"
) -> DataFrame:
    """``score_counts`` with the hits (tp) and false alarms (fp) at or above each score.

    The prefix sums are spread over score ranges, so a continuous score with as many values as rows
    is no harder than a coarse one.
    """
    counts = score_counts(preds, y_true, score)
    return running_totals(
        counts, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}
    )


def _class_totals(cumulative: DataFrame) -> tuple[Column, Column]:
    return (
        cumulative.agg(F.sum("pos")).scalar(),
        cumulative.agg(F.sum("neg")).scalar(),
    )


def roc_curve(preds: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score."""
    cumulative = cumulative_scores(preds, y_true, score)
    positives, negatives = _class_totals(cumulative)
    return cumulative.select(
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), negatives).alias("fpr"),
        ratio(F.col("tp"), positives).alias("tpr"),
    )


def precision_recall_curve(
    preds: DataFrame, y_true: str = "y_true", score: str = "score"
) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score."""
    cumulative = cumulative_scores(preds, y_true, score)
    positives, _ = _class_totals(cumulative)
    return cumulative.select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), positives).alias("recall"),
    )


def ranking_metrics(preds: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """``(roc_auc, average_precision)``, exact under ties; NULL unless both classes occur.

    A score group adds a trapezoid of its positives over its negatives to the area, and its recall
    step times the precision reached to the average precision, so one aggregate over the
    cumulative table is enough.
    """
    cumulative = cumulative_scores(preds, y_true, score)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = F.sum(neg * (F.col("tp") - pos / 2))
    steps = F.sum(pos * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return cumulative.agg(
        ratio(area, F.sum(pos) * F.sum(neg)).alias("roc_auc"),
        F.when(F.sum(neg) > 0, ratio(steps, F.sum(pos))).alias("average_precision"),
    )


def regression_metrics(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Root mean squared error, R² and a score in 0..1."""
    y, p = quoted(y_true).cast("double"), quoted(y_pred).cast("double")
    sums = nan_to_null(preds.select(quoted(y_true), quoted(y_pred))).filter(y.isNotNull() & p.isNotNull()).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("spread")
    )
    r2 = 1 - F.try_divide(F.col("mse"), F.col("spread"))
    return sums.select(
        F.sqrt("mse").alias("rmse"),
        r2.alias("r2"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r2 + 1) / 2)).alias("base_score"),
    )


def score_edges(
    preds: DataFrame,
    score: str = "score",
    bins: int = CALIBRATION_BINS,
    buffer_limit: int = BUFFER_LIMIT,
) -> list[float]:
    """Quantile edges of the score, both extremes included."""
    shares = [i / bins for i in range(bins + 1)]
    return exact_quantiles(nan_to_null(preds.select(quoted(score))), [score], shares, buffer_limit)[score]


def calibration_curve(
    preds: DataFrame,
    y_true: str = "y_true",
    score: str = "score",
    bins: int = CALIBRATION_BINS,
    buffer_limit: int = BUFFER_LIMIT,
) -> DataFrame:
    """``(bin, n, mean_score, observed)`` per quantile bin; a value on an inner edge counts in
    both neighbours. Bins are literals, so the scan needs no join."""
    edges = score_edges(preds, score, bins, buffer_limit)
    preds = nan_to_null(preds)
    if edges[0] is None:
        edges = [0.0] * (bins + 1)
    s = quoted(score).cast("double")
    member = F.array_compact(
        F.array(
            *[
                F.when((s >= F.lit(edges[i])) & (s < F.lit(edges[i + 1] + EDGE_SLACK)), F.lit(i))
                for i in range(bins)
            ]
        )
    )
    return (
        preds.select(s.alias("s"), quoted(y_true).alias("y"), F.explode(member).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("observed"))
    )


def calibration_error(
    preds: DataFrame,
    y_true: str = "y_true",
    score: str = "score",
    bins: int = CALIBRATION_BINS,
    buffer_limit: int = BUFFER_LIMIT,
) -> DataFrame:
    """``(ece, bins, score, severity)``: mean gap between observed rate and mean score.

    A value on an inner edge belongs to the lower bin; bins weigh the same; empty bins drop out.
    """
    edges = score_edges(preds, score, bins, buffer_limit)
    preds = nan_to_null(preds)
    s = quoted(score).cast("double")
    inner = [] if edges[0] is None else edges[1:-1]
    index = sum(((s > F.lit(e)).cast("int") for e in inner), F.lit(0))
    gaps = (
        preds.filter(s.isNotNull())
        .groupBy(index.alias("bin"))
        .agg(F.abs(F.avg(quoted(y_true)) - F.avg(s)).alias("gap"))
    )
    ece = F.avg("gap")
    return gaps.agg(
        ece.alias("ece"),
        F.count("*").alias("bins"),
        F.greatest(
            F.lit(0.0), 100 * (1 - F.least(ece * ECE_FACTOR, F.lit(1.0)))
        ).alias("score"),
        F.when(ece > ECE_LIMIT, "warning").otherwise("info").alias("severity"),
    )


def performance_score(base: Column) -> Column:
    return 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def performance_severity(score: Column) -> Column:
    return F.when(score < WEAK, "error").when(score < MODERATE, "warning").otherwise("info")


def binary_performance(
    preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", score: str = "score"
) -> DataFrame:
    """Agent row for a binary model: the mean of accuracy, F1, precision, recall and AUC."""
    rates = binary_metrics(preds, y_true, y_pred)
    auc = ranking_metrics(preds, y_true, score).select("roc_auc").scalar()
    names = ("accuracy", "f1", "precision", "recall")
    with_auc = rates.withColumn("auc", auc)
    mean = (
        sum((F.col(n) for n in names), F.lit(0.0)) + F.coalesce("auc", "accuracy")
    ) / (len(names) + 1)
    total = performance_score(mean)
    return with_auc.select(
        F.lit("performance").alias("agent"), *names, "auc",
        total.alias("score"), performance_severity(total).alias("severity"),
    )


def model_accuracy(
    preds: DataFrame, model: str = "model", y_true: str = "y_true", score: str = "score"
) -> DataFrame:
    """``(model, accuracy)``: share of rows on the right side of 0.5."""
    right = (quoted(score) > 0.5).cast("int") == quoted(y_true)
    return preds.groupBy(quoted(model).alias("model")).agg(
        ratio(count_where(right), F.count("*")).alias("accuracy")
    )


