"""Group fairness over a predictions table ``(y_true, y_pred, score, attribute columns…)``.

Everything starts from one small count table: per attribute and group, how many rows, positives,
selections, hits. It takes a single scan with a map-side combine, whatever the number of attributes,
and a group that holds most of the rows costs one partial row per task. All criteria, for all
attributes and thresholds, are then computed from the counts. Per-attribute extremes are aggregates
joined back, not windows, so an attribute with very many groups stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, quoted, ratio
from ..functions.ordering import settle

# The limits of the three criteria, and the threshold grid (19 values, 0.05 to 0.95).
DP_GAP_MAX, EO_GAP_MAX, DI_RATIO_MIN = 0.1, 0.1, 0.8
WARNING_GAP, GAP_PENALTY, LOWEST_SCORE, UNCHECKED_SCORE = 0.1, 10.0, 40.0, 80.0
GRID_START, GRID_STOP, GRID_SIZE = 0.05, 0.95, 19

COUNTS = ("n", "positives", "selected", "hits", "correct")


def threshold_grid(
    start: float = GRID_START, stop: float = GRID_STOP, size: int = GRID_SIZE
) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (stop - start) / (size - 1)
    return [start + i * step if i < size - 1 else stop for i in range(size)]


def _attribute_rows(attributes: Sequence[str]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("attribute"), quoted(a).cast("string").alias("group")
                )
                for a in attributes
            ]
        )
    )


def group_counts(
    preds: DataFrame,
    attributes: Sequence[str],
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    favorable: int = 1,
) -> DataFrame:
    """``(attribute, group, n, positives, selected, hits, correct)``; a missing group stays NULL."""
    truth, chosen = quoted(y_true) == favorable, quoted(y_pred) == favorable
    flagged = preds.select(
        truth.alias("_t"), chosen.alias("_p"),
        (quoted(y_true) == quoted(y_pred)).alias("_c"),
        _attribute_rows(attributes),
    )
    return settle(
        flagged.groupBy("attribute", "group").agg(
            F.count("*").alias("n"),
            count_where(F.col("_t")).alias("positives"),
            count_where(F.col("_p")).alias("selected"),
            count_where(F.col("_t") & F.col("_p")).alias("hits"),
            count_where(F.col("_c")).alias("correct"),
        )
    )


def threshold_counts(
    preds: DataFrame,
    attributes: Sequence[str],
    thresholds: Sequence[float] | None = None,
    y_true: str = "y_true",
    score: str = "score",
) -> DataFrame:
    """The count table at every threshold, from one scan.

    Each row is reduced to the number of thresholds its score reaches. Counts per (group, that
    number) are all a sweep needs, so the data is read once and the grid multiplies only the
    counts.
    """
    grid = sorted(threshold_grid() if thresholds is None else [float(t) for t in thresholds])
    s = quoted(score)
    reached = sum((F.coalesce((s >= F.lit(t)).cast("int"), F.lit(0)) for t in grid), F.lit(0))
    histogram = (
        preds.select(
            (quoted(y_true) == 1).cast("int").alias("_t"),
            reached.alias("_reached"),
            _attribute_rows(attributes),
        )
        .groupBy("attribute", "group", "_reached")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("_t"), F.lit(0)).alias("positives"))
    )
    steps = F.array(
        *[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]
    )
    on = F.col("_reached") > F.col("_i")
    n, pos = F.col("n"), F.col("positives")
    return settle(
        histogram.select("*", F.inline(steps))
        .groupBy("threshold", "attribute", "group")
        .agg(
            F.sum("n").alias("n"),
            F.sum("positives").alias("positives"),
            F.sum(F.when(on, n).otherwise(0)).alias("selected"),
            F.sum(F.when(on, pos).otherwise(0)).alias("hits"),
            F.sum(F.when(on, pos).otherwise(n - pos)).alias("correct"),
        )
    )


def _with_privileged(counts: DataFrame, privileged: dict[str, str] | None) -> Column:
    fixed = F.lit(None).cast("string")
    for attribute, group in (privileged or {}).items():
        fixed = F.when(F.col("attribute") == attribute, F.lit(group)).otherwise(fixed)
    return fixed


def reference_groups(
    counts: DataFrame, privileged: dict[str, str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``(attribute, reference_group, configured)``: the privileged group, else the largest one.

    Ties go to the smallest group name. ``configured`` says a privileged group was named.
    """
    known = counts.filter(F.col("group").isNotNull())
    return (
        known.groupBy(*by, "attribute")
        .agg(F.min_by("group", F.struct(-F.col("n"), F.col("group"))).alias("_largest"))
        .select(
            *by,
            "attribute",
            F.coalesce(_with_privileged(counts, privileged), F.col("_largest")).alias(
                "reference_group"
            ),
            _with_privileged(counts, privileged).isNotNull().cast("int").alias("configured"),
        )
    )


def _against_group(
    counts: DataFrame, rate: Column, name: str, privileged, by: Sequence[str]
) -> DataFrame:
    """Rate per group with its gaps to the extremes and to the reference group."""
    keys = [*by, "attribute"]
    rates = counts.filter(F.col("group").isNotNull()).withColumn(name, rate)
    references = reference_groups(counts, privileged, by)
    extremes = (
        rates.join(F.broadcast(references), keys)
        .groupBy(*keys)
        .agg(
            F.max(name).alias("_max"),
            F.min(name).alias("_min"),
            F.max(F.when(F.col("group") == F.col("reference_group"), F.col(name))).alias("_ref"),
        )
    )
    # One row per attribute (and threshold): bounded by the columns named and the grid.
    return rates.join(F.broadcast(extremes), keys).select(
        *keys,
        "group",
        name,
        F.col("n").alias("count"),
        (F.col("_max") - F.col(name)).alias("gap_vs_max"),
        (F.col(name) - F.col("_min")).alias("gap_vs_min"),
        (F.col(name) - F.col("_ref")).alias("diff_vs_ref"),
        ratio(F.col(name), F.col("_ref")).alias("ratio_vs_ref"),
    )


def demographic_parity(
    counts: DataFrame, privileged: dict[str, str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Selection rate per group."""
    return _against_group(
        counts, ratio(F.col("selected"), F.col("n")), "selection_rate", privileged, by
    )


def equal_opportunity(
    counts: DataFrame,
    privileged: dict[str, str] | None = None,
    by: Sequence[str] = (),
    zero_division: float | None = None,
) -> DataFrame:
    """True positive rate per group, NULL (or ``zero_division``) where a group has no positives."""
    rate = ratio(F.col("hits"), F.col("positives"))
    if zero_division is not None:
        rate = F.coalesce(rate, F.lit(float(zero_division)))
    return _against_group(counts, rate, "tpr", privileged, by)


def disparate_impact(
    counts: DataFrame, privileged: dict[str, str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The group whose selection rate is smallest relative to the reference group."""
    keys = [*by, "attribute"]
    rates = counts.filter(F.col("group").isNotNull()).withColumn(
        "rate", ratio(F.col("selected"), F.col("n"))
    )
    joined = rates.join(F.broadcast(reference_groups(counts, privileged, by)), keys)
    is_reference = F.col("group") == F.col("reference_group")
    reference = joined.groupBy(*keys).agg(
        F.max(F.when(is_reference, F.col("rate"))).alias("ref_rate")
    )
    anchored = joined.join(F.broadcast(reference), keys).withColumn("ratio", ratio(F.col("rate"), F.col("ref_rate")))
    rank = F.struct(F.coalesce("ratio", F.lit(float("inf"))), F.col("group"))
    worst = F.min_by(F.struct("group", "rate", "ratio"), F.when(~is_reference, rank))
    return (
        anchored.groupBy(*keys)
        .agg(
            F.first("reference_group").alias("reference_group"),
            F.first("ref_rate").alias("reference_rate"),
            worst.alias("_worst"),
        )
        .select(
            *keys,
            "reference_group",
            "reference_rate",
            F.col("_worst.group").alias("worst_group"),
            F.col("_worst.rate").alias("worst_group_rate"),
            F.col("_worst.ratio").alias("di_ratio"),
        )
    )


def fairness_criteria(
    counts: DataFrame,
    privileged: dict[str, str] | None = None,
    by: Sequence[str] = (),
    dp_gap_max: float = DP_GAP_MAX,
    eo_gap_max: float = EO_GAP_MAX,
    di_ratio_min: float = DI_RATIO_MIN,
) -> DataFrame:
    """Gaps, worst ratio, accuracy and a pass flag per criterion; an undefined value fails."""
    keys = [*by, "attribute"]
    known = F.col("group").isNotNull()
    selection = F.when(known, ratio(F.col("selected"), F.col("n")))
    tpr = F.when(known, ratio(F.col("hits"), F.col("positives")))
    gaps = counts.groupBy(*keys).agg(
        (F.max(selection) - F.min(selection)).alias("dp_gap"),
        (F.max(tpr) - F.min(tpr)).alias("eo_gap"),
        ratio(F.sum("correct"), F.sum("n")).alias("accuracy"),
    )
    impact = disparate_impact(counts, privileged, by).select(*keys, "di_ratio")

    def passed(condition):
        return F.coalesce(condition, F.lit(False)).cast("int")

    return gaps.join(impact, keys, "left").select(
        *keys,
        "dp_gap",
        "eo_gap",
        "di_ratio",
        "accuracy",
        passed(F.col("dp_gap") <= dp_gap_max).alias("pass_dp"),
        passed(F.col("eo_gap") <= eo_gap_max).alias("pass_eo"),
        passed(F.col("di_ratio") >= di_ratio_min).alias("pass_di"),
    )


def tradeoffs(
    preds: DataFrame,
    attributes: Sequence[str],
    thresholds: Sequence[float] | None = None,
    privileged: dict[str, str] | None = None,
    **limits: float,
) -> DataFrame:
    """The criteria at every threshold."""
    counts = threshold_counts(preds, attributes, thresholds)
    return fairness_criteria(counts, privileged, by=("threshold",), **limits)


def fairness_verdict(criteria: DataFrame) -> DataFrame:
    """Three criteria passed: pass; two: warn; else fail."""
    passed = F.col("pass_dp") + F.col("pass_eo") + F.col("pass_di")
    return criteria.withColumn("criteria_passed", passed).withColumn(
        "verdict",
        F.when(F.col("criteria_passed") == 3, "pass")
        .when(F.col("criteria_passed") == 2, "warn")
        .otherwise("fail"),
    )


def intersectional(
    preds: DataFrame,
    attributes: Sequence[str],
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    favorable: int = 1,
) -> DataFrame:
    """Rates per combination of attribute values, with gaps to the best and worst combination.

    A missing value is a group of its own here, written ``nan``.
    """
    truth, chosen = quoted(y_true) == favorable, quoted(y_pred) == favorable
    combination = F.concat_ws(
        "|", *[F.coalesce(quoted(a).cast("string"), F.lit("nan")) for a in attributes]
    )
    rates = settle(
        preds.groupBy(combination.alias("intersection_group"))
        .agg(
            F.count("*").alias("count"),
            count_where(truth).alias("_positives"),
            count_where(chosen).alias("_selected"),
            count_where(truth & chosen).alias("_hits"),
        )
        .select(
            "intersection_group",
            ratio(F.col("_selected"), F.col("count")).alias("selection_rate"),
            ratio(F.col("_hits"), F.col("_positives")).alias("tpr"),
            "count",
        )
    )

    def extreme(f, name):
        return rates.agg(f(name)).scalar()

    return rates.select(
        "*",
        *[
            expression.alias(f"{c}_gap_vs_{kind}")
            for c in ("selection_rate", "tpr")
            for kind, expression in (
                ("best", extreme(F.max, c) - F.col(c)),
                ("worst", F.col(c) - extreme(F.min, c)),
            )
        ],
    )


def missing_privileged(counts: DataFrame, privileged: dict[str, str]) -> DataFrame:
    """Findings on configured privileged groups that do not occur in the data."""
    configured = counts.sparkSession.createDataFrame(
        list(privileged.items()), "attribute string, group string"
    )
    return configured.join(counts, ["attribute", "group"], "left_anti").select(
        F.lit("fairness").alias("agent"),
        F.lit("warning").alias("severity"),
        F.lit("privileged_group_absent").alias("code"),
        F.col("attribute").alias("column_name"),
        F.concat(F.lit("no rows in group "), F.col("group")).alias("message"),
    )


def group_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, positive rate and true positive rate (0 without positives) per group."""
    return counts.filter(F.col("group").isNotNull()).select(
        "attribute",
        "group",
        F.col("n").alias("count"),
        ratio(F.col("correct"), F.col("n")).alias("accuracy"),
        ratio(F.col("selected"), F.col("n")).alias("positive_rate"),
        F.coalesce(ratio(F.col("hits"), F.col("positives")), F.lit(0.0)).alias("tpr"),
    )


def subgroup_gaps(counts: DataFrame) -> DataFrame:
    """``(attribute, metric, gap, severity)``; a gap above 0.1 is a warning."""
    gaps = group_rates(counts).groupBy("attribute").agg(
        (F.max("accuracy") - F.min("accuracy")).alias("subgroup_accuracy_gap"),
        (F.max("positive_rate") - F.min("positive_rate")).alias("demographic_parity_gap"),
        (F.max("tpr") - F.min("tpr")).alias("equal_opportunity_gap"),
        F.count("*").alias("groups"),
    )
    names = ("subgroup_accuracy_gap", "demographic_parity_gap", "equal_opportunity_gap")
    rows = gaps.select(
        "attribute",
        "groups",
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("gap")) for n in names])
        ),
    )
    # With a single group only the accuracy gap is defined, as 0.
    return rows.filter((F.col("groups") > 1) | (F.col("metric") == names[0])).select(
        "attribute",
        "metric",
        "gap",
        F.when(F.col("gap") > WARNING_GAP, "warning").otherwise("ok").alias("severity"),
    )


def fairness_score(gaps: DataFrame) -> DataFrame:
    """100 less 10 per warning, not below 40; 80 when no attribute was given."""
    warnings = count_where(F.col("severity") == "warning")
    return gaps.agg(
        F.lit("fairness").alias("agent"),
        warnings.alias("warnings"),
        F.when(F.count("*") == 0, UNCHECKED_SCORE)
        .otherwise(F.greatest(F.lit(LOWEST_SCORE), 100.0 - GAP_PENALTY * warnings))
        .alias("score"),
    )


def fairness_report(
    preds: DataFrame,
    attributes: Sequence[str],
    privileged: dict[str, str] | None = None,
    **limits: float,
) -> dict[str, DataFrame]:
    """All fairness tables of a predictions table, by name; they share one count table."""
    counts = group_counts(preds, attributes)
    criteria = fairness_criteria(counts, privileged, **limits)
    return {
        "demographic_parity": demographic_parity(counts, privileged),
        "equal_opportunity": equal_opportunity(counts, privileged),
        "disparate_impact": disparate_impact(counts, privileged),
        "criteria": criteria,
        "verdict": fairness_verdict(criteria),
        "intersectional": intersectional(preds, attributes),
        "findings": missing_privileged(counts, privileged or {"": ""}).filter(
            F.lit(bool(privileged))
        ),
    }
