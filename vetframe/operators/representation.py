"""Representation of groups against a population benchmark, and diversity of group shares.

All measures derive from one count table ``(attribute, group, n)``. Shares are counts joined to
per-attribute totals, so no attribute is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, quoted, ratio
from ..functions.ordering import settle
from ..functions.ranks import BUFFER_LIMIT, order_statistics

# Limits of the representation status, weights and limits of the diversity scores.
SEVERELY_UNDER, UNDER, SLIGHTLY_OVER, OVER = 0.7, 0.85, 1.15, 1.3
UNDER_STATUS = ("Severely Under-represented", "Under-represented")
ADEQUATE_STATUS = ("Adequately Represented", "Slightly Over-represented")
SHANNON_WEIGHT, EVENNESS_WEIGHT, DOMINANCE_WEIGHT, SHANNON_SCALE = 0.4, 0.3, 0.3, 3.0
DIVERSITY_LEVELS = (
    (0.5, "Very Low Diversity"),
    (1.0, "Low Diversity"),
    (1.5, "Moderate Diversity"),
    (2.0, "High Diversity"),
)
BIAS_LEVELS = (
    (0.8, "Low Representation Bias"),
    (0.6, "Moderate Representation Bias"),
    (0.4, "High Representation Bias"),
)
MINORITY_SHARE, DOMINANCE_RATIO_LIMIT, PERIODS = 0.1, 2.0, 5


def attribute_counts(
    df: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``(by…, attribute, group, n)`` with missing groups kept as NULL; one scan, one shuffle."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("attribute"), quoted(a).cast("string").alias("group"))
            for a in attributes
        ]
    )
    return settle(
        df.select(*by, F.inline(pairs))
        .groupBy(*by, "attribute", "group")
        .agg(F.count("*").alias("n"))
    )


def group_shares(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts with the share within the attribute; missing groups do not count."""
    keys = [*by, "attribute"]
    known = counts.filter(F.col("group").isNotNull())
    totals = known.groupBy(*keys).agg(F.sum("n").alias("_total"))
    if not by:
        # One row per attribute column, so an attribute with very many groups is not shuffled.
        totals = F.broadcast(totals)
    return known.join(totals, keys).select(
        *keys, "group", "n", ratio(F.col("n"), F.col("_total")).alias("share")
    )


def distribution_summary(counts: DataFrame) -> DataFrame:
    """Groups, most and least common group, and the ratio of their sizes per attribute."""
    return (
        counts.filter(F.col("group").isNotNull())
        .groupBy("attribute")
        .agg(
            F.count("*").alias("unique_values"),
            F.min_by("group", F.struct(-F.col("n"), F.col("group"))).alias("most_common"),
            F.max_by("group", F.struct(-F.col("n"), F.col("group"))).alias("least_common"),
            F.when(F.count("*") > 1, ratio(F.max("n"), F.min("n")))
            .otherwise(1.0)
            .alias("dominance_ratio"),
        )
        .withColumn(
            "dominance_warning",
            (F.col("dominance_ratio") > DOMINANCE_RATIO_LIMIT).cast("int"),
        )
    )


def representation_status(value: Column) -> Column:
    """Status of a representation ratio."""
    return (
        F.when(value < SEVERELY_UNDER, UNDER_STATUS[0])
        .when(value < UNDER, UNDER_STATUS[1])
        .when(value > OVER, "Over-represented")
        .when(value > SLIGHTLY_OVER, ADEQUATE_STATUS[1])
        .otherwise(ADEQUATE_STATUS[0])
    )


def benchmark_frame(df: DataFrame, benchmark: dict[str, dict[str, float]]) -> DataFrame:
    """A benchmark given as ``{attribute: {group: expected share}}`` as a table."""
    rows = [(a, g, float(p)) for a, groups in benchmark.items() for g, p in groups.items()]
    return df.sparkSession.createDataFrame(
        rows, "attribute string, group string, expected_share double"
    )


def representation_gaps(counts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Observed against expected share of every expected group, 0 when it does not occur."""
    observed = group_shares(counts).select("attribute", "group", F.col("share").alias("_share"))
    attributes = counts.select("attribute").distinct()
    expected, share = F.col("expected_share"), F.coalesce(F.col("_share"), F.lit(0.0))
    infinite = F.lit(float("inf"))
    return (
        benchmark.join(attributes, "attribute", "left_semi")
        .join(observed, ["attribute", "group"], "left")
        .select("attribute", "group", share.alias("observed_share"), "expected_share")
        .withColumn(
            "representation_ratio",
            F.when(expected > 0, ratio(F.col("observed_share"), expected)).otherwise(infinite),
        )
        .withColumn("absolute_gap", F.col("observed_share") - expected)
        .withColumn(
            "relative_gap_percent",
            F.when(expected > 0, ratio(F.col("absolute_gap"), expected) * 100).otherwise(infinite),
        )
        .withColumn("status", representation_status(F.col("representation_ratio")))
    )


def inclusion_scores(gaps: DataFrame) -> DataFrame:
    """Accuracy of the shares, weighted by the expected share; may be negative."""
    expected = F.when(F.col("expected_share") > 0, F.col("expected_share"))
    accuracy = 1 - F.try_divide(F.abs("absolute_gap"), expected)
    return gaps.groupBy("attribute").agg(
        F.coalesce(
            F.try_divide(F.sum(accuracy * expected), F.sum(expected)), F.lit(0.0)
        ).alias("inclusion_score")
    )


def inclusion_gaps(counts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Missing and unexpected groups and the coverage of the benchmark per attribute.

    Groups are matched by a full outer join. The lists hold the missing groups (bounded by the
    benchmark) and the number of unexpected ones; the unexpected groups themselves come from
    ``unexpected_groups``, as rows.
    """
    attributes = counts.select("attribute").distinct()
    expected = benchmark.join(attributes, "attribute", "left_semi").select(
        "attribute", "group", F.lit(1).alias("_expected")
    )
    covered = benchmark.select("attribute").distinct()
    observed = counts.join(covered, "attribute", "left_semi").select(
        F.col("attribute").alias("_a"), F.col("group").alias("_g"), F.lit(1).alias("_observed")
    )
    same = (F.col("attribute") == F.col("_a")) & F.col("group").eqNullSafe(F.col("_g"))
    merged = expected.join(observed, same, "full_outer").select(
        F.coalesce("attribute", "_a").alias("attribute"),
        F.col("group"),
        (F.col("_expected").isNotNull() & F.col("_observed").isNotNull()).alias("shared"),
        F.col("_expected").isNotNull().alias("expected"),
    )
    lists = merged.groupBy("attribute").agg(
        count_where(F.col("expected")).alias("expected_groups"),
        count_where(F.col("shared") | ~F.col("expected")).alias("observed_groups"),
        F.array_join(
            F.array_sort(
                F.collect_list(F.when(F.col("expected") & ~F.col("shared"), F.col("group")))
            ),
            "|",
        ).alias("missing_groups"),
        count_where(~F.col("expected")).alias("unexpected_groups"),
        ratio(count_where(F.col("shared")), count_where(F.col("expected"))).alias(
            "coverage_ratio"
        ),
    )
    return lists.join(inclusion_scores(representation_gaps(counts, benchmark)), "attribute")


def unexpected_groups(counts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(attribute, group, n)`` of the groups the benchmark does not list."""
    covered = benchmark.select("attribute").distinct()
    listed = benchmark.select(F.col("attribute").alias("_a"), F.col("group").alias("_g"))
    same = (F.col("attribute") == F.col("_a")) & F.col("group").eqNullSafe(F.col("_g"))
    return counts.join(covered, "attribute", "left_semi").join(listed, same, "left_anti")


def diversity_level(shannon: Column, groups: Column) -> Column:
    level = F.lit("Very High Diversity")
    for limit, name in reversed(DIVERSITY_LEVELS):
        level = F.when(shannon < limit, name).otherwise(level)
    return F.when(groups == 1, "No Diversity (Monolithic)").otherwise(level)


def diversity_score(shannon: Column, evenness: Column, dominance: Column) -> Column:
    """Overall diversity between 0 and 1."""
    return (
        SHANNON_WEIGHT * F.least(shannon / SHANNON_SCALE, F.lit(1.0))
        + EVENNESS_WEIGHT * evenness
        + DOMINANCE_WEIGHT * (1 - dominance)
    )


def diversity(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Diversity indices of the group shares per attribute (and per further key).

    ``gini_simpson`` follows the original formula, which exceeds 1; ``gini_simpson_norm`` is the
    normalised index.
    """
    keys = [*by, "attribute"]
    p = F.col("share")
    rows = counts.groupBy(*keys).agg(F.sum("n").alias("sample_size"))
    sums = (
        group_shares(counts, by)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_groups"),
            (-F.sum(p * F.ln(p))).alias("shannon_diversity"),
            F.sum(p * p).alias("_squares"),
            F.max(p).alias("berger_parker_dominance"),
            F.sum(p * (p - 1)).alias("_signed"),
            count_where(p < MINORITY_SHARE).alias("minority_groups_count"),
        )
    )
    groups = F.col("total_groups").cast("double")
    many = F.col("total_groups") > 1
    shannon, squares = F.col("shannon_diversity"), F.col("_squares")
    evenness = F.when(many, F.try_divide(shannon, F.ln(groups))).otherwise(0.0)
    spread = 1 - F.try_divide(F.lit(1.0), groups)
    inverse = F.try_divide(F.lit(1.0), squares)
    return sums.join(rows, keys).select(
        *keys,
        "shannon_diversity",
        (1 - squares).alias("simpson_diversity"),
        F.when(many, 1 - F.try_divide(F.col("_signed"), spread)).otherwise(0.0).alias(
            "gini_simpson"
        ),
        F.when(many, F.try_divide(1 - squares, spread)).otherwise(0.0).alias("gini_simpson_norm"),
        inverse.alias("inverse_simpson"),
        "berger_parker_dominance",
        F.col("total_groups").alias("hill_0_richness"),
        F.exp(shannon).alias("hill_1_shannon_exp"),
        inverse.alias("hill_2_simpson_inv"),
        evenness.alias("evenness_pielou"),
        evenness.alias("evenness_shannon"),
        F.ln(inverse).alias("renyi_2_diversity"),
        (F.ln(groups) - shannon).alias("theil_diversity_index"),
        F.exp(shannon).alias("effective_groups"),
        "total_groups",
        F.col("berger_parker_dominance").alias("dominant_group_proportion"),
        "minority_groups_count",
        diversity_score(shannon, evenness, F.col("berger_parker_dominance")).alias(
            "diversity_score"
        ),
        diversity_level(shannon, F.col("total_groups")).alias("diversity_level"),
        "sample_size",
    )


def _period_measures(counts: DataFrame, period: str) -> DataFrame:
    return diversity(counts, (period,)).select(
        period,
        "attribute",
        "sample_size",
        "shannon_diversity",
        "simpson_diversity",
        F.col("total_groups").alias("num_groups"),
        F.col("berger_parker_dominance").alias("dominant_proportion"),
    )


def diversity_by_period(
    df: DataFrame,
    attributes: Sequence[str],
    order_key: str,
    periods: int = PERIODS,
    buffer_limit: int = BUFFER_LIMIT,
) -> DataFrame:
    """Diversity in equal consecutive chunks of the rows, the last one taking the remainder.

    ``order_key`` is a unique number that defines the row order. Only the key values at the chunk
    borders are needed, so nothing is sorted: the borders are exact order statistics, and each row
    compares its key with them.
    """
    total = df.count()
    size = total // periods
    border_ranks = [i * size for i in range(1, periods)] if size else []
    borders = []
    if border_ranks:
        found = order_statistics(df, {order_key: border_ranks}, buffer_limit)
        borders = [found[order_key][r] for r in border_ranks]
    position = sum((((quoted(order_key) >= F.lit(b)).cast("int")) for b in borders), F.lit(1))
    if not size:
        position = F.lit(periods)
    marked = df.withColumn("period", position.cast("int"))
    return _period_measures(attribute_counts(marked, attributes, ("period",)), "period")


def diversity_by_time(
    df: DataFrame, attributes: Sequence[str], time: str, duration: str
) -> DataFrame:
    """Diversity in fixed windows of a time column; ``period`` is the start of the window."""
    marked = df.withColumn("period", F.window(quoted(time), duration)["start"])
    return _period_measures(attribute_counts(marked, attributes, ("period",)), "period")


def diversity_trend(by_period: DataFrame) -> DataFrame:
    """First against last period per attribute: direction, strength and volatility."""
    first = F.min_by("shannon_diversity", "period")
    last = F.max_by("shannon_diversity", "period")
    return by_period.groupBy("attribute").agg(
        F.when(last > first, "Increasing")
        .when(last < first, "Decreasing")
        .otherwise("Stable")
        .alias("shannon_trend"),
        F.stddev_pop("shannon_diversity").alias("diversity_volatility"),
        F.abs(last - first).alias("trend_strength"),
    )


def diversity_by_subgroup(
    df: DataFrame, attributes: Sequence[str], subgroup: str | Column
) -> DataFrame:
    """Diversity inside every subgroup, in one job for all of them."""
    column = quoted(subgroup) if isinstance(subgroup, str) else subgroup
    marked = df.withColumn("subgroup", column.cast("string")).filter("subgroup is not null")
    return diversity(attribute_counts(marked, attributes, ("subgroup",)), ("subgroup",))


def subgroup_summary(by_subgroup: DataFrame) -> DataFrame:
    """Most and least diverse subgroup, range, mean and deviation per attribute."""
    score = F.col("diversity_score")
    return by_subgroup.groupBy("attribute").agg(
        F.min_by("subgroup", F.struct(-score, F.col("subgroup"))).alias("most_diverse_subgroup"),
        F.min_by("subgroup", F.struct(score, F.col("subgroup"))).alias("least_diverse_subgroup"),
        (F.max(score) - F.min(score)).alias("diversity_range"),
        F.avg(score).alias("average_diversity"),
        F.stddev_pop(score).alias("diversity_std"),
    )


def diversity_benchmark(measures: DataFrame) -> DataFrame:
    """Diversity against what the number of groups allows."""
    evenness, shannon = F.col("evenness_pielou"), F.col("shannon_diversity")
    efficiency = F.when(
        F.col("total_groups") > 1, F.try_divide(shannon, F.ln(F.col("total_groups")))
    ).otherwise(0.0)
    return measures.select(
        "attribute",
        efficiency.alias("shannon_efficiency"),
        F.when(evenness > 0.8, "Excellent")
        .when(evenness > 0.6, "Good")
        .when(evenness > 0.4, "Fair")
        .otherwise("Poor")
        .alias("evenness_rating"),
        F.when(shannon > 1.5, "Sufficient")
        .when(shannon > 1.0, "Moderate")
        .otherwise("Low")
        .alias("diversity_adequacy"),
        ((efficiency + evenness) / 2).alias("benchmark_score"),
    )


def diversity_recommendations(
    measures: DataFrame, trend: DataFrame, top: int | None = None
) -> DataFrame:
    """``(position, severity, attribute, value)``: what to improve; the first ``top`` entries, or all.

    Entries come attribute by attribute, rule by rule, then falling trends; ``MAINTAIN`` stands
    alone when nothing applies; three standing entries follow.
    """

    def entry(rank, severity, condition, value):
        return F.when(
            condition,
            F.struct(
                F.lit(rank).alias("rank"), F.lit(severity).alias("severity"),
                value.cast("double").alias("value"),
            ),
        )

    score, dominance = F.col("diversity_score"), F.col("berger_parker_dominance")
    evenness, shannon = F.col("evenness_pielou"), F.col("shannon_diversity")
    rules = F.array_compact(
        F.array(
            entry(1, "CRITICAL", score < 0.4, score),
            entry(2, "WARNING", dominance > 0.7, dominance),
            entry(3, "IMPROVE", evenness < 0.5, evenness),
            entry(4, "ENHANCE", shannon < 1.0, shannon),
        )
    )
    found = measures.select(F.lit(1).alias("block"), "attribute", F.inline(rules)).unionByName(
        trend.filter("shannon_trend = 'Decreasing'").select(
            F.lit(2).alias("block"), "attribute", F.lit(1).alias("rank"),
            F.lit("TREND ALERT").alias("severity"), F.col("trend_strength").alias("value"),
        )
    )
    nothing = found.agg(count_where(F.lit(True)).alias("c")).filter("c = 0")
    none = F.lit(None)

    def standing(block, rank, severity):
        return [
            F.lit(block).alias("block"), none.cast("string").alias("attribute"),
            F.lit(rank).alias("rank"), F.lit(severity).alias("severity"),
            none.cast("double").alias("value"),
        ]

    fixed = F.inline(
        F.array(
            *[F.struct(*standing(4, i, s)) for i, s in enumerate(("MONITOR", "BENCHMARK", "DOCUMENT"))]
        )
    )
    always = measures.agg(F.count("*").alias("c")).select(fixed)
    combined = (
        found.unionByName(nothing.select(*standing(3, 1, "MAINTAIN")))
        .unionByName(always)
    )
    if top is not None:
        combined = combined.orderBy("block", "attribute", "rank").limit(top)
    return combined.agg(
        F.array_sort(
            F.collect_list(F.struct("block", "attribute", "rank", "severity", "value"))
        ).alias("items")
    ).select(F.posexplode("items").alias("index", "item")).select(
        (F.col("index") + 1).alias("position"), "item.severity", "item.attribute", "item.value"
    )


def overall_assessment(measures: DataFrame, gaps: DataFrame) -> DataFrame:
    """Mean diversity, representation and inclusion, their combination and the bias level."""
    adequate = gaps.groupBy("attribute").agg(
        ratio(count_where(F.col("status").isin(*ADEQUATE_STATUS)), F.count("*")).alias("a")
    )
    diversity_mean = measures.agg(F.coalesce(F.avg("diversity_score"), F.lit(0.0)))
    representation_mean = adequate.agg(F.coalesce(F.avg("a"), F.lit(0.0)))
    inclusion_mean = inclusion_scores(gaps).agg(F.coalesce(F.avg("inclusion_score"), F.lit(0.0)))
    combined = F.col("combined_bias_score")
    level = F.lit("Severe Representation Bias")
    for limit, name in reversed(BIAS_LEVELS):
        level = F.when(combined >= limit, name).otherwise(level)
    return (
        diversity_mean.toDF("overall_diversity_score")
        .select(
            "overall_diversity_score",
            representation_mean.scalar().alias("overall_representation_score"),
            inclusion_mean.scalar().alias("overall_inclusion_score"),
        )
        .withColumn(
            "combined_bias_score",
            (
                F.col("overall_diversity_score")
                + F.col("overall_representation_score")
                + F.col("overall_inclusion_score")
            )
            / 3,
        )
        .withColumn("bias_level", level)
    )


def key_concerns(measures: DataFrame, gaps: DataFrame, top: int | None = None) -> DataFrame:
    """Under- and over-represented groups, then attributes of low diversity; the first ``top``,
    or all."""
    groups = gaps.filter(F.col("status").isin(*UNDER_STATUS, "Over-represented")).select(
        F.lit(1).alias("block"), "attribute", "group", F.lower("status").alias("concern")
    )
    low = measures.filter("diversity_score < 0.5").select(
        F.lit(2).alias("block"), "attribute", F.lit(None).cast("string").alias("group"),
        F.lit("low diversity").alias("concern"),
    )
    concerns = groups.unionByName(low)
    if top is not None:
        concerns = concerns.orderBy("block", "attribute", "group").limit(top)
    return concerns.select("attribute", "group", "concern")


def age_band(age: Column) -> Column:
    """The age bands a population benchmark uses."""
    return (
        F.when(age < 18, "Under-18")
        .when(age < 25, "18-24")
        .when(age < 35, "25-34")
        .when(age < 45, "35-44")
        .when(age < 55, "45-54")
        .when(age < 65, "55-64")
        .when(age >= 65, "65+")
    )


def representation_report(
    df: DataFrame, attributes: Sequence[str], benchmark: DataFrame
) -> dict[str, DataFrame]:
    """All representation tables by name, derived from one count table."""
    counts = attribute_counts(df, attributes)
    measures = diversity(counts)
    gaps = representation_gaps(counts, benchmark)
    return {
        "counts": counts,
        "distribution": distribution_summary(counts),
        "gaps": gaps,
        "inclusion": inclusion_gaps(counts, benchmark),
        "diversity": measures,
        "benchmark": diversity_benchmark(measures),
        "assessment": overall_assessment(measures, gaps),
        "concerns": key_concerns(measures, gaps),
    }
