"""Fairness and representation, including undefined rates and absent groups."""

import math

from pyspark.sql import functions as F

from vetframe.operators import fairness, representation as rep


def _preds(spark):
    rows = []
    for group, truth, pred, n in [
        ("m", 1, 1, 30), ("m", 1, 0, 10), ("m", 0, 1, 10), ("m", 0, 0, 50),
        ("f", 1, 1, 5), ("f", 1, 0, 15), ("f", 0, 0, 30), ("x", 0, 0, 4), (None, 1, 1, 6),
    ]:
        rows += [(group, truth, pred, 0.9 if pred else 0.1)] * n
    return spark.createDataFrame(rows, "g string, y_true int, y_pred int, score double")


def test_parity_opportunity_and_impact(spark):
    counts = fairness.group_counts(_preds(spark), ["g"])
    parity = {r.group: r for r in fairness.demographic_parity(counts).collect()}
    assert set(parity) == {"m", "f", "x"}
    assert math.isclose(parity["f"].ratio_vs_ref, 0.25) and parity["x"].selection_rate == 0
    chances = {r.group: r for r in fairness.equal_opportunity(counts).collect()}
    assert chances["x"].tpr is None and math.isclose(chances["f"].diff_vs_ref, -0.5)
    impact = fairness.disparate_impact(counts).first()
    assert (impact.reference_group, impact.worst_group, impact.di_ratio) == ("m", "x", 0.0)
    criteria = fairness.fairness_criteria(counts).first()
    assert math.isclose(criteria.dp_gap, 0.4) and math.isclose(criteria.eo_gap, 0.5)
    assert math.isclose(criteria.accuracy, (30 + 50 + 5 + 30 + 4 + 6) / 160)
    assert fairness.fairness_verdict(fairness.fairness_criteria(counts)).first().verdict == "fail"


def test_zero_or_absent_reference(spark):
    counts = fairness.group_counts(_preds(spark), ["g"])
    zero = fairness.disparate_impact(counts, {"g": "x"}).first()
    assert zero.di_ratio is None and zero.worst_group == "f"
    absent = fairness.demographic_parity(counts, {"g": "none"}).collect()
    assert all(r.diff_vs_ref is None and r.ratio_vs_ref is None for r in absent)
    assert fairness.missing_privileged(counts, {"g": "none"}).count() == 1
    assert fairness.fairness_criteria(counts, {"g": "none"}).first().pass_di == 0


def test_sweep_equals_criteria_at_each_threshold(spark):
    df = spark.range(400).select(
        (F.col("id") % 4).cast("string").alias("g"),
        ((F.col("id") % 7) < 3).cast("int").alias("y_true"),
        ((F.col("id") * 37 % 101) / 100.0).alias("score"),
    )
    grid = [0.1, 0.35, 0.5, 0.9]
    swept = {r.threshold: r for r in fairness.tradeoffs(df, ["g"], grid).collect()}
    for t in grid:
        marked = df.withColumn("y_pred", (F.col("score") >= t).cast("int"))
        alone = fairness.fairness_criteria(fairness.group_counts(marked, ["g"])).first()
        for c in ("dp_gap", "eo_gap", "di_ratio", "accuracy"):
            assert math.isclose(alone[c], swept[t][c])
    assert len(fairness.threshold_grid()) == 19 and fairness.threshold_grid()[-1] == 0.95


def test_intersections_keep_missing_values(spark):
    got = {r.intersection_group: r for r in fairness.intersectional(_preds(spark), ["g"]).collect()}
    assert got["nan"]["count"] == 6 and got["nan"].selection_rate_gap_vs_best == 0.0


def test_subgroup_gaps_and_score(spark):
    gaps = fairness.subgroup_gaps(fairness.group_counts(_preds(spark), ["g"]))
    assert {r.metric: round(r.gap, 3) for r in gaps.collect()}["equal_opportunity_gap"] == 0.75
    assert fairness.fairness_score(gaps).first().score == 70.0
    assert fairness.fairness_score(gaps.limit(0)).first().score == 80.0


def test_report_holds_all_tables(spark):
    report = fairness.fairness_report(_preds(spark), ["g"])
    assert report["findings"].count() == 0 and report["criteria"].count() == 1


def _groups(spark, sizes):
    rows = [(g,) for g, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame(rows, "g string")


def test_uniform_groups(spark):
    got = rep.diversity(rep.attribute_counts(_groups(spark, {"a": 5, "b": 5}), ["g"])).first()
    assert math.isclose(got.gini_simpson, 2.0) and math.isclose(got.gini_simpson_norm, 1.0)
    assert math.isclose(got.shannon_diversity, math.log(2)) and math.isclose(got.evenness_pielou, 1)
    assert got.hill_0_richness >= got.hill_1_shannon_exp - 1e-9 >= got.hill_2_simpson_inv - 2e-9


def test_single_group_is_monolithic(spark):
    counts = rep.attribute_counts(_groups(spark, {"a": 5}), ["g"])
    got = rep.diversity(counts).first()
    assert got.diversity_level == "No Diversity (Monolithic)" and got.evenness_pielou == 0
    assert rep.distribution_summary(counts).first().dominance_ratio == 1.0


def test_gaps_inclusion_and_concerns(spark):
    counts = rep.attribute_counts(_groups(spark, {"a": 80, "b": 20, None: 10}), ["g"])
    bench = rep.benchmark_frame(counts, {"g": {"a": 0.5, "b": 0.3, "c": 0.2}, "other": {"z": 1.0}})
    gaps = {r.group: r for r in rep.representation_gaps(counts, bench).collect()}
    assert set(gaps) == {"a", "b", "c"}
    assert gaps["a"].status == "Over-represented" and gaps["c"].observed_share == 0.0
    assert gaps["b"].status == "Severely Under-represented"
    row = rep.inclusion_gaps(counts, bench).first()
    assert row.missing_groups == "c" and row.unexpected_groups == 1 and row.observed_groups == 3
    assert math.isclose(row.coverage_ratio, 2 / 3) and math.isclose(row.inclusion_score, 1 - 0.6)
    assert rep.unexpected_groups(counts, bench).first().group is None
    concerns = rep.key_concerns(rep.diversity(counts), rep.representation_gaps(counts, bench))
    assert concerns.count() == 4


def test_zero_expected_share_is_infinite(spark):
    counts = rep.attribute_counts(_groups(spark, {"a": 1}), ["g"])
    bench = rep.benchmark_frame(counts, {"g": {"a": 0.0}})
    assert rep.representation_gaps(counts, bench).first().representation_ratio == float("inf")


def test_last_period_takes_the_remainder(spark):
    df = spark.range(23).select("id", F.when(F.col("id") < 12, "a").otherwise("b").alias("g"))
    for limit in (2, 1000):
        found = rep.diversity_by_period(df, ["g"], "id", buffer_limit=limit).orderBy("period").collect()
        assert [r.sample_size for r in found] == [4, 4, 4, 4, 7]
    tiny = rep.diversity_by_period(df.limit(3), ["g"], "id").collect()
    assert [r.period for r in tiny] == [5]


def test_recommendations(spark):
    counts = rep.attribute_counts(_groups(spark, {"a": 95, "b": 5}), ["g"])
    trend = spark.createDataFrame([("g", "Decreasing", 0.1, 0.2)], "attribute string, shannon_trend string, diversity_volatility double, trend_strength double")
    got = [r.severity for r in rep.diversity_recommendations(rep.diversity(counts), trend).collect()]
    assert got == ["CRITICAL", "WARNING", "IMPROVE", "ENHANCE", "TREND ALERT", "MONITOR", "BENCHMARK", "DOCUMENT"]
    even = rep.attribute_counts(_groups(spark, {c: 5 for c in "abcdefgh"}), ["g"])
    steady = trend.withColumn("shannon_trend", F.lit("Stable"))
    got = [r.severity for r in rep.diversity_recommendations(rep.diversity(even), steady).collect()]
    assert got == ["MAINTAIN", "MONITOR", "BENCHMARK", "DOCUMENT"]


def test_age_bands(spark):
    df = spark.createDataFrame([(17,), (18,), (44,), (65,), (None,)], "age int")
    assert [r[0] for r in df.select(rep.age_band(F.col("age"))).collect()] == [
        "Under-18", "18-24", "35-44", "65+", None,
    ]
