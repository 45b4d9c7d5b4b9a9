"""Queries on groups: representation, diversity and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness, representation as rep
from . import views as V
from .views import BENCH, PEOPLE, PEOPLE_ATTRIBUTES, PEOPLE_COUNTS, PREDS, PREDS_DOCS, SHARES, r6, union_all

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- representation

_COUNT_CTES = "WITH " + ", ".join((PEOPLE, PEOPLE_COUNTS, SHARES))
_GAPS = """gaps AS (SELECT attribute, "group", observed_share, expected_share,
    observed_share / expected_share AS representation_ratio,
    observed_share - expected_share AS absolute_gap,
    100e0 * (observed_share - expected_share) / expected_share AS relative_gap_percent,
    CASE WHEN observed_share / expected_share < 0.7e0 THEN 'Severely Under-represented'
      WHEN observed_share / expected_share < 0.85e0 THEN 'Under-represented'
      WHEN observed_share / expected_share > 1.3e0 THEN 'Over-represented'
      WHEN observed_share / expected_share > 1.15e0 THEN 'Slightly Over-represented'
      ELSE 'Adequately Represented' END AS status
  FROM (SELECT b.attribute, b.grp AS "group", coalesce(s.share, 0e0) AS observed_share, expected_share
    FROM bench b LEFT JOIN shares s ON b.attribute = s.attribute AND b.grp = s.grp))"""
_INCLUSION = """inclusion AS (SELECT attribute,
    sum((1 - abs(absolute_gap) / expected_share) * expected_share) / sum(expected_share)
      AS inclusion_score FROM gaps GROUP BY attribute)"""
_GAP_CTES = "WITH " + ", ".join((PEOPLE, PEOPLE_COUNTS, SHARES, BENCH, _GAPS, _INCLUSION))


def _counts(spark, sf_dir):
    return rep.attribute_counts(V.people(spark, sf_dir), PEOPLE_ATTRIBUTES)


def _bench(spark, sf_dir):
    return rep.benchmark_frame(V.people(spark, sf_dir), V.BENCHMARK)


@query(
    "group_shares",
    _COUNT_CTES + f' SELECT attribute, grp AS "group", n, {r6("share")} AS share FROM shares',
)
def group_shares(spark, sf_dir):
    return V.rounded(rep.group_shares(_counts(spark, sf_dir)))


@query(
    "distribution_summary",
    _COUNT_CTES + f"""
SELECT attribute, CAST(count(*) AS BIGINT) AS unique_values,
  first(grp ORDER BY n DESC, grp) AS most_common, first(grp ORDER BY n, grp DESC) AS least_common,
  {r6('CAST(max(n) AS DOUBLE) / min(n)')} AS dominance_ratio,
  CAST(CAST(max(n) AS DOUBLE) / min(n) > 2 AS INTEGER) AS dominance_warning
FROM shares GROUP BY attribute""",
)
def distribution_summary(spark, sf_dir):
    return V.rounded(rep.distribution_summary(_counts(spark, sf_dir)))


@query(
    "representation_gaps",
    _GAP_CTES + ' SELECT attribute, "group", ' + ", ".join(
        f"{r6(c)} AS {c}"
        for c in (
            "observed_share", "expected_share", "representation_ratio", "absolute_gap",
            "relative_gap_percent",
        )
    ) + ", status FROM gaps",
)
def representation_gaps(spark, sf_dir):
    return V.rounded(rep.representation_gaps(_counts(spark, sf_dir), _bench(spark, sf_dir)))


@query(
    "representation_status",
    """SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN r < 0.7e0
  THEN 'Severely Under-represented' WHEN r < 0.85e0 THEN 'Under-represented'
  WHEN r > 1.3e0 THEN 'Over-represented' WHEN r > 1.15e0 THEN 'Slightly Over-represented'
  ELSE 'Adequately Represented' END AS status FROM (SELECT l_quantity / 25e0 AS r FROM lineitem))
GROUP BY 1""",
)
def representation_status(spark, sf_dir):
    value = F.col("l_quantity") / 25.0
    return (
        V.table(spark, sf_dir, "lineitem")
        .select(rep.representation_status(value).alias("status"))
        .groupBy("status")
        .agg(F.count("*").alias("n"))
    )


@query(
    "inclusion_gaps",
    _GAP_CTES + f""", merged AS (
  SELECT coalesce(b.attribute, c.attribute) AS attribute, b.grp AS e, b.attribute IS NOT NULL AS expected,
    c.attribute IS NOT NULL AS observed
  FROM bench b FULL OUTER JOIN (SELECT * FROM counts WHERE attribute IN (SELECT attribute FROM bench)) c
    ON b.attribute = c.attribute AND b.grp IS NOT DISTINCT FROM c.grp)
SELECT m.attribute, CAST(count(*) FILTER (WHERE expected) AS BIGINT) AS expected_groups,
  CAST(count(*) FILTER (WHERE observed) AS BIGINT) AS observed_groups,
  coalesce(string_agg(e, '|' ORDER BY e) FILTER (WHERE expected AND NOT observed), '') AS missing_groups,
  CAST(count(*) FILTER (WHERE NOT expected) AS BIGINT) AS unexpected_groups,
  {r6("count(*) FILTER (WHERE expected AND observed) / CAST(count(*) FILTER (WHERE expected) AS DOUBLE)")}
    AS coverage_ratio, {r6('any_value(inclusion_score)')} AS inclusion_score
FROM merged m JOIN inclusion i ON m.attribute = i.attribute GROUP BY m.attribute""",
)
def inclusion_gaps(spark, sf_dir):
    return V.rounded(rep.inclusion_gaps(_counts(spark, sf_dir), _bench(spark, sf_dir)))


@query(
    "unexpected_groups",
    _GAP_CTES + """ SELECT attribute, grp AS "group", n FROM counts c
WHERE attribute IN (SELECT attribute FROM bench) AND NOT EXISTS (
  SELECT 1 FROM bench b WHERE b.attribute = c.attribute AND b.grp IS NOT DISTINCT FROM c.grp)""",
)
def unexpected_groups(spark, sf_dir):
    return rep.unexpected_groups(_counts(spark, sf_dir), _bench(spark, sf_dir))


@query(
    "inclusion_scores",
    _GAP_CTES + f" SELECT attribute, {r6('inclusion_score')} AS inclusion_score FROM inclusion",
)
def inclusion_scores(spark, sf_dir):
    gaps = rep.representation_gaps(_counts(spark, sf_dir), _bench(spark, sf_dir))
    return V.rounded(rep.inclusion_scores(gaps))


def _diversity_sql(shares, rows, keys="attribute"):
    """Diversity measures from a share relation (keys, grp, n, share) and a size relation."""
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM z.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""diversity AS (SELECT {keys}, h AS shannon_diversity, 1 - sq AS simpson_diversity,
    CASE WHEN k > 1 THEN 1 - signed / (1 - 1e0 / k) ELSE 0 END AS gini_simpson,
    CASE WHEN k > 1 THEN (1 - sq) / (1 - 1e0 / k) ELSE 0 END AS gini_simpson_norm,
    1 / sq AS inverse_simpson, top AS berger_parker_dominance, k AS hill_0_richness,
    exp(h) AS hill_1_shannon_exp, 1 / sq AS hill_2_simpson_inv,
    CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END AS evenness_pielou,
    CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END AS evenness_shannon,
    ln(1 / sq) AS renyi_2_diversity, theil AS theil_diversity_index, exp(h) AS effective_groups,
    k AS total_groups, top AS dominant_group_proportion, small AS minority_groups_count,
    0.4e0 * least(h / 3, 1) + 0.3e0 * CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END
      + 0.3e0 * (1 - top) AS diversity_score,
    CASE WHEN k = 1 THEN 'No Diversity (Monolithic)' WHEN h < 0.5 THEN 'Very Low Diversity'
      WHEN h < 1 THEN 'Low Diversity' WHEN h < 1.5 THEN 'Moderate Diversity'
      WHEN h < 2 THEN 'High Diversity' ELSE 'Very High Diversity' END AS diversity_level,
    sample_size
  FROM (SELECT {picked}, CAST(count(*) AS BIGINT) AS k, -sum(share * ln(share)) AS h,
      sum(share * share) AS sq, max(share) AS top, sum(share * (share - 1)) AS signed,
      sum(share * ln(share * kk)) AS theil,
      CAST(count(*) FILTER (WHERE share < 0.1e0) AS BIGINT) AS small,
      any_value(z.sample_size) AS sample_size
    FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS kk FROM {shares}) s
      JOIN {rows} z ON {on} GROUP BY {picked}))"""


_SIZES = "sizes AS (SELECT attribute, CAST(sum(n) AS BIGINT) AS sample_size FROM counts GROUP BY 1)"
_DIVERSITY_CTES = _COUNT_CTES + ", " + _SIZES + ", " + _diversity_sql("shares", "sizes")
_MEASURES = (
    "shannon_diversity", "simpson_diversity", "gini_simpson", "gini_simpson_norm",
    "inverse_simpson", "berger_parker_dominance", "hill_1_shannon_exp", "hill_2_simpson_inv",
    "evenness_pielou", "evenness_shannon", "renyi_2_diversity", "theil_diversity_index",
    "effective_groups", "dominant_group_proportion", "diversity_score",
)
_MEASURE_LIST = ", ".join(f"{r6(m)} AS {m}" for m in _MEASURES) + (
    ", hill_0_richness, total_groups, minority_groups_count, diversity_level, sample_size"
)


@query("diversity", _DIVERSITY_CTES + f" SELECT attribute, {_MEASURE_LIST} FROM diversity")
def diversity(spark, sf_dir):
    return V.rounded(rep.diversity(_counts(spark, sf_dir)))


_PERIOD_COLUMNS = f"""sample_size, {r6('shannon_diversity')} AS shannon_diversity,
  {r6('simpson_diversity')} AS simpson_diversity, total_groups AS num_groups,
  {r6('berger_parker_dominance')} AS dominant_proportion"""


def _period_ctes(marked):
    return (
        f"WITH marked AS ({marked}), counts AS (SELECT period, 'event_type' AS attribute,"
        " event_type AS grp, CAST(count(*) AS BIGINT) AS n FROM marked GROUP BY 1, 3),"
        " shares AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY period, attribute)"
        " AS share FROM counts WHERE grp IS NOT NULL),"
        " sizes AS (SELECT period, attribute, CAST(sum(n) AS BIGINT) AS sample_size FROM counts"
        " GROUP BY 1, 2), " + _diversity_sql("shares", "sizes", "period, attribute")
    )


_CHUNKS = """SELECT *, CAST(least((row_number() OVER (ORDER BY event_id) - 1)
  // (SELECT count(*) // 5 FROM events), 4) + 1 AS INTEGER) AS period FROM events"""


@query(
    "diversity_by_period",
    _period_ctes(_CHUNKS) + f" SELECT period, attribute, {_PERIOD_COLUMNS} FROM diversity",
)
def diversity_by_period(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return V.rounded(rep.diversity_by_period(events, ["event_type"], "event_id"))


@query(
    "diversity_by_time",
    _period_ctes("SELECT *, date_trunc('day', ts) AS period FROM events")
    + f" SELECT CAST(period AS TIMESTAMP) AS period, attribute, {_PERIOD_COLUMNS} FROM diversity",
)
def diversity_by_time(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return V.rounded(rep.diversity_by_time(events, ["event_type"], "ts", "1 day"))


@query(
    "diversity_trend",
    _period_ctes(_CHUNKS) + f""" SELECT attribute, CASE WHEN b > a THEN 'Increasing'
  WHEN b < a THEN 'Decreasing' ELSE 'Stable' END AS shannon_trend,
  {r6('v')} AS diversity_volatility, {r6('abs(b - a)')} AS trend_strength
FROM (SELECT attribute, arg_min(shannon_diversity, period) AS a, arg_max(shannon_diversity, period) AS b,
  stddev_pop(shannon_diversity) AS v FROM diversity GROUP BY 1)""",
)
def diversity_trend(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return V.rounded(
        rep.diversity_trend(rep.diversity_by_period(events, ["event_type"], "event_id"))
    )


_SUBGROUP_CTES = (
    "WITH counts AS (SELECT CAST(user_id % 5 AS VARCHAR) AS subgroup, 'event_type' AS attribute,"
    " event_type AS grp, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 3),"
    " shares AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY subgroup, attribute)"
    " AS share FROM counts),"
    " sizes AS (SELECT subgroup, attribute, CAST(sum(n) AS BIGINT) AS sample_size FROM counts"
    " GROUP BY 1, 2), " + _diversity_sql("shares", "sizes", "subgroup, attribute")
)


def _by_subgroup(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return rep.diversity_by_subgroup(events, ["event_type"], F.col("user_id") % 5)


@query(
    "diversity_by_subgroup",
    _SUBGROUP_CTES + f" SELECT subgroup, attribute, {_MEASURE_LIST} FROM diversity",
)
def diversity_by_subgroup(spark, sf_dir):
    return V.rounded(_by_subgroup(spark, sf_dir))


@query(
    "subgroup_summary",
    _SUBGROUP_CTES + f""" SELECT attribute,
  first(subgroup ORDER BY diversity_score DESC, subgroup) AS most_diverse_subgroup,
  first(subgroup ORDER BY diversity_score, subgroup) AS least_diverse_subgroup,
  {r6('max(diversity_score) - min(diversity_score)')} AS diversity_range,
  {r6('avg(diversity_score)')} AS average_diversity, {r6('stddev_pop(diversity_score)')} AS diversity_std
FROM diversity GROUP BY attribute""",
)
def subgroup_summary(spark, sf_dir):
    return V.rounded(rep.subgroup_summary(_by_subgroup(spark, sf_dir)))


@query(
    "diversity_benchmark",
    _DIVERSITY_CTES + f""" SELECT attribute, {r6('evenness_pielou')} AS shannon_efficiency,
  CASE WHEN evenness_pielou > 0.8 THEN 'Excellent' WHEN evenness_pielou > 0.6 THEN 'Good'
    WHEN evenness_pielou > 0.4 THEN 'Fair' ELSE 'Poor' END AS evenness_rating,
  CASE WHEN shannon_diversity > 1.5 THEN 'Sufficient' WHEN shannon_diversity > 1 THEN 'Moderate'
    ELSE 'Low' END AS diversity_adequacy, {r6('evenness_pielou')} AS benchmark_score FROM diversity""",
)
def diversity_benchmark(spark, sf_dir):
    return V.rounded(rep.diversity_benchmark(rep.diversity(_counts(spark, sf_dir))))


#: Shannon diversity of the first (a) and last (b) fifth of the customers, by attribute.
_PEOPLE_TREND = (
    "fifths AS (SELECT *, least((row_number() OVER (ORDER BY c_custkey) - 1)"
    " // (SELECT count(*) // 5 FROM people), 4) + 1 AS period FROM people), cells AS ("
    + union_all(
        f"SELECT period, '{a}' AS attribute, {a} AS grp, count(*) AS n FROM fifths"
        f" WHERE {a} IS NOT NULL GROUP BY 1, 3"
        for a in PEOPLE_ATTRIBUTES
    )
    + "), parts AS (SELECT period, attribute, n / sum(n) OVER (PARTITION BY period, attribute) AS p"
    " FROM cells), entropies AS (SELECT period, attribute, -sum(p * ln(p)) AS h FROM parts"
    " GROUP BY 1, 2), trend AS (SELECT attribute, arg_min(h, period) AS a, arg_max(h, period) AS b"
    " FROM entropies GROUP BY 1)"
)


@query(
    "diversity_recommendations",
    _DIVERSITY_CTES + ", " + _PEOPLE_TREND + """, rules AS (
  SELECT 1 AS block, attribute, 1 AS rank, 'CRITICAL' AS severity, diversity_score AS value
    FROM diversity WHERE diversity_score < 0.4
  UNION ALL SELECT 1, attribute, 2, 'WARNING', berger_parker_dominance FROM diversity
    WHERE berger_parker_dominance > 0.7
  UNION ALL SELECT 1, attribute, 3, 'IMPROVE', evenness_pielou FROM diversity WHERE evenness_pielou < 0.5
  UNION ALL SELECT 1, attribute, 4, 'ENHANCE', shannon_diversity FROM diversity WHERE shannon_diversity < 1
  UNION ALL SELECT 2, attribute, 1, 'TREND ALERT', abs(b - a) FROM trend WHERE b < a
  UNION ALL SELECT 4, NULL, 0, 'MONITOR', NULL UNION ALL SELECT 4, NULL, 1, 'BENCHMARK', NULL
  UNION ALL SELECT 4, NULL, 2, 'DOCUMENT', NULL),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY block, attribute, rank) AS INTEGER) AS position, *
  FROM rules)
SELECT position, severity, attribute, round(value, 6) AS value FROM numbered""",
)
def diversity_recommendations(spark, sf_dir):
    people = V.people(spark, sf_dir)
    trend = rep.diversity_trend(rep.diversity_by_period(people, PEOPLE_ATTRIBUTES, "c_custkey"))
    return V.rounded(
        rep.diversity_recommendations(rep.diversity(_counts(spark, sf_dir)), trend)
    )


_ASSESSMENT_CTES = (
    "WITH " + ", ".join((PEOPLE, PEOPLE_COUNTS, SHARES, BENCH, _GAPS, _INCLUSION, _SIZES))
    + ", " + _diversity_sql("shares", "sizes")
)


@query(
    "overall_assessment",
    _ASSESSMENT_CTES + f""", parts AS (SELECT (SELECT avg(diversity_score) FROM diversity) AS d,
  (SELECT avg(a) FROM (SELECT count(*) FILTER (WHERE status IN
    ('Adequately Represented', 'Slightly Over-represented')) / CAST(count(*) AS DOUBLE) AS a
    FROM gaps GROUP BY attribute)) AS r,
  (SELECT avg(inclusion_score) FROM inclusion) AS i)
SELECT {r6('d')} AS overall_diversity_score, {r6('r')} AS overall_representation_score,
  {r6('i')} AS overall_inclusion_score, {r6('(d + r + i) / 3')} AS combined_bias_score,
  CASE WHEN (d + r + i) / 3 >= 0.8 THEN 'Low Representation Bias'
    WHEN (d + r + i) / 3 >= 0.6 THEN 'Moderate Representation Bias'
    WHEN (d + r + i) / 3 >= 0.4 THEN 'High Representation Bias'
    ELSE 'Severe Representation Bias' END AS bias_level FROM parts""",
)
def overall_assessment(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    gaps = rep.representation_gaps(counts, _bench(spark, sf_dir))
    return V.rounded(rep.overall_assessment(rep.diversity(counts), gaps))


@query(
    "key_concerns",
    _ASSESSMENT_CTES + """, concerns AS (
  SELECT 1 AS block, attribute, "group", lower(status) AS concern FROM gaps
    WHERE status IN ('Severely Under-represented', 'Under-represented', 'Over-represented')
  UNION ALL SELECT 2, attribute, NULL, 'low diversity' FROM diversity WHERE diversity_score < 0.5)
SELECT attribute, "group", concern FROM concerns""",
)
def key_concerns(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    gaps = rep.representation_gaps(counts, _bench(spark, sf_dir))
    return rep.key_concerns(rep.diversity(counts), gaps)


@query(
    "representation_report",
    _ASSESSMENT_CTES + f""" SELECT d.attribute, total_groups, {r6('diversity_score')} AS diversity_score,
  {r6('inclusion_score')} AS inclusion_score, CAST(below AS BIGINT) AS under_represented
FROM diversity d LEFT JOIN inclusion i ON d.attribute = i.attribute
LEFT JOIN (SELECT attribute, count(*) FILTER (WHERE status IN ('Severely Under-represented',
  'Under-represented')) AS below FROM gaps GROUP BY 1) g ON d.attribute = g.attribute""",
)
def representation_report(spark, sf_dir):
    report = rep.representation_report(
        V.people(spark, sf_dir), PEOPLE_ATTRIBUTES, _bench(spark, sf_dir)
    )
    below = report["gaps"].groupBy("attribute").agg(
        F.count(F.when(F.col("status").isin(*rep.UNDER_STATUS), F.lit(1))).alias(
            "under_represented"
        )
    )
    return V.rounded(
        report["diversity"]
        .select("attribute", "total_groups", "diversity_score")
        .join(report["inclusion"].select("attribute", "inclusion_score"), "attribute", "left")
        .join(below, "attribute", "left")
    )


# ---------------------------------------------------------------- fairness

_ATTRIBUTES = ["a1", "a2", "a3"]


def _fair_counts_sql(source, attributes):
    return "fc AS (" + union_all(
        f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, CAST(count(*) AS BIGINT) AS n,"
        f" CAST(sum(y_true) AS BIGINT) AS positives, CAST(sum(y_pred) AS BIGINT) AS selected,"
        f" CAST(sum(y_true * y_pred) AS BIGINT) AS hits,"
        f" CAST(count(*) FILTER (WHERE y_true = y_pred) AS BIGINT) AS correct"
        f" FROM {source} GROUP BY {a}"
        for a in attributes
    ) + ")"


_RATES = """rates AS (SELECT *, CAST(selected AS DOUBLE) / n AS sr,
    CAST(hits AS DOUBLE) / nullif(positives, 0) AS tpr FROM fc WHERE grp IS NOT NULL)"""


def _refs_sql(privileged=None, keys="attribute"):
    fixed = "NULL"
    for a, g in (privileged or {}).items():
        fixed = f"CASE WHEN attribute = '{a}' THEN '{g}' ELSE {fixed} END"
    return (
        f"refs AS (SELECT {keys}, coalesce({fixed}, first(grp ORDER BY n DESC, grp)) AS ref"
        f" FROM rates GROUP BY {keys})"
    )


_FAIR_CTES = "WITH " + ", ".join((PREDS, _fair_counts_sql("preds", _ATTRIBUTES), _RATES, _refs_sql()))
_DOC_ATTRIBUTES = ["lang", "source"]
_DOC_PRIVILEGED = {"lang": "en"}
_DOC_CTES = "WITH " + ", ".join(
    (PREDS_DOCS, _fair_counts_sql("preds_docs", _DOC_ATTRIBUTES), _RATES, _refs_sql(_DOC_PRIVILEGED))
)


def _line_counts(spark, sf_dir):
    return fairness.group_counts(V.preds(spark, sf_dir), _ATTRIBUTES)


def _doc_counts(spark, sf_dir):
    return fairness.group_counts(V.preds_docs(spark, sf_dir), _DOC_ATTRIBUTES)


def _against_sql(rate, name):
    return f""" SELECT r.attribute, grp AS "group", {r6(rate)} AS {name}, n AS "count",
  {r6(f'hi - {rate}')} AS gap_vs_max, {r6(f'{rate} - lo')} AS gap_vs_min,
  {r6(f'{rate} - rr')} AS diff_vs_ref, {r6(f'{rate} / nullif(rr, 0)')} AS ratio_vs_ref
FROM rates r JOIN (SELECT x.attribute, max({rate}) AS hi, min({rate}) AS lo,
  max(CASE WHEN grp = ref THEN {rate} END) AS rr FROM rates x JOIN refs ON x.attribute = refs.attribute
  GROUP BY 1) e ON r.attribute = e.attribute"""


_IMPACT = """impact AS (SELECT attribute, any_value(ref) AS reference_group, any_value(rr) AS reference_rate,
    first(grp ORDER BY coalesce(ratio, 'inf'::DOUBLE), grp) FILTER (WHERE grp <> ref) AS worst_group,
    first(sr ORDER BY coalesce(ratio, 'inf'::DOUBLE), grp) FILTER (WHERE grp <> ref) AS worst_group_rate,
    first(ratio ORDER BY coalesce(ratio, 'inf'::DOUBLE), grp) FILTER (WHERE grp <> ref) AS di_ratio
  FROM (SELECT x.attribute, grp, ref, sr, rr, sr / nullif(rr, 0) AS ratio FROM rates x
    JOIN (SELECT y.attribute, any_value(ref) AS ref, max(CASE WHEN grp = ref THEN sr END) AS rr
      FROM rates y JOIN refs ON y.attribute = refs.attribute GROUP BY 1) z ON x.attribute = z.attribute)
  GROUP BY attribute)"""
_CRITERIA = """criteria AS (SELECT g.attribute, dp_gap, eo_gap, di_ratio, accuracy,
    CAST(coalesce(dp_gap <= 0.1e0, false) AS INTEGER) AS pass_dp,
    CAST(coalesce(eo_gap <= 0.1e0, false) AS INTEGER) AS pass_eo,
    CAST(coalesce(di_ratio >= 0.8e0, false) AS INTEGER) AS pass_di
  FROM (SELECT attribute, max(sr) - min(sr) AS dp_gap, max(tpr) - min(tpr) AS eo_gap FROM rates GROUP BY 1) g
  JOIN (SELECT attribute, CAST(sum(correct) AS DOUBLE) / sum(n) AS accuracy FROM fc GROUP BY 1) a
    ON g.attribute = a.attribute
  JOIN impact i ON g.attribute = i.attribute)"""
_CRITERIA_LIST = ", ".join(
    f"{r6(c)} AS {c}" for c in ("dp_gap", "eo_gap", "di_ratio", "accuracy")
) + ", pass_dp, pass_eo, pass_di"


@query(
    "reference_groups",
    _DOC_CTES + """ SELECT attribute, ref AS reference_group,
  CAST(attribute = 'lang' AS INTEGER) AS configured FROM refs""",
)
def reference_groups(spark, sf_dir):
    return fairness.reference_groups(_doc_counts(spark, sf_dir), _DOC_PRIVILEGED)


@query("demographic_parity", _FAIR_CTES + _against_sql("sr", "selection_rate"))
def demographic_parity(spark, sf_dir):
    return V.rounded(fairness.demographic_parity(_line_counts(spark, sf_dir)))


@query("demographic_parity_documents", _DOC_CTES + _against_sql("sr", "selection_rate"))
def demographic_parity_documents(spark, sf_dir):
    return V.rounded(fairness.demographic_parity(_doc_counts(spark, sf_dir), _DOC_PRIVILEGED))


@query("equal_opportunity", _FAIR_CTES + _against_sql("tpr", "tpr"))
def equal_opportunity(spark, sf_dir):
    return V.rounded(fairness.equal_opportunity(_line_counts(spark, sf_dir)))


@query("equal_opportunity_documents", _DOC_CTES + _against_sql("tpr", "tpr"))
def equal_opportunity_documents(spark, sf_dir):
    return V.rounded(fairness.equal_opportunity(_doc_counts(spark, sf_dir), _DOC_PRIVILEGED))


@query(
    "disparate_impact",
    _DOC_CTES + ", " + _IMPACT + f""" SELECT attribute, reference_group,
  {r6('reference_rate')} AS reference_rate, worst_group, {r6('worst_group_rate')} AS worst_group_rate,
  {r6('di_ratio')} AS di_ratio FROM impact""",
)
def disparate_impact(spark, sf_dir):
    return V.rounded(fairness.disparate_impact(_doc_counts(spark, sf_dir), _DOC_PRIVILEGED))


@query(
    "fairness_criteria",
    _FAIR_CTES + ", " + _IMPACT + ", " + _CRITERIA + f" SELECT attribute, {_CRITERIA_LIST} FROM criteria",
)
def fairness_criteria(spark, sf_dir):
    return V.rounded(fairness.fairness_criteria(_line_counts(spark, sf_dir)))


@query(
    "fairness_criteria_documents",
    _DOC_CTES + ", " + _IMPACT + ", " + _CRITERIA + f" SELECT attribute, {_CRITERIA_LIST} FROM criteria",
)
def fairness_criteria_documents(spark, sf_dir):
    return V.rounded(fairness.fairness_criteria(_doc_counts(spark, sf_dir), _DOC_PRIVILEGED))


@query(
    "fairness_verdict",
    _DOC_CTES + ", " + _IMPACT + ", " + _CRITERIA + f""" SELECT attribute, {_CRITERIA_LIST},
  CAST(pass_dp + pass_eo + pass_di AS INTEGER) AS criteria_passed,
  CASE pass_dp + pass_eo + pass_di WHEN 3 THEN 'pass' WHEN 2 THEN 'warn' ELSE 'fail' END AS verdict
FROM criteria""",
)
def fairness_verdict(spark, sf_dir):
    criteria = fairness.fairness_criteria(_doc_counts(spark, sf_dir), _DOC_PRIVILEGED)
    return V.rounded(fairness.fairness_verdict(criteria))


@query(
    "intersectional",
    "WITH " + PREDS + f""", g AS (SELECT concat_ws('|', a1, a2, coalesce(a3, 'nan')) AS ig,
    CAST(count(*) AS BIGINT) AS n, avg(CAST(y_pred AS DOUBLE)) AS sr,
    CAST(sum(y_true * y_pred) AS DOUBLE) / nullif(sum(y_true), 0) AS tpr FROM preds GROUP BY 1)
SELECT ig AS intersection_group, {r6('sr')} AS selection_rate, {r6('tpr')} AS tpr, n AS "count",
  {r6('max(sr) OVER () - sr')} AS selection_rate_gap_vs_best,
  {r6('sr - min(sr) OVER ()')} AS selection_rate_gap_vs_worst,
  {r6('max(tpr) OVER () - tpr')} AS tpr_gap_vs_best, {r6('tpr - min(tpr) OVER ()')} AS tpr_gap_vs_worst
FROM g""",
)
def intersectional(spark, sf_dir):
    return V.rounded(fairness.intersectional(V.preds(spark, sf_dir), _ATTRIBUTES))


def _sweep_sql():
    """The criteria at each threshold, computed the long way: one pass per threshold."""
    grid = fairness.threshold_grid()
    values = ", ".join(f"({t:.17e})" for t in grid)
    counts = "fc AS (" + union_all(
        f"SELECT t AS threshold, '{a}' AS attribute, {a} AS grp, CAST(count(*) AS BIGINT) AS n,"
        f" CAST(sum(y_true) AS BIGINT) AS positives,"
        f" CAST(count(*) FILTER (WHERE score >= t) AS BIGINT) AS selected,"
        f" CAST(count(*) FILTER (WHERE score >= t AND y_true = 1) AS BIGINT) AS hits,"
        f" CAST(count(*) FILTER (WHERE CAST(score >= t AS INTEGER) = y_true) AS BIGINT) AS correct"
        f" FROM preds, grid GROUP BY ALL"
        for a in _ATTRIBUTES
    ) + ")"
    body = ", ".join((counts, _RATES, _refs_sql(keys="threshold, attribute"), _IMPACT, _CRITERIA))
    # The same relations as above, with the threshold as a further key.
    body = (
        body.replace("impact AS (SELECT attribute,", "impact AS (SELECT threshold, attribute,")
        .replace("SELECT x.attribute, grp, ref", "SELECT x.threshold, x.attribute, grp, ref")
        .replace("SELECT y.attribute, any_value(ref)", "SELECT y.threshold, y.attribute, any_value(ref)")
        .replace(
            "JOIN refs ON y.attribute = refs.attribute GROUP BY 1) z ON x.attribute = z.attribute)",
            "JOIN refs ON y.attribute = refs.attribute AND y.threshold = refs.threshold GROUP BY 1, 2) z"
            " ON x.attribute = z.attribute AND x.threshold = z.threshold)",
        )
        .replace("GROUP BY attribute)", "GROUP BY threshold, attribute)")
        .replace("criteria AS (SELECT g.attribute", "criteria AS (SELECT g.threshold, g.attribute")
        .replace("(SELECT attribute, max(sr)", "(SELECT threshold, attribute, max(sr)")
        .replace("FROM rates GROUP BY 1) g", "FROM rates GROUP BY 1, 2) g")
        .replace("(SELECT attribute, CAST(sum(correct)", "(SELECT threshold, attribute, CAST(sum(correct)")
        .replace("FROM fc GROUP BY 1) a", "FROM fc GROUP BY 1, 2) a")
        .replace("ON g.attribute = a.attribute", "ON g.attribute = a.attribute AND g.threshold = a.threshold")
        .replace(
            "ON g.attribute = i.attribute)",
            "ON g.attribute = i.attribute AND g.threshold = i.threshold)",
        )
    )
    return (
        f"WITH {PREDS}, grid(t) AS (VALUES {values}), {body}"
        f" SELECT {r6('threshold')} AS threshold, attribute, {_CRITERIA_LIST} FROM criteria"
    )


@query("fairness_tradeoffs", _sweep_sql())
def fairness_tradeoffs(spark, sf_dir):
    return V.rounded(fairness.tradeoffs(V.preds(spark, sf_dir), _ATTRIBUTES))


@query(
    "fairness_report",
    _DOC_CTES + ", " + _IMPACT + ", " + _CRITERIA + f""" SELECT c.attribute, {_CRITERIA_LIST},
  reference_group, worst_group, {r6('best')} AS highest_selection_rate
FROM criteria c JOIN impact i ON c.attribute = i.attribute
JOIN (SELECT attribute AS x, max(sr) AS best FROM rates GROUP BY 1) ON c.attribute = x""".replace(
        "di_ratio AS DOUBLE", "c.di_ratio AS DOUBLE"
    ),
)
def fairness_report(spark, sf_dir):
    report = fairness.fairness_report(V.preds_docs(spark, sf_dir), _DOC_ATTRIBUTES, _DOC_PRIVILEGED)
    highest = report["demographic_parity"].groupBy("attribute").agg(
        F.max("selection_rate").alias("highest_selection_rate")
    )
    impact = report["disparate_impact"].select("attribute", "reference_group", "worst_group")
    return V.rounded(
        report["criteria"].join(impact, "attribute").join(highest, "attribute")
    )


@query(
    "group_rates",
    _DOC_CTES + f""" SELECT attribute, grp AS "group", n AS "count",
  {r6('CAST(correct AS DOUBLE) / n')} AS accuracy, {r6('sr')} AS positive_rate,
  {r6('coalesce(tpr, 0)')} AS tpr FROM rates""",
)
def group_rates(spark, sf_dir):
    return V.rounded(fairness.group_rates(_doc_counts(spark, sf_dir)))


_SUBGROUP_GAPS = """sg AS (SELECT attribute, max(acc) - min(acc) AS subgroup_accuracy_gap,
    max(sr) - min(sr) AS demographic_parity_gap,
    max(coalesce(tpr, 0)) - min(coalesce(tpr, 0)) AS equal_opportunity_gap
  FROM (SELECT *, CAST(correct AS DOUBLE) / n AS acc FROM rates) GROUP BY attribute),
sgl AS (UNPIVOT sg ON subgroup_accuracy_gap, demographic_parity_gap, equal_opportunity_gap
  INTO NAME metric VALUE gap)"""


@query(
    "subgroup_gaps",
    _DOC_CTES + ", " + _SUBGROUP_GAPS + f""" SELECT attribute, metric, {r6('gap')} AS gap,
  CASE WHEN gap > 0.1 THEN 'warning' ELSE 'ok' END AS severity FROM sgl""",
)
def subgroup_gaps(spark, sf_dir):
    return V.rounded(fairness.subgroup_gaps(_doc_counts(spark, sf_dir)))


@query(
    "fairness_score",
    _DOC_CTES + ", " + _SUBGROUP_GAPS + """ SELECT 'fairness' AS agent,
  CAST(count(*) FILTER (WHERE gap > 0.1) AS BIGINT) AS warnings,
  CAST(greatest(40, 100 - 10 * count(*) FILTER (WHERE gap > 0.1)) AS DOUBLE) AS score FROM sgl""",
)
def fairness_score(spark, sf_dir):
    return fairness.fairness_score(fairness.subgroup_gaps(_doc_counts(spark, sf_dir)))


@query(
    "missing_privileged",
    _DOC_CTES + """ SELECT 'fairness' AS agent, 'warning' AS severity,
  'privileged_group_absent' AS code, a AS column_name, 'no rows in group ' || g AS message
FROM (VALUES ('lang', 'en'), ('source', 'absent')) v(a, g)
WHERE NOT EXISTS (SELECT 1 FROM fc WHERE attribute = a AND grp = g)""",
)
def missing_privileged(spark, sf_dir):
    return fairness.missing_privileged(
        _doc_counts(spark, sf_dir), {"lang": "en", "source": "absent"}
    )
