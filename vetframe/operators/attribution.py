"""Additive feature attributions: exact for linear models, Monte-Carlo Shapley for any model.

Attributions are long tables ``(key…, feature, phi)``. For a generic model each row is expanded
into hybrids of itself and a background row, the model scores all hybrids in one transform, and the
signed scores are summed back per row. The expansion stays next to its row, so the partial
aggregation collapses it before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, quoted
from ..functions.ordering import global_row_number, hash_order, lookup

# Fixed value: background size.
BACKGROUND_ROWS = 100
#: Hybrids of a row that are scored side by side; of more, each gets a row of its own.
IN_PLACE = 16


def background_sample(
    df: DataFrame, key: Sequence[str], size: int = BACKGROUND_ROWS, seed: int = 42
) -> DataFrame:
    """A repeatable sample of at most ``size`` rows."""
    return df.orderBy(hash_order(key, seed), *[quoted(k) for k in key]).limit(size)


def background_means(background: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = background.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return {c: float(row[f"m{i}"]) for i, c in enumerate(features)}


def _long(key: Sequence[str], df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(
        *key,
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("feature"), v.alias("phi")) for f, v in values.items()]
            )
        ),
    )


def linear_attributions(
    df: DataFrame,
    key: Sequence[str],
    weights: dict[str, float],
    means: dict[str, float],
    scales: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """phi = weight · (x − mean of the background), in the model's margin (log odds).

    ``scales`` gives ``(centre, scale)`` of a standardising step before the model; the weights then
    belong to the scaled features and the means are scaled alike.
    """
    values = {}
    for f, w in weights.items():
        scale = (scales or {}).get(f, (0.0, 1.0))[1]
        values[f] = (quoted(f).cast("double") - F.lit(float(means[f]))) * F.lit(float(w) / scale)
    return _long(key, df, values)


def base_value(weights: dict[str, float], means: dict[str, float], intercept: float) -> float:
    """The model's margin at the background mean."""
    return intercept + sum(weights[f] * means[f] for f in weights)


def global_importance(phi: DataFrame, top: int | None = None) -> DataFrame:
    """``(feature, mean_abs_phi)``, the most important features first; ``top`` of them, or all."""
    ranked = (
        phi.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
        .orderBy(F.col("mean_abs_phi").desc(), "feature")
    )
    return ranked if top is None else ranked.limit(top)


def local_explanations(
    df: DataFrame,
    key: Sequence[str],
    weights: dict[str, float],
    means: dict[str, float],
    intercept: float = 0.0,
) -> DataFrame:
    """For every row its contributions, largest first, with the running margin.

    ``(key…, position, feature, phi, margin_before, margin_after)``. A row's contributions are
    ranked inside the row, so there is no shuffle.
    """
    items = F.array(
        *[
            F.struct(
                F.abs(
                    (quoted(f).cast("double") - F.lit(float(means[f]))) * F.lit(float(w))
                ).alias("size"),
                F.lit(f).alias("feature"),
                (
                    (quoted(f).cast("double") - F.lit(float(means[f]))) * F.lit(float(w))
                ).alias("phi"),
            )
            for f, w in weights.items()
        ]
    )
    ranked = F.array_sort(
        items,
        lambda a, b: F.when(a["size"] > b["size"], -1)
        .when(a["size"] < b["size"], 1)
        .when(a["feature"] < b["feature"], -1)
        .otherwise(1),
    )
    base = F.lit(base_value(weights, means, intercept))
    rows = df.select(*key, ranked.alias("_items")).select(
        *key, "_items", F.posexplode("_items").alias("_at", "_item")
    )

    def margin(length):
        return F.aggregate(F.slice("_items", F.lit(1), length), base, lambda s, i: s + i["phi"])

    return rows.select(
        *key,
        (F.col("_at") + 1).alias("position"),
        F.col("_item.feature").alias("feature"),
        F.col("_item.phi").alias("phi"),
        margin(F.col("_at")).alias("margin_before"),
        margin(F.col("_at") + 1).alias("margin_after"),
    )


def compare_models(phi: DataFrame, models: Sequence[str], top: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature and model, 0 where a model lacks the feature.

    ``phi`` carries a ``model`` column. Features rank by their average over the models;
    ``top`` of them are kept, or all.
    """
    wide = (
        phi.groupBy("feature")
        .pivot("model", list(models))
        .agg(F.avg(F.abs("phi")))
        .na.fill(0.0, list(models))
    )
    average = sum((quoted(m) for m in models), F.lit(0.0)) / len(models)
    ranked = wide.withColumn("average", average).orderBy(F.col("average").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


Scorer = Callable[[DataFrame, str], DataFrame]


def _permuted(
    df: DataFrame, key: Sequence[str], features: Sequence[str], background: DataFrame, seed: int,
    permutations: int,
) -> DataFrame:
    """One row per (row, permutation): its values, a background row and every feature's draw ``_h``.

    The background may be of any size: its rows are numbered in a repeatable order, and every
    (row, permutation) looks its pick up by number. Rows are brought together by key first, before they are
    multiplied, so that what is summed for a key later needs no shuffle and no table of a whole file's keys.
    """
    values = F.array(*[quoted(f).cast("double") for f in features])
    by_value = [F.xxhash64("_b"), F.col("_b")]
    table = lookup(global_row_number(background.select(values.alias("_b")), by_value, "_pick"))
    rows = table.count()
    if not rows:
        raise ValueError("the background holds no rows")
    keys = [quoted(k) for k in key]
    drawn = [
        F.xxhash64(*keys, F.col("_perm"), F.lit(j), F.lit(seed)).alias("h") for j in range(len(features))
    ]
    pick = F.pmod(F.xxhash64(*keys, F.col("_perm"), F.lit(seed + 1)), F.lit(rows))
    return (
        df.select(*key, values.alias("_x"))
        .repartition(*keys)
        .withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .select("*", F.array(*drawn).alias("_h"), (pick + 1).alias("_pick"))
        .join(table, "_pick")
        .drop("_pick")
    )


def _ordered(permuted: DataFrame, features: int) -> DataFrame:
    """With ``_order``: the features by their draws."""
    order = F.transform(
        F.array_sort(
            F.array(
                *[F.struct(F.get("_h", F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(features)]
            )
        ),
        lambda s: s["j"],
    )
    return permuted.withColumn("_order", order).drop("_h")


def _place(j: int, features: int) -> Column:
    """How many features come before feature ``j``; of equal draws the first."""
    own = F.get("_h", F.lit(j))
    before = [
        (F.get("_h", F.lit(i)) <= own) if i < j else (F.get("_h", F.lit(i)) < own)
        for i in range(features) if i != j
    ]
    return sum((b.cast("int") for b in before), F.lit(0))


def _known_sum(values: Sequence[Column]) -> Column:
    """The sum of the values that are not NULL, as the aggregate has it."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(F.coalesce(*values).isNotNull(), total)


def _scored_in_place(df: DataFrame, hybrids: Sequence[Sequence[Column]], score: Scorer) -> DataFrame:
    """The table with ``_v0``, ``_v1``, ...: the scores of hybrids given by whether a feature is the row's."""
    out = df
    for i, from_row in enumerate(hybrids):
        values = [
            F.when(own, F.get("_x", F.lit(j))).otherwise(F.get("_b", F.lit(j)))
            for j, own in enumerate(from_row)
        ]
        scored = score(out.withColumn("_features", F.array(*values)), "_features")
        out = scored.drop("_features").withColumnRenamed("_value", f"_v{i}")
    return out


def shapley_values(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    background: DataFrame,
    score: Scorer,
    permutations: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Monte-Carlo Shapley values ``(key…, feature, phi)`` of any model.

    ``score(frame, column)`` adds a ``_value`` column with the model output for the feature array
    in ``column``. Along a random feature order, a feature's contribution is the score after it
    takes the row's value less the score before, so every hybrid is scored once and enters the
    sum twice, with opposite signs. Up to ``IN_PLACE`` hybrids are scored side by side in their row.
    """
    d = len(features)
    permuted = _permuted(df, key, features, background, seed, permutations)
    names = F.array(*[F.lit(f) for f in features])
    if 0 < d < IN_PLACE and len(set(features)) == d:
        places = permuted.select("*", *[_place(j, d).alias(f"_place{j}") for j in range(d)]).drop("_h")
        steps = [[F.col(f"_place{j}") < step for j in range(d)] for step in range(d + 1)]
        scored = _scored_in_place(places, steps, score)
        values = F.array(*[F.col(f"_v{step}") for step in range(d + 1)])
        sums = scored.groupBy(*key).agg(
            *[
                (
                    F.sum(
                        _known_sum(
                            [F.get(values, F.col(f"_place{j}") + 1), -F.get(values, F.col(f"_place{j}"))]
                        )
                    )
                    / permutations
                ).alias(f"_phi{j}")
                for j in range(d)
            ]
        )
        return _long(key, sums, {f: F.col(f"_phi{j}") for j, f in enumerate(features)})
    expanded = _ordered(permuted, d).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    hybrid = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(
            F.array_position("_order", j) <= F.col("_step"), F.get("_x", j)
        ).otherwise(F.get("_b", j)),
    )
    scored = score(expanded.withColumn("_features", hybrid), "_features")
    signed = F.array_compact(
        F.array(
            F.when(
                F.col("_step") > 0,
                F.struct(F.get("_order", F.col("_step") - 1).alias("j"), F.col("_value").alias("v")),
            ),
            F.when(
                F.col("_step") < d,
                F.struct(F.get("_order", F.col("_step")).alias("j"), (-F.col("_value")).alias("v")),
            ),
        )
    )
    return (
        scored.select(*key, F.inline(signed))
        .groupBy(*key, F.get(names, F.col("j")).alias("feature"))
        .agg((F.sum("v") / permutations).alias("phi"))
    )


def _pair_effects(per_row: DataFrame) -> DataFrame:
    return per_row.groupBy("feature_a", "feature_b").agg(
        F.avg(F.abs("value")).alias("mean_abs_interaction"),
        F.avg("value").alias("mean_interaction"),
        count_where(F.col("value") != 0).alias("rows_interacting"),
    )


def shapley_interactions(
    df: DataFrame,
    key: Sequence[str],
    features: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    background: DataFrame,
    score: Scorer,
    permutations: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Monte-Carlo Shapley interaction index ``(feature_a, feature_b, mean_abs, mean)`` per pair.

    For a random set of other features taken from the row, the index is the second difference of
    the score in the pair.
    """
    d = len(features)
    index = {f: i for i, f in enumerate(features)}
    permuted = _permuted(df, key, features, background, seed, permutations)
    if 0 < 4 * len(pairs) <= IN_PLACE and len(set(pairs)) == len(pairs) and len(index) == d:
        places = permuted.select("*", *[_place(j, d).alias(f"_place{j}") for j in range(d)]).drop("_h")

        def used(a, b, use_a, use_b):
            before = [F.col(f"_place{j}") < F.col(f"_place{index[a]}") for j in range(d)]
            # The first of the pair decides, as it does where both names are one feature.
            return [
                F.lit(use_a) if j == index[a] else F.lit(use_b) if j == index[b] else before[j]
                for j in range(d)
            ]

        both = [(True, True), (True, False), (False, True), (False, False)]
        hybrids = [used(a, b, *use) for a, b in pairs for use in both]
        scored = _scored_in_place(places, hybrids, score)
        v = [F.col(f"_v{i}") for i in range(len(hybrids))]
        sums = scored.groupBy(*key).agg(
            *[
                (
                    F.sum(_known_sum([v[4 * i], -v[4 * i + 1], -v[4 * i + 2], v[4 * i + 3]])) / permutations
                ).alias(f"_pair{i}")
                for i in range(len(pairs))
            ]
        )
        per_row = sums.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                            F.col(f"_pair{i}").alias("value"),
                        )
                        for i, (a, b) in enumerate(pairs)
                    ]
                )
            )
        )
        return _pair_effects(per_row)
    cases = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                F.lit(index[a]).alias("ia"), F.lit(index[b]).alias("ib"),
                F.lit(use_a).alias("use_a"), F.lit(use_b).alias("use_b"),
            )
            for a, b in pairs
            for use_a in (0, 1)
            for use_b in (0, 1)
        ]
    )
    expanded = _ordered(permuted, d).select("*", F.inline(cases))
    # The pair enters as one player at the place of its first feature; the others keep their order.
    from_row = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(j == F.col("ia"), F.col("use_a") == 1)
        .when(j == F.col("ib"), F.col("use_b") == 1)
        .otherwise(F.array_position("_order", j) < F.array_position("_order", F.col("ia"))),
    )
    hybrid = F.zip_with(
        F.arrays_zip(F.col("_x").alias("x"), F.col("_b").alias("b")), from_row,
        lambda v, use: F.when(use, v["x"]).otherwise(v["b"]),
    )
    scored = score(expanded.withColumn("_features", hybrid), "_features")
    sign = F.when(F.col("use_a") == F.col("use_b"), 1.0).otherwise(-1.0)
    per_row = scored.groupBy(*key, "feature_a", "feature_b").agg(
        (F.sum(sign * F.col("_value")) / permutations).alias("value")
    )
    return _pair_effects(per_row)
