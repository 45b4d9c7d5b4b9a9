"""Baseline models, out-of-fold predictions, noise, permutation and corruption tests (MLlib)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import (
    count_where,
    name_has,
    nan_to_null,
    numeric_columns,
    quoted,
    ratio,
    string_columns,
)
from ..functions.ordering import LOOKUP_ROWS, hash_cuts, hash_order, lookup, settle
from ..functions.ranks import BUFFER_LIMIT, exact_quantiles
from .repair import most_common_values

# Model settings, perturbation sizes, limits and factors of the agent scores.
TREES, ITERATIONS, PLAIN_ITERATIONS = 300, 2000, 200
LOW_CARDINALITY, HASH_FEATURES, DATE_SHARE = 200, 64, 0.7
#: Depth of the trees: the deepest that the learner grows.
TREE_DEPTH = 30
DATE_HINTS = ("date", "time", "_dt")
NOISE, TRIALS, NOISE_LEVELS = 0.01, 20, (0.0, 0.005, 0.01, 0.02, 0.05)
FLIP_LIMIT, FLIP_FACTOR, DRIFT_LIMIT = 0.1, 5.0, 0.05
REPEATS = 5
CORRUPT_SHARE, CORRUPT_SIZE, CORRUPT_LIMIT, CORRUPT_CAP = 0.05, 10.0, 0.05, 0.5
#: Rows of a table that are worth a partition of their own to a forest, and the most partitions.
SPREAD_ROWS, SPREAD_PARTS = 5_000, 24
#: Rows of the ranges that a permutation is sorted in; the permutation doesn't depend on it.
PERMUTATION_RANGE = 200_000
#: Copied rows in each task that sorts them.
PERMUTATION_TASK = 500_000

#: Cells of a forest's grid that are scored once for all rows; a finer grid is not made.
GRID_CELLS = LOOKUP_ROWS
#: Nodes of a forest whose thresholds are read, about 40 bytes of text each.
GRID_NODES = 1_000_000
#: Slots of a feature vector that one expression writes; wider vectors are left to the pipeline's stages.
VECTOR_SLOTS = 64

PREDICTION_COLUMNS = ("features", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- features


def spread(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> DataFrame:
    """The table over as many partitions as its rows are worth, for work that is long for each row.

    A small file of many rows is read in one task, and a forest is then grown and asked in that one.
    The placement follows the columns' values alone, so that a rerun draws the same bootstrap rows.
    Every partition adds its own statistics of all open nodes to a forest's passes; their number is bounded.
    """
    rows = df.count() if rows is None else rows
    parts = min(SPREAD_PARTS, -(-rows // SPREAD_ROWS))
    if parts < 2:
        return df
    by = [quoted(c) for c in columns]
    return df.repartition(parts, *by).sortWithinPartitions(*by, *[
        quoted(f.name) for f in df.schema.fields
        if f.name not in columns and isinstance(f.dataType, T.AtomicType)
    ])


def impute_median(
    df: DataFrame, columns: Sequence[str] | None = None, buffer_limit: int = BUFFER_LIMIT
) -> DataFrame:
    """The numeric columns only, missing values replaced by the exact median."""
    columns = numeric_columns(df) if columns is None else list(columns)
    clean = nan_to_null(df)
    medians = exact_quantiles(clean, columns, [0.5], buffer_limit)
    return clean.select(
        *[
            F.coalesce(quoted(c).cast("double"), F.lit(medians[c][0]).cast("double")).alias(c)
            for c in columns
        ]
    )


def class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add the balanced class weight rows / (classes · rows of the class)."""
    counts = settle(df.groupBy(quoted(label).alias("_class")).agg(F.count("*").alias("_size")))
    total, classes = counts.agg(F.sum("_size")).scalar(), counts.agg(F.count("_class")).scalar()
    weights = lookup(
        counts.select("_class", ratio(total, classes * F.col("_size")).alias(weight))
    )
    return df.join(weights, df[label] == F.col("_class")).select(*[df[c] for c in df.columns], weight)


def assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def baseline_classifier(
    features: Sequence[str], label: str, rows: int, weight: str | None = "weight",
    iterations: int = ITERATIONS,
) -> Pipeline:
    """Logistic regression with an L2 penalty of unit strength, on the given numeric columns."""
    model = LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=iterations, tol=1e-4,
        regParam=1.0 / max(rows, 1), standardization=False,
    )
    if weight is not None:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[assembled(features), model])


def baseline_regressor(features: Sequence[str], label: str, trees: int = TREES, seed: int = 42,
    depth: int = TREE_DEPTH,
) -> Pipeline:
    """A random forest of trees grown down to single rows, or to ``depth`` levels (30 at most)."""
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, seed=seed, maxDepth=depth,
        # A row's node in every tree is kept from pass to pass instead of found again from the root.
        cacheNodeIds=True,
    )
    return Pipeline(stages=[assembled(features), forest])


def one_hot_stages(columns: Sequence[str]) -> tuple[list, list[str]]:
    """Index and one-hot encode text columns; an unseen value becomes all zeros."""
    stages: list = []
    outputs = []
    if columns:
        indexed = [f"_{c}_index" for c in columns]
        outputs = [f"_{c}_onehot" for c in columns]
        stages = [
            StringIndexer(
                inputCols=list(columns), outputCols=indexed, handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=outputs, dropLast=True),
        ]
    return stages, outputs


def distinct_values(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of distinct non-null values per column, one job for all of them."""
    if not columns:
        return {}
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    counts = (
        df.select(F.inline(pairs)).distinct().groupBy("column_name").agg(F.count("value").alias("k"))
    )
    found = {r["column_name"]: r["k"] for r in counts.collect()}
    return {c: found.get(c, 0) for c in columns}


def fairness_baseline(
    df: DataFrame, label: str, rows: int, encoding: dict[str, str] | None = None
) -> Pipeline:
    """One-hot text columns, numbers as they are, logistic regression.

    ``encoding`` names the columns to be encoded otherwise: ``{column: "hash"}`` takes one of very
    many categories into a wide sparse vector, because one-hot encoding keeps its categories in
    the model. The choice is the caller's and never depends on the data.
    """
    numbers = [c for c in numeric_columns(df) if c != label]
    text = [c for c in string_columns(df) if c != label]
    kinds = {**dict.fromkeys(text, "onehot"), **(encoding or {})}
    unknown = {c: k for c, k in kinds.items() if c not in text or k not in ("onehot", "hash")}
    if unknown:
        raise ValueError(f"no such text column or encoding: {unknown}")
    stages, encoded = one_hot_stages([c for c in text if kinds[c] == "onehot"])
    many = [c for c in text if kinds[c] == "hash"]
    if many:
        stages.append(FeatureHasher(inputCols=many, outputCol="_hashed"))
        encoded.append("_hashed")
    model = LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=PLAIN_ITERATIONS,
        regParam=1.0 / max(rows, 1), standardization=False,
    )
    return Pipeline(stages=[*stages, assembled([*numbers, *encoded]), model])


def _date_like(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns named like a date whose values mostly parse."""
    hinted = [c for c in columns if name_has(c, DATE_HINTS)]
    if not hinted:
        return []
    row = df.agg(
        *[
            ratio(
                count_where(quoted(c).cast("string").try_cast("timestamp").isNotNull()),
                F.count(quoted(c)),
            ).alias(f"d{i}")
            for i, c in enumerate(hinted)
        ]
    ).first()
    return [c for i, c in enumerate(hinted) if (row[f"d{i}"] or 0.0) > DATE_SHARE]


def _date_parts(c: str) -> dict[str, Column]:
    when = quoted(c).cast("string").try_cast("timestamp")
    return {
        f"{c}_year": F.year(when),
        f"{c}_month": F.month(when),
        f"{c}_day": F.dayofmonth(when),
        f"{c}_dow": F.weekday(when),
        f"{c}_hour": F.hour(when),
    }


def date_part_names(column: str) -> list[str]:
    """The feature names that a date column gets."""
    return [f"{column}_{part}" for part in ("year", "month", "day", "dow", "hour")]


def mixed_features(
    df: DataFrame, label: str, exclude: Sequence[str] = (), buffer_limit: int = BUFFER_LIMIT,
    low_cardinality: int = LOW_CARDINALITY,
) -> tuple[DataFrame, list, list[str]]:
    """Prepare a table of mixed columns for a model.

    Returns the table with missing values imputed and date parts added, the encoding stages, and
    the names of the assembled inputs: scaled numbers, one-hot text with up to ``low_cardinality``
    values, and text with more values hashed into 64 slots.
    """
    clean = nan_to_null(df)
    skip = {label, *exclude}
    numbers = [c for c in numeric_columns(df) if c not in skip]
    others = [c for c in df.columns if c not in skip and c not in numbers]
    dates = _date_like(clean, others)
    text = [c for c in others if c not in dates]
    counts = distinct_values(clean, text)
    few = [c for c in text if counts[c] <= low_cardinality]
    many = [c for c in text if c not in few]

    parts = {name: part for c in dates for name, part in _date_parts(c).items()}
    prepared = clean.select(
        *[quoted(c) for c in df.columns if c not in text],
        *[quoted(c).cast("string").alias(c) for c in text],
        *[p.alias(n) for n, p in parts.items()],
    )
    medians = exact_quantiles(prepared, numbers, [0.5], buffer_limit)
    common = most_common_values(prepared, [*few, *parts])
    fills: dict[str, Column] = {}
    for c in numbers:
        fills[c] = F.coalesce(
            quoted(c).cast("double"), F.lit(medians[c][0]).cast("double"), F.lit(0.0)
        )
    for c in parts:
        fills[c] = F.coalesce(quoted(c), F.lit(common.get(c, 0))).cast("double")
    for c in few:
        fills[c] = F.coalesce(quoted(c), F.lit(common.get(c, "")))
    for c in many:
        fills[c] = F.coalesce(quoted(c), F.lit("NA"))
    prepared = prepared.select(
        *[fills[c].alias(c) if c in fills else quoted(c) for c in prepared.columns]
    )
    stages: list = []
    inputs: list[str] = []
    if numbers:
        stages += [
            VectorAssembler(inputCols=numbers, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        inputs.append("_scaled")
    encode, encoded = one_hot_stages(few)
    stages += encode
    inputs += encoded
    if many:
        stages.append(
            FeatureHasher(inputCols=many, outputCol="_hashed", numFeatures=HASH_FEATURES)
        )
        inputs.append("_hashed")
    return prepared, stages, [*inputs, *parts]


# ---------------------------------------------------------------- predictions


def _number_slot(value: Column) -> Callable[[Sequence[float]], Column]:
    return lambda weights: value * F.lit(float(weights[0]))


def _label_slot(value: Column, labels: Sequence[str]) -> Callable[[Sequence[float]], Column]:
    def weigh(weights):
        pairs = [F.lit(x) for label, w in zip(labels, weights, strict=True) for x in (label, float(w))]
        known = F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("double")
        return F.coalesce(known, F.lit(0.0))

    return weigh


@dataclass
class _Part:
    """A part of a feature vector: what it adds for given weights, and its slots as columns."""

    width: int
    weigh: Callable[[Sequence[float]], Column]
    slots: Callable[[], list[Column]]
    #: The number itself, if the part is one.
    number: Column | None = None


def _number_part(value: Column) -> _Part:
    return _Part(1, _number_slot(value), lambda: [value], value)


def _label_part(value: Column, labels: Sequence[str]) -> _Part:
    one, none = F.lit(1.0), F.lit(0.0)
    return _Part(
        len(labels), _label_slot(value, labels),
        lambda: [F.when(value == F.lit(x), one).otherwise(none) for x in labels],
    )


def _weighed(parts: Sequence[_Part], weights: Sequence[float], intercept: float) -> Column:
    total, at = F.lit(0.0), 0
    for part in parts:
        total, at = total + part.weigh(weights[at : at + part.width]), at + part.width
    if at != len(weights):
        raise ValueError("the model's weights don't fit its inputs")
    return total + F.lit(float(intercept))


def _feature_parts(
    stages: Sequence[Transformer], name: str, read: Callable[[str], Column] = quoted
) -> list[_Part] | None:
    """The parts of the feature vector ``name`` as expressions over the table's columns.

    The stages are assembled, scaled and one-hot encoded columns; others give None. ``read`` says what
    stands for a column of the table.
    """
    vectors: dict[str, list[_Part]] = {}
    indexed: dict[str, tuple[Column, Sequence[str]]] = {}
    for stage in stages:
        if isinstance(stage, VectorAssembler):
            if stage.getHandleInvalid() == "skip":
                return None
            parts = []
            for c in stage.getInputCols():
                if c in indexed:
                    return None
                if stage.getHandleInvalid() == "error":
                    number = _refusing(c, read)
                else:
                    number = F.coalesce(read(c).cast("double"), F.lit(float("nan")))
                parts += vectors.get(c) or [_number_part(number)]
            vectors[stage.getOutputCol()] = parts
        elif isinstance(stage, StandardScalerModel):
            parts = vectors.get(stage.getInputCol())
            if parts is None or any(part.number is None for part in parts):
                return None
            scaled = []
            for part, mean, std in zip(parts, stage.mean, stage.std, strict=True):
                value = part.number - F.lit(float(mean)) if stage.getWithMean() else part.number
                if stage.getWithStd():
                    value = value * F.lit(1.0 / float(std) if std else 0.0)
                scaled.append(_number_part(value))
            vectors[stage.getOutputCol()] = scaled
        elif isinstance(stage, StringIndexerModel) and stage.getHandleInvalid() == "keep" and stage.isSet("inputCols"):
            for c, out, labels in zip(
                stage.getInputCols(), stage.getOutputCols(), stage.labelsArray, strict=True
            ):
                indexed[out] = (read(c).cast("string"), list(labels))
        elif isinstance(stage, OneHotEncoderModel) and stage.getDropLast():
            for c, out, size in zip(
                stage.getInputCols(), stage.getOutputCols(), stage.categorySizes, strict=True
            ):
                if c not in indexed or size != len(indexed[c][1]) + 1 or size > LOW_CARDINALITY + 1:
                    return None  # a map of very many labels is slower to plan and to search than the stage
                vectors[out] = [_label_part(*indexed[c])]
        else:
            return None
    return vectors.get(name)


def linear_margin(model: Transformer, read: Callable[[str], Column] = quoted) -> Column | None:
    """The log odds of class 1 as an expression over the table's columns, where the model has one.

    That is a pipeline of assembled, scaled and one-hot encoded columns before a binary logistic
    regression. A row is then scored by plain arithmetic, without a vector built for each stage; a
    missing number gives NaN, as it does in the vector. Other models give None. ``read`` says what
    stands for a column of the table, such as the value of another row.
    """
    stages = model.stages if isinstance(model, PipelineModel) else []
    core = stages[-1] if stages else None
    if not isinstance(core, LogisticRegressionModel) or core.numClasses != 2 or core.getThreshold() != 0.5:
        return None
    if core.coefficientMatrix.numRows != 1 or core.isSet("thresholds"):
        return None
    parts = _feature_parts(stages[:-1], core.getFeaturesCol(), read)
    return None if parts is None else _weighed(parts, core.coefficients.toArray(), core.intercept)


def _scaled_numbers(stages: Sequence) -> dict[str, list[str]]:
    """By the uid of each scaler of columns that refuse missing values: those columns."""
    assembled_from = {
        s.getOutputCol(): s.getInputCols()
        for s in stages if isinstance(s, VectorAssembler) and s.getHandleInvalid() == "error"
    }
    made = {c for s in stages for c in _outputs(s)}
    found = {}
    for s in stages:
        columns = assembled_from.get(s.getInputCol()) if isinstance(s, StandardScaler) else None
        if columns and not made & set(columns):
            found[s.uid] = columns
    return found


def _outputs(stage) -> list[str]:
    several = stage.hasParam("outputCols") and stage.isSet("outputCols")
    return list(stage.getOutputCols()) if several else [stage.getOutputCol()]


def _keeps_rows(stage) -> bool:
    """Is it one of the feature stages that add columns and leave rows and other columns alone?"""
    if isinstance(stage, (VectorAssembler, StringIndexer, StringIndexerModel)):
        return stage.getHandleInvalid() != "skip"
    return isinstance(stage, (StandardScaler, StandardScalerModel, OneHotEncoder, OneHotEncoderModel, FeatureHasher))


def _moments(df: DataFrame, columns: Sequence[str], wheres: Sequence[Column]) -> list[dict[str, tuple]]:
    """Mean and deviation of the columns over the rows of each condition, from one reading."""
    aggregates = []
    for i, where in enumerate(wheres):
        for j, c in enumerate(columns):
            x = F.when(where, _refusing(c))
            aggregates += [F.avg(x).alias(f"m{i}_{j}"), F.stddev_samp(x).alias(f"s{i}_{j}")]
    row = df.agg(*aggregates).first() if aggregates else {}
    return [
        {c: (row[f"m{i}_{j}"], row[f"s{i}_{j}"]) for j, c in enumerate(columns)} for i in range(len(wheres))
    ]


def _refusing(c: str, read: Callable[[str], Column] = quoted) -> Column:
    """The column as a number that must not be missing."""
    number = F.coalesce(read(c).cast("double"), F.lit(float("nan")))
    refused = F.raise_error(F.lit(f"missing value in column {c}")).cast("double")
    return F.when(F.isnan(number), refused).otherwise(number)


def _category_rows(df: DataFrame, columns: Sequence[str], wheres: Sequence[Column]) -> list[DataFrame]:
    """For each condition a small table that holds every value its rows have in the columns, from one reading."""
    if not columns:
        return [df] * len(wheres)
    pairs = F.array(*[
        F.struct(F.lit(j).alias("_column"), quoted(c).cast("string").alias("_value")) for j, c in enumerate(columns)
    ])
    flags = [where.cast("int").alias(f"_in{i}") for i, where in enumerate(wheres)]
    counted = df.select(*flags, F.inline(pairs)).filter("_value IS NOT NULL").groupBy("_column", "_value").agg(
        *[F.max(f"_in{i}").alias(f"_in{i}") for i in range(len(wheres))]
    )
    rows, schema = counted.collect(), T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return [
        df.sparkSession.createDataFrame(
            [tuple(r._value if j == r._column else None for j in range(len(columns))) for r in rows if r[f"_in{i}"]],
            schema,
        )
        for i in range(len(wheres))
    ]


def _scaler(stage: StandardScaler, moments: Sequence[tuple]) -> StandardScalerModel:
    """The fitted scaler of known means and deviations."""
    spark = SparkSession.active()
    vectors = [
        _py2java(spark.sparkContext, Vectors.dense([float(m[k] or 0.0) for m in moments])) for k in (1, 0)
    ]
    name = "org.apache.spark.ml.feature.StandardScalerModel"
    return stage._copyValues(stage._create_model(stage._new_java_obj(name, stage.uid, *vectors)))


def fit_each(estimator: Estimator, df: DataFrame, wheres: Sequence[Column]) -> list[Transformer]:
    """``estimator`` fitted on the rows of each condition, with less work for each row where the core is linear.

    Scalers and indexers of all the models learn from two readings of the table together. The learner reads it
    twice and then works on blocks of its own; a pipeline has a vector made by each of its stages in both
    readings, here one expression writes the same features. Pipelines with other stages, or of over
    ``VECTOR_SLOTS`` slots, go through their stages.
    """
    stages = estimator.getStages() if type(estimator) is Pipeline else []
    core = stages[-1] if stages else None
    if not isinstance(core, LogisticRegression) or not all(map(_keeps_rows, stages[:-1])):
        return [estimator.fit(df.filter(where)) for where in wheres]
    numbers = _scaled_numbers(stages[:-1])
    moments = _moments(df, list(dict.fromkeys(c for cs in numbers.values() for c in cs)), wheres)
    # An indexer that sorts by name needs to see every value once.
    by_name = [
        s for s in stages[:-1]
        if isinstance(s, StringIndexer) and s.isSet("inputCols") and s.getStringOrderType() == "alphabetAsc"
        and set(s.getInputCols()) <= set(df.columns)
    ]
    texts = list(dict.fromkeys(c for s in by_name for c in s.getInputCols()))
    categories = _category_rows(df, texts, wheres)
    kept = [core.getLabelCol(), *([core.getWeightCol()] if core.isSet("weightCol") else [])]
    models = []
    for where, known, values in zip(wheres, moments, categories):
        fitted, rows = [], df.filter(where)
        for stage in stages[:-1]:
            if stage.uid in numbers and all(known[c][0] is not None for c in numbers[stage.uid]):
                fitted.append(_scaler(stage, [known[c] for c in numbers[stage.uid]]))
            elif stage in by_name:
                fitted.append(stage.fit(values))
            else:
                fitted.append(stage.fit(rows) if isinstance(stage, Estimator) else stage)
            rows = fitted[-1].transform(rows)
        parts = _feature_parts(fitted, core.getFeaturesCol())
        if parts is not None and sum(part.width for part in parts) <= VECTOR_SLOTS:
            slots = [slot for part in parts for slot in part.slots()]
            vector = array_to_vector(F.array(*slots) if slots else F.array().cast("array<double>"))
            rows = df.filter(where).select(
                *[quoted(c) for c in dict.fromkeys(kept)], vector.alias(core.getFeaturesCol())
            )
        models.append(PipelineModel([*fitted, core.fit(rows)]))
    return models


def fit(estimator: Estimator, df: DataFrame) -> Transformer:
    """What ``estimator.fit(df)`` gives, see ``fit_each``."""
    return fit_each(estimator, df, [F.lit(True)])[0]


def _odds(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def _side(margin: Column) -> Column:
    """The class; NaN, which sorts last, is no class 1. The margin is computed once."""
    return F.when(F.nanvl(margin, F.lit(0.0)) > 0, 1.0).otherwise(0.0)


_SPLIT = re.compile(r"If \(feature (\d+) (?:<= ([^)\s]+)|(in ))")


def forest_cuts(model: Transformer, cells: int = GRID_CELLS) -> dict[str, list[float]] | None:
    """A forest's thresholds by column, in order, if their grid has at most that many cells.

    The learner chooses every threshold of a column from one short list, the same for all trees. So a
    forest of assembled columns is one number for each cell of the grid that its thresholds make. Other
    models, splits by category, finer grids and forests of over ``GRID_NODES`` nodes give None.
    """
    stages = model.stages if isinstance(model, PipelineModel) else []
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler):
        return None
    assembler, forest = stages
    names = assembler.getInputCols()
    if not isinstance(forest, RandomForestRegressionModel) or assembler.getHandleInvalid() != "keep":
        return None
    if forest.getFeaturesCol() != assembler.getOutputCol() or forest.numFeatures != len(names):
        return None
    if forest.getPredictionCol() != "prediction" or forest.getLeafCol():
        return None
    found: dict[str, set[float]] = {c: set() for c in names}
    if len(found) != len(names):
        return None
    if forest.totalNumNodes > GRID_NODES:
        return None
    for feature, threshold, category in set(_SPLIT.findall(forest.toDebugString)):
        if category:
            return None
        found[names[int(feature)]].add(float(threshold))
    fits = math.prod(len(cuts) + 1 for cuts in found.values()) <= cells
    return {c: sorted(cuts) for c, cuts in found.items()} if fits else None


def _grid(model: Transformer, spark, cuts: dict[str, list[float]]) -> DataFrame:
    """``(_cell, prediction)``: the forest at every cell; a cell's values are its upper thresholds."""
    step, values = 1, []
    for c, at in cuts.items():
        upper = F.array(*[F.lit(x) for x in (*at, math.inf)])
        place = F.floor(F.col("_cell") / step) % (len(at) + 1)
        values.append(F.get(upper, place.cast("int")).alias(c))
        step *= len(at) + 1
    cells = spark.range(step).withColumnRenamed("id", "_cell").select("_cell", *values)
    return lookup(model.transform(cells).select("_cell", "prediction"))


def _cell(cuts: dict[str, list[float]]) -> Column:
    """A row's cell: how many thresholds lie below each of its values; NaN and NULL lie above all."""
    step, cell = 1, F.lit(0).cast("long")
    for c, at in cuts.items():
        number = F.coalesce(quoted(c).cast("double"), F.lit(float("nan")))
        cell = cell + sum(((number > F.lit(x)).cast("long") for x in at), F.lit(0)) * F.lit(step)
        step *= len(at) + 1
    return cell


def prediction_adder(model: Transformer) -> Callable[[DataFrame], DataFrame]:
    """What adds ``prediction`` to a table, and whatever work columns the model leaves.

    A linear model is arithmetic; a forest of few thresholds is asked once for each cell of their grid,
    and rows look their cell up. Both give the model's own numbers; other models are asked for every row.
    """
    margin = linear_margin(model)
    if margin is not None:
        return lambda df: df.withColumn("prediction", _side(margin))
    cuts = forest_cuts(model)
    if cuts is None:
        return model.transform
    grids: list[DataFrame] = []

    def look_up(df):
        types = {f.name: f.dataType for f in df.schema.fields}
        if not all(isinstance(types.get(c), T.NumericType) for c in cuts) or "prediction" in types:
            return model.transform(df)
        if not grids:
            grids.append(_grid(model, df.sparkSession, cuts))
        return df.withColumn("_cell", _cell(cuts)).join(grids[0], "_cell", "left").drop("_cell")

    return look_up


def with_prediction(model: Transformer, df: DataFrame) -> DataFrame:
    """The table with ``prediction``, and whatever work columns the model leaves."""
    return prediction_adder(model)(df)


def positive_score(predicted: DataFrame) -> DataFrame:
    """Add ``score``: the probability of class 1, where the model has probabilities."""
    if "probability" not in predicted.columns:
        return predicted.withColumn("score", F.lit(None).cast("double"))
    return predicted.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def predict(model: Transformer, df: DataFrame, name: str = "y_pred") -> DataFrame:
    """The table with the prediction and score, without the model's work columns."""
    margin = linear_margin(model)
    if margin is not None:
        return _predicted(df, margin, name)
    scored = positive_score(with_prediction(model, df)).withColumn(name, F.col("prediction"))
    return scored.select(*[quoted(c) for c in df.columns], name, "score")


def _predicted(df: DataFrame, margin: Column, name: str = "y_pred") -> DataFrame:
    kept = [quoted(c) for c in df.columns if c not in (name, "score")]
    return df.select(*kept, _side(margin).alias(name), _odds(margin).alias("score"))


def cross_val_predict(df: DataFrame, estimator: Estimator, folds: int, fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions; every fold is fitted once and yields class and score together.

    Linear models are all asked in one reading of the table, each for the rows of its fold.
    """
    models = fit_each(estimator, df, [quoted(fold) != i for i in range(folds)])
    margins = [linear_margin(model) for model in models]
    if all(m is not None for m in margins):
        own = F.lit(None).cast("double")
        for i, margin in enumerate(margins):
            own = F.when(quoted(fold) == i, margin).otherwise(own)
        return _predicted(df.filter(quoted(fold).isin(*range(folds))), own)
    out = None
    for i, model in enumerate(models):
        part = predict(model, df.filter(quoted(fold) == i))
        out = part if out is None else out.unionByName(part)
    return out


def margin_scorer(model: PipelineModel) -> Callable[[DataFrame, str], DataFrame]:
    """A scorer for feature arrays: probability of class 1, or the prediction of a regressor."""
    core = model.stages[-1] if isinstance(model, PipelineModel) else model
    linear = isinstance(core, LogisticRegressionModel) and core.coefficientMatrix.numRows == 1

    def score(df: DataFrame, column: str) -> DataFrame:
        if linear:
            numbers = [
                F.coalesce(F.get(F.col(column), F.lit(i)), F.lit(0.0)) for i in range(core.numFeatures)
            ]
            parts = [_number_part(number) for number in numbers]
            margin = _weighed(parts, core.coefficients.toArray(), core.intercept)
            return df.select(*df.columns, _odds(margin).alias("_value"))
        scored = core.transform(df.withColumn("features", array_to_vector(F.col(column))))
        if "probability" in scored.columns:
            value = F.get(vector_to_array("probability"), F.lit(1))
        else:
            value = F.col("prediction")
        return scored.select(*df.columns, value.alias("_value"))

    return score


# ---------------------------------------------------------------- robustness


def hash_gaussian(keys: Sequence[Column], salt: Column) -> Column:
    """A standard normal value that depends only on the key: the same whenever a task reruns."""

    def uniform(seed):
        h = F.xxhash64(*keys, salt, F.lit(seed))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def _noisy_predictions(
    model: Transformer, df: DataFrame, key: Sequence[str], features: Sequence[str],
    levels: Sequence[float], trials: int, seed: int,
) -> DataFrame:
    """Predictions of the clean rows and of every (level, trial) copy of them.

    Copies are made and scored inside the task that holds the row; nothing is shuffled.
    """
    add = prediction_adder(model)
    base = add(df).withColumnRenamed("prediction", "base_prediction")
    kept = base.select(*[quoted(c) for c in df.columns], "base_prediction")
    # A run carries the salts of its features: constants, not strings put together for each copy.
    runs = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("sigma"), F.lit(t).alias("trial"),
                F.struct(
                    *[
                        F.concat_ws("|", F.lit(f"{c}|{seed}"), F.lit(t), F.lit(float(s))).alias(f"s{i}")
                        for i, c in enumerate(features)
                    ]
                ).alias("_salts"),
            )
            for s in levels
            for t in range(1, trials + 1)
        ]
    )
    keys = [quoted(k) for k in key]
    expanded = kept.select("*", F.inline(runs))
    salts = {c: F.col("_salts")[f"s{i}"] for i, c in enumerate(features)}
    noisy = expanded.select(
        *[
            (
                quoted(c).cast("double") + F.col("sigma") * hash_gaussian(keys, salts[c])
            ).alias(c)
            if c in salts
            else quoted(c)
            for c in expanded.columns
            if c != "_salts"
        ]
    )
    return add(noisy)


def noise_flips(
    model: Transformer, df: DataFrame, key: Sequence[str], features: Sequence[str],
    levels: Sequence[float] = NOISE_LEVELS, trials: int = 1, seed: int = 42,
) -> DataFrame:
    """``(sigma, flip_rate)``: share of predictions that noise of that size changes."""
    noisy = _noisy_predictions(model, df, key, features, levels, trials, seed)
    return noisy.groupBy("sigma").agg(
        ratio(
            count_where(F.col("prediction") != F.col("base_prediction")), F.count("*")
        ).alias("flip_rate")
    )


def robustness_classification(
    model: Transformer, df: DataFrame, key: Sequence[str], features: Sequence[str],
    noise: float = NOISE, trials: int = TRIALS, seed: int = 42,
) -> DataFrame:
    """Agent row: mean flip rate over the trials, and its score."""
    flips = noise_flips(model, df, key, features, (noise,), trials, seed)
    rate = F.col("flip_rate")
    return flips.select(
        F.lit("robustness").alias("agent"),
        rate.alias("avg_flip_rate"),
        F.when(rate > FLIP_LIMIT, "warning").otherwise("info").alias("severity"),
        F.greatest(
            F.lit(0.0), 100 * (1 - F.least(rate * FLIP_FACTOR, F.lit(1.0)))
        ).alias("score"),
    )


def robustness_regression(
    model: Transformer, df: DataFrame, key: Sequence[str], features: Sequence[str], label: str,
    noise: float = NOISE, trials: int = TRIALS, seed: int = 42,
) -> DataFrame:
    """Agent row: mean change of the root mean squared error over the trials, and its score."""
    noisy = _noisy_predictions(model, df, key, features, (noise,), trials, seed)
    y = quoted(label).cast("double")

    def rmse(column):
        return F.sqrt(F.avg((y - F.col(column)) * (y - F.col(column))))

    per_trial = noisy.groupBy("trial").agg(
        F.abs(rmse("prediction") - rmse("base_prediction")).alias("drift")
    )
    drift = F.avg("drift")
    return per_trial.agg(
        F.lit("robustness").alias("agent"),
        drift.alias("avg_rmse_drift"),
        F.when(drift > DRIFT_LIMIT, "warning").otherwise("info").alias("severity"),
        F.greatest(F.lit(0.0), 100 * (1 - F.least(drift, F.lit(1.0)))).alias("score"),
    )


# ---------------------------------------------------------------- permutation importance


def permutation_importance(
    model: Transformer, df: DataFrame, key: Sequence[str],
    features: Sequence[str] | dict[str, Sequence[str]], label: str,
    task: str = "classification", repeats: int = REPEATS, seed: int = 42,
    range_rows: int = PERMUTATION_RANGE,
) -> DataFrame:
    """``(feature, importance_mean, importance_std)``: loss of score when a feature is shuffled.

    Per repeat the rows are put in a random (hash) order and each takes the values of the next row,
    the last those of the first: one random cyclic permutation of the whole table. Hashes are
    spread evenly, so equal ranges of them are sorted in different tasks; the last row of a range
    takes the values of the next range's first row, from a table of one row for each range. One
    shuffle serves all features: a row learns its donor's values once and is scored with one
    feature at a time replaced. ``features`` may name several columns that are shuffled together,
    such as the parts of a date. ``range_rows`` has no influence on the result.
    """
    groups = features if isinstance(features, dict) else {f: [f] for f in features}
    columns = list(dict.fromkeys(c for members in groups.values() for c in members))
    # The upper 20 bits of the hash, cut into as many ranges as the rows fill.
    rows = df.count()
    ranges = max(1, min(1 << 20, -(-rows // range_rows)))
    order = F.xxhash64(*[quoted(k) for k in key], F.col("_repeat"), F.lit(seed))
    top_bits = F.shiftright("_order", 44) + F.lit(1 << 19)

    def placed(rows):
        copies = rows.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        return copies.withColumn("_order", order).withColumn(
            "_range", F.shiftright(top_bits * F.lit(ranges), 20)
        )

    spread = placed(df)
    # Rows of equal hash stand by what they hold; the key, several times as wide, isn't shuffled for that.
    by_order = [F.col("_order"), *[quoted(c) for c in (*columns, label)]]
    donor = F.struct(*[quoted(c).alias(c) for c in columns])
    # The smallest hash of a range is a number and combines in the tasks; then its row is looked up.
    smallest = lookup(
        spread.groupBy("_repeat", "_range").agg(F.min("_order").alias("_least")).select(
            F.col("_repeat").alias("_for_repeat"), F.col("_least").alias("_for_order")
        )
    )
    is_first = (F.col("_repeat") == F.col("_for_repeat")) & (F.col("_order") == F.col("_for_order"))
    firsts = spread.join(smallest, is_first).groupBy("_repeat", "_range").agg(
        F.min_by(donor, F.struct(*by_order)).alias("_first")
    )
    along = Window.partitionBy("_repeat").orderBy("_range")
    start = F.first("_first").over(along.rowsBetween(Window.unboundedPreceding, 0))
    following = lookup(
        firsts.select(
            F.col("_repeat").alias("_for_repeat"), F.col("_range").alias("_for_range"),
            F.coalesce(F.lead("_first").over(along), start).alias("_next"),
        )
    )
    window = Window.partitionBy("_repeat", "_range").orderBy(*by_order)
    same = (F.col("_repeat") == F.col("_for_repeat")) & (F.col("_range") == F.col("_for_range"))
    # Rows leave their task with like ones beside them, which takes half the bytes; they arrive in hash order.
    alike = df.sortWithinPartitions(*[quoted(c) for c in dict.fromkeys((label, *columns))])
    # They are sorted by one number there, repeat and hash, without comparing rows; the window finds them in order.
    bits = max(repeats, 1).bit_length()
    place = F.shiftrightunsigned(F.col("_order").bitwiseXOR(F.lit(-(1 << 63))), bits + 1)
    number = F.shiftleft(F.col("_repeat").cast("long"), 63 - bits).bitwiseOR(place)
    tasks = max(1, -(-rows * repeats // PERMUTATION_TASK))
    shifted = (
        placed(alike).repartition(tasks, "_repeat", "_range").sortWithinPartitions(number)
        .withColumn("_lead", F.lead(donor).over(window))
        .withColumn("_inside", F.lead(F.lit(True)).over(window))
        .join(following, same)
        .withColumn("_donor", F.when(F.col("_inside"), F.col("_lead")).otherwise(F.col("_next")))
        .drop("_lead", "_inside", "_next", "_for_repeat", "_for_range")
    )
    y = quoted(label).cast("double")

    def goodness(p):
        if task == "classification":
            return ratio(count_where(y == p), F.count("*"))
        return 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))

    add = prediction_adder(model)
    base = add(df).agg(goodness(F.col("prediction")).alias("g")).scalar()
    if linear_margin(model) is not None and label not in columns:
        # A linear model is asked for all features in the row itself.
        def swapped(members):
            return linear_margin(model, lambda c: F.col("_donor")[c] if c in members else quoted(c))

        scores = [goodness(_side(swapped(members))) for members in groups.values()]
        found = [F.struct(F.lit(f).alias("_feature"), g.alias("g")) for f, g in zip(groups, scores)]
        by_repeat = shifted.groupBy("_repeat").agg(F.array(*found).alias("_found"))
        runs = by_repeat.select("_repeat", F.inline("_found"))
    else:
        cases = F.array(*[F.lit(f) for f in groups])
        expanded = shifted.withColumn("_feature", F.explode(cases))

        def shuffled(c):
            members = [f for f, cs in groups.items() if c in cs]
            return F.when(F.col("_feature").isin(*members), F.col("_donor")[c]).otherwise(quoted(c))

        replaced = expanded.select(
            *[shuffled(c).alias(c) if c in columns else quoted(c) for c in expanded.columns]
        )
        runs = add(replaced).groupBy("_feature", "_repeat").agg(goodness(F.col("prediction")).alias("g"))
    drops = runs.select(F.col("_feature").alias("feature"), (base - F.col("g")).alias("drop"))
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    )


def top_importances(importances: DataFrame, top: int | None = None) -> DataFrame:
    """The importances by size; the first ``top``, or all."""
    ranked = importances.orderBy(F.abs("importance_mean").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


# ---------------------------------------------------------------- corruption


def corrupt(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], share: float = CORRUPT_SHARE,
    seed: int = 42,
) -> DataFrame:
    """Set a share of the rows (at least one) to mean + 10 deviations in the given columns.

    The rows are those with the smallest key hashes, found by their cut; no sort.
    """
    wanted = F.array(F.greatest(F.lit(1), F.floor(F.col("n") * share)).cast("long"))
    cut = hash_cuts(df, key, seed, wanted).first()
    chosen = hash_order(key, seed) <= F.lit(cut["cuts"][0]) if cut else F.lit(False)
    row = df.agg(
        *[
            F.struct(
                F.avg(quoted(c)).cast("double").alias("m"),
                F.stddev_samp(quoted(c)).cast("double").alias("s"),
            ).alias(f"x{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    extreme = {}
    for i, c in enumerate(columns):
        mean, deviation = row[f"x{i}"]["m"] or 0.0, row[f"x{i}"]["s"]
        usable = deviation is not None and math.isfinite(deviation) and deviation > 0
        extreme[c] = mean + CORRUPT_SIZE * (deviation if usable else 1.0)
    return df.select(
        *[
            F.when(chosen, F.lit(extreme[c])).otherwise(quoted(c).cast("double")).alias(c)
            if c in extreme
            else quoted(c)
            for c in df.columns
        ],
        chosen.cast("int").alias("corrupted"),
    )


def model_quality(predicted: DataFrame, label: str, task: str, name: str) -> DataFrame:
    """Accuracy or R² of a predicted table as a one-row frame."""
    y, p = quoted(label).cast("double"), F.col("prediction")
    if task == "regression":
        value = 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))
    else:
        value = ratio(count_where(y == p), F.count("*"))
    return predicted.agg(value.alias(name))


def falsification(
    df: DataFrame, estimator: Estimator, key: Sequence[str], features: Sequence[str], label: str,
    task: str = "classification", seed: int = 42, model: Transformer | None = None,
) -> DataFrame:
    """Agent row: loss of quality when the model is refitted on the corrupted table.

    ``model`` is the estimator already fitted on the clean table, if there is one.
    """
    dirty = corrupt(df, key, list(features)[:2], seed=seed)
    fitted = fit(estimator, df) if model is None else model
    base = model_quality(with_prediction(fitted, df), label, task, "base_quality")
    after = model_quality(with_prediction(fit(estimator, dirty), dirty), label, task, "q").scalar()
    drop = F.col("corruption_perf_drop")
    return (
        base.withColumn("corrupted_quality", after)
        .withColumn("corruption_perf_drop", F.col("base_quality") - F.col("corrupted_quality"))
        .select(
            F.lit("falsification").alias("agent"),
            "base_quality",
            "corrupted_quality",
            "corruption_perf_drop",
            F.when(drop > CORRUPT_LIMIT, "warning").otherwise("info").alias("severity"),
            F.greatest(
                F.lit(0.0),
                F.least(F.lit(100.0), 100 - 100 * F.least(drop, F.lit(CORRUPT_CAP))),
            ).alias("score"),
        )
    )


def is_numeric_label(df: DataFrame, label: str) -> bool:
    return isinstance(df.schema[label].dataType, T.NumericType)
