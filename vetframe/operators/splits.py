"""Repeatable splits and folds, decided by key hashes and independent of the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, quoted, ratio
from ..functions.ordering import hash_cuts, hash_order, lookup, settle

# Split sizes, seeds and the sampling score.
TRAIN_SHARE, SPLIT_SEED, FOLD_SEED, FOLDS = 0.75, 7, 42, 5
DRIFT_LIMIT, DRIFT_PENALTY = 0.10, 15.0


def _with_cuts(
    df: DataFrame, key: Sequence[str], seed: int, sizes: Column, strata: Sequence[str]
) -> DataFrame:
    """The table with the hash and the cuts of its stratum."""
    cuts = hash_cuts(df, key, seed, sizes, strata)
    hashed = df.withColumn("_hash", hash_order(key, seed))
    if not strata:
        row = cuts.first()
        limits = F.array(*[F.lit(c) for c in row["cuts"]]) if row else F.array()
        return hashed.withColumn("_cuts", limits.cast("array<bigint>"))
    condition = F.lit(True)
    renamed = lookup(
        cuts.select(*[F.col(s).alias(f"_c_{s}") for s in strata], F.col("cuts").alias("_cuts"))
    )
    for s in strata:
        condition = condition & hashed[s].eqNullSafe(renamed[f"_c_{s}"])
    return hashed.join(renamed, condition, "left").drop(*[f"_c_{s}" for s in strata])


def train_test_split(
    df: DataFrame,
    key: Sequence[str],
    train_share: float = TRAIN_SHARE,
    seed: int = SPLIT_SEED,
    stratify: str | None = None,
) -> DataFrame:
    """Add ``split`` ('train' or 'test'); with ``stratify`` every class is split in proportion.

    ``key`` must identify a row. The number of test rows is exact.
    """
    wanted = F.array(F.round(F.col("n") * (1 - train_share)).cast("long"))
    marked = _with_cuts(df, key, seed, wanted, [stratify] if stratify else [])
    in_test = F.coalesce(F.col("_hash") <= F.get("_cuts", F.lit(0)), F.lit(False))
    return marked.select(
        *[quoted(c) for c in df.columns],
        F.when(in_test, "test").otherwise("train").alias("split"),
    )


def assign_folds(
    df: DataFrame,
    key: Sequence[str],
    folds: int = FOLDS,
    seed: int = FOLD_SEED,
    stratify: str | None = None,
) -> DataFrame:
    """Add ``fold`` (0 … folds-1), of equal size within every class."""
    wanted = F.transform(
        F.sequence(F.lit(1), F.lit(folds - 1)),
        lambda i: F.ceil(F.col("n") * i / F.lit(folds)).cast("long"),
    )
    marked = _with_cuts(df, key, seed, wanted, [stratify] if stratify else [])
    passed = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<bigint>")), lambda c: F.col("_hash") > c))
    return marked.select(*[quoted(c) for c in df.columns], passed.alias("fold"))


def fold_count(smallest_class: int, folds: int = FOLDS) -> int:
    """Folds a label allows: no more than its smallest class, at least two."""
    return max(2, min(folds, smallest_class)) if smallest_class >= 2 else 2


def class_shares(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Counts per class in all, train and test rows, and the shift of the test share."""
    counts = settle(
        df.groupBy(quoted(label).alias("label")).agg(
            F.count("*").alias("n_all"),
            count_where(quoted(split) == "train").alias("n_train"),
            count_where(quoted(split) == "test").alias("n_test"),
        )
    )
    total, test = counts.agg(F.sum("n_all")).scalar(), counts.agg(F.sum("n_test")).scalar()
    share_all = F.coalesce(ratio(F.col("n_all"), total), F.lit(0.0))
    share_test = F.coalesce(ratio(F.col("n_test"), test), F.lit(0.0))
    return counts.select("*", F.abs(share_all - share_test).alias("drift"))


def sampling_score(shares: DataFrame) -> DataFrame:
    """Largest class shift; above 0.10 is a warning and costs 15 points."""
    drift = F.coalesce(F.max("drift"), F.lit(0.0))
    return shares.agg(
        F.lit("sampling").alias("agent"),
        drift.alias("test_class_ratio_drift"),
        F.when(drift > DRIFT_LIMIT, "warning").otherwise("ok").alias("severity"),
        F.when(drift > DRIFT_LIMIT, 100.0 - DRIFT_PENALTY).otherwise(100.0).alias("score"),
    )
