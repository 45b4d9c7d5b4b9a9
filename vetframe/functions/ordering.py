"""Ordering work that would otherwise land in one task: prefix sums, row numbers, cuts.

Every helper here spreads a *global* order over the cluster. Prefix sums range-partition the rows
and add per-partition offsets; hash cuts find the one hash bucket that holds the wanted rank (for
quantiles see ``ranks``). No group is ever sorted as a whole in one task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .columns import quoted

#: Hash buckets per stratum: 2**20, from the top bits of a 64-bit hash.
BUCKET_SHIFT = 44
#: A lookup table up to this many rows is broadcast; a larger one is joined by shuffle.
LOOKUP_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a private one only on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="vetframe-checkpoint-")
    sc.setCheckpointDir(configured)


def settle(df: DataFrame) -> DataFrame:
    """Compute an aggregate once and continue from its checkpoint.

    Several results derive from one count table, each with other columns. Left lazy, each would
    scan the source again; settled, the source is read once, and a lost executor costs a read of
    the checkpoint, not a new scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def lookup(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Settle a small result that a big table is joined with, and broadcast it if it is small.

    Its rows are counted first. Without the hint the planner would judge it by the size of what it
    was computed from, and shuffle the big table by a key that may be badly skewed.
    """
    settled = settle(df)
    return F.broadcast(settled) if settled.limit(rows + 1).count() <= rows else settled


def broadcast_if_small(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Broadcast a stored table if it has at most that many rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: dict[str, Column],
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive prefix sums (``totals``: new column name -> summand) in the given order.

    Rows are range-partitioned by (group, order) and the placement is checkpointed, so that the
    partition number of a row cannot change when a lost task runs again. Each range is then summed
    on its own and shifted by what the earlier ranges hold. A group larger than one partition
    simply spans several ranges. ``order_by`` should be a total order, or ties cost exactness.
    """
    ensure_checkpoint_dir(df.sparkSession)
    group_by = list(group_by)
    summands = {k: f"_s_{k}" for k in totals}
    prepared = df.select("*", *[v.cast("long").alias(summands[k]) for k, v in totals.items()])
    placed = (
        prepared.repartitionByRange(*[F.col(g) for g in group_by], *order_by)
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    sizes = placed.groupBy("_range", *group_by).agg(
        *[F.sum(s).alias(s) for s in summands.values()]
    )
    # One row per range and group touching it: at most ranges + groups rows.
    before = Window.partitionBy(*(group_by or [F.lit(0)])).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = lookup(
        sizes.select(
            F.col("_range").alias("_o_range"),
            *[F.col(g).alias(f"_o_{g}") for g in group_by],
            *[
                F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_o{s}")
                for s in summands.values()
            ],
        )
    )
    within = Window.partitionBy("_range", *group_by).orderBy(*order_by)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        "*", *[F.sum(s).over(within).alias(f"_l{s}") for s in summands.values()]
    )
    condition = local["_range"] == offsets["_o_range"]
    for g in group_by:
        condition = condition & local[g].eqNullSafe(offsets[f"_o_{g}"])
    return local.join(offsets, condition).select(
        *df.columns,
        *[(F.col(f"_l{s}") + F.col(f"_o{s}")).alias(k) for k, s in summands.items()],
    )


def global_row_number(df: DataFrame, order_by: Sequence[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 over the whole table, in the given total order."""
    return running_totals(df, order_by, {name: F.lit(1)})


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """A pseudo-random but repeatable position for each row."""
    return F.xxhash64(*[quoted(k) for k in keys], F.lit(seed))


def hash_cuts(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    sizes: Column,
    strata: Sequence[str] = (),
) -> DataFrame:
    """``(strata…, cuts)``: hash values below which exactly the wanted numbers of rows lie.

    ``sizes`` is an array column over ``n``, the rows of the stratum. The histogram of hash
    buckets says which bucket holds a wanted rank, and only that bucket (about a millionth of the
    stratum) is ranked. Rows are then assigned by comparing their hash with the cuts, so the table
    itself is not sorted or shuffled. The table is read twice, and the small result is settled.
    """
    strata = list(strata)
    hashed = df.select(*strata, hash_order(keys, seed).alias("_h")).withColumn(
        "_bucket", F.shiftright("_h", BUCKET_SHIFT)
    )
    histogram = settle(hashed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_c")))
    so_far = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("_bucket")
    cumulative = histogram.withColumn(
        "_upto", F.sum("_c").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    )
    totals = histogram.groupBy(*strata).agg(F.sum("_c").alias("n"))
    if strata:
        totals = lookup(totals.select(*[F.col(s).alias(f"_w_{s}") for s in strata], "n"))
        same = F.lit(True)
        for s in strata:
            same = same & F.col(s).eqNullSafe(F.col(f"_w_{s}"))
        sized = cumulative.join(totals, same)
    else:
        sized = cumulative.withColumn("n", totals.scalar())
    # The wanted ranks that fall into a bucket are picked out inside the bucket's own row.
    before = F.col("_upto") - F.col("_c")
    inside = F.filter(
        F.transform(sizes, lambda w, i: F.struct(i.alias("_cut"), w.alias("_want"))),
        lambda s: (s["_want"] > before) & (s["_want"] <= F.col("_upto")),
    )
    target = settle(
        sized.select(
            *[F.col(s).alias(f"_t_{s}") for s in strata],
            F.col("_bucket").alias("_t_bucket"),
            before.alias("_before"),
            F.inline(inside),
        ).select(
            *[f"_t_{s}" for s in strata], "_t_bucket", "_cut",
            (F.col("_want") - F.col("_before")).alias("_need"),
        )
    )
    needles = lookup(target.select(*[f"_t_{s}" for s in strata], "_t_bucket").distinct())
    same = F.col("_bucket") == F.col("_t_bucket")
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"_t_{s}"))
    ranked = (
        hashed.join(needles, same)
        .withColumn(
            "_rank",
            F.row_number().over(
                Window.partitionBy(*[f"_t_{s}" for s in strata], "_t_bucket").orderBy("_h")
            ),
        )
        .select(
            *[F.col(s).alias(f"_r_{s}") for s in strata], F.col("_bucket").alias("_r_b"),
            "_h", "_rank",
        )
    )
    hit = (F.col("_t_bucket") == F.col("_r_b")) & (F.col("_need") == F.col("_rank"))
    for s in strata:
        hit = hit & F.col(f"_t_{s}").eqNullSafe(F.col(f"_r_{s}"))
    return settle(
        target.join(ranked, hit)
        .groupBy(*[F.col(f"_t_{s}").alias(s) for s in strata])
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_cut", "_h"))), lambda s: s["_h"]
            ).alias("cuts")
        )
    )
