"""Ordering helpers against plain sorting, with hot values and hot groups."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from vetframe.functions import ordering as O, ranks as R


def _skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [7.0 if rng.random() < 0.4 else round(rng.uniform(-50, 50), 3) for _ in range(n)]


def test_order_statistics_match_sorting_whatever_the_buffer(spark):
    values = _skewed()
    ordered = sorted(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "x double")
    ranks = [0, 1, 500, 1200, 1500, 1501, 2998, 2999]
    for limit in (1, 40, 10_000):
        found = R.order_statistics(df, {"x": ranks}, buffer_limit=limit)["x"]
        assert [found[r] for r in ranks] == [ordered[r] for r in ranks]


def test_quantiles_agree_between_both_ways(spark):
    values = _skewed(seed=3)
    df = spark.createDataFrame(
        [(v, i, None) for i, v in enumerate(values)], "x double, i long, e double"
    )
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    plain = R.exact_quantiles(df, ["x", "i", "e"], shares)
    narrow = R.exact_quantiles(df, ["x", "i", "e"], shares, buffer_limit=25)
    assert plain["e"] == narrow["e"] == [None] * 6
    for c in ("x", "i"):
        assert all(abs(a - b) < 1e-9 for a, b in zip(plain[c], narrow[c]))


def test_quantiles_of_integers_beyond_doubles_and_of_decimals(spark):
    big = [2**60 + i for i in range(3000)]
    df = spark.createDataFrame([(v, Decimal(i) / 4) for i, v in enumerate(big)], "x long, d decimal(12, 2)")
    found = R.order_statistics(df, {"x": [0, 1, 1717, 2999], "d": [5]}, buffer_limit=50)
    assert found["x"] == {r: big[r] for r in (0, 1, 1717, 2999)} and found["d"] == {5: 1.25}


def test_scans_do_not_grow_with_the_columns(spark):
    """The rows that Python workers hand over count the scans: two for 20,000 values, however many columns."""
    rows, columns = 20_000, 100
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    source = spark.range(0, rows, 1, 4).mapInPandas(counted, "id long")
    value = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(997 + 100_003 * (i % 3))).cast("double")
    df = source.select(*[value(i).alias(f"c{i}") for i in range(columns)])
    got = R.exact_quantiles(df, df.columns, [0.4])
    assert seen.value / rows <= 3
    names = ["c0", "c1", "c2", "c99"]
    want = df.agg(*[F.percentile(c, 0.4) for c in names]).first()
    assert [got[c][0] for c in names] == list(want)


def test_running_totals_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randint(0, 9)) for i in range(2000)]
    rows += [(None, 5000 + i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {
        (r.g, r.k): r.upto
        for r in O.running_totals(df, [F.col("k")], {"upto": F.col("v")}, ["g"]).collect()
    }
    sums: dict = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + v
        assert got[(g, k)] == sums[g]


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(5)
    rows = O.global_row_number(df, [F.col("k"), F.col("id")], "n").orderBy("k", "id").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_hash_cuts_take_exact_numbers_per_stratum(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "big").alias("s"))
    cuts = O.hash_cuts(df, ["id"], 9, F.array(F.lit(10).cast("long"), F.lit(700).cast("long")), ["s"])
    hashed = df.withColumn("h", O.hash_order(["id"], 9))
    for row in cuts.collect():
        part = hashed.filter(F.col("s").eqNullSafe(row.s))
        assert part.filter(F.col("h") <= row.cuts[0]).count() == 10
        assert part.filter(F.col("h") <= row.cuts[1]).count() == 700
