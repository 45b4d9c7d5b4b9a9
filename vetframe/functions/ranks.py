"""Exact values at given ranks of many columns at once, by narrowing brackets with quantile sketches.

Every scan serves all columns. The first one builds a mergeable sketch per column; its quantiles a little
below and above a wanted rank are *cuts*. The next scan counts the rows on either side of each pair of
cuts and sketches the values between them, which gives the exact place of the rank and narrower cuts, and
so on. A sketch of at most ``size`` values holds them all, and then its quantiles are the answer.

The rows between two cuts shrink about 350 times in a scan with the usual size: one scan is enough for
8,192 values, two for three million, three for 10**9, four for 4 * 10**11, whatever the number of columns. A hot
value becomes a cut and is counted, never stored. Nothing is sorted, and memory is one sketch (about
160 KB) for each pair of cuts. Sketches are merged in two steps, the second one with a row for each pair
of cuts, so that no task takes all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import count_where, let, quoted

#: Size of a sketch; up to so many values it holds all of them.
BUFFER_LIMIT = 8192
#: Smallest size of a sketch.
MIN_SIZE = 8
#: Tasks that merge the sketches of the scanning tasks before the last one does.
MERGERS = 32

#: How the sketch of each kind of number is built, merged and read.
_SKETCHES = {
    "long": (F.kll_sketch_agg_bigint, F.kll_merge_agg_bigint, F.kll_sketch_get_n_bigint,
             F.kll_sketch_get_quantile_bigint),
    "double": (F.kll_sketch_agg_double, F.kll_merge_agg_double, F.kll_sketch_get_n_double,
               F.kll_sketch_get_quantile_double),
}


def rank_error(size: int) -> float:
    """Share of the values by which a sketch's quantile may be off, with about five deviations to spare."""
    # The published error of this kind of sketch at 99 % confidence.
    return min(0.25, 2 * 2.296 / size**0.9021)


@dataclass
class _Bracket:
    """Ranks of a column that lie between the same two values; ``None`` is an open end."""

    column: str
    ranks: list[int]
    cuts: tuple
    #: Values that certainly enclose the ranks.
    outer: tuple = (None, None)


def _kind(df: DataFrame, name: str) -> str:
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return "long" if isinstance(df.schema[name].dataType, integral) else "double"


def _scan(
    df: DataFrame,
    sketched: dict[int, tuple[str, Column]],
    counted: dict[int, dict[str, Column]],
    ranks: Callable[[DataFrame], DataFrame],
    size: int,
) -> dict[int, dict]:
    """One scan: some counts, and a sketch for each of some (kind, value), which is read for some ranks.

    ``ranks`` adds an array ``ranks`` to the rows ``(number, counts..., n)``, where ``n`` is how many values
    the sketch has seen. Gives those rows with ``read``: for each rank its value, which is exact if the
    sketch holds all values, and the cuts below and above it, ``None`` where the values end.
    """
    names = sorted({k for counts in counted.values() for k in counts})
    numbers = sorted({*sketched, *counted})
    part = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_merger")).agg(
        *[_SKETCHES[kind][0](x, size).alias(f"s{i}") for i, (kind, x) in sketched.items()],
        *[c.alias(f"{k}{i}") for i, counts in counted.items() for k, c in counts.items()],
    )
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    rows = [
        F.struct(
            F.lit(i).alias("number"),
            *[(F.col(f"{k}{i}") if k in counted.get(i, ()) else zero).alias(k) for k in names],
            *[
                (F.col(f"s{i}") if i in sketched and sketched[i][0] == kind else none).alias(kind)
                for kind in _SKETCHES
            ],
        )
        for i in numbers
    ]
    whole = part.select(F.inline(F.array(*rows))).groupBy("number").agg(
        *[F.sum(k).alias(k) for k in names],
        *[_SKETCHES[kind][1](kind, size).alias(kind) for kind in _SKETCHES],
    )
    seen = {kind: F.coalesce(_SKETCHES[kind][2](kind), zero) for kind in _SKETCHES}
    asked = ranks(whole.withColumn("n", sum(seen.values())))
    # A sketch is read at literal shares only: at a grid fine enough to meet each of `size` values, of
    # which the wanted ones are picked.
    grid = 1 << (size - 1).bit_length()
    at = F.split(F.lit(",".join(str((j + 0.5) / grid) for j in range(grid))), ",").cast("array<double>")
    kinds = {kind for kind, _ in sketched.values()}
    read = {
        kind: let(F.when(seen[kind] > 0, _SKETCHES[kind][3](kind, at)), lambda values: _picked(values, grid, size))
        for kind in kinds
    }
    found = {}
    for row in asked.select("number", *names, "n", *[read[kind].alias(kind) for kind in kinds]).collect():
        kind = sketched[row.number][0] if row.number in sketched else None
        found[row.number] = {**{k: row[k] for k in names}, "n": row.n, "read": kind and row[kind]}
    return {i: found.get(i, dict.fromkeys(names, 0) | {"n": 0, "read": None}) for i in numbers}


def _picked(values: Column, grid: int, size: int) -> Column:
    """Of a sketch's values at the middles of ``grid`` equal steps: for each of the column ``ranks`` that at the
    rank, and those safely below and above it (null beyond the ends)."""

    def three(r: Column) -> Column:
        share = (r + 0.5) / F.col("n")
        steps = lambda s: F.floor(s * grid).cast("int")
        error = F.lit(rank_error(size))
        return F.array(
            F.get(values, steps(share)), F.get(values, steps(share - error) - 1), F.get(values, steps(share + error) + 1)
        )

    return F.transform("ranks", three)


def _narrow(df: DataFrame, brackets: list[_Bracket], size: int) -> dict[str, dict[int, float]]:
    """Values at the ranks of some brackets."""
    found: dict[str, dict[int, float]] = {}
    while brackets:
        sketched, counted = {}, {}
        for i, b in enumerate(brackets):
            kind = _kind(df, b.column)
            x = quoted(b.column).cast(kind)
            low, high = b.cuts
            between = x.isNotNull()
            counted[i] = {}
            if low is not None:
                counted[i] = {"below": count_where(x < F.lit(low)), "low": count_where(x == F.lit(low))}
                between = between & (x > F.lit(low))
            if high is not None and high != low:
                counted[i]["high"] = count_where(x == F.lit(high))
                between = between & (x < F.lit(high))
            if low is None or high != low:
                sketched[i] = (kind, F.when(between, x))

        wanted = df.sparkSession.createDataFrame(
            [(i, b.ranks) for i, b in enumerate(brackets)], "number int, _ranks array<long>"
        )

        def local(rows: DataFrame) -> DataFrame:
            before = sum((F.col(k) for k in ("below", "low") if k in rows.columns), F.lit(0))
            return rows.join(F.broadcast(wanted), "number").withColumn(
                "ranks", F.transform("_ranks", lambda r: r - before)
            )

        rows = _scan(df, sketched, counted, local, size)
        after: list[_Bracket] = []
        for i, b in enumerate(brackets):
            low, high = b.cuts
            below, on_low, on_high = (rows[i].get(k, 0) for k in ("below", "low", "high"))
            inside, read = rows[i]["n"], rows[i]["read"]
            values = found.setdefault(b.column, {})
            left, middle, right = [], [], []
            for at, r in enumerate(b.ranks):
                if r < below:
                    left.append(r)
                elif r < below + on_low:
                    values[r] = low
                elif r < below + on_low + inside:
                    if inside <= size:
                        values[r] = read[at][0]
                    else:
                        middle.append(r)
                elif r < below + on_low + inside + on_high:
                    values[r] = high
                else:
                    right.append(r)
            # A sketch's cuts rarely miss; the values known to enclose the ranks are the next cuts then.
            if left:
                after.append(_Bracket(b.column, left, (b.outer[0], low), (b.outer[0], low)))
            if middle:
                cuts = (read[b.ranks.index(middle[0])][1], read[b.ranks.index(middle[-1])][2])
                after.append(_Bracket(b.column, middle, tuple(o if c is None else c for c, o in zip(cuts, b.cuts)), b.cuts))
            if right:
                after.append(_Bracket(b.column, right, (high, b.outer[1]), (high, b.outer[1])))
        brackets = after
    return found


def _in_runs(ranks: Sequence[int]) -> list[list[int]]:
    """Neighbouring ranks together."""
    runs: list[list[int]] = []
    for r in sorted(set(ranks)):
        if runs and r == runs[-1][-1] + 1:
            runs[-1].append(r)
        else:
            runs.append([r])
    return runs


def _size(buffer_limit: int) -> int:
    return max(MIN_SIZE, min(buffer_limit, BUFFER_LIMIT))


def order_statistics(
    df: DataFrame, wanted: dict[str, Sequence[int]], buffer_limit: int = BUFFER_LIMIT
) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ranks of numeric columns, without their missing values."""
    slim = df.select(*[quoted(c) for c in wanted])
    open_ends = [
        _Bracket(c, run, (None, None)) for c, ranks in wanted.items() for run in _in_runs(ranks)
    ]
    return _narrow(slim, open_ends, _size(buffer_limit))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    buffer_limit: int = BUFFER_LIMIT,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns; ``None`` for a column without values.

    The answer is a handful of numbers per column, so it returns to the driver and later passes
    use it as literals.
    """
    columns, size = list(columns), _size(buffer_limit)
    if not columns or not shares:
        return {c: [] for c in columns}
    slim = df.select(*[quoted(c) for c in columns])
    sketched = {i: (_kind(slim, c), quoted(c).cast(_kind(slim, c))) for i, c in enumerate(columns)}

    def ends(rows: DataFrame) -> DataFrame:
        place = lambda s: s * (F.col("n") - 1)
        both = lambda s: F.array(F.floor(place(s)), F.ceil(place(s)))
        return rows.withColumn("ranks", F.flatten(F.transform(F.array(*[F.lit(float(s)) for s in shares]), both)))

    rows = _scan(slim, sketched, {}, ends, size)
    found: dict[str, dict[int, float]] = {}
    brackets = []
    places: dict[str, list[float]] = {}
    for i, c in enumerate(columns):
        n, values = rows[i]["n"], rows[i]["read"]
        places[c] = [s * (n - 1) for s in shares] if n else []
        for at, p in enumerate(places[c]):
            low, high = values[2 * at : 2 * at + 2]
            ranks = [math.floor(p), math.ceil(p)]
            if n <= size:
                found.setdefault(c, {}).update(zip(ranks, (low[0], high[0])))
            else:
                brackets.append(_Bracket(c, sorted(set(ranks)), (low[1], high[2])))
    for c, values in _narrow(slim, brackets, size).items():
        found.setdefault(c, {}).update(values)

    def between(c: str, p: float) -> float:
        low, high = (float(found[c][r]) for r in (math.floor(p), math.ceil(p)))
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    return {c: [between(c, p) for p in places[c]] or [None] * len(shares) for c in columns}
