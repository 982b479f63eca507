"""Ordered computations (ranks, running totals, quantiles) without one-task windows.

``Window.orderBy`` without a fine partition key sorts a whole group in a single
task.  Here each group is cut into value ranges first:

1. equal values are merged (map-side combine), so ties never pile up;
2. a mergeable quantile sketch per group gives the range borders;
3. totals per (group, range) are summed and shifted - a table of at most
   ``ranges`` rows per group;
4. only the rows of one (group, range) are ordered together.

The range number is a pure function of the value, hence retries and reuse of
either branch always agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayloom.schema import col, quoted

RANGES = 64  # of a group; a power of two
MOST_RANGES = 1 << 14  # of a whole table


def _ranges(df: DataFrame, by: Sequence[str]) -> int:
    """Ranges of a group, or for a whole table as many as a shuffle has tasks; a power of two."""
    if by:
        return RANGES
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_RANGES, max(RANGES, 1 << (tasks - 1).bit_length()))


def same_keys(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by``, where null is a key like any other; the keys appear once."""
    named = right.select(*[col(b).alias(f"__key{i}") for i, b in enumerate(by)], *[col(c) for c in right.columns if c not in by])
    same = [col(b).eqNullSafe(F.col(f"__key{i}")) for i, b in enumerate(by)]
    return left.join(named, same, how).drop(*[f"__key{i}" for i in range(len(by))])


def _range_of(df: DataFrame, ranges: int) -> DataFrame:
    """Add ``__range``: how many of the sorted borders lie below the value (binary search)."""
    steps, at, step = [], "0", ranges // 2
    while step:
        name = "__range" if step == 1 else f"__at{step}"
        steps.append(f"{at} + if(get(__borders, {at} + {step - 1}) < __order, {step}, 0) as {name}")
        at, step = name, step // 2
    return df.selectExpr("*", *steps).drop("__borders", *[f"__at{2**i}" for i in range(1, ranges.bit_length() - 1)])


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    *,
    descending: bool = False,
    wanted: str | None = None,
) -> DataFrame:
    """One row per (group, distinct value) with cumulative and total sums.

    For each name in ``sums`` the result has ``name`` (this value alone),
    ``name_upto`` (this and all earlier values) and ``name_total`` (the group).

    All three uses of the merged values read the same columns, so the plan holds
    one shuffle of them and reuses it.  ``wanted`` is a condition on a range
    (``before`` it, ``inside`` it and ``total`` of the group, for the first sum) that
    drops whole ranges before any row of theirs is ordered.
    """
    keys = [col(b) for b in by]
    sign = -1 if descending else 1
    cells = (
        df.filter(col(order).isNotNull())
        .groupBy(*keys, col(order))
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .withColumn("__order", sign * col(order).cast("double"))
    )
    ranges = _ranges(df, by)
    cut_points = [i / ranges for i in range(1, ranges)]
    carried = F.when(F.coalesce(*[F.col(n) for n in sums]).isNotNull(), F.col("__order"))
    borders = F.percentile_approx(carried, cut_points, max(1_000, 16 * ranges)).alias("__borders")
    if by:
        marked = same_keys(cells, cells.groupBy(*keys).agg(borders), by)
    else:
        marked = cells.withColumn("__borders", cells.agg(borders).scalar())
    marked = _range_of(marked, ranges)

    per_range = marked.groupBy(*keys, "__range").agg(*[F.sum(n).alias(f"__{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    shifts = per_range.select(
        *keys,
        "__range",
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}_before") for n in sums],
        *[F.sum(f"__{n}").over(whole).alias(f"{n}_total") for n in sums],
        *[F.col(f"__{n}").alias("inside") for n in list(sums)[:1]],
    )
    if wanted is not None:
        shifts = shifts.filter(wanted)
    inside = (
        Window.partitionBy(*keys, "__range")
        .orderBy("__order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return same_keys(marked, shifts, [*by, "__range"]).select(
        *keys,
        col(order),
        "__order",
        "__range",
        *[F.col(n) for n in sums],
        *[(F.sum(n).over(inside) + F.col(f"__{n}_before")).alias(f"{n}_upto") for n in sums],
        *[F.col(f"{n}_total") for n in sums],
    )


def running_extreme(
    totals: DataFrame, by: Sequence[str], value: Column, name: str, *, lowest: bool, backwards: bool
) -> DataFrame:
    """Cumulative min or max over the rows ``running_totals`` returned, in either direction."""
    pick = F.min if lowest else F.max
    best = F.least if lowest else F.greatest
    keys = [col(b) for b in by]
    cells = totals.withColumn("__v", value)
    # backwards means in falling order: a frame that ends at the last row is computed anew for each row
    falling = lambda c: F.col(c).desc() if backwards else F.col(c)
    ranges = cells.groupBy(*keys, "__range").agg(pick("__v").alias("__best"))
    outside = Window.partitionBy(*keys).orderBy(falling("__range")).rowsBetween(Window.unboundedPreceding, -1)
    others = ranges.select(*keys, "__range", pick("__best").over(outside).alias("__other"))
    inside = Window.partitionBy(*keys, "__range").orderBy(falling("__order")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        same_keys(cells, others, [*by, "__range"])
        .withColumn("__here", pick("__v").over(inside))
        .withColumn(name, best(F.col("__here"), F.coalesce("__other", "__here")))
        .drop("__v", "__here", "__other")
    )


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float], *, large: bool | None = None
) -> DataFrame:
    """Exact quantiles per group, linear between neighbours: one row per group.

    A group's distinct values are counted in one aggregation, combined before the
    shuffle; a group whose distinct values don't fit one task is ``large``, and so
    is, by default, the whole table (``by`` empty). Large groups are cut into
    ranges, and only those that hold a wanted position are ordered.
    """
    if not (not by if large is None else large):
        shares = F.array(*[F.lit(float(p)) for p in probabilities.values()])
        found = (
            df.filter(col(value).isNotNull()).groupBy(*map(col, by))
            .agg(F.percentile(col(value).cast("double"), shares).alias("__quantiles"))
        )
        return found.select(*map(col, by), *[F.col("__quantiles")[i].alias(name) for i, name in enumerate(probabilities)])
    n = "__n"
    first, last = f"({n}_upto - {n})", f"{n}_upto"
    spots, picks, names = [], [], []
    for i, (name, p) in enumerate(probabilities.items()):
        position = f"{float(p)!r}D * ({n}_total - 1)"
        ends = (f"floor({position})", f"ceil({position})")
        spots += [f"(__{n}_before <= {k} and {k} < __{n}_before + inside)" for k in ends]
        picks += [
            F.expr(f"max(case when {first} <= {k} and {k} < {last} then cast({quoted(value)} as double) end)").alias(f"__q{i}{side}")
            for side, k in zip("ab", ends)
        ]
        picks.append(F.expr(f"max({position} - floor({position}))").alias(f"__q{i}f"))
        names.append(f"__q{i}a * (1 - __q{i}f) + __q{i}b * __q{i}f as {quoted(name)}")
    totals = running_totals(df, by, value, {n: F.lit(1)}, wanted=" or ".join(dict.fromkeys(spots)))
    return totals.groupBy(*map(col, by)).agg(*picks).selectExpr(*map(quoted, by), *names)
