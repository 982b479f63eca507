"""Per-feature group comparisons with multiple-testing correction.

Each test is one aggregation per feature; p-values are column arithmetic on the
one-row-per-feature result.  A feature with a missing value in a compared group
is left out, as is one whose p-value is undefined.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayloom.functions.tails import f_upper, t_two_sided, u_two_sided
from assayloom.plans.prefix import running_extreme, running_totals, same_keys
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col, measure_column, require_columns

BENJAMINI_HOCHBERG = "Benjamini-Hochberg"
BONFERRONI = "Bonferroni"

_BASES = {"log2": 2.0, "log10": 10.0, "None": None, None: None}


class Comparison(NamedTuple):
    results: DataFrame  # one row per tested feature
    corrected_alpha: DataFrame  # one row
    omitted: DataFrame  # features without a defined p-value


# ------------------------------------------------------------------ groups


def attach_groups(df: DataFrame, metadata: DataFrame, grouping: str, *, sample: str = SAMPLE) -> DataFrame:
    """Inner join of the group column on the sample."""
    require_columns(metadata, sample, grouping)
    return df.join(metadata.select(col(sample), col(grouping)), sample)


def two_groups(metadata: DataFrame, grouping: str, group1: str | None, group2: str | None) -> tuple[str, str]:
    """The requested groups, or the first (by name) that exist where a request is invalid."""
    require_columns(metadata, grouping)
    label = col(grouping)
    asked = [g for g in (group1, group2) if g is not None]
    known = {r[0] for r in metadata.filter(label.isin(asked)).select(label).distinct().collect()} if asked else set()
    first = group1 if group1 in known else metadata.agg(F.min(label)).first()[0]
    if group2 in known and group2 != first:
        return first, group2
    return first, metadata.filter(label != first).agg(F.min(label)).first()[0]


def selected_groups(metadata: DataFrame, grouping: str, asked: Sequence[str] | None) -> list[str]:
    """The requested groups (all must exist), or every group of the column."""
    require_columns(metadata, grouping)
    if not asked or isinstance(asked, str) or len(asked) < 2:
        return sorted(r[0] for r in metadata.select(col(grouping)).distinct().collect() if r[0] is not None)
    known = {r[0] for r in metadata.filter(col(grouping).isin(list(asked))).select(col(grouping)).distinct().collect()}
    unknown = [g for g in asked if g not in known]
    if unknown:
        raise ValueError(f"groups {unknown} are not in column {grouping!r}")
    return list(asked)


def _unlogged(x: Column, log_base: str | None) -> Column:
    base = _BASES.get(log_base)
    return x if base is None else F.pow(F.lit(base), x)


def log2_fold_change(mean1: Column, mean2: Column) -> Column:
    """log2 of the ratio of the group means; null where it is undefined."""
    return F.log2(F.try_divide(mean2, mean1))


def _two_group_sums(
    df: DataFrame, metadata: DataFrame, grouping: str, group1: str, group2: str, log_base: str | None,
    value: str | None, sample: str, feature: str, keep: Sequence[str] = (),
) -> DataFrame:
    """n, complete, mean, variance and unlogged mean of both groups per feature."""
    measure = measure_column(df, value)
    x = col(measure).cast("double")
    wanted = metadata.filter(col(grouping).isin(group1, group2))
    joined = attach_groups(df, wanted, grouping, sample=sample)
    aggs = []
    for i, group in ((1, group1), (2, group2)):
        mine = col(grouping) == group
        here = F.when(mine, x)
        aggs += [
            F.count(here).alias(f"n{i}"),
            F.count_if(mine & x.isNull()).alias(f"gaps{i}"),
            F.avg(here).alias(f"mean{i}"),
            F.var_samp(here).alias(f"var{i}"),
            F.avg(F.when(mine, _unlogged(x, log_base))).alias(f"plain{i}"),
        ]
    return joined.groupBy(col(feature), *map(col, keep)).agg(*aggs)


def _finish(tested: DataFrame, columns: Sequence[str], method: str, alpha: float, feature: str) -> Comparison:
    """Cut the one-row-per-feature table, drop undefined p-values, correct the rest."""
    tested = cut(tested)
    defined = tested.filter(F.col("p_value").isNotNull() & ~F.isnan("p_value"))
    corrected = correct_p_values(defined.select(col(feature), *columns, "p_value"), method)
    return Comparison(
        corrected, corrected_alpha(defined, method, alpha), tested.select(col(feature)).join(defined.select(col(feature)), feature, "left_anti")
    )


# -------------------------------------------------------------- correction


def correct_p_values(
    df: DataFrame, method: str = BENJAMINI_HOCHBERG, *, p: str = "p_value", by: Sequence[str] = (), name: str = "corrected_p_value"
) -> DataFrame:
    """Add the corrected p-value, within each family named by ``by``.

    Benjamini-Hochberg: the smallest p x n / rank over all larger p.  Bonferroni
    leaves p as it is (``corrected_alpha`` carries the correction).
    """
    if method == BONFERRONI:
        return df.withColumn(name, col(p))
    if method != BENJAMINI_HOCHBERG:
        raise ValueError(f"unknown correction {method!r}")
    totals = running_totals(df, by, p, {"__n": F.lit(1)})
    scaled = F.col("__n_total") * col(p) / F.col("__n_upto")
    adjusted = running_extreme(totals, by, scaled, "__adj", lowest=True, backwards=True).select(
        *map(col, by), col(p), F.least(F.col("__adj"), F.lit(1.0)).alias(name)
    )
    return same_keys(df, adjusted, [*by, p], "left")  # rows without p-value or family stay


def corrected_alpha(df: DataFrame, method: str, alpha: float) -> DataFrame:
    """One row: the level corrected p-values are compared with."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    level = F.try_divide(F.lit(float(alpha)), F.count("*").cast("double")) if method == BONFERRONI else F.max(F.lit(float(alpha)))
    return df.agg(F.coalesce(level, F.lit(float(alpha))).alias("corrected_alpha"))


# ------------------------------------------------------------------- tests


def t_statistics(sums: DataFrame, equal_var: bool) -> DataFrame:
    """Add ``t_statistic`` and ``df`` (null where undefined) to two-group sums."""
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    usable = (F.col("gaps1") + F.col("gaps2") == 0) & (n1 >= 2) & (n2 >= 2)
    if equal_var:
        df = (n1 + n2 - 2).cast("double")
        pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, df)
        se2 = pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    else:
        a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
        se2 = a + b
        df = F.try_divide(se2 * se2, F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    gap = F.col("mean1") - F.col("mean2")
    endless = F.signum(gap) * F.lit(float("inf"))
    t = F.when(se2 > 0, F.try_divide(gap, F.sqrt(se2))).when((se2 == 0) & (gap != 0), endless)
    return sums.withColumn("t_statistic", F.when(usable, t)).withColumn(
        "df", F.when(usable, F.coalesce(df, F.lit(1.0)))
    )


def t_test(
    df: DataFrame,
    metadata: DataFrame,
    grouping: str,
    group1: str | None = None,
    group2: str | None = None,
    *,
    equal_var: bool = True,
    method: str = BENJAMINI_HOCHBERG,
    alpha: float = 0.05,
    log_base: str | None = None,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Comparison:
    """Two-sided t-test of two groups per feature (pooled, or Welch's when not ``equal_var``)."""
    group1, group2 = two_groups(metadata, grouping, group1, group2)
    sums = _two_group_sums(df, metadata, grouping, group1, group2, log_base, value, sample, feature)
    tested = (
        t_statistics(sums, equal_var)
        .withColumn("p_value", F.when(F.col("t_statistic").isNotNull(), t_two_sided("t_statistic", "df")))
        .withColumn("log2_fold_change", log2_fold_change(F.col("plain1"), F.col("plain2")))
    )
    return _finish(tested, ["t_statistic", "df", "log2_fold_change"], method, alpha, feature)


def linear_model(
    df: DataFrame,
    metadata: DataFrame,
    grouping: str,
    group1: str | None = None,
    group2: str | None = None,
    *,
    method: str = BENJAMINI_HOCHBERG,
    alpha: float = 0.05,
    log_base: str | None = None,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Comparison:
    """Least squares of the value on a constant and the group coded -1 / +1.

    With one two-valued regressor the fit has a closed form in the group means
    and variances: slope = (mean2 - mean1) / 2.
    """
    group1, group2 = two_groups(metadata, grouping, group1, group2)
    sums = _two_group_sums(df, metadata, grouping, group1, group2, log_base, value, sample, feature)
    n1, n2 = F.col("n1"), F.col("n2")
    usable = (F.col("gaps1") + F.col("gaps2") == 0) & (n1 >= 1) & (n2 >= 1) & (n1 + n2 > 2)
    freedom = (n1 + n2 - 2).cast("double")
    residual = (n1 - 1) * F.coalesce("var1", F.lit(0.0)) + (n2 - 1) * F.coalesce("var2", F.lit(0.0))
    slope = (F.col("mean2") - F.col("mean1")) / 2.0
    se = F.sqrt(F.try_divide(residual, freedom) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))) / 2.0
    t = F.when(se > 0, F.try_divide(slope, se)).when((se == 0) & (slope != 0), F.signum(slope) * F.lit(float("inf")))
    tested = (
        sums.withColumn("slope", F.when(usable, slope))
        .withColumn("intercept", F.when(usable, (F.col("mean1") + F.col("mean2")) / 2.0))
        .withColumn("t_statistic", F.when(usable, t))
        .withColumn("df", freedom)
        .withColumn("p_value", F.when(F.col("t_statistic").isNotNull(), t_two_sided("t_statistic", "df")))
        .withColumn("log2_fold_change", log2_fold_change(F.col("plain1"), F.col("plain2")))
    )
    return _finish(tested, ["slope", "intercept", "t_statistic", "df", "log2_fold_change"], method, alpha, feature)


def anova(
    df: DataFrame,
    metadata: DataFrame,
    grouping: str,
    groups: Sequence[str] | None = None,
    *,
    method: str = BENJAMINI_HOCHBERG,
    alpha: float = 0.05,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Comparison:
    """One-way analysis of variance per feature.

    Every group must have a value and no gap. Without ``groups`` all groups of the
    column are compared; their names stay in the table.
    """
    x = col(measure_column(df, value)).cast("double")
    if groups and not isinstance(groups, str) and len(groups) >= 2:
        wanted = metadata.filter(col(grouping).isin(selected_groups(metadata, grouping, groups)))
    else:
        require_columns(metadata, grouping)
        wanted = metadata.filter(col(grouping).isNotNull())
    number = wanted.agg(F.count_distinct(col(grouping)).alias("k")).scalar()
    joined = attach_groups(df, wanted, grouping, sample=sample)
    cells = joined.groupBy(col(feature), col(grouping)).agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("gaps"), F.avg(x).alias("mean"), F.var_pop(x).alias("var")
    )
    whole = Window.partitionBy(col(feature))  # a row per group
    grand = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(whole), F.sum("n").over(whole))
    away = F.col("mean") - F.col("grand")
    per_feature = cells.withColumn("grand", grand).groupBy(col(feature)).agg(
        F.sum(F.col("n") * away * away).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.count("*").alias("k"), F.min("n").alias("fewest"),
    ).withColumn("groups", number)
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    usable = (F.col("gaps") == 0) & (F.col("k") == F.col("groups")) & (F.col("fewest") > 0) & (d2 > 0)
    tested = (
        per_feature.withColumn("d1", d1)
        .withColumn("d2", d2)
        .withColumn(
            "f_statistic",
            F.when(
                usable,
                F.when(F.col("within") > 0, F.try_divide(F.col("between") / d1, F.col("within") / d2)).when(
                    F.col("between") > 0, F.lit(float("inf"))
                ),
            ),
        )
        .withColumn("p_value", F.when(F.col("f_statistic").isNotNull(), f_upper("f_statistic", "d1", "d2")))
    )
    return _finish(tested, ["f_statistic", "d1", "d2"], method, alpha, feature)


def mann_whitney(
    df: DataFrame,
    metadata: DataFrame,
    grouping: str,
    group1: str | None = None,
    group2: str | None = None,
    *,
    method: str = BENJAMINI_HOCHBERG,
    alpha: float = 0.05,
    p_value: str = "auto",
    log_base: str | None = None,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Comparison:
    """Two-sided U test of two groups per feature.

    ``p_value`` is ``exact`` (features with ties have none), ``asymptotic`` (normal,
    corrected for ties and continuity), or ``auto``: exact without ties where a
    group has at most eight values, as is usual, else asymptotic. The exact form
    counts the ways to each rank sum of the tail asked for, at most n1 * n2 / 2 numbers
    for a pair of sizes.

    Ranks come from running totals over the distinct values of a feature, so
    ties share their average rank without ordering all rows of a feature in one task.
    """
    if p_value not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown kind of p-value {p_value!r}")
    group1, group2 = two_groups(metadata, grouping, group1, group2)
    measure = measure_column(df, value)
    wanted = metadata.filter(col(grouping).isin(group1, group2))
    joined = attach_groups(df, wanted, grouping, sample=sample)
    is_first = F.when(col(grouping) == group1, 1).otherwise(0)
    totals = running_totals(joined, [feature], measure, {"__n": F.lit(1), "__n1": is_first})
    rank = F.col("__n_upto") - (F.col("__n") - 1) / 2
    ranked = totals.groupBy(col(feature)).agg(
        F.sum(F.col("__n1") * rank).alias("rank_sum"),
        F.sum(F.col("__n").cast("double") * (F.col("__n") * F.col("__n") - 1)).alias("tie_sum"),
    )
    sums = _two_group_sums(df, metadata, grouping, group1, group2, log_base, value, sample, feature)
    n1 = F.col("n1").cast("double")
    usable = (F.col("gaps1") + F.col("gaps2") == 0) & (F.col("n1") > 0) & (F.col("n2") > 0)
    tested = (
        sums.join(ranked, feature, "left")
        .withColumn("u_statistic", F.when(usable, F.col("rank_sum") - n1 * (n1 + 1) / 2))
        .withColumn("p_value", F.when(usable, u_two_sided("u_statistic", "n1", "n2", "tie_sum", F.lit(p_value))))
        .withColumn("log2_fold_change", log2_fold_change(F.col("plain1"), F.col("plain2")))
    )
    return _finish(tested, ["u_statistic", "n1", "n2", "tie_sum", "log2_fold_change"], method, alpha, feature)


def mann_whitney_on_columns(
    wide: DataFrame, metadata: DataFrame, grouping: str, group1: str | None = None, group2: str | None = None,
    *, columns_name: str = "column", sample: str = SAMPLE, **options,
) -> Comparison:
    """U test of every value column of a wide table, such as modification counts."""
    names = [c for c in wide.columns if c not in (sample, grouping)]
    typed = wide.select(col(sample), *[col(c).cast("double").alias(c) for c in names])
    tall = typed.unpivot([col(sample)], [col(c) for c in names], columns_name, "amount")
    return mann_whitney(
        tall, metadata, grouping, group1, group2, value="amount", feature=columns_name, sample=sample, **options
    )


def significant(comparison: Comparison, *, strict: bool = False, p: str = "corrected_p_value") -> DataFrame:
    """Results at or below (``strict``: below) the corrected level."""
    level = comparison.corrected_alpha.scalar()
    return comparison.results.filter(col(p) < level if strict else col(p) <= level)


def with_results(df: DataFrame, results: DataFrame, *, feature: str = FEATURE) -> DataFrame:
    """The long rows of the tested features with the results attached."""
    return df.join(results, feature)


def sample_groups(df: DataFrame, metadata: DataFrame, grouping: str, results: DataFrame, *, sample: str = SAMPLE, feature: str = FEATURE) -> DataFrame:
    """Sample-to-group pairs among the long rows of the tested features."""
    rows = df.join(results.select(col(feature)), feature, "left_semi")
    return attach_groups(rows, metadata, grouping, sample=sample).select(col(sample), col(grouping)).distinct()
