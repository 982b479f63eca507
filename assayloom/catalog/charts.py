"""Chart-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.catalog import views as v
from assayloom.catalog.learning import _VECTORS, _near
from assayloom.catalog.registry import query
from assayloom.operators import charts, filters, normalise, outliers, stats
from assayloom.schema import FEATURE, SAMPLE, col

_BOX = "round(min(x), {d}) as low, round(quantile_cont(x, 0.25), {d}) as q1, round(quantile_cont(x, 0.5), {d}) as median, round(quantile_cont(x, 0.75), {d}) as q3, round(max(x), {d}) as high"


def _box(df, *keys, digits=6):
    return df.select(
        *keys, F.round("min", digits).alias("low"), F.round("q1", digits).alias("q1"), F.round("median", digits).alias("median"),
        F.round("q3", digits).alias("q3"), F.round("max", digits).alias("high"),
    )


@query("cht1_kept_and_filtered", f"""with {v.BY_PART}, n as (select p, count(x) >= 0.25 * (select count(distinct s) from i) k from i group by p)
 select 'kept' as part, count(*) filter (where k) as n from n union all select 'filtered', count(*) filter (where not k) from n""")
def cht1(spark, folder):
    found = filters.by_samples_missing(v.by_part(spark, folder), percentage=0.25)
    return charts.keep_share(found.kept, found.removed, FEATURE)


@query("cht2_box_all", f"with {v.BY_PART} select {_BOX.format(d=6)} from i")
def cht2(spark, folder):
    return _box(charts.box_statistics(v.by_part(spark, folder)))


@query("cht2_box_by_sample", f"with {v.BY_PART} select s as sample, {_BOX.format(d=6)} from i group by s")
def cht2_sample(spark, folder):
    return _box(charts.box_statistics(v.by_part(spark, folder), SAMPLE), col(SAMPLE).alias("sample"))


@query("cht2_box_by_feature_before_and_after", f"""with {v.BY_BRAND}, z as (select s, quantile_cont(x, 0.5) q from i group by s),
 b as (select 'before' k, p, x from i union all select 'after', p, x / q from i join z using (s))
 select k as tab, p as feature, {_BOX.format(d=6)} from b group by 1, 2""")
def cht2_compare(spark, folder):
    before = v.by_brand(spark, folder)
    found = charts.compare_boxes(before, normalise.by_median(before).table, FEATURE)
    return _box(found, F.col("table").alias("tab"), col(FEATURE).alias("feature"))


def _bins(x: str) -> str:
    return f"""y as (select {x} x from i), b as (select min(x) a, max(x) z, (max(x) - min(x)) / 100 w from y),
 c as (select case when floor((x - a) / w) > 0 and x >= z and floor((x - a) / w) * w + a >= z then floor((x - a) / w) - 1 else floor((x - a) / w) end k from y, b)
 select cast(k as bigint) as bin, round(any_value(a) + k * any_value(w), 6) as "left", round(any_value(a) + (k + 1) * any_value(w), 6) as "right", count(*) as n from c, b group by k"""


@query("cht3_histogram", f"with {v.BY_PART}, {_bins('x')}")
def cht3(spark, folder):
    return _edges(charts.histogram(v.by_part(spark, folder)))


def _edges(found):
    return found.select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n")


@query("cht3_histogram_log10", f"with {v.BY_PART}, {_bins('log10(x)')}")
def cht3_log(spark, folder):
    return _edges(charts.histogram(v.by_part(spark, folder), logged=True))


@query("cht3_histograms_overlaid", f"""with {v.BY_PART}, y as (select 'before' t, x from i union all select 'after', x from i where x > 60000),
 o as (select t, (max(x) - min(x)) / 100 w from y group by t), b as (select min(x) a, max(x) z, (select max(w) from o) w from y),
 c as (select t, case when floor((x - a) / w) > 0 and x >= z and floor((x - a) / w) * w + a >= z then floor((x - a) / w) - 1 else floor((x - a) / w) end k from y, b)
 select t as tab, cast(k as bigint) as bin, count(*) as n from c group by 1, 2""")
def cht3_overlay(spark, folder):
    before = v.by_part(spark, folder)
    found = charts.compare_histograms(before, before.filter("Intensity > 60000"), overlay=True)
    return found.select(F.col("table").alias("tab"), "bin", "n")


@query("cht4_volcano", f"""with t as (select 'P' || o_orderkey p, o_totalprice / (select max(o_totalprice) + 1 from orders) v, (o_custkey % 7) / 2.0 - 1.5 c from orders)
 select p as feature, c as log2_fold_change, round(-log10(v), 6) as minus_log10_p, v <= 0.3 and abs(c) >= 1 as significant, p in ('P1', 'P33') as of_interest from t""")
def cht4(spark, folder):
    orders = v.table(spark, folder, "orders")
    top = orders.agg((F.max("o_totalprice") + 1).alias("m")).scalar()
    results = orders.select(
        F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias(FEATURE), (F.col("o_totalprice") / top).alias("corrected_p_value"),
        ((F.col("o_custkey") % 7) / 2.0 - 1.5).alias("log2_fold_change"),
    )
    found = charts.volcano(results, 0.3, 1.0, ["P1", "P33"])
    return found.select(col(FEATURE).alias("feature"), "log2_fold_change", F.round("minus_log10_p", 6).alias("minus_log10_p"), "significant", "of_interest")


_Z = f"{v.BY_BRAND}, a as (select p, avg(x) m, stddev_pop(x) d from i group by p), z as (select s, p, (x - m) / d z from i join a using (p)), t as (select s, z from z where p = 'Brand#12')"


@query("cht5_similar_euclidean", f"with {_Z} select p as feature, round(sqrt(sum((z.z - t.z) ** 2)), 6) as similarity from z join t using (s) where p <> 'Brand#12' group by p having sqrt(sum((z.z - t.z) ** 2)) <= 13.5")
def cht5(spark, folder):
    found = charts.similar_features(v.by_brand(spark, folder), "Brand#12", 13.5)
    return found.select(col(FEATURE).alias("feature"), F.round("similarity", 6).alias("similarity"))


@query("cht5_similar_cosine", f"""with {_Z}, c as (select p, sum(z.z * t.z) / (sqrt(sum(z.z * z.z)) * sqrt(sum(t.z * t.z))) c from z join t using (s) where p <> 'Brand#12' group by p)
 select p as feature, round(c, 6) as similarity from c where c >= 0.05""")
def cht5_cosine(spark, folder):
    found = charts.similar_features(v.by_brand(spark, folder), "Brand#12", 0.05, "cosine similarity")
    return found.select(col(FEATURE).alias("feature"), F.round("similarity", 6).alias("similarity"))


@query("cht5_intensity_band", f"with {v.BY_PART} select s as sample, min(x) as low, max(x) as high from i group by s")
def cht5_band(spark, folder):
    return charts.intensity_band(v.by_part(spark, folder)).withColumnRenamed(SAMPLE, "sample")


@query("cht6_scatter_with_colour", f"""with {_VECTORS}, {_near('euclidean', 20)},
 k as (select i, max(round(d, 10)) kd from n group by i),
 l as (select n.i, 1 / (avg(greatest(round(n.d, 10), k.kd)) + 1e-10) lrd from n join k on k.i = n.j group by n.i)
 select n.i as id, round(-avg(b.lrd) / any_value(a.lrd), 6) as anomaly_score, any_value(e.label) as colour
 from n join l a on a.i = n.i join l b on b.i = n.j join e on e.id = n.i group by n.i""")
def cht6(spark, folder):
    """Anomaly scores of all samples, coloured by their label."""
    rows = v.vectors(spark, folder)
    scores = outliers.local_outlier_factor(rows, 20).select("id", F.round("anomaly_score", 6).alias("anomaly_score"))
    return charts.scatter(scores, rows.select(F.col("id").alias(SAMPLE), F.col("label").alias("colour")))


@query("cht7_heat_map_by_feature", f"""with {v.BY_BRAND}, {v.GROUPS}, a as (select p, avg(x) m, stddev_pop(x) d from i group by p)
 select s as sample, p as feature, round((x - a.m) / d, 6) as value, g as grp from i join a using (p) join m using (s)""")
def cht7(spark, folder):
    groups = v.groups(spark, folder).select(SAMPLE, "Group")
    found = charts.heat_map(v.by_brand(spark, folder), standardise="column", groups=groups)
    return found.select(col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.round("value", 6).alias("value"), F.col("Group").alias("grp"))


@query("cht7_heat_map_by_sample", f"""with {v.BY_PART}, a as (select s, avg(x) m, stddev_pop(x) d from i group by s)
 select s as sample, p as feature, round((x - m) / d, 6) as value from i join a using (s)""")
def cht7_rows(spark, folder):
    return v.tidy(charts.heat_map(v.by_part(spark, folder), standardise="row"), 6, "value")


@query("sta3_sample_groups", f"with {v.BY_BRAND}, {v.GROUPS} select distinct s as sample, g as grp from i join m using (s)")
def sta3_groups(spark, folder):
    table, groups = v.by_brand(spark, folder), v.groups(spark, folder)
    found = stats.sample_groups(table, groups, "Group", stats.anova(table, groups, "Group").results)
    return found.select(col(SAMPLE).alias("sample"), F.col("Group").alias("grp"))
