"""Group comparisons and modification counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.catalog import views as v
from assayloom.catalog.registry import query
from assayloom.operators import filters, normalise, ptm, stats
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col

_SUMS = """w as (select p, count(x) filter (where g = 'EUROPE') n1, count(x) filter (where g = 'ASIA') n2,
   avg(x) filter (where g = 'EUROPE') m1, avg(x) filter (where g = 'ASIA') m2,
   var_samp(x) filter (where g = 'EUROPE') v1, var_samp(x) filter (where g = 'ASIA') v2 from i join m using (s) group by p)"""

# two-sided p of Student's t for whole degrees of freedom: the finite trigonometric series
_T_P = """case when df % 2 = 0 then 1 - sin(th) * list_sum(list_transform(range(0, cast(df / 2 as bigint)),
     lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * cos(th) ** (2 * j)))
   else 1 - 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(list_transform(range(0, cast((df - 1) / 2 as bigint)),
     lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * cos(th) ** (2 * j))), 0)) end"""

_POOLED = f"""t0 as (select *, n1 + n2 - 2 df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) t,
   log2(m2 / m1) fc from w where n1 >= 2 and n2 >= 2),
 t1 as (select *, atan(abs(t) / sqrt(df)) th from t0), t2 as (select *, {_T_P} pv from t1)"""

_BH = """bh as (select p, least(1, min(pv * n / r) over (order by pv desc, r desc rows between unbounded preceding and current row)) adj
   from (select p, pv, count(*) over () n, rank() over (order by pv) + count(*) over (partition by pv) - 1 r from {t}))"""


@query("sta1_attach_groups", f"""with {v.BY_PART}, {v.GROUPS} select s as sample, p as feature, g as grp, round(x, 2) as value from i join m using (s)""")
def sta1(spark, folder):
    joined = stats.attach_groups(v.by_part(spark, folder), v.groups(spark, folder), "Group")
    return joined.select(col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.col("Group").alias("grp"), F.round("Intensity", 2).alias("value"))


@query("sta2_pooled_t_test", f"""with {v.BY_BRAND}, {v.GROUPS}, {_SUMS}, {_POOLED}, {_BH.format(t='t2')}
 select p as feature, round(t, 6) as t_statistic, cast(df as double) as df, round(pv, 8) as p_value, round(adj, 8) as corrected_p_value,
   round(fc, 6) as log2_fold_change from t2 join bh using (p)""")
def sta2(spark, folder):
    found = stats.t_test(v.by_brand(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA").results
    return _tested(found, "t_statistic", "df")


def _tested(found, *statistics):
    return found.select(
        col(FEATURE).alias("feature"), *[F.round(c, 6).alias(c) for c in statistics], F.round("p_value", 8).alias("p_value"),
        F.round("corrected_p_value", 8).alias("corrected_p_value"), F.round("log2_fold_change", 6).alias("log2_fold_change"),
    )


@query("sta2_welch_statistics", f"""with {v.BY_BRAND}, {v.GROUPS}, {_SUMS}
 select p as feature, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t_statistic,
   round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) as df from w where n1 >= 2 and n2 >= 2""")
def sta2_welch(spark, folder):
    found = stats.t_test(v.by_brand(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA", equal_var=False).results
    return found.select(col(FEATURE).alias("feature"), F.round("t_statistic", 6).alias("t_statistic"), F.round("df", 6).alias("df"))


# two-sided p for any degrees of freedom: Simpson's rule over the angle whose tangent is t / sqrt(df)
_SIMPSON = """exp(lgamma((df + 1) / 2) - lgamma(df / 2)) * 2 / sqrt(pi()) * (pi() / 2 - th) / 6000
   * list_sum(list_transform(range(0, 2001), lambda j: case when j = 0 or j = 2000 then 1 when j % 2 = 1 then 4 else 2 end
     * greatest(cos(th + (pi() / 2 - th) * j / 2000), 0) ** (df - 1)))"""


@query("sta2_welch_p_values", f"""with {v.BY_BRAND}, {v.GROUPS}, {_SUMS},
 t0 as (select *, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) df, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) t, log2(m2 / m1) fc from w where n1 >= 2 and n2 >= 2),
 t1 as (select *, atan(abs(t) / sqrt(df)) th from t0), t2 as (select *, {_SIMPSON} pv from t1), {_BH.format(t='t2')}
 select p as feature, round(t, 6) as t_statistic, round(df, 6) as df, round(pv, 6) as p_value, round(adj, 6) as corrected_p_value, round(fc, 6) as log2_fold_change from t2 join bh using (p)""")
def sta2_welch_p(spark, folder):
    found = _tested(stats.t_test(v.by_brand(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA", equal_var=False).results, "t_statistic", "df")
    return found.withColumns({c: F.round(c, 6) for c in ("p_value", "corrected_p_value")})


@query("sta3_anova", f"""with {v.BY_BRAND}, {v.GROUPS},
 c as (select p, g, count(x) n, avg(x) a, var_pop(x) * count(x) ss from i join m using (s) group by 1, 2),
 t as (select p, sum(n * a) / sum(n) ga from c group by p),
 f0 as (select p, sum(n) n, count(*) k, sum(n * (a - ga) ** 2) b, sum(ss) w from c join t using (p) group by p),
 f1 as (select p, cast(k - 1 as double) d1, cast(n - k as double) d2, (b / (k - 1)) / (w / (n - k)) f from f0),
 f2 as (select *, d2 / (d2 + d1 * f) z from f1), f3 as (select *, z ** (d2 / 2) * (1 + d2 / 2 * (1 - z)) pv from f2), {_BH.format(t='f3')}
 select p as feature, round(f, 6) as f_statistic, d1, d2, round(pv, 8) as p_value, round(adj, 8) as corrected_p_value from f3 join bh using (p)""")
def sta3(spark, folder):
    found = stats.anova(v.by_brand(spark, folder), v.groups(spark, folder), "Group").results
    return found.select(
        col(FEATURE).alias("feature"), F.round("f_statistic", 6).alias("f_statistic"), "d1", "d2", F.round("p_value", 8).alias("p_value"),
        F.round("corrected_p_value", 8).alias("corrected_p_value"),
    )


@query("sta4_linear_model", f"""with {v.BY_BRAND}, {v.GROUPS}, {_SUMS}, {_POOLED}, {_BH.format(t='t2')},
 o as (select p, regr_slope(x, z) b, regr_intercept(x, z) a from (select p, x, case g when 'EUROPE' then -1 else 1 end z
   from i join m using (s) where g in ('EUROPE', 'ASIA')) group by p)
 select p as feature, round(b, 6) as slope, round(a, 6) as intercept, round(-t, 6) as t_statistic, round(pv, 8) as p_value,
   round(adj, 8) as corrected_p_value, round(fc, 6) as log2_fold_change from t2 join bh using (p) join o using (p)""")
def sta4(spark, folder):
    found = stats.linear_model(v.by_brand(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA").results
    return found.select(
        col(FEATURE).alias("feature"), F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"),
        F.round("t_statistic", 6).alias("t_statistic"), F.round("p_value", 8).alias("p_value"),
        F.round("corrected_p_value", 8).alias("corrected_p_value"), F.round("log2_fold_change", 6).alias("log2_fold_change"),
    )


def _rank_test(rows: str) -> str:
    """U test of two groups of (p, g, x) rows; the normal p by its power series."""
    return f"""d as (select p, x, count(*) n, count(*) filter (where g = 'EUROPE') k from {rows} group by 1, 2),
 r as (select *, sum(n) over (partition by p order by x) - (n - 1) / 2.0 rk from d),
 u0 as (select p, sum(k * rk) - sum(k) * (sum(k) + 1) / 2.0 u, sum(k) n1, sum(n) - sum(k) n2, sum(n * n * n - n) ties from r group by p),
 u1 as (select *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) z
   from u0 where n1 > 8 and n2 > 8),
 u2 as (select *, case when z <= 0 then 1 else greatest(0, 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120),
   lambda j: exp((2 * j + 1) * ln(z) - (j + 1) * ln(2) - lgamma(j + 1.5)) * sqrt(pi())))) end pv from u1)"""


@query("sta5_mann_whitney", f"""with {v.BY_BRAND}, {v.GROUPS}, q as (select p, g, x from i join m using (s) where g in ('EUROPE', 'ASIA')),
 {_rank_test('q')}, {_BH.format(t='u2')}
 select p as feature, cast(u as double) as u_statistic, cast(ties as double) as tie_sum, round(pv, 7) as p_value, round(adj, 7) as corrected_p_value from u2 join bh using (p)""")
def sta5(spark, folder):
    found = stats.mann_whitney(v.by_brand(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA").results
    return found.select(
        col(FEATURE).alias("feature"), "u_statistic", "tie_sum", F.round("p_value", 7).alias("p_value"), F.round("corrected_p_value", 7).alias("corrected_p_value")
    )


@query("sta5_mann_whitney_exact", f"""with {v.BY_NATION}, w as (select n_name s, r_name g from nation join region on n_regionkey = r_regionkey),
 q as (select p, g, x from c join w using (s) where g in ('EUROPE', 'ASIA')), {_rank_test('q')},
 a as (select n, m, bit_count(m) k from (select n, unnest(range(0::bigint, 1::bigint << n)) m from (select unnest(range(2, 11)) n))),
 b as (select k, n - k j, list_sum(list_transform(range(n), lambda i: ((m >> i) & 1) * (i + 1))) - k * (k + 1) / 2 h, count(*) ways from a group by 1, 2, 3)
 select p as feature, cast(u as double) as u_statistic, round(least(1, 2 * sum(ways) filter (h >= greatest(u, n1 * n2 - u)) / sum(ways)), 9) as p_value
 from u0 join b on k = n1 and j = n2 where ties = 0 and n1 > 0 and n2 > 0 group by p, u, n1, n2""")
def sta5_exact(spark, folder):
    """Nations as samples: up to five against five, of as many sizes as parts have gaps."""
    nations = v.suppliers(spark, folder).select(F.col("n_name").alias(SAMPLE), F.col("r_name").alias("Group")).distinct()
    found = stats.mann_whitney(v.by_nation(spark, folder), nations, "Group", "EUROPE", "ASIA", p_value="exact").results
    return found.select(col(FEATURE).alias("feature"), "u_statistic", F.round("p_value", 9).alias("p_value"))


_MODIFICATIONS = f"""{v.PEPTIDES}, {v.GROUPS}, tk as (select s, r t from pep union all select s, t from pep where t <> r),
 mc as (select s, t p, count(*) x from tk group by 1, 2)"""


@query("sta6_mann_whitney_on_counts", f"""with {_MODIFICATIONS}, q as (select p, g, x from mc join m using (s) where g in ('EUROPE', 'ASIA')),
 {_rank_test('q')} select p as modification, cast(u as double) as u_statistic, round(pv, 7) as p_value from u2""")
def sta6(spark, folder):
    counts = ptm.modifications_per_sample_wide(v.peptides(spark, folder), ["A", "N", "R", "F", "O"])
    found = stats.mann_whitney_on_columns(counts, v.groups(spark, folder), "Group", "EUROPE", "ASIA", columns_name="modification").results
    return found.select("modification", "u_statistic", F.round("p_value", 7).alias("p_value"))


_ORDER_P = "t as (select o_orderkey p, o_totalprice / (select max(o_totalprice) + 1 from orders) pv from orders)"


@query("sta7_benjamini_hochberg", f"with {_ORDER_P}, {_BH.format(t='t')} select p as id, round(adj, 9) as corrected_p_value from bh")
def sta7(spark, folder):
    orders = v.table(spark, folder, "orders")
    top = orders.agg((F.max("o_totalprice") + 1).alias("m")).scalar()
    p = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / top).alias("p_value"))
    return stats.correct_p_values(p).select("id", F.round("corrected_p_value", 9).alias("corrected_p_value"))


@query("sta7_benjamini_hochberg_by_family", """with t as (select o_orderkey p, o_orderstatus f, o_totalprice / (select max(o_totalprice) + 1 from orders) pv from orders),
 z as (select *, count(*) over (partition by f) n, rank() over (partition by f order by pv) + count(*) over (partition by f, pv) - 1 r from t)
 select p as id, round(least(1, min(pv * n / r) over (partition by f order by pv desc rows between unbounded preceding and current row)), 9) as corrected_p_value from z""")
def sta7_family(spark, folder):
    orders = v.table(spark, folder, "orders")
    top = orders.agg((F.max("o_totalprice") + 1).alias("m")).scalar()
    p = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("family"), (F.col("o_totalprice") / top).alias("p_value"))
    return stats.correct_p_values(p, by=["family"]).select("id", F.round("corrected_p_value", 9).alias("corrected_p_value"))


@query("sta7_bonferroni_level", "select round(0.05 / count(*), 12) as corrected_alpha from orders")
def sta7_bonferroni(spark, folder):
    return stats.corrected_alpha(v.table(spark, folder, "orders"), stats.BONFERRONI, 0.05).select(F.round("corrected_alpha", 12).alias("corrected_alpha"))


@query("sta8_fold_change_of_logged", f"""with {v.BY_BRAND}, {v.GROUPS}, y as (select p, g, log2(x) x from i join m using (s))
 select p as feature, round(log2(avg(2 ** x) filter (where g = 'ASIA') / avg(2 ** x) filter (where g = 'EUROPE')), 6) as log2_fold_change from y group by p""")
def sta8(spark, folder):
    logged = normalise.by_log(v.by_brand(spark, folder), "log2")
    found = stats.t_test(logged, v.groups(spark, folder), "Group", "EUROPE", "ASIA", log_base="log2").results
    return found.select(col(FEATURE).alias("feature"), F.round("log2_fold_change", 6).alias("log2_fold_change"))


@query("sta9_significant_rows", f"""with {v.BY_BRAND}, {v.GROUPS}, {_SUMS}, {_POOLED}, {_BH.format(t='t2')}
 select s as sample, p as feature, round(x, 2) as value, round(adj, 8) as corrected_p_value from i join bh using (p) where adj <= 0.95""")
def sta9(spark, folder):
    table = v.by_brand(spark, folder)
    found = stats.t_test(table, v.groups(spark, folder), "Group", "EUROPE", "ASIA", alpha=0.95)
    rows = stats.with_results(table, stats.significant(found))
    return rows.select(col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.round("Intensity", 2).alias("value"), F.round("corrected_p_value", 8).alias("corrected_p_value"))


@query("flt8_most_significant", f"""with {v.BY_BRAND}, {v.GROUPS}, {_SUMS}, {_POOLED}, {_BH.format(t='t2')}
 select p as feature, round(adj, 8) as corrected_p_value from bh order by adj, p limit 1""")
def flt8(spark, folder):
    found = stats.t_test(v.by_brand(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA").results
    return filters.most_significant(found).select(col(FEATURE).alias("feature"), F.round("corrected_p_value", 8).alias("corrected_p_value"))


# ------------------------------------------------------------- modifications


@query("ptm1_amount_and_name", """select distinct p_size || ' ' || p_type as token, case when p_size > 1 then p_size else 1 end as amount, p_type as name from part""")
def ptm1(spark, folder):
    token = F.concat_ws(" ", "p_size", "p_type")
    amount, name = ptm.amount_and_name(token)
    return v.table(spark, folder, "part").select(token.alias("token"), amount.alias("amount"), name.alias("name")).distinct()


@query("ptm2_per_sample", f"with {_MODIFICATIONS} select s as sample, p as modification, x as amount from mc")
def ptm2(spark, folder):
    return ptm.modifications_per_sample(v.peptides(spark, folder)).select(col(SAMPLE).alias("sample"), "modification", "amount")


@query("ptm3_per_feature_and_sample", f"""with {v.PEPTIDES}, tk as (select s, p, r t from pep union all select s, p, t from pep where t <> r),
 mc as (select s, p, t, count(*) n from tk group by 1, 2, 3)
 select s as sample, p as feature, string_agg('(' || n || ') ' || t || ', ', '' order by t) as modifications from mc group by 1, 2""")
def ptm3(spark, folder):
    return ptm.modifications_per_feature(v.peptides(spark, folder)).select(
        col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.col("Modifications").alias("modifications")
    )


# ------------------------------------------------------------------ the spine


@query("flagship_differential_expression", f"""with {v.BY_BRAND}, {v.GROUPS},
 k as (select p from i group by p having count(x) >= 0.5 * (select count(distinct s) from i)),
 z as (select s, quantile_cont(x, 0.5) q from i where p in (select p from k) group by s),
 y as (select i.s, i.p, log2(i.x / z.q) x from i join z using (s) where p in (select p from k)),
 w as (select p, count(x) filter (where g = 'EUROPE') n1, count(x) filter (where g = 'MIDDLE EAST') n2,
   avg(x) filter (where g = 'EUROPE') m1, avg(x) filter (where g = 'MIDDLE EAST') m2,
   var_samp(x) filter (where g = 'EUROPE') v1, var_samp(x) filter (where g = 'MIDDLE EAST') v2,
   log2(avg(2 ** x) filter (where g = 'MIDDLE EAST') / avg(2 ** x) filter (where g = 'EUROPE')) f from y join m using (s) group by p),
 t0 as (select *, n1 + n2 - 2 df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) t
   from w where n1 >= 2 and n2 >= 2),
 t1 as (select *, atan(abs(t) / sqrt(df)) th from t0), t2 as (select *, {_T_P} pv from t1), {_BH.format(t='t2')}
 select p as feature, round(t, 6) as t_statistic, round(pv, 8) as p_value, round(adj, 8) as corrected_p_value, round(f, 6) as log2_fold_change
 from t2 join bh using (p)""")
def flagship(spark, folder):
    """Filter, median-normalise, log2, t-test, correct: the usual spine of an assay analysis."""
    table = cut(v.by_brand(spark, folder))  # the imported table, read by every step
    kept = filters.by_samples_missing(table, percentage=0.5).kept
    logged = normalise.by_log(normalise.by_median(kept).table, "log2")
    found = stats.t_test(logged, v.groups(spark, folder), "Group", "EUROPE", "MIDDLE EAST", log_base="log2").results
    return found.select(
        col(FEATURE).alias("feature"), F.round("t_statistic", 6).alias("t_statistic"), F.round("p_value", 8).alias("p_value"),
        F.round("corrected_p_value", 8).alias("corrected_p_value"), F.round("log2_fold_change", 6).alias("log2_fold_change"),
    )
