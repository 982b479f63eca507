"""Reshaping, filters, normalisation and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.catalog import views as v
from assayloom.catalog.registry import query
from assayloom.functions.draws import normal
from assayloom.operators import filters, impute, normalise, reshape
from assayloom.schema import FEATURE, SAMPLE, col

# The part types of the driver tables.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

_LONG = "select s as sample, p as feature, round(x, {d}) as value from "


# ------------------------------------------------------------------- reshape


@query("rsh1_long_to_wide", f"""with {v.BY_TYPE} select s as sample, {', '.join(f"max(case when p = '{t}' then x end) as {t.lower()}" for t in TYPES)}
 from i group by s""")
def rsh1(spark, folder):
    wide = reshape.long_to_wide(v.by_type(spark, folder), TYPES)
    return wide.select(F.col(SAMPLE).alias("sample"), *[F.col(t).alias(t.lower()) for t in TYPES])


@query("rsh1_duplicate_keys", """select l_suppkey as sample, l_partkey as feature, count(*) as n from lineitem group by 1, 2 having count(*) > 1""")
def rsh1_keys(spark, folder):
    found = reshape.duplicate_keys(v.lines(spark, folder), sample="l_suppkey", feature="l_partkey")
    return found.select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("feature"), "n")


@query("rsh2_wide_to_long", f"""with {v.BY_TYPE}, k as (select distinct s from i), t as (select unnest({TYPES}) p)
 select k.s as sample, t.p as feature, i.x as value from k cross join t left join i on i.s = k.s and i.p = t.p""")
def rsh2(spark, folder):
    wide = reshape.long_to_wide(v.by_type(spark, folder), TYPES)
    return v.tidy(reshape.wide_to_long(wide, "Intensity"), 2)


@query("rsh4_complete_grid", f"""with {v.BY_PART} select a.s as sample, b.p as feature, i.x as value
 from (select distinct s from i) a cross join (select distinct p from i) b left join i on i.s = a.s and i.p = b.p""")
def rsh4(spark, folder):
    return v.tidy(reshape.complete_grid(v.by_part(spark, folder)), 2)


@query("rsh5_clean_identifiers", """with g as (select p_partkey k, [p_brand || '-' || p_size, p_brand || '_' || p_type, p_type || '-1_2', p_brand] a from part),
 c as (select k, list_transform(a, lambda z: split_part(split_part(z, '-', 1), '_', 1)) a from g)
 select k as part, case when a[3] = a[4] then a[1] || ';' || a[3] else a[1] || ';' || a[3] || ';' || a[4] end as cleaned from c
 where a[1] = a[2] and a[2] <> a[3]""")
def rsh5(spark, folder):
    parts = v.table(spark, folder, "part")
    joined = parts.select(
        F.col("p_partkey").alias("part"),
        F.concat_ws(
            ";", F.concat_ws("-", "p_brand", "p_size"), F.concat_ws("_", "p_brand", "p_type"),
            F.concat("p_type", F.lit("-1_2")), "p_brand",
        ).alias(FEATURE),
    )
    return reshape.with_clean_groups(joined).select("part", col(FEATURE).alias("cleaned"))


# ------------------------------------------------------------------- filters


@query("flt1_features_by_samples_missing", f"""with {v.BY_PART}, k as (select p from i group by p
 having count(x) >= 0.25 * (select count(distinct s) from i)) {_LONG.format(d=2)} i where p in (select p from k)""")
def flt1(spark, folder):
    return v.tidy(filters.by_samples_missing(v.by_part(spark, folder), percentage=0.25).kept, 2)


@query("flt2_samples_by_intensity_sum", f"""with {v.BY_PART}, z as (select s, sum(x) t from i group by s),
 b as (select quantile_cont(t, 0.5) m, stddev_samp(t) d from z)
 select s as sample, round(t, 2) as total from z, b where t between m - 0.8 * d and m + 0.8 * d""")
def flt2(spark, folder):
    kept = filters.by_intensity_sum(v.by_part(spark, folder), deviation_threshold=0.8).kept
    return kept.groupBy(col(SAMPLE).alias("sample")).agg(F.round(F.sum("Intensity"), 2).alias("total"))


@query("flt3_samples_by_feature_count", f"""with {v.BY_PART}, z as (select s, count(distinct p) t from i where x is not null group by s),
 b as (select quantile_cont(t, 0.5) m, stddev_samp(t) d from z)
 select s as sample, t as features from z, b where not t between m - 0.8 * d and m + 0.8 * d""")
def flt3(spark, folder):
    table = v.by_part(spark, folder)
    removed = filters.by_feature_count(table, deviation_threshold=0.8).removed
    return table.join(removed, SAMPLE, "left_semi").groupBy(col(SAMPLE).alias("sample")).agg(F.count_distinct(col(FEATURE)).alias("features"))


@query("flt4_samples_by_features_missing", f"""with {v.BY_PART}, z as (select s, count(distinct p) n from i where x is not null group by s)
 {_LONG.format(d=2)} i where s in (select s from z where n >= 0.26 * (select count(distinct p) from i))""")
def flt4(spark, folder):
    return v.tidy(filters.by_features_missing(v.by_part(spark, folder), percentage=0.26).kept, 2)


@query("flt4_peptides_follow_samples", f"""with {v.BY_PART}, {v.PEPTIDES}, z as (select s, count(distinct p) n from i where x is not null group by s)
 select s as sample, q as sequence, count(*) as n, round(sum(x), 2) as total from pep
 where s in (select s from z where n >= 0.26 * (select count(distinct p) from i)) group by 1, 2""")
def flt4_peptides(spark, folder):
    found = filters.by_features_missing(v.by_part(spark, folder), v.peptides(spark, folder), 0.26)
    return found.peptides.groupBy(col(SAMPLE).alias("sample"), F.col("Sequence").alias("sequence")).agg(
        F.count("*").alias("n"), F.round(F.sum("Intensity"), 2).alias("total")
    )


@query("flt5_peptides_by_pep", f"""with {v.PEPTIDES} select s as sample, p as feature, q as sequence, e as pep, round(x, 2) as value
 from pep where not e < 0.05""")
def flt5(spark, folder):
    kept = filters.by_pep_value(v.peptides(spark, folder), 0.05).kept
    return kept.select(
        col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.col("Sequence").alias("sequence"), F.col("PEP").alias("pep"),
        F.round("Intensity", 2).alias("value"),
    )


@query("flt5_removed_sequences", f"with {v.PEPTIDES} select distinct q as sequence from pep where e < 0.01")
def flt5_removed(spark, folder):
    return filters.by_pep_value(v.peptides(spark, folder), 0.01).removed.select(F.col("Sequence").alias("sequence"))


@query("flt6_peptides_of_features", f"""with {v.PEPTIDES}, w as (select distinct p_brand w from part where p_size >= 49
 union select distinct p_type from part where p_size <= 1)
 select w as matched, s as sample, count(*) as n, round(sum(x), 2) as total from pep join w on w = split_part(p, ';', 1) or w = split_part(p, ';', 2) group by 1, 2""")
def flt6(spark, folder):
    parts = v.table(spark, folder, "part")
    wanted = parts.filter("p_size >= 49").select(F.col("p_brand").alias("id")).unionByName(
        parts.filter("p_size <= 1").select(F.col("p_type").alias("id"))
    )
    found = filters.peptides_of_features(v.peptides(spark, folder), wanted)
    return found.groupBy(F.col("matched_id").alias("matched"), col(SAMPLE).alias("sample")).agg(
        F.count("*").alias("n"), F.round(F.sum("Intensity"), 2).alias("total")
    )


@query("flt6_peptides_containing", f"""with {v.PEPTIDES}, w as (select unnest(['Brand#1', 'PROMO']) w)
 select w as matched, p as feature, count(*) as n from pep join w on contains(p, w) group by 1, 2""")
def flt6_text(spark, folder):
    found = filters.peptides_containing(v.peptides(spark, folder), ["Brand#1", "PROMO"])
    return found.groupBy(F.col("matched_id").alias("matched"), col(FEATURE).alias("feature")).agg(F.count("*").alias("n"))


@query("flt7_peptides_for_isoforms", f"""with {v.PEPTIDES}, {v.GROUPS} select distinct q as sequence from pep join m using (s)
 where contains(p, 'Brand#12') and x is not null and x <> 0 and g in ('ASIA', 'EUROPE')""")
def flt7(spark, folder):
    found = filters.peptides_for_isoforms(v.peptides(spark, folder), "Brand#12", v.groups(spark, folder), ["ASIA", "EUROPE"])
    return found.select(F.col("Sequence").alias("sequence"))


@query("flt9_rows_of_two_groups", f"""with {v.BY_PART}, {v.GROUPS} {_LONG.format(d=2)} i where s in (select s from m where g in ('ASIA', 'EUROPE'))""")
def flt9(spark, folder):
    return v.tidy(filters.restrict_to_groups(v.by_part(spark, folder), v.groups(spark, folder), "Group", ["ASIA", "EUROPE"]), 2)


# ------------------------------------------------------------- normalisation


@query("nrm1_log2", f"with {v.BY_PART} select s as sample, p as feature, round(log2(x), 6) as value from i")
def nrm1(spark, folder):
    return v.tidy(normalise.by_log(v.by_part(spark, folder), "log2"))


@query("nrm1_log10_peptides", f"""with {v.PEPTIDES} select s as sample, q as sequence, round(sum(log10(x)), 4) as total from pep group by 1, 2""")
def nrm1_peptides(spark, folder):
    logged = normalise.by_log(v.peptides(spark, folder), "log10")
    return logged.groupBy(col(SAMPLE).alias("sample"), F.col("Sequence").alias("sequence")).agg(F.round(F.sum("Intensity"), 4).alias("total"))


@query("nrm2_z_score", f"""with {v.BY_PART}, z as (select s, avg(x) a, stddev_pop(x) d from i group by s)
 select s as sample, p as feature, round(case when d = 0 then x - a else (x - a) / d end, 6) as value from i join z using (s)""")
def nrm2(spark, folder):
    return v.tidy(normalise.by_z_score(v.by_part(spark, folder)))


@query("nrm3_median", f"""with {v.BY_PART}, z as (select s, quantile_cont(x, 0.5) q from i group by s)
 select s as sample, p as feature, round(case when q = 0 then 0 else x / q end, 6) as value from i join z using (s)""")
def nrm3(spark, folder):
    return v.tidy(normalise.by_median(v.by_part(spark, folder)).table)


@query("nrm3_percentile", f"""with {v.BY_BRAND}, z as (select s, quantile_cont(x, 0.3) q from i group by s)
 select s as sample, p as feature, round(case when q = 0 then 0 else x / q end, 6) as value from i join z using (s)""")
def nrm3_percentile(spark, folder):
    return v.tidy(normalise.by_median(v.by_brand(spark, folder), 0.3).table)


@query("nrm4_total_sum", f"""with {v.BY_PART}, z as (select s, sum(x) q from i group by s)
 select s as sample, p as feature, round(case when q = 0 then 0 else x / q end, 9) as value from i join z using (s)""")
def nrm4(spark, folder):
    return v.tidy(normalise.by_total_sum(v.by_part(spark, folder)).table, 9)


_REFERENCE = """r as (select min(p) p from i where list_contains(string_split(p, ';'), 'PROMO')),
 d as (select i.s, i.x from i join r using (p) where i.x > 0)"""


@query("nrm5_reference_feature", f"""with {v.BY_GROUP}, {_REFERENCE}
 select i.s as sample, i.p as feature, round(i.x / d.x, 6) as value from i join d on d.s = i.s""")
def nrm5(spark, folder):
    return v.tidy(normalise.by_reference_feature(v.by_group(spark, folder), "PROMO").table)


@query("nrm5_dropped_samples", f"with {v.BY_GROUP}, {_REFERENCE} select distinct s as sample from i where s not in (select s from d)")
def nrm5_dropped(spark, folder):
    return normalise.by_reference_feature(v.by_group(spark, folder), "PROMO").samples.select(col(SAMPLE).alias("sample"))


# ---------------------------------------------------------------- imputation

_FILLED = "select i.s as sample, i.p as feature, round(coalesce(i.x, f.v), 4) as value from i"


_NEAREST_GRID = v.NATION_GRID.replace("c as (", "c as materialized (").replace("i as (", "i as materialized (")


@query("imp1_nearest_samples", f"""with {_NEAREST_GRID}, k as (select count(distinct p) k from c),
 d as materialized (select a.s s1, b.s s2, sqrt(any_value(k) * sum((a.x - b.x) ** 2) / count(*)) dist from c a join c b on a.p = b.p and a.s <> b.s cross join k group by 1, 2),
 n as (select q.s, q.p, c.x, row_number() over (partition by q.s, q.p order by d.dist, d.s2) r
   from (select s, p from i where x is null) q join c on c.p = q.p join d on d.s1 = q.s and d.s2 = c.s),
 f as (select s, p, avg(x) v from n where r <= 5 group by 1, 2)
 {_FILLED} left join f on f.s = i.s and f.p = i.p""")
def imp1(spark, folder):
    return v.tidy(impute.by_nearest_samples(v.nation_grid(spark, folder), 5), 4)


@query("imp2_mean", f"with {v.NATION_GRID}, f as (select p, avg(x) v from i group by p having count(x) > 0) {_FILLED.replace('4)', '6)')} join f on f.p = i.p")
def imp2_mean(spark, folder):
    return v.tidy(impute.by_simple_statistic(v.nation_grid(spark, folder), "mean"))


@query("imp2_median", f"with {v.NATION_GRID}, f as (select p, quantile_cont(x, 0.5) v from c group by p) {_FILLED} join f on f.p = i.p")
def imp2_median(spark, folder):
    return v.tidy(impute.by_simple_statistic(v.nation_grid(spark, folder), "median"), 4)


@query("imp2_most_frequent", f"""with {v.NATION_GRID}, k as (select p, x, count(*) n from c group by 1, 2),
 f as (select p, x v from (select *, row_number() over (partition by p order by n desc, x) r from k) where r = 1) {_FILLED} join f on f.p = i.p""")
def imp2_mode(spark, folder):
    return v.tidy(impute.by_simple_statistic(v.nation_grid(spark, folder), "most_frequent"), 4)


@query("imp3_min_per_sample", f"with {v.NATION_GRID}, f as (select s, min(x) * 0.5 v from i group by s) {_FILLED} join f on f.s = i.s")
def imp3(spark, folder):
    return v.tidy(impute.by_min_per_sample(v.nation_grid(spark, folder), 0.5), 4)


@query("imp4_min_per_feature", f"with {v.NATION_GRID}, f as (select p, min(x) * 0.2 v from i group by p having count(x) > 0) {_FILLED} join f on f.p = i.p")
def imp4(spark, folder):
    return v.tidy(impute.by_min_per_feature(v.nation_grid(spark, folder), 0.2), 4)


@query("imp5_min_per_dataset", f"with {v.NATION_GRID}, f as (select min(x) * 0.1 v from i) {_FILLED} cross join f")
def imp5(spark, folder):
    return v.tidy(impute.by_min_per_dataset(v.nation_grid(spark, folder), 0.1), 4)


def _drawn(spark, folder, strategy):
    """Observed cells, and of drawn ones what is left of the fill without the cell's own draw.

    The draws are known from the keys; taken out with their share of the deviation, they
    must leave the place where draws are centred, digit by digit.
    """
    grid = v.nation_grid(spark, folder)
    filled = impute.by_normal_draws(grid, strategy, -1.0, 0.5)
    by = [col(FEATURE)] if strategy == "perProtein" else []
    logs = grid.groupBy(*by).agg(F.stddev(F.log10("Intensity")).alias("d"))
    both = filled.withColumnRenamed("Intensity", "now").join(grid, [SAMPLE, FEATURE])
    both = both.join(logs, FEATURE) if by else both.crossJoin(logs)  # one row
    centre = F.log10("now") - 0.5 * F.col("d") * normal(0, col(SAMPLE), col(FEATURE))
    return both.select(
        col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.when(F.col("Intensity").isNotNull(), F.round("now", 2)).alias("observed"),
        F.when(F.col("Intensity").isNull(), F.round(centre, 6)).alias("centre"),
    )


@query("imp6_normal_draws_per_feature", f"with {v.NATION_GRID}, l as (select p, avg(log10(x)) - stddev_samp(log10(x)) z from i group by p having count(x) > 1) select s as sample, p as feature, round(x, 2) as observed, case when x is null then round(z, 6) end as centre from i left join l using (p)")
def imp6(spark, folder):
    return _drawn(spark, folder, "perProtein")


@query("imp7_normal_draws_per_dataset", f"with {v.NATION_GRID}, l as (select avg(log10(x)) - stddev_samp(log10(x)) z from i) select s as sample, p as feature, round(x, 2) as observed, case when x is null then round(z, 6) end as centre from i, l")
def imp7(spark, folder):
    return _drawn(spark, folder, "perDataset")


@query("imp8_missing_values", f"with {v.NATION_GRID} select count(*) - count(x) as missing from i")
def imp8(spark, folder):
    return impute.flag_invalid_values(v.nation_grid(spark, folder)).missing


@query("imp8_constant_features", f"with {v.BY_PART} select p as feature from i group by p having count(distinct x) = 1")
def imp8_constant(spark, folder):
    return impute.flag_invalid_values(v.by_part(spark, folder)).constant.select(col(FEATURE).alias("feature"))


@query("imp9_number_imputed", f"with {v.NATION_GRID} select count(*) - count(x) as imputed from i")
def imp9(spark, folder):
    grid = v.nation_grid(spark, folder)
    return impute.number_of_imputed_values(grid, impute.by_min_per_dataset(grid))
