"""Mapping to genes, annotation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.catalog import views as v
from assayloom.catalog.registry import query
from assayloom.operators import enrich, gsea, mapping
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col

# ------------------------------------------------------------------- mapping

_PAIRED = """grp as (select distinct 'E' || p_size || ';E' || p_size || '-2;E' || (p_size + 40) || '_x' g, p_size a, p_size + 40 b from part),
 e1 as (select p_size k, min(p_name) n from part where p_size % 3 = 0 group by 1),
 e2 as (select p_size k, min(p_type) n from part where p_size % 2 = 0 group by 1),
 e as (select coalesce(e1.k, e2.k) k, coalesce(split_part(e1.n, ' ', 1), e2.n) n from e1 full join e2 on e1.k = e2.k)"""


def _databases(spark, folder):
    """Two annotation tables by part size: one with all gene names, one with the primary name."""
    parts = v.table(spark, folder, "part")
    entry = F.concat(F.lit("E"), F.col("p_size").cast("string")).alias("Entry")
    first = parts.filter("p_size % 3 = 0").groupBy(entry).agg(F.min("p_name").alias("Gene Names"))
    second = parts.filter("p_size % 2 = 0").groupBy(entry).agg(F.min("p_type").alias("Gene Names (primary)"))
    return [first, second]


def _entry_groups(spark, folder):
    e = lambda x: F.concat(F.lit("E"), x.cast("string"))
    group = F.concat(e(F.col("p_size")), F.lit(";"), e(F.col("p_size")), F.lit("-2;"), e(F.col("p_size") + 40), F.lit("_x"))
    return v.table(spark, folder, "part").select(group.alias(FEATURE), "p_size").distinct()


@query("int1_gene_mapping", f"""with {_PAIRED} select g as feature, n as gene from grp join e on e.k = a
 union all select g, n from grp join e on e.k = b""")
def int1(spark, folder):
    found = mapping.map_to_genes(_entry_groups(spark, folder), _databases(spark, folder))
    return found.pairs.select(col(FEATURE).alias("feature"), F.col("Gene").alias("gene"))


@query("int1_unmapped_groups", f"with {_PAIRED} select g as feature from grp where a not in (select k from e) and b not in (select k from e)")
def int1_unmapped(spark, folder):
    return mapping.map_to_genes(_entry_groups(spark, folder), _databases(spark, folder)).unmapped.select(col(FEATURE).alias("feature"))


@query("int2_annotations", f"""with {_PAIRED} select g as feature, case when x.n is null and y.n is null then null when x.n = y.n then x.n
   else coalesce(x.n, 'None') || ';' || coalesce(y.n, 'None') end as organism from grp
 left join e2 x on x.k = a left join e2 y on y.k = b""")
def int2(spark, folder):
    database = _databases(spark, folder)[1].withColumnRenamed("Gene Names (primary)", "Organism")
    found = mapping.add_annotations(_entry_groups(spark, folder), database, ["Organism"])
    return found.select(col(FEATURE).alias("feature"), F.col("Organism").alias("organism"))


@query("int3_links", f"""with {_PAIRED} select g as feature, 'https://uniprot.org/uniprotkb/E' || a || ' https://uniprot.org/uniprotkb/E' || b as links from grp""")
def int3(spark, folder):
    found = mapping.add_annotations(_entry_groups(spark, folder), None, ["Links"])
    return found.select(col(FEATURE).alias("feature"), F.col("Links").alias("links"))


# -------------------------------------------------------- over-representation


@query("int4_up_and_down", f"with {v.CHANGES} select p as feature, case when c > 1.5 then 'up' else 'down' end as direction from ch where abs(c) > 1.5")
def int4(spark, folder):
    return enrich.regulated(v.changes(spark, folder), "log2_fold_change", 1.5).select(col(FEATURE).alias("feature"), "direction")


def _overlap_sql(query: str, background: str) -> str:
    """Hypergeometric test of the genes in ``query`` against gs, with log factorials."""
    if background == "sets":
        sizes = """bg as (select l, count(distinct gs.g) n, count(distinct q.g) k from gs left join q on q.g = gs.g group by l)"""
    else:
        sizes = f"bg as (select l, cast({background} as bigint) n, (select count(*) from q) k from (select distinct l from gs))"
    return f"""q as ({query}), {sizes},
 o as (select gs.l, gs.t, count(*) m, count(q.g) x, any_value(n) n, any_value(k) k from gs join bg on bg.l = gs.l left join q on q.g = gs.g group by 1, 2),
 pv as (select *, least(1, list_sum(list_transform(range(greatest(x, m + k - n), least(m, k) + 1), lambda j: exp(
     lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(n - m + 1) - lgamma(k - j + 1) - lgamma(n - m - k + j + 1)
     - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))))) pv from o where x > 0),
 bh as (select l, t, m, x, n, k, pv, least(1, min(pv * c / r) over (partition by l order by pv desc rows between unbounded preceding and current row)) adj
   from (select *, count(*) over (partition by l) c, rank() over (partition by l order by round(pv, 12))
     + count(*) over (partition by l, round(pv, 12)) - 1 r from pv))"""


_REGULATED = "select distinct gp.g from ch join gp using (p) where c > 1.5"
_TERM_COLUMNS = """l as library, t as term, x as overlap, m as set_size, k as query_size, n as background_size, round(pv, 8) as p_value,
   round((x + 0.5) * (n - m + 0.5) / ((m + 0.5) * (k - x + 0.5)), 6) as odds_ratio"""


def _terms(found):
    return found.select(
        "library", "term", "overlap", "set_size", "query_size", "background_size", F.round("p_value", 8).alias("p_value"), F.round("odds_ratio", 6).alias("odds_ratio"),
        F.round("adjusted_p_value", 7).alias("adjusted_p_value"),
    )


def _up(spark, folder):
    return enrich.regulated(v.changes(spark, folder), "log2_fold_change", 1.5).filter("direction = 'up'")


@query("int5_over_representation", f"""with {v.CHANGES}, {v.GENE_SETS}, {v.GENE_PAIRS}, {_overlap_sql(_REGULATED, 'sets')}
 select {_TERM_COLUMNS}, round(adj, 7) as adjusted_p_value from bh""")
def int5(spark, folder):
    return _terms(enrich.over_representation(_up(spark, folder), v.gene_pairs(spark, folder), v.gene_sets(spark, folder)).terms)


@query("int5_hits", f"""with {v.CHANGES}, {v.GENE_SETS}, {v.GENE_PAIRS}, q as ({_REGULATED})
 select l as library, t as term, count(distinct gs.g) as genes, count(*) as features from gs join q on q.g = gs.g join gp on gp.g = gs.g group by 1, 2""")
def int5_hits(spark, folder):
    hits = enrich.over_representation(_up(spark, folder), v.gene_pairs(spark, folder), v.gene_sets(spark, folder)).hits
    return hits.groupBy("library", "term").agg(F.count_distinct("gene").alias("genes"), F.count("*").alias("features"))


@query("int6_background_number", f"""with {v.CHANGES}, {v.GENE_SETS}, {v.GENE_PAIRS}, {_overlap_sql(_REGULATED, '200')}
 select {_TERM_COLUMNS}, round(adj, 7) as adjusted_p_value from bh""")
def int6(spark, folder):
    return _terms(enrich.over_representation(_up(spark, folder), v.gene_pairs(spark, folder), v.gene_sets(spark, folder), 200).terms)


@query("int6_background_table", f"""with {v.CHANGES}, {v.GENE_PAIRS}, b as (select distinct p_name g from part where p_size <= 1), {v.GENE_SETS.replace('gs as (', 'g0 as (')},
 gs as (select g0.* from g0 where g in (select g from b)),
 {_overlap_sql(_REGULATED + ' and gp.g in (select g from b)', '(select count(*) from b)')} select {_TERM_COLUMNS}, round(adj, 7) as adjusted_p_value from bh""")
def int6_table(spark, folder):
    background = v.table(spark, folder, "part").filter("p_size <= 1").select(F.col("p_name").alias("gene"))
    return _terms(enrich.over_representation(_up(spark, folder), v.gene_pairs(spark, folder), v.gene_sets(spark, folder), background).terms)


_SIDES = """select s as category, b as term, pv, n from (select n_name s, p_brand b, min(l_discount) + avg(l_tax) pv, count(distinct p_name) n from lineitem
   join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_returnflag = '{f}' group by 1, 2)"""


def _sides(spark, folder, flag):
    nations = v.suppliers(spark, folder).select("s_suppkey", "n_name")
    rows = v.lines_with_parts(spark, folder).join(nations, F.col("l_suppkey") == F.col("s_suppkey")).filter(F.col("l_returnflag") == flag)
    keys = [F.col("n_name").alias("library"), F.col("p_brand").alias("term")]
    terms = rows.groupBy(*keys).agg((F.min("l_discount") + F.avg("l_tax")).alias("adjusted_p_value"), F.count_distinct("p_name").alias("overlap"))
    return terms, rows.select(*keys, F.col("p_name").alias("gene"), F.col("p_partkey").cast("string").alias(FEATURE)).distinct()


@query("int7_merge_directions", f"""with a as ({_SIDES.format(f='A')}), r as ({_SIDES.format(f='R')}),
 u as (select n_name category, p_brand term, count(distinct p_name) n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
   join nation on s_nationkey = n_nationkey where l_returnflag in ('A', 'R') group by 1, 2)
 select coalesce(a.category, r.category) as library, coalesce(a.term, r.term) as term, round(greatest(a.pv, r.pv), 6) as adjusted_p_value, u.n as overlap
 from a full join r on a.category = r.category and a.term = r.term join u on u.category = coalesce(a.category, r.category) and u.term = coalesce(a.term, r.term)""")
def int7(spark, folder):
    (up, up_hits), (down, down_hits) = _sides(spark, folder, "A"), _sides(spark, folder, "R")
    merged, _ = enrich.merge_directions(up, down, up_hits, down_hits)
    return merged.select("library", "term", F.round("adjusted_p_value", 6).alias("adjusted_p_value"), "overlap")


@query("int8_merge_categories", f"""with a as ({_SIDES.format(f='A')}), r as ({_SIDES.format(f='R')}),
 u as (select n_name category, p_brand term, count(distinct p_partkey) n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
   join nation on s_nationkey = n_nationkey where l_returnflag in ('A', 'R') group by 1, 2)
 select coalesce(a.category, r.category) as category, coalesce(a.term, r.term) as term, round(greatest(a.pv, r.pv), 6) as p_value,
   case when a.term is null then r.n when r.term is null then a.n else u.n end as number_of_genes
 from a full join r on a.category = r.category and a.term = r.term join u on u.category = coalesce(a.category, r.category) and u.term = coalesce(a.term, r.term)""")
def int8(spark, folder):
    names = {"library": "category", "adjusted_p_value": "p_value", "overlap": "number_of_genes"}
    sides = [tuple(t.withColumnsRenamed(names) for t in _sides(spark, folder, flag)) for flag in "AR"]
    merged, _ = enrich.merge_directions(
        sides[0][0], sides[1][0], sides[0][1], sides[1][1], keys=("category", "term"), p="p_value", count="number_of_genes", counted=FEATURE
    )
    return merged.select("category", "term", F.round("p_value", 6).alias("p_value"), "number_of_genes")


@query("int5_both_directions", f"""with {v.CHANGES}, {v.GENE_SETS}, {v.GENE_PAIRS},
 q as (select distinct gp.g from ch join gp using (p) where abs(c) > 1.5)
 select l as library, t as term, count(q.g) as united_genes from gs join q on q.g = gs.g group by 1, 2""")
def int5_both(spark, folder):
    found = enrich.enrich_regulated(v.changes(spark, folder), "log2_fold_change", 1.5, v.gene_pairs(spark, folder), v.gene_sets(spark, folder))
    return found.terms.select("library", "term", F.col("overlap").alias("united_genes"))


@query("int13_top_terms", f"""with {v.CHANGES}, {v.GENE_SETS}, {v.GENE_PAIRS}, {_overlap_sql(_REGULATED, 'sets')},
 k as (select *, row_number() over (partition by l order by round(pv, 12), t) r from bh where pv <= 0.95)
 select l as library, t as term, r as rank, round(-log10(pv), 6) as minus_log10 from k where r <= 5""")
def int13(spark, folder):
    found = enrich.over_representation(_up(spark, folder), v.gene_pairs(spark, folder), v.gene_sets(spark, folder)).terms
    # p-values that differ in the last digits only are the same test
    same = found.withColumn("p_value", F.round("p_value", 12))
    return enrich.top_terms(same, 5, 0.95, p="p_value").select("library", "term", "rank", F.round("minus_log10", 6).alias("minus_log10"))


# --------------------------------------------------------------------- ranks

_RANKED = f"""{v.CHANGES}, {v.GENE_PAIRS}, rk as (select g, min(c) c from ch join gp using (p) group by g)"""


@query("int9_ranked_genes", f"with {_RANKED} select g as gene, round(c, 6) as score, rank() over (order by c desc) as rank from rk")
def int9(spark, folder):
    found = gsea.rank_genes(v.changes(spark, folder), "log2_fold_change", v.gene_pairs(spark, folder), "descending")
    return found.select("gene", F.round("score", 6).alias("score"), "rank")


@query("int9_ranked_genes_ascending", f"""with {v.CHANGES}, {v.GENE_PAIRS}, rk as (select g, max(c) c from ch join gp using (p) group by g)
 select g as gene, round(c, 6) as score, rank() over (order by c) as rank from rk""")
def int9_ascending(spark, folder):
    found = gsea.rank_genes(v.changes(spark, folder), "log2_fold_change", v.gene_pairs(spark, folder))
    return found.select("gene", F.round("score", 6).alias("score"), "rank")


_WALK = f"""{v.GENE_SETS}, ps as (select g, c, row_number() over (order by c desc) - 1 i from rk), nn as (select count(*) n from ps),
 h as (select l, t, ps.g, i, abs(c) w, sum(abs(c)) over z / sum(abs(c)) over (partition by l, t) up, abs(c) / sum(abs(c)) over (partition by l, t) own,
   (i + 1 - count(*) over z) / ((select n from nn) - count(*) over (partition by l, t))::double miss, count(*) over (partition by l, t) m
   from gs join ps on ps.g = gs.g window z as (partition by l, t order by i rows unbounded preceding)),
 es as (select l, t, m, case when abs(max(up - miss)) > abs(min(up - own - miss)) then max(up - miss) else min(up - own - miss) end es from h where m between 5 and 500 group by 1, 2, 3)"""
_SCORED = f"{_RANKED}, {_WALK}"


def _ranking(spark, folder):
    scored = gsea.rank_genes(v.changes(spark, folder), "log2_fold_change", v.gene_pairs(spark, folder), "descending").drop("rank")
    return cut(gsea.positions(scored))


@query("int10_enrichment_scores", f"with {_SCORED} select l as library, t as term, m as size, round(es, 6) as es from es")
def int10_scores(spark, folder):
    ranking = _ranking(spark, folder)
    sets = gsea.sized_sets(v.gene_sets(spark, folder), ranking, 5, 500)
    return gsea.observed_scores(sets, ranking, 1.0)[0].select("library", "term", "size", F.round("es", 6).alias("es"))


def _judged(terms):
    """The score of each term, and whether all that random permutations give obeys the rules they must."""
    share = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    return terms.select("library", "term", F.round("es", 6).alias("es"), (share("p_value") & share("fdr") & (F.col("nes").isNull() | (F.signum("nes") == F.signum("es")))).alias("sound"))


@query("int10_preranked", f"with {_SCORED} select l as library, t as term, round(es, 6) as es, true as sound from es")
def int10(spark, folder):
    found = gsea.gsea_preranked(
        v.changes(spark, folder), "log2_fold_change", v.gene_pairs(spark, folder), v.gene_sets(spark, folder), "descending", min_size=5, permutations=100
    )
    return _judged(found.terms)


@query("int11_gene_intensities", f"""with {v.BY_PART}, {v.GENE_PAIRS} select g as gene, s as sample, round(avg(x), 6) as value from i join gp using (p) group by 1, 2""")
def int11(spark, folder):
    found = gsea.gene_intensities(v.by_part(spark, folder), v.gene_pairs(spark, folder))
    return found.select("gene", col(SAMPLE).alias("sample"), F.round("value", 6).alias("value"))


_CELLS = f"""{v.BY_PART}, {v.GROUPS}, {v.GENE_PAIRS}, ce as (select gp.g, i.s, m.g grp, avg(x) x from i join gp using (p) join m using (s) where m.g in ('EUROPE', 'ASIA') group by 1, 2, 3),
 st as (select g, avg(x) filter (where grp = 'EUROPE') m1, avg(x) filter (where grp = 'ASIA') m2, stddev_samp(x) filter (where grp = 'EUROPE') s1,
   stddev_samp(x) filter (where grp = 'ASIA') s2, count(x) filter (where grp = 'EUROPE') n1, count(x) filter (where grp = 'ASIA') n2 from ce group by g)"""


@query("int12_class_scores", f"""with {_CELLS}, a as (select g, unnest(['signal_to_noise', 't_test', 'ratio_of_classes', 'diff_of_classes', 'log2_ratio_of_classes']) method,
   unnest([(m1 - m2) / (s1 + s2), (m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2), m1 / m2, m1 - m2, log2(m1 / m2)]) score from st)
 select method, g as gene, round(score, 4) as score from a where score is not null""")
def int12_scores(spark, folder):
    wanted = v.groups(spark, folder).filter(F.col("Group").isin("EUROPE", "ASIA"))
    cells = cut(gsea.gene_intensities(v.by_part(spark, folder).join(wanted.select(SAMPLE), SAMPLE, "left_semi"), v.gene_pairs(spark, folder)).join(wanted, SAMPLE))
    parts = [
        gsea.class_scores(cells, F.col("Group") == "EUROPE", m, []).select(F.lit(m).alias("method"), "gene", F.round("score", 4).alias("score"))
        for m in gsea.RANKING_METHODS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("int12_gsea_phenotype", f"""with {_CELLS}, rk as (select g, (m1 - m2) / (s1 + s2) c from st where (m1 - m2) / (s1 + s2) is not null), {_WALK}
 select l as library, t as term, round(es, 6) as es, true as sound from es""")
def int12(spark, folder):
    found = gsea.gsea(
        v.by_part(spark, folder), v.groups(spark, folder), "Group", "EUROPE", "ASIA", v.gene_pairs(spark, folder), v.gene_sets(spark, folder),
        min_size=5, permutations=50,
    )
    return _judged(found.terms)


@query("int14_term_curve", f"""with {_RANKED}, {v.GENE_SETS}, mb as (select g from gs where l = 'brand' and t = 'Brand#12'),
 ps as (select rk.g, c, row_number() over (order by c desc) - 1 i, mb.g is not null hit from rk left join mb on mb.g = rk.g)
 select i as position, g as gene, hit as is_hit, round(sum(case when hit then abs(c) else 0 end) over w / (select sum(abs(c)) from ps where hit)
   - coalesce(sum(case when hit then 0 else 1 end) over w / nullif((select count(*) from ps where not hit), 0)::double, 0), 6) as running_sum
 from ps window w as (order by i rows unbounded preceding)""")
def int14(spark, folder):
    members = v.gene_sets(spark, folder).filter("library = 'brand' and term = 'Brand#12'")
    return gsea.term_curve(_ranking(spark, folder), members).withColumn("running_sum", F.round("running_sum", 6))
