"""Neighbours, outliers, clustering, classification and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.catalog import views as v
from assayloom.catalog.registry import query
from assayloom.operators import classify, cluster, embed, kernels, mixture, outliers
from assayloom.operators.impute import by_min_per_feature
from assayloom.operators.vectors import to_vectors
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col

_VECTORS = "e as (select vec_id id, cast(embedding as double[]) v, label from embeddings)"
_PAIRS = {
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    "cosine": "1 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.v, lambda z: z * z)) * list_sum(list_transform(b.v, lambda z: z * z)))",
}


def _near(metric: str, k: int) -> str:
    return f"""d as (select a.id i, b.id j, {_PAIRS[metric]} d from e a join e b on a.id <> b.id),
 n as (select i, j, d, row_number() over (partition by i order by round(d, 10), j) r from d qualify r <= {k})"""


def _neighbours(spark, folder, metric, k):
    found = embed.neighbour_graph(v.vectors(spark, folder), k, metric)
    return found.select("id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


@query("emb2_neighbours_euclidean", f"with {_VECTORS}, {_near('euclidean', 15)} select i as id, r as rank, j as neighbour, round(d, 6) as distance from n")
def emb2(spark, folder):
    return _neighbours(spark, folder, "euclidean", 15)


@query("emb2_neighbours_manhattan", f"with {_VECTORS}, {_near('manhattan', 10)} select i as id, r as rank, j as neighbour, round(d, 6) as distance from n")
def emb2_manhattan(spark, folder):
    return _neighbours(spark, folder, "manhattan", 10)


@query("emb2_neighbours_cosine", f"with {_VECTORS}, {_near('cosine', 10)} select i as id, r as rank, j as neighbour, round(d, 6) as distance from n")
def emb2_cosine(spark, folder):
    return _neighbours(spark, folder, "cosine", 10)


_RAW = """e as (select vec_id + 1000000 * copy id, list_transform(embedding, lambda x: 1000000000.0::double + round(x::double * 1000000)) v
   from embeddings, (select unnest([0, 1]) copy) where copy = 0 or vec_id % 10 = 0)"""


def raw_intensities(spark, folder):
    """Vectors on the scale of raw intensities, far from zero; every tenth one is there twice."""
    plain = v.vectors(spark, folder).select("id", F.transform("vec", lambda x: F.lit(1e9) + F.round(x.cast("double") * 1e6)).alias("vec"))
    return plain.unionByName(plain.filter("id % 10 = 0").withColumn("id", F.col("id") + 1000000))


@query("emb2_neighbours_of_raw_intensities", f"with {_RAW}, {_near('euclidean', 5)} select i as id, r as rank, j as neighbour, round(d, 3) as distance from n")
def emb2_raw(spark, folder):
    found = embed.neighbour_graph(raw_intensities(spark, folder), 5, "euclidean")
    return found.select("id", "rank", "neighbour", F.round("distance", 3).alias("distance"))


def _length(scores):
    """Distance of each row from the centre: all components together keep it."""
    names = [c for c in scores.columns if c != "id"]
    return scores.select("id", F.round(F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))), 4).alias("from_centre"))


@query("emb1_principal_components", f"""with {_VECTORS}, u as (select id, unnest(v) x, generate_subscripts(v, 1) k from e), m as (select k, avg(x) m from u group by k)
 select id, round(sqrt(sum((x - m) ** 2)), 4) as from_centre from u join m using (k) group by id""")
def emb1(spark, folder):
    return _length(embed.principal_components(v.vectors(spark, folder), 64).scores)


@query("emb1_principal_components_wide", f"""with {v.NATION_GRID}, f as (select p, min(x) v from i group by p having count(x) > 0), g as (select i.s, i.p, coalesce(x, v) x from i join f on f.p = i.p),
 m as (select p, avg(x) m from g group by p) select s as id, round(sqrt(sum((x - m) ** 2)), 4) as from_centre from g join m using (p) group by s""")
def emb1_wide(spark, folder):
    return _length(embed.principal_components_wide(by_min_per_feature(v.nation_grid(spark, folder)), 25).scores)


# the largest axis by power iteration: 25 nations, so the products of rows are 25 lists of 25 numbers
@query("emb1_principal_components_first", f"""with recursive {v.NATION_GRID}, f as (select p, min(x) v from i group by p having count(x) > 0),
 g as (select i.s, i.p, coalesce(x, v) x from i join f on f.p = i.p), m as (select p, avg(x) m from g group by p), z as materialized (select s, p, x - m z from g join m using (p)),
 q as (select a.s, b.s t, sum(a.z * b.z) g from z a join z b on a.p = b.p group by 1, 2), w as (select s, list(g order by t) r from q group by s),
 k as materialized (select list(r order by s) a, list(s order by s) ids, list_sum(list_transform(range(1, count(*) + 1), lambda j: list(r order by s)[j][j])) total from w),
 h as (select 0 n, a[1] u from k union all select n + 1, list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)))
   from (select n, list_transform(a, lambda r: list_dot_product(r, u)) b from h, k where n < 1000)),
 e as (select u, list_transform(a, lambda r: list_dot_product(r, u)) b, ids, total from h, k where n = 1000),
 d as (select unnest(ids) id, unnest(u) x, list_dot_product(u, b) l, total from e)
 select id, round(abs(x) * sqrt(l), 1) as first, round(l / total, 6) as share from d""")
def emb1_first(spark, folder):
    """The first of three components of some thousand features, and its share of all variance."""
    found = embed.principal_components_wide(by_min_per_feature(v.nation_grid(spark, folder)), 3)
    share = found.explained.filter("component = 'component_1'").select(F.round("variance_ratio", 6).alias("share"))
    return found.scores.select("id", F.round(F.abs("component_1"), 1).alias("first")).crossJoin(share)  # a single row


@query("emb1_explained_variance", f"""with {_VECTORS}, u as (select unnest(v) x, generate_subscripts(v, 1) k from e), t as (select sum(z) z from (select var_pop(x) z from u group by k))
 select round(z, 6) as total, true as falling, true as whole from t""")
def emb1_explained(spark, folder):
    found = embed.principal_components(v.vectors(spark, folder), 64)
    names = [c for c in found.scores.columns if c != "id"]
    spread = found.scores.agg(*[F.var_pop(c).alias(c) for c in names]).select(F.array(*names).alias("s"))
    ratios = found.explained.agg(F.array_sort(F.collect_list(F.struct(F.length("component").alias("n"), "component", "variance_ratio"))).alias("r")).select("r.variance_ratio")
    both = spread.crossJoin(ratios)  # two single rows
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return both.select(
        F.round(total, 6).alias("total"),
        F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i) <= F.get("s", i - 1) + 1e-9).alias("falling"),
        (F.abs(F.aggregate("variance_ratio", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6).alias("whole"),
    )


# ------------------------------------------------------------------ outliers


@query("out1_isolation_forest", f"""with {v.BY_BRAND}, s as (select distinct s from i union all select 'planted')
 select s as id, s = 'planted' as lowest, true as in_range, true as marked from s""")
def out1(spark, folder):
    """Next to all samples a planted one, far off in every feature, that must score lowest."""
    table = v.by_brand(spark, folder)
    planted = table.groupBy(col(FEATURE)).agg((F.max("Intensity") * 50).alias("Intensity")).select(F.lit("planted").alias(SAMPLE), col(FEATURE), "Intensity")
    scores = cut(outliers.by_isolation_forest(table.unionByName(planted), n_estimators=100).scores)
    return scores.select(
        "id", (F.col("anomaly_score") == scores.agg(F.min("anomaly_score")).scalar()).alias("lowest"),
        F.abs("anomaly_score").between(0, 0.5).alias("in_range"), (F.col("outlier") == (F.col("anomaly_score") < 0)).alias("marked"),
    )


@query("out2_local_outlier_factor", f"""with {_VECTORS}, {_near('euclidean', 20)},
 k as (select i, max(round(d, 10)) kd from n group by i),
 l as (select n.i, 1 / (avg(greatest(round(n.d, 10), k.kd)) + 1e-10) lrd from n join k on k.i = n.j group by n.i)
 select n.i as id, round(-avg(b.lrd) / any_value(a.lrd), 6) as anomaly_score, -avg(b.lrd) / any_value(a.lrd) < -1.5 as outlier
 from n join l a on a.i = n.i join l b on b.i = n.j group by n.i""")
def out2(spark, folder):
    found = outliers.local_outlier_factor(v.vectors(spark, folder), 20)
    return found.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("out2_samples_by_local_outlier_factor", f"""with {v.BY_BRAND}, e as (select s id, list(x order by p) v from i group by s), {_near('euclidean', 20)},
 k as (select i, max(d) kd from n group by i), l as (select n.i, 1 / (avg(greatest(n.d, k.kd)) + 1e-10) lrd from n join k on k.i = n.j group by n.i)
 select n.i as id, round(-avg(b.lrd) / any_value(a.lrd), 6) as anomaly_score, -avg(b.lrd) / any_value(a.lrd) < -1.5 as outlier
 from n join l a on a.i = n.i join l b on b.i = n.j group by n.i""")
def out2_samples(spark, folder):
    found = outliers.by_local_outlier_factor(v.by_brand(spark, folder), number_of_neighbours=20).scores
    return found.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("out3_outside_ellipsoid", """with c as (select vec_id id, cast(embedding[1] as double) a, cast(embedding[2] as double) b from embeddings),
 m as (select quantile_cont(a, 0.5) ma, stddev_samp(a) sa, quantile_cont(b, 0.5) mb, stddev_samp(b) sb from c)
 select id, ((a - ma) / (2 * sa)) ** 2 + ((b - mb) / (2 * sb)) ** 2 > 1 as outlier from c, m""")
def out3(spark, folder):
    scores = v.vectors(spark, folder).select("id", F.get("vec", F.lit(0)).alias("a"), F.get("vec", F.lit(1)).alias("b"))
    return outliers.outside_ellipsoid(scores, ["a", "b"], 2.0).select("id", "outlier")


@query("out3_pca_outliers", f"with {v.BY_BRAND} select s as id, true as centred, true as marked, true as split from i group by s")
def out3_pca(spark, folder):
    """Scores lie around zero, the flag is the ellipsoid's, and a sample is kept unless it is flagged."""
    found = outliers.by_pca(v.by_brand(spark, folder), threshold=2.0, number_of_components=3)
    names = ["component_1", "component_2", "component_3"]
    scores = cut(found.scores)
    about = scores.agg(*[F.struct(F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("middle"), F.stddev(c).alias("spread")).alias(c) for c in names])
    about = about.select(F.struct(*names)).scalar()
    kept = found.kept.select(col(SAMPLE).alias("id")).distinct().withColumn("kept", F.lit(True))
    rows = scores.withColumn("a", about).join(kept, "id", "left")
    far = sum((((F.col(c) - F.col(f"a.{c}.middle")) / (2 * F.col(f"a.{c}.spread"))) ** 2 for c in names), F.lit(0.0))
    return rows.select(
        "id", (F.abs("a.component_1.mean") < 1e-6 * F.col("a.component_1.spread")).alias("centred"),
        (F.col("outlier") == (far > 1)).alias("marked"), (F.coalesce("kept", F.lit(False)) != F.col("outlier")).alias("split"),
    )


# ---------------------------------------------------------------- clustering


def _at_nearest(vectors, found):
    """(id, at_nearest): whether each row has the label of its nearest centre."""
    centres = found.centres.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("c")).select("label", F.col("c.value").alias("c"))
    everyone = centres.agg(F.collect_list(F.struct("label", "c")).alias("all")).scalar()
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    rows = vectors.select("id", "vec").join(found.labels, "id").withColumn("all", everyone)
    rows = rows.withColumn("d", F.transform("all", lambda c: F.struct(c["label"].alias("label"), far(F.col("vec"), c["c"]).alias("d"))))
    own = F.get(F.filter("d", lambda d: d["label"] == F.col("label")), F.lit(0))["d"]
    return rows.select("id", (own <= F.array_min(F.transform("d", lambda d: d["d"])) * (1 + 1e-9) + 1e-12).alias("at_nearest"))


@query("clu1_k_means", "select vec_id as id, true as at_nearest from embeddings")
def clu1(spark, folder):
    rows = v.vectors(spark, folder)
    return _at_nearest(rows, cluster.k_means(rows, 10, n_init=3, max_iter=200, tolerance=0.0))


@query("clu1_search", "select cast(k as varchar) as param_n_clusters, true as between from (select unnest([2, 4]) k)")
def clu1_search(spark, folder):
    """Settings that were tried, with a silhouette between -1 and 1."""
    rows = v.vectors(spark, folder).select("id", "vec")
    _, table = cluster.search(rows, "k_means", {"n_clusters": [2, 4]}, ["silhouette_score", "davies_bouldin_score"], n_init=2, max_iter=20)
    return table.select("param_n_clusters", (F.col("silhouette_score").between(-1, 1) & (F.col("davies_bouldin_score") > 0)).alias("between"))


@query("clu2_expectation_maximisation", "select vec_id as id, 4 as components, true as whole, true as likeliest from embeddings")
def clu2(spark, folder):
    rows = embed.principal_components(v.vectors(spark, folder), 3).scores
    reduced = cut(rows.select("id", F.array("component_1", "component_2", "component_3").alias("vec")))
    found = cluster.expectation_maximisation(reduced, 4, max_iter=30)
    share = found.probabilities.join(found.labels, "id").groupBy("id").agg(
        F.count("*").cast("int").alias("components"), F.sum("probability").alias("sum"), F.max("probability").alias("most"),
        F.max(F.when(F.col("component") == F.col("label"), F.col("probability"))).alias("own"),
    )
    return share.select("id", "components", (F.abs(F.col("sum") - 1) < 1e-6).alias("whole"), (F.col("own") == F.col("most")).alias("likeliest"))


_STEP = """x as (select vec_id id, label, i, embedding[i]::double x from embeddings cross join (select unnest(range(1, (select len(any_value(embedding)) + 1 from embeddings))) i) p),
 n as (select label, count(*) n from embeddings group by 1), m as (select label, i, avg(x) m, var_pop(x) v from x group by 1, 2),"""
_SHARES = """ t as (select id, l.label, ln(n) - 0.5 * sum(ln(w) + (x - m) ** 2 / w) s from x join w l using (i) join n on n.label = l.label group by id, l.label, n),
 u as (select *, max(s) over (partition by id) top from t), o as (select label, dense_rank() over (order by label) - 1 component from n)
 select id, component::int as component, round(exp(s - top) / sum(exp(s - top)) over (partition by id), 5) as probability from u join o using (label)"""


def _step(spark, folder, kind):
    """Probabilities after one step from the labels of the table."""
    rows = v.vectors(spark, folder)
    order = rows.select("label").distinct().agg(F.array_sort(F.collect_set("label"))).scalar()
    coded = cut(rows.withColumn("label", F.array_position(order, F.col("label")).cast("int") - 1))
    found = mixture.from_labels(coded, coded.agg(F.max("label")).first()[0] + 1, kind)
    return mixture.probabilities(coded, found).withColumn("probability", F.round("probability", 5))


@query("clu2_diagonal_step", f"with {_STEP} w as (select label, i, m, v + 1e-6 w from m), {_SHARES}")
def clu2_diagonal(spark, folder):
    return _step(spark, folder, "diag")


@query("clu2_spherical_step", f"with {_STEP} a as (select label, avg(v) + 1e-6 w from m group by 1), w as (select label, i, m, w from m join a using (label)), {_SHARES}")
def clu2_spherical(spark, folder):
    return _step(spark, folder, "spherical")


@query("clu3_hierarchical", f"with {v.BY_BRAND} select count(distinct s) as samples, 5 as clusters, true as none_empty from i")
def clu3(spark, folder):
    sizes = cluster.hierarchical(to_vectors(v.by_brand(spark, folder)), 5).labels.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("samples"), F.count("*").cast("int").alias("clusters"), (F.min("n") > 0).alias("none_empty"))


@query("clu3_single_linkage", f"""with recursive {v.BY_BRAND}, d as materialized (select a.s a, b.s b, sqrt(sum((a.x - b.x) ** 2)) h from i a join i b on a.p = b.p and a.s <> b.s group by 1, 2),
 t as (select [(select min(s) from i)] seen, 0.0::double h union all
  select list_append(seen, n.b), n.h from (select seen, arg_min(b, (d.h, b)) b, min(d.h) h from t join d on list_contains(seen, d.a) and not list_contains(seen, d.b) group by seen) n)
 select round(h, 3) as height, count(*) as merges from t where len(seen) > 1 group by 1""")
def clu3_single(spark, folder):
    """Merge heights of single linkage: the edges of the minimum spanning tree."""
    tree = cluster.spanning_tree(to_vectors(v.by_brand(spark, folder)))
    return tree.groupBy(F.round("height", 3).alias("height")).agg(F.count("*").alias("merges"))


_LABELLED = """p as (select vec_id id, label truth, (case when embedding[1] > 0 then 2 else 0 end + case when embedding[2] > 0 then 1 else 0 end) pred from embeddings)"""
_CONTINGENCY = f"""{_LABELLED}, n as (select truth, pred, count(*) n from p group by 1, 2), a as (select truth, sum(n) a from n group by 1), b as (select pred, sum(n) b from n group by 1),
 t as (select sum(n)::double t from n),
 s as (select sum(n * (n - 1) / 2.0) tp, sum(n / t * ln(n * t / (a * b))) mi, any_value(t) t from n join a using (truth) join b using (pred) cross join t),
 ha as (select sum(a * (a - 1) / 2.0) pa, -sum(a / t * ln(a / t)) ht from a cross join t), hb as (select sum(b * (b - 1) / 2.0) pb, -sum(b / t * ln(b / t)) hp from b cross join t),
 em as (select sum(list_sum(list_transform(range(greatest(1, a + b - t)::bigint, least(a, b)::bigint + 1), lambda k: k / t * ln(t * k / (a * b))
   * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))))) emi
   from a cross join b cross join t),
 r as (select *, pb - tp fp, pa - tp fn, t * (t - 1) / 2 every from s, ha, hb, em),
 x as (select unnest(['rand_score', 'adjusted_rand_score', 'mutual_info_score', 'normalized_mutual_info_score', 'adjusted_mutual_info_score', 'homogeneity_score',
   'completeness_score', 'v_measure_score', 'fowlkes_mallows_score']) metric,
  unnest([(every - fp - fn) / every, (tp - pa * pb / every) / ((pa + pb) / 2 - pa * pb / every), mi, mi / ((ht + hp) / 2), (mi - emi) / ((ht + hp) / 2 - emi), mi / ht, mi / hp,
   2 * mi / (ht + hp), tp / sqrt(pa * pb)]) score from r)"""


@query("clu4_external_indices", f"with {_CONTINGENCY} select metric, round(score, 6) as score from x")
def clu4(spark, folder):
    first, second = F.get("vec", F.lit(0)) > 0, F.get("vec", F.lit(1)) > 0
    pairs = v.vectors(spark, folder).select(
        F.col("label").alias("truth"), (F.when(first, 2).otherwise(0) + F.when(second, 1).otherwise(0)).alias("label")
    )
    return cluster.external_indices(pairs).withColumn("score", F.round("score", 6))


@query("clu4_binary_indices", """with t as (select count(*) filter (where quality = 1 and toxic = 1) tp, count(*) filter (where quality <> 1 and toxic = 1) fp,
   count(*) filter (where quality = 1 and toxic <> 1) fn from labels)
 select 'jaccard_score' as metric, round(coalesce(tp::double / nullif(tp + fp + fn, 0), 0), 6) as score from t
 union all select 'f1_score', round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) from t""")
def clu4_binary(spark, folder):
    found = cluster.binary_indices(v.table(spark, folder, "labels"), "quality", "toxic")
    return found.withColumn("score", F.round("score", 6))


@query("clu5_silhouette", f"""with {_VECTORS}, s as (select label, count(*) n from e group by 1),
 d as (select a.id, a.label l, b.label o, sum(list_distance(a.v, b.v)) t from e a cross join e b group by 1, 2, 3),
 w as (select id, max(case when l = o then t / (n - 1) end) a, min(case when l <> o then t / n end) b from d join s on s.label = d.o group by id)
 select round(avg((b - a) / greatest(a, b)), 6) as silhouette_score from w""")
def clu5(spark, folder):
    return cluster.silhouette(v.vectors(spark, folder)).select(F.round("silhouette_score", 6).alias("silhouette_score"))


@query("clu5_davies_bouldin", f"""with {_VECTORS}, u as (select id, label, unnest(v) x, generate_subscripts(v, 1) k from e),
 c0 as (select label, k, avg(x) m from u group by 1, 2), c as (select label, list(m order by k) c from c0 group by 1),
 s as (select label, any_value(c.c) c, avg(list_distance(e.v, c.c)) s from e join c using (label) group by 1),
 r as (select a.label, max((a.s + b.s) / list_distance(a.c, b.c)) r from s a join s b on a.label <> b.label group by 1)
 select round(avg(r), 6) as davies_bouldin_score from r""")
def clu5_db(spark, folder):
    return cluster.davies_bouldin(v.vectors(spark, folder)).select(F.round("davies_bouldin_score", 6).alias("davies_bouldin_score"))


@query("clu5_dunn", f"""with {_VECTORS} select round(min(list_distance(a.v, b.v)) filter (where a.label <> b.label) / max(list_distance(a.v, b.v)) filter (where a.label = b.label), 6) as dunn_score
 from e a cross join e b""")
def clu5_dunn(spark, folder):
    return cluster.dunn(v.vectors(spark, folder)).select(F.round("dunn_score", 6).alias("dunn_score"))


# ------------------------------------------------------------ classification


@query("mlc1_encode_labels", """with c as (select o_orderpriority l, min(o_orderkey) f from orders group by 1), k as (select l, row_number() over (order by f, l) - 1 c from c)
 select o_orderkey as id, k.c as code from orders join k on k.l = o_orderpriority""")
def mlc1(spark, folder):
    coded, _ = classify.encode_labels(v.table(spark, folder, "orders"), "o_orderpriority", order_by="o_orderkey", name="code")
    return coded.select(F.col("o_orderkey").alias("id"), "code")


@query("mlc1_decode_labels", "select o_orderkey as id, o_orderpriority as label from orders")
def mlc1_decode(spark, folder):
    coded, mapping = classify.encode_labels(v.table(spark, folder, "orders"), "o_orderpriority", order_by="o_orderkey", name="code")
    return classify.decode_labels(coded.select(F.col("o_orderkey").alias("id"), "code"), mapping, code="code").select("id", "label")


@query("mlc2_stratified_split_sizes", "select o_orderstatus as label, count(*) as n, cast(round(0.2 * count(*)) as bigint) as test from orders group by 1")
def mlc2(spark, folder):
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    train, test = classify.train_test_split(rows, "label", 0.2)
    both = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.sum("t").alias("test"))


@query("mlc3_fold_sizes", "with f as (select unnest(range(5)) fold) select cast(fold as int) as fold, (select count(*) from orders) // 5 + case when fold < (select count(*) from orders) % 5 then 1 else 0 end as n from f")
def mlc3(spark, folder):
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    return classify.with_folds(rows, "K-Fold", 5).groupBy("fold").agg(F.count("*").alias("n"))


def _binary(spark, folder):
    """A label that can be learned: the sign of the first number."""
    return v.vectors(spark, folder).select("id", "vec", (F.get("vec", F.lit(0)) > 0).cast("int").alias("label"))


@query("mlc3_repeated_folds", "select r as repeat, count(*) as n, count(distinct o_orderkey) as rows, 3 as folds from orders cross join (select unnest([0, 1]) r) group by 1")
def mlc3_repeated(spark, folder):
    """Each row is in one fold of each repeat, and repeats differ."""
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    tables = [t.withColumn("repeat", F.lit(i)) for i, t in enumerate(classify.repeated_folds(rows, 3, 2))]
    return tables[0].unionByName(tables[1]).groupBy("repeat").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("rows"), F.count_distinct("fold").cast("int").alias("folds")
    )


@query("mlc4_model_selection", "select unnest(['2', '4']) as \"param_maxDepth\", true as learned, true as fits_training_better")
def mlc4(spark, folder):
    table = classify.random_forest(
        _binary(spark, folder), {"maxDepth": [2, 4]}, n_estimators=10, max_depth=4, n_splits=3, n_repeats=2, validation="Repeated K-Fold",
        score=["accuracy", "matthews_corrcoef"],
    ).evaluation
    learned = (F.col("mean_test_accuracy") > 0.7) & (F.col("mean_test_matthews_corrcoef") > 0.4) & (F.col("std_test_accuracy") < 0.2)
    return table.select("param_maxDepth", learned.alias("learned"), (F.col("mean_train_accuracy") >= F.col("mean_test_accuracy")).alias("fits_training_better"))


_CLASSES = """n as (select embedding[1] > 0 l, count(*) n from embeddings group by 1), t as (select sum(round(0.2 * n)) t from n)"""


@query("mlc5_random_forest", f"with {_CLASSES} select unnest(['accuracy', 'f1_score', 'precision', 'recall']) as metric, cast(t as bigint) as rows, true as above from t")
def mlc5(spark, folder):
    found = classify.random_forest(_binary(spark, folder), n_estimators=20, max_depth=6, n_splits=2)
    return _above(found, ["accuracy", "precision", "recall", "f1_score"], 0.75)


@query("mlc6_svm", f"with {_CLASSES} select unnest(['accuracy', 'matthews_corrcoef']) as metric, cast(t as bigint) as rows, true as above from t")
def mlc6(spark, folder):
    return _above(classify.svm(_binary(spark, folder), max_iter=20, n_splits=2), ["accuracy", "matthews_corrcoef"], 0.7)


@query("mlc6_kernel_values", """with l as (select arg_min(embedding, vec_id) y, min(vec_id) landmark from embeddings group by label),
 g as (select 1 / (max(d) * var_pop(x)) g from (select len(embedding) d, unnest(embedding)::double x from embeddings)),
 p as (select vec_id id, landmark, list_sum(list_transform(list_zip(embedding, y), lambda z: z[1]::double * z[2]::double)) inner_product,
   list_sum(list_transform(list_zip(embedding, y), lambda z: (z[1]::double - z[2]::double) ** 2)) squared from embeddings cross join l)
 select id, landmark, round(exp(-g * squared), 6) as rbf, round((g * inner_product + 1) ** 3, 5) as poly, round(tanh(g * inner_product + 1), 6) as sigmoid from p cross join g""")
def mlc6_values(spark, folder):
    """All rows against the first row of each label."""
    rows = v.vectors(spark, folder)
    points = rows.groupBy("label").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("landmark")).select("landmark", "vec")
    found = None
    for kind, digits in (("rbf", 6), ("poly", 5), ("sigmoid", 6)):
        shape = kernels.kernel(rows, kind, coef0=0.0 if kind == "rbf" else 1.0)
        one = kernels.kernel_values(rows, points, shape).select("id", "landmark", F.round("value", digits).alias(kind))
        found = one if found is None else found.join(one, ["id", "landmark"])
    return found


_RING = "r as (select embedding[1] ** 2 + embedding[2] ** 2 > (select median(embedding[1]::double ** 2 + embedding[2]::double ** 2) from embeddings) l from embeddings)"


@query("mlc6_svm_kernels", f"""with {_RING}, n as (select l, count(*) n from r group by 1), t as (select cast(sum(round(0.2 * n)) as bigint) t from n)
 select unnest(['linear', 'rbf', 'poly']) as kernel, t as rows, unnest([false, true, true]) as learned from t""")
def mlc6_kernels(spark, folder):
    """Whether a ring around a disc is learned: never by a linear machine."""
    flat = v.vectors(spark, folder).select("id", F.slice("vec", 1, 2).alias("vec"))
    far = F.get("vec", F.lit(0)) ** 2 + F.get("vec", F.lit(1)) ** 2
    rows = cut(flat.withColumn("label", (far > flat.agg(F.median(far)).scalar()).cast("int")))
    tables = []
    for kind in ("linear", "rbf", "poly"):
        found = classify.svm(rows, kernel=kind, degree=2, c=10.0, n_splits=2, max_iter=25).predictions
        right = F.avg((F.col("label") == F.col("prediction")).cast("int"))
        tables.append(found.agg(F.lit(kind).alias("kernel"), F.count("*").alias("rows"), (right > 0.8).alias("learned")))
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _above(found, names, floor):
    """Scores of a test table of the right size, and whether each passes a floor."""
    rows = found.predictions.agg(F.count("*")).scalar()
    scores = classify.classification_scores(found.predictions, names)
    return scores.select(F.col("Metric").alias("metric"), rows.alias("rows"), (F.col("Score") > floor).alias("above"))


_CONFUSION = """t as (select count(*) filter (where quality = 1 and toxic = 0) tp, count(*) filter (where quality = 0 and toxic = 0) fp,
   count(*) filter (where quality = 1 and toxic = 1) fn, count(*) filter (where quality = 0 and toxic = 1) tn from labels)"""


@query("mlc7_classification_scores", f"""with {_CONFUSION}, x as (select unnest(['accuracy', 'precision', 'recall', 'matthews_corrcoef', 'f1_score', 'other']) metric,
  unnest([(tp + tn)::double / (tp + tn + fp + fn), tp::double / (tp + fp), tp::double / (tp + fn),
   coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 2.0::double * tp / (2 * tp + fp + fn), null]) s from t)
 select metric, round(s, 6) as score, case when s is null then 'Score not known' end as note from x""")
def mlc7(spark, folder):
    rows = v.table(spark, folder, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    names = ["accuracy", "precision", "recall", "matthews_corrcoef", "f1_score", "other"]
    found = classify.classification_scores(rows, names, truth="quality", predicted="clean")
    return found.select(F.col("Metric").alias("metric"), F.round("Score", 6).alias("score"), F.col("Note").alias("note"))


_CURVE = """j as (select n_chars s, count(*) filter (where quality = 1) tp, count(*) filter (where quality <> 1) fp from documents join labels using (doc_id) group by 1),
 k as (select s, tp, fp, sum(tp) over w ctp, sum(fp) over w cfp, sum(tp) over () p, sum(fp) over () n from j window w as (order by s desc rows unbounded preceding))"""


def _scored(spark, folder):
    return v.table(spark, folder, "documents").join(v.table(spark, folder, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))


@query("mlc8_roc_curve", f"with {_CURVE} select cast(s as double) as threshold, round(cfp / n, 9) as fpr, round(ctp / p, 9) as tpr from k union all select 'infinity'::double, 0, 0")
def mlc8(spark, folder):
    return classify.roc_curve(_scored(spark, folder)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("mlc8_roc_auc", f"with {_CURVE} select round(sum(fp * (ctp - tp / 2.0)) / (any_value(p) * any_value(n)), 9) as roc_auc from k")
def mlc8_auc(spark, folder):
    return classify.roc_auc(_scored(spark, folder)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("mlc9_precision_recall_curve", f"""with {_CURVE} select cast(s as double) as threshold, round(ctp / (ctp + cfp), 9) as precision, round(ctp / p, 9) as recall from k union all select null, 1, 0""")
def mlc9(spark, folder):
    return classify.precision_recall_curve(_scored(spark, folder)).select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("mlc9_average_precision", f"with {_CURVE} select round(sum(tp / p * ctp / (ctp + cfp)), 9) as average_precision from k")
def mlc9_average(spark, folder):
    return classify.average_precision(_scored(spark, folder)).select(F.round("average_precision", 9).alias("average_precision"))
