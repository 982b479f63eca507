"""Rank-based gene-set enrichment.

The running sum of a set changes direction only at its own genes, so scores need
the hit rows alone: (permutation, term, position).  Random permutations are a
keyed bijection of positions, computed row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayloom.functions.draws import shuffled, shuffled_positions
from assayloom.operators.reshape import numbered
from assayloom.plans.prefix import running_totals
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, GENE, SAMPLE, col, measure_column

RANKING_METHODS = ["signal_to_noise", "t_test", "ratio_of_classes", "diff_of_classes", "log2_ratio_of_classes"]


class GeneSetEnrichment(NamedTuple):
    terms: DataFrame
    leading: DataFrame  # (library, term, gene, position, feature) of the leading edge
    ranking: DataFrame  # (gene, score, position)
    unmapped: DataFrame


# ----------------------------------------------------------------- rankings


def rank_genes(
    df: DataFrame, column: str, mapping: DataFrame, direction: str = "ascending", *, feature: str = FEATURE, gene: str = GENE
) -> DataFrame:
    """(gene, score, rank): the worst score of a gene's features, best first.

    Ascending: small scores are good, so the largest is kept, and vice versa.
    Equal scores share the smallest rank.
    """
    if direction not in ("ascending", "descending"):
        raise ValueError(f"unknown direction {direction!r}")
    up = direction == "ascending"
    once = df.groupBy(col(feature)).agg(F.min(col(column)).alias("__x"))
    worst = F.max("__x") if up else F.min("__x")
    scored = once.join(mapping.select(col(feature), col(gene).alias("gene")), feature).groupBy("gene").agg(worst.alias("score"))
    scored = cut(scored)  # one row per gene
    ranks = running_totals(scored, [], "score", {"__n": F.lit(1)}, descending=not up)
    return scored.join(ranks.select("score", (F.col("__n_upto") - F.col("__n") + 1).alias("rank")), "score").select("gene", "score", "rank")


TIE_SLOTS = 256


def positions(scored: DataFrame, keys: list[str] | None = None, *, best_first_descending: bool = True) -> DataFrame:
    """Number the genes 0.. by score (per key); equal scores follow a hash of the gene.

    Genes of one score are dealt into hash slots and numbered slot by slot, so a
    score shared by many genes is no single group either.
    """
    keys = keys or []
    ranks = running_totals(scored, keys, "score", {"__n": F.lit(1)}, descending=best_first_descending)
    first = ranks.select(*map(col, keys), "score", "__n", (F.col("__n_upto") - F.col("__n")).cast("long").alias("position"))
    placed = scored.join(first, [*keys, "score"])
    alone = placed.filter("__n = 1").drop("__n")
    tied = placed.filter("__n > 1").withColumn("__slot", F.pmod(F.xxhash64("gene"), F.lit(TIE_SLOTS)))
    tie = [*map(col, keys), F.col("score")]
    sizes = tied.groupBy(*tie, "__slot").agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*tie).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*tie, "__slot", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*tie, "__slot").orderBy("gene")
    spread = tied.join(shifts, [*keys, "score", "__slot"]).withColumn(
        "position", (F.col("position") + F.col("__shift") + F.row_number().over(inside) - 1).cast("long")
    )
    return alone.unionByName(spread.select(*alone.columns))


def gene_intensities(
    df: DataFrame, mapping: DataFrame, *, value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE, gene: str = GENE
) -> DataFrame:
    """(gene, sample, value): mean over the features of a gene; a feature counts for all its genes."""
    measure = measure_column(df, value)
    pairs = mapping.select(col(feature), col(gene).alias("gene")).distinct()
    return df.join(pairs, feature).groupBy("gene", col(sample)).agg(F.avg(col(measure)).alias("value"))


def class_scores(cells: DataFrame, first, method: str, keys: list[str]) -> DataFrame:
    """Score of every gene from its values in the first and the other class."""
    x = F.col("value")
    sums = cells.groupBy(*map(col, keys), "gene").agg(
        F.avg(F.when(first, x)).alias("m1"), F.avg(F.when(~first, x)).alias("m2"),
        F.stddev_samp(F.when(first, x)).alias("s1"), F.stddev_samp(F.when(~first, x)).alias("s2"),
        F.count(F.when(first, x)).alias("n1"), F.count(F.when(~first, x)).alias("n2"),
    )
    m1, m2, s1, s2 = (F.col(c) for c in ("m1", "m2", "s1", "s2"))
    if method == "signal_to_noise":
        score = F.try_divide(m1 - m2, s1 + s2)
    elif method == "t_test":
        score = F.try_divide(m1 - m2, F.sqrt(F.try_divide(s1 * s1, F.col("n1")) + F.try_divide(s2 * s2, F.col("n2"))))
    elif method == "ratio_of_classes":
        score = F.try_divide(m1, m2)
    elif method == "diff_of_classes":
        score = m1 - m2
    elif method == "log2_ratio_of_classes":
        score = F.log2(F.try_divide(m1, m2))
    else:
        raise ValueError(f"unknown ranking method {method!r}; use one of {RANKING_METHODS}")
    return sums.select(*map(col, keys), "gene", score.alias("score")).filter("score is not null")


# ------------------------------------------------------------------- scores


def sized_sets(gene_sets: DataFrame, ranking: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """(library, term, gene, size) of the sets with a fitting number of ranked genes."""
    inside = gene_sets.select("library", "term", "gene").distinct().join(ranking.select("gene"), "gene", "left_semi")
    sizes = inside.groupBy("library", "term").agg(F.count("*").alias("size"))
    fitting = sizes.filter(F.col("size").between(min_size, max_size))
    return inside.join(fitting, ["library", "term"])


def hit_sums(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Running sum just before and just after every hit.

    ``hits`` holds the keys, position, weight and n_genes.  One group is one set
    (at most the largest allowed set size) of one permutation.
    """
    order = Window.partitionBy(*map(col, keys)).orderBy("position")
    whole = Window.partitionBy(*map(col, keys))
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.row_number().over(order)
    missed = F.coalesce(
        F.try_divide((F.col("position") - number + 1).cast("double"), F.col("n_genes") - F.count("*").over(whole)), F.lit(0.0)
    )
    total = F.sum("weight").over(whole)
    return hits.withColumn("after", F.try_divide(upto, total) - missed).withColumn(
        "before", F.try_divide(upto - F.col("weight"), total) - missed
    )


def enrichment_scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, es, peak): the largest deviation from zero and the position where it is reached."""
    found = sums.groupBy(*map(col, keys)).agg(
        F.max("after").alias("top"), F.min("before").alias("low"),
        F.max_by("position", F.struct("after", -F.col("position"))).alias("top_at"),
        F.min_by("position", F.struct("before", "position")).alias("low_at"),
    )
    rises = F.abs("top") > F.abs("low")
    return found.select(
        *map(col, keys),
        F.when(rises, F.col("top")).otherwise(F.col("low")).alias("es"),
        F.when(rises, F.col("top_at")).otherwise(F.col("low_at")).alias("peak"),
    ).filter("es is not null")


def _weighted(score, weighted_score: float):
    return F.pow(F.abs(score), F.lit(float(weighted_score)))


def set_permutation_null(sets: DataFrame, ranking: DataFrame, permutations: int, weighted_score: float, seed: int) -> DataFrame:
    """(library, term, permutation, es) with the genes of a set moved to random positions."""
    n_genes = ranking.agg(F.count("*").alias("n")).scalar()
    weights = ranking.select("position", _weighted(F.col("score"), weighted_score).alias("weight"))
    homes = sets.join(ranking.select("gene", F.col("position").alias("home")), "gene")
    moved = (
        homes.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .withColumn("n_genes", n_genes)
        .withColumn("key", F.xxhash64(F.lit(seed), "library", "term", "permutation"))
        .withColumn("position", shuffled("home", "key", "n_genes"))
        .select("library", "term", "permutation", "position", "n_genes")
    )
    hits = moved.join(weights, "position")
    keys = ["library", "term", "permutation"]
    return enrichment_scores(hit_sums(hits, keys), keys).drop("peak")


#: Labels that a task holds at once: samples x permutations.
LABELS = 4_000_000


def _shuffled_scores(keys: list[int], n: int, first: int, method: str):
    """Scores of genes (gene, i[], x[]) under every shuffled labelling of ``n`` samples, ``first`` of them in the first class."""
    step = max(1, LABELS // max(n, 1))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(g, np.asarray(i, dtype=np.int64), np.asarray(x, dtype=float)) for g, i, x in zip(batch["gene"], batch["i"], batch["x"])]
            if not rows:
                continue
            for start in range(0, len(keys), step):
                some = np.array(keys[start:start + step], dtype=np.int64)
                labels = shuffled_positions(np.tile(np.arange(n), len(some)), np.repeat(some, n), np.full(n * len(some), n))
                labels = (labels < first).reshape(len(some), n).astype(float)
                scores = np.array([_class_scores(x, labels[:, i], method) for _, i, x in rows])
                gene, at = np.nonzero(~np.isnan(scores))
                names = np.array([g for g, _, _ in rows], dtype=object)
                yield pd.DataFrame({"permutation": (start + 1 + at).astype("int32"), "gene": names[gene], "score": scores[gene, at]})

    return scored


def _class_scores(x: np.ndarray, labels: np.ndarray, method: str) -> np.ndarray:
    """``class_scores`` of one gene for each row of labels (1: first class); nan where there is none."""
    middle = x.mean()
    away = x - middle  # deviations are summed around the gene's own mean
    with np.errstate(divide="ignore", invalid="ignore"):
        n1 = labels.sum(axis=1)
        n2 = len(x) - n1
        d1, d2 = (labels @ away) / n1, ((1 - labels) @ away) / n2
        m1, m2 = d1 + middle, d2 + middle
        if method == "diff_of_classes":
            score = m1 - m2
        elif method == "ratio_of_classes":
            score = m1 / m2
        elif method == "log2_ratio_of_classes":
            score = np.log2(m1 / m2)
        else:
            v1, v2 = ((k @ (away * away) - c * d * d) / (c - 1) for k, c, d in ((labels, n1, d1), (1 - labels, n2, d2)))
            v1, v2 = np.maximum(v1, 0.0), np.maximum(v2, 0.0)
            spread = np.sqrt(v1) + np.sqrt(v2) if method == "signal_to_noise" else np.sqrt(v1 / n1 + v2 / n2)
            score = np.where(spread > 0, (m1 - m2) / spread, np.nan)
    return np.where(np.isfinite(score), score, np.nan)


def phenotype_null(
    cells: DataFrame, sets: DataFrame, first_size, permutations: int, method: str, weighted_score: float, seed: int, *, sample: str = SAMPLE
) -> DataFrame:
    """(library, term, permutation, es) with the class labels shuffled among the samples."""
    spark = cells.sparkSession
    samples = cut(numbered(cells, sample, "__i"))
    n = samples.count()
    first = spark.range(1).select(first_size).first()[0]
    keys = [r["k"] for r in spark.range(1, permutations + 1).orderBy("id").select(F.xxhash64(F.lit(seed), F.col("id").cast("int")).alias("k")).collect()]
    # a gene's values meet all shuffled labels in one task: cells aren't multiplied by the permutations
    genes = cells.join(samples, sample).filter("value is not null").groupBy("gene").agg(F.collect_list(F.struct("__i", "value")).alias("v"))
    scored = genes.select("gene", F.col("v.__i").alias("i"), F.col("v.value").alias("x")).mapInPandas(
        _shuffled_scores(keys, n, first, method), "permutation int, gene string, score double"
    )
    scored = cut(scored)
    ranked = positions(scored, ["permutation"])
    sizes = scored.groupBy("permutation").agg(F.count("*").alias("n_genes"))
    hits = (
        ranked.join(sets.select("library", "term", "gene"), "gene")
        .join(sizes, "permutation")
        .withColumn("weight", _weighted(F.col("score"), weighted_score))
    )
    keys = ["library", "term", "permutation"]
    return enrichment_scores(hit_sums(hits, keys), keys).drop("peak")


def significance(observed: DataFrame, null: DataFrame) -> DataFrame:
    """Add nes, p_value, fdr and fwer to (library, term, es).

    Scores are compared with null scores of their own sign.  The shares of null
    and observed scores beyond a score come from running totals, in each sign.
    """
    sign = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    null = null.withColumn("sign", sign("es"))
    means = null.groupBy("library", "term", "sign").agg(F.avg(F.abs("es")).alias("mean"), F.count("*").alias("n"))
    scored = observed.withColumn("sign", sign("es")).join(means, ["library", "term", "sign"], "left")
    scored = scored.withColumn("nes", F.try_divide(F.col("es"), F.col("mean")))
    normed = null.join(means, ["library", "term", "sign"]).withColumn("nes", F.try_divide(F.col("es"), F.col("mean")))

    beyond = (
        normed.select("library", "term", "sign", F.col("es").alias("null_es"))
        .join(scored.select("library", "term", "sign", "es"), ["library", "term", "sign"])
        .groupBy("library", "term")
        .agg(F.count_if(F.abs("null_es") >= F.abs("es")).alias("beyond"))
    )
    every = normed.select("sign", F.abs("nes").alias("size"), F.lit(1).alias("from_null"), F.lit(0).alias("from_seen")).unionByName(
        scored.select("sign", F.abs("nes").alias("size"), F.lit(0).alias("from_null"), F.lit(1).alias("from_seen"))
    )
    shares = running_totals(
        every, ["sign"], "size", {"nulls": F.col("from_null"), "seen": F.col("from_seen")}, descending=True
    ).filter("seen > 0")
    shares = shares.select(
        "sign", "size", F.try_divide(F.col("nulls_upto"), F.col("nulls_total")).alias("q_null"),
        F.try_divide(F.col("seen_upto"), F.col("seen_total")).alias("q_seen"),
    )
    extremes = normed.groupBy("permutation", "sign").agg(F.max(F.abs("nes")).alias("size"))
    chance = running_totals(
        extremes.select("sign", "size", F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
            scored.select("sign", F.abs("nes").alias("size"), F.lit(0).alias("e"), F.lit(1).alias("s"))
        ),
        ["sign"], "size", {"e": F.col("e"), "s": F.col("s")}, descending=True,
    ).filter("s > 0").select("sign", "size", F.try_divide(F.col("e_upto"), F.col("e_total")).alias("fwer"))
    return (
        scored.withColumn("size_of_nes", F.abs("nes"))
        .join(beyond, ["library", "term"], "left")
        .join(shares.withColumnRenamed("size", "size_of_nes"), ["sign", "size_of_nes"], "left")
        .join(chance.withColumnRenamed("size", "size_of_nes"), ["sign", "size_of_nes"], "left")
        .select(
            *map(col, observed.columns), "nes",
            F.try_divide(F.col("beyond"), F.col("n")).alias("p_value"),
            F.least(F.try_divide(F.col("q_null"), F.col("q_seen")), F.lit(1.0)).alias("fdr"),
            F.col("fwer"),
        )
    )


def observed_scores(sets: DataFrame, ranking: DataFrame, weighted_score: float) -> tuple[DataFrame, DataFrame]:
    """(library, term, es, peak, tag and gene shares) and the hits of the leading edge."""
    n_genes = ranking.agg(F.count("*").alias("n")).scalar()
    hits = (
        sets.join(ranking, "gene")
        .withColumn("n_genes", n_genes)
        .withColumn("weight", _weighted(F.col("score"), weighted_score))
    )
    keys = ["library", "term"]
    scores = enrichment_scores(hit_sums(hits, keys), keys)
    joined = hits.join(scores, keys)
    edge = joined.filter(F.when(F.col("es") >= 0, F.col("position") <= F.col("peak")).otherwise(F.col("position") >= F.col("peak")))
    tags = edge.groupBy(*keys).agg(
        F.count("*").alias("leading_size"), F.max("size").alias("size"), F.max("n_genes").alias("n_genes")
    )
    share = F.when(F.col("es") >= 0, F.col("peak") + 1).otherwise(F.col("n_genes") - F.col("peak"))
    terms = scores.join(tags, keys).select(
        *keys, "es", "size", "leading_size", F.try_divide(F.col("leading_size"), F.col("size")).alias("tag_share"),
        F.try_divide(share, F.col("n_genes")).alias("gene_share"),
    )
    return terms, edge.select("library", "term", "gene", "position")


def _result(terms, edge, ranking, null, mapping, wanted, feature, gene) -> GeneSetEnrichment:
    pairs = mapping.select(col(feature), col(gene).alias("gene")).distinct()
    return GeneSetEnrichment(
        significance(cut(terms), cut(null)), edge.join(pairs, "gene", "left"), ranking, wanted.join(pairs, feature, "left_anti")
    )


def gsea_preranked(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    gene_sets: DataFrame,
    direction: str = "ascending",
    *,
    min_size: int = 15,
    max_size: int = 500,
    permutations: int = 1000,
    weighted_score: float = 1.0,
    seed: int = 123,
    feature: str = FEATURE,
    gene: str = GENE,
) -> GeneSetEnrichment:
    """Enrichment along a given score per feature, against randomly placed sets."""
    scored = rank_genes(df, column, mapping, direction, feature=feature, gene=gene).drop("rank")
    ranking = cut(positions(scored, best_first_descending=direction == "descending"))
    sets = sized_sets(gene_sets, ranking, min_size, max_size)
    terms, edge = observed_scores(sets, ranking, weighted_score)
    null = set_permutation_null(sets, ranking, permutations, weighted_score, seed)
    return _result(terms, edge, ranking, null, mapping, df.select(col(feature)).distinct(), feature, gene)


def gsea(
    df: DataFrame,
    metadata: DataFrame,
    grouping: str,
    group1: str,
    group2: str,
    mapping: DataFrame,
    gene_sets: DataFrame,
    *,
    method: str = "signal_to_noise",
    permutation_type: str = "phenotype",
    min_size: int = 15,
    max_size: int = 500,
    permutations: int = 1000,
    weighted_score: float = 1.0,
    seed: int = 123,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
    gene: str = GENE,
) -> GeneSetEnrichment:
    """Enrichment along a class difference computed from the intensities."""
    known = {r[0] for r in metadata.filter(col(grouping).isin(group1, group2)).select(col(grouping)).distinct().collect()}
    if known != {group1, group2}:
        raise ValueError("both groups must occur in the metadata")
    if permutation_type not in ("phenotype", "gene_set"):
        raise ValueError(f"unknown permutation type {permutation_type!r}")
    wanted = metadata.filter(col(grouping).isin(group1, group2)).select(col(sample), (col(grouping) == group1).alias("first"))
    used = df.join(wanted.select(col(sample)), sample, "left_semi")
    measure = measure_column(df, value)
    if method == "log2_ratio_of_classes" and used.filter(col(measure) < 0).limit(1).count():
        raise ValueError("a log ratio of classes needs values of zero or more")
    cells = cut(gene_intensities(used, mapping, value=measure, sample=sample, feature=feature, gene=gene))
    labelled = cells.join(wanted, sample)
    ranking = cut(positions(class_scores(labelled, F.col("first"), method, [])))
    sets = sized_sets(gene_sets, ranking, min_size, max_size)
    terms, edge = observed_scores(sets, ranking, weighted_score)
    if permutation_type == "phenotype":
        first_size = cells.select(col(sample)).distinct().join(wanted.filter("first"), sample, "left_semi").agg(F.count("*").alias("n")).scalar()
        null = phenotype_null(cells, sets, first_size, permutations, method, weighted_score, seed, sample=sample)
    else:
        null = set_permutation_null(sets, ranking, permutations, weighted_score, seed)
    return _result(terms, edge, ranking, null, mapping, used.select(col(feature)).distinct(), feature, gene)


def term_curve(ranking: DataFrame, members: DataFrame, weighted_score: float = 1.0) -> DataFrame:
    """(position, gene, is_hit, running_sum) of one term along the whole ranking."""
    tagged = ranking.join(members.select("gene").distinct().withColumn("__in", F.lit(1)), "gene", "left")
    tagged = tagged.withColumn("is_hit", F.col("__in").isNotNull()).withColumn(
        "weight", F.when(F.col("is_hit"), _weighted(F.col("score"), weighted_score)).otherwise(F.lit(0.0))
    )
    totals = running_totals(
        tagged, [], "position", {"__w": F.col("weight"), "__miss": F.when(F.col("is_hit"), 0).otherwise(1)}
    )
    level = F.try_divide(F.col("__w_upto"), F.col("__w_total")) - F.coalesce(F.try_divide(F.col("__miss_upto"), F.col("__miss_total")), F.lit(0.0))
    return tagged.select("position", "gene", "is_hit").join(totals.select("position", level.alias("running_sum")), "position")


def with_lead_lists(result: GeneSetEnrichment, *, feature: str = FEATURE) -> DataFrame:
    """Export form: terms with ``;``-joined leading genes (by position) and features."""
    lists = result.leading.groupBy("library", "term").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", "gene"))), lambda g: g["gene"]), ";").alias("Lead_genes"),
        F.array_join(F.array_sort(F.collect_set(col(feature))), ";").alias("Lead_proteins"),
    )
    return result.terms.join(lists, ["library", "term"], "left")
