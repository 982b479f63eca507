"""Over-representation of gene sets among regulated features.

Results stay long: one row per term, and one row per (term, gene, feature) hit.
Gene lists are joined into texts only by ``with_lists``, for export.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayloom.functions.tails import overlap_upper
from assayloom.operators.stats import correct_p_values
from assayloom.plans.prefix import running_totals
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, GENE, col


class Enrichment(NamedTuple):
    terms: DataFrame
    hits: DataFrame  # (library, term, gene, feature)
    unmapped: DataFrame  # regulated features without a gene


def regulated(df: DataFrame, column: str, threshold: float, *, feature: str = FEATURE) -> DataFrame:
    """(feature, direction) with ``up`` above and ``down`` below the threshold.

    For a column with ``log`` in its name the lower threshold is the negative one.
    A feature listed several times counts once, with its smallest value.
    """
    low = -threshold if "log" in column else threshold
    once = df.groupBy(col(feature)).agg(F.min(col(column)).alias("__x"))
    direction = F.when(F.col("__x") > threshold, "up").when(F.col("__x") < low, "down")
    return once.select(col(feature), direction.alias("direction")).filter("direction is not null")


def usable_directions(labelled: DataFrame, direction: str = "both") -> list[str]:
    """Which directions to run: an empty side is skipped for ``both``, else an error."""
    if direction not in ("up", "down", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    row = labelled.agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down")).first()
    wanted = ["up", "down"] if direction == "both" else [direction]
    present = [d for d in wanted if row[d] > 0]
    if not present:
        raise ValueError(f"no features for direction {direction!r} at this threshold")
    return present


def overlap_test(query: DataFrame, gene_sets: DataFrame, background: DataFrame | int | None = None) -> DataFrame:
    """Hypergeometric test of (gene) rows against (library, term, gene) sets.

    Without a background, all genes of a library's sets are its background.  A
    background table also restricts sets and query; a number only sets the size.
    Terms without any overlap are not reported.
    """
    sets = gene_sets.select("library", "term", "gene").distinct()
    marked = query.select("gene").distinct().withColumn("hit", F.lit(1))
    hit = F.coalesce("hit", F.lit(0))
    if isinstance(background, DataFrame):
        known = background.select("gene").distinct()
        sets = sets.join(known, "gene", "left_semi")
    counted = sets.join(marked, "gene", "left").groupBy("library", "term").agg(
        F.count("*").alias("set_size"), F.sum(hit).alias("overlap")
    )
    if background is None:
        sizes = sets.select("library", "gene").distinct().join(marked, "gene", "left").groupBy("library").agg(
            F.sum(hit).alias("query_size"), F.count("*").alias("background_size")
        )
        terms = counted.join(sizes, "library")
    else:
        if isinstance(background, DataFrame):
            sizes = known.join(marked, "gene", "left").agg(F.struct(F.sum(hit).alias("k"), F.count("*").alias("n")).alias("s"))
        else:
            sizes = marked.agg(F.struct(F.count("*").alias("k"), F.max(F.lit(background).cast("long")).alias("n")).alias("s"))
        terms = counted.withColumn("s", sizes.scalar()).select(
            "library", "term", "set_size", "overlap", F.col("s.k").alias("query_size"), F.col("s.n").alias("background_size")
        )
    x, m, k, n = (F.col(c).cast("double") for c in ("overlap", "set_size", "query_size", "background_size"))
    odds = (x + 0.5) * (n - m + 0.5) / ((m + 0.5) * (k - x + 0.5))
    tested = cut(
        terms.filter("overlap > 0")
        .withColumn("p_value", overlap_upper("overlap", "set_size", "query_size", "background_size"))
        .withColumn("odds_ratio", odds)
    )
    corrected = correct_p_values(tested, by=["library"], name="adjusted_p_value")
    return corrected.withColumn("combined_score", -F.log("p_value") * F.col("odds_ratio"))


def over_representation(
    features: DataFrame,
    mapping: DataFrame,
    gene_sets: DataFrame,
    background: DataFrame | int | None = None,
    *,
    feature: str = FEATURE,
    gene: str = GENE,
) -> Enrichment:
    """Test the genes of the given features; ``mapping`` holds (feature, gene) pairs."""
    pairs = mapping.select(col(feature), col(gene).alias("gene")).distinct()
    wanted = features.select(col(feature)).distinct()
    query = cut(pairs.join(wanted, feature, "left_semi").select("gene").distinct())  # gene names, used below and in the test
    terms = overlap_test(query, gene_sets, background)
    hits = (
        gene_sets.select("library", "term", "gene").distinct()
        .join(terms.select("library", "term"), ["library", "term"], "left_semi")
        .join(query, "gene", "left_semi")
    )
    if isinstance(background, DataFrame):
        hits = hits.join(background.select("gene").distinct(), "gene", "left_semi")
    return Enrichment(
        terms, hits.join(pairs, "gene").select("library", "term", "gene", col(feature)), wanted.join(pairs, feature, "left_anti")
    )


def merge_directions(
    up: DataFrame,
    down: DataFrame,
    up_hits: DataFrame,
    down_hits: DataFrame,
    *,
    keys: Sequence[str] = ("library", "term"),
    p: str = "adjusted_p_value",
    count: str = "overlap",
    counted: str = "gene",
) -> tuple[DataFrame, DataFrame]:
    """One row per term of either direction, and the united hits.

    Of a term found in both, the row with the higher p stays (the upper one on
    ties) and its count becomes the number of distinct united members.
    """
    keys = list(keys)
    both = up.withColumn("__side", F.lit(1)).unionByName(down.withColumn("__side", F.lit(0)))
    columns = [c for c in up.columns if c not in keys]
    kept = both.groupBy(*map(col, keys)).agg(
        F.max_by(F.struct(*map(col, columns)), F.struct(col(p), F.col("__side"))).alias("__row"),
        F.count("*").alias("__sides"),
    )
    hits = up_hits.unionByName(down_hits).distinct()
    united = hits.groupBy(*map(col, keys)).agg(F.count_distinct(col(counted)).alias("__united"))
    joined = kept.join(united, keys, "left").select(*map(col, keys), "__row.*", "__sides", "__united")
    merged = joined.withColumn(
        count, F.when((F.col("__sides") > 1) & F.col("__united").isNotNull(), F.col("__united")).otherwise(col(count))
    )
    return merged.drop("__sides", "__united"), hits


def enrich_regulated(
    df: DataFrame,
    column: str,
    threshold: float,
    mapping: DataFrame,
    gene_sets: DataFrame,
    background: DataFrame | int | None = None,
    direction: str = "both",
    *,
    feature: str = FEATURE,
    gene: str = GENE,
) -> Enrichment:
    """Over-representation of up- and downregulated features, merged per term."""
    labelled = cut(regulated(df, column, threshold, feature=feature))  # counted, then read once per direction
    parts = [
        over_representation(labelled.filter(F.col("direction") == d), mapping, gene_sets, background, feature=feature, gene=gene)
        for d in usable_directions(labelled, direction)
    ]
    if len(parts) == 1:
        return parts[0]
    terms, hits = merge_directions(parts[0].terms, parts[1].terms, parts[0].hits, parts[1].hits)
    return Enrichment(terms, hits, parts[0].unmapped.unionByName(parts[1].unmapped))


def with_lists(result: Enrichment, *, feature: str = FEATURE) -> DataFrame:
    """Export form: ``Overlap`` as ``x/m`` and ``;``-joined genes and features per term."""
    lists = result.hits.groupBy("library", "term").agg(
        F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("Genes"),
        F.array_join(F.array_sort(F.collect_set(col(feature))), ";").alias("Proteins"),
    )
    # column names ignore case: the text takes the place of the number
    share = F.concat_ws("/", F.col("overlap").cast("string"), F.col("set_size").cast("string"))
    return result.terms.join(lists, ["library", "term"], "left").withColumn("Overlap", share)


def top_terms(
    terms: DataFrame, n: int, cutoff: float, *, libraries: Sequence[str] | None = None, p: str = "adjusted_p_value",
    library: str = "library", term: str = "term",
) -> DataFrame:
    """The n best terms per library at or below the cutoff, with -log10 of their p.

    The number of each value within its library comes from running totals; only
    terms tied at the border are ordered by name.
    """
    kept = terms.filter(col(p) <= cutoff)
    if libraries is not None:
        kept = kept.filter(col(library).isin(list(libraries)))
    ranks = running_totals(kept, [library], p, {"__n": F.lit(1)})
    near = ranks.filter(F.col("__n_upto") - F.col("__n") < n).select(
        col(library), col(p), (F.col("__n_upto") - F.col("__n")).alias("__before")
    )
    order = Window.partitionBy(col(library), col(p)).orderBy(col(term))
    return (
        kept.join(near, [library, p])
        .withColumn("__row", F.row_number().over(order))
        .filter(F.col("__row") <= n)  # lets every task keep only its first n per tie
        .withColumn("rank", F.col("__before") + F.col("__row"))
        .filter(F.col("rank") <= n)
        .withColumn("minus_log10", -F.log10(col(p)))
        .drop("__before", "__row")
    )
