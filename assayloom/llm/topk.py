"""Exact top-k by inner product, through histograms of all scores.

Vectors are scaled to whole numbers, so scores are exact. Queries and candidates
are packed into blocks, and every pair of blocks is scored. Each round counts, for
each query, the scores in equal bins of an interval, summed over all blocks, and
narrows the interval to the bin that holds the k-th highest score, until that
score is known. A last round returns what reaches it, and ties go to the smaller
id. No round returns more than a few rows for a query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import saved

#: Queries and candidates of a block, and bins of a histogram.
QUERY_BLOCK, BLOCK, BINS = 512, 2048, 1024
SCALE = 256
#: Vectors of whole numbers take part below this squared length: then no score or sum on the way to it passes 64 bits.
LARGEST = float(1 << 60)


def whole_vectors(df: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, dim, v): components x as floor(scale * x).

    Rows without id, and vectors that are null, empty, or hold null or non-finite components, are left out.
    So are finite ones of a squared length of ``LARGEST`` or more, whose scores may not fit 64 bits:
    ``too_large`` names them.
    """
    sound, length = _sound(df, id_column, vector, scale)
    whole = F.transform(F.col("vector"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return sound.filter(length < LARGEST).select("id", F.size("vector").alias("dim"), whole.alias("v"))


def too_large(df: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id) of the finite vectors that ``whole_vectors`` leaves out for their length."""
    sound, length = _sound(df, id_column, vector, scale)
    return sound.filter(length >= LARGEST).select("id")


def _sound(df: DataFrame, id_column: str, vector: str, scale: int):
    """Rows (id, vector) that are whole, and their squared length once they are whole numbers, as a double."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    # a larger number is as far off as this one, and can be cut to a whole number and multiplied
    near = F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), x.cast("double") * scale))).cast("double"))
    return rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & sound), F.aggregate(near, F.lit(0.0), lambda s, x: s + x * x)


_BLOCK = "dim int, ids binary, data binary"


def _pack(rows: DataFrame, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension, within each partition."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def block(dim, part):
            row = {"dim": dim, "ids": part["id"].to_numpy(dtype=np.int64).tobytes(), "data": np.stack(part["v"].tolist()).astype(np.int64).tobytes()}
            return row | {c: part[c].to_numpy(dtype=np.int64).tobytes() for c in extra}

        held: dict[int, list] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                held.setdefault(dim, []).append(part)
                if sum(map(len, held[dim])) >= size:
                    joined = pd.concat(held[dim])
                    whole = len(joined) // size * size
                    yield pd.DataFrame([block(dim, joined[i:i + size]) for i in range(0, whole, size)])
                    held[dim] = [joined[whole:]]
        left = [block(dim, joined) for dim, parts in held.items() if len(joined := pd.concat(parts))]
        if left:
            yield pd.DataFrame(left)

    schema = _BLOCK + "".join(f", {c} binary" for c in extra)
    return rows.select("id", "dim", "v", *extra).mapInPandas(packed, schema)


def _matrix(data: bytes, dim: int):
    import numpy as np

    return np.frombuffer(data, dtype=np.int64).reshape(-1, dim)


def _scores(queries, candidates):
    """Inner products as 64-bit integers. No sum, nor a part of it, is larger than the product of the two lengths."""
    import numpy as np

    q, c = queries.astype(np.float64), candidates.astype(np.float64)
    bound = np.sqrt((q * q).sum(axis=1).max() * (c * c).sum(axis=1).max())
    if bound < 2 ** 52:  # doubles hold these sums exactly
        return (q @ c.T).astype(np.int64)
    return queries @ candidates.T


def _pairs(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of queries beside every block of candidates: a stated query set against all rows."""
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return candidates.crossJoin(named).filter("dim = q_dim")


def _count(k: int):
    """Per query and block: counts by bin, from the highest bin down to the one with the block's k-th score."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for row in batch.itertuples():
                rows = np.frombuffer(row.q_row, dtype=np.int64)
                low, high, width = (np.frombuffer(x, dtype=np.int64)[:, None] for x in (row.q_low, row.q_high, row.q_width))
                scores = _scores(_matrix(row.q_data, row.dim), _matrix(row.data, row.dim))
                own = np.frombuffer(row.q_ids, dtype=np.int64)[:, None] == np.frombuffer(row.ids, dtype=np.int64)[None, :]
                bins = (scores - low) // width
                bins[own | (scores < low) | (scores >= high)] = -1
                if bins.shape[1] > k:  # lower bins can't hold the k-th of all
                    least = np.partition(bins, bins.shape[1] - k, axis=1)[:, [-k]]
                    bins[bins < least] = -1
                at, col = np.nonzero(bins >= 0)
                pairs, n = np.unique(at * BINS + bins[at, col], return_counts=True)
                if len(pairs):
                    yield pd.DataFrame({"row": rows[pairs // BINS], "bin": pairs % BINS, "n": n})

    return counted


def _reach(k: int):
    """Per query and block: the k best of the scores that reach the query's bound."""

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for row in batch.itertuples():
                rows, of = (np.frombuffer(x, dtype=np.int64) for x in (row.q_row, row.q_ids))
                bound, ids = np.frombuffer(row.q_low, dtype=np.int64), np.frombuffer(row.ids, dtype=np.int64)
                scores = _scores(_matrix(row.q_data, row.dim), _matrix(row.data, row.dim))
                fine = (scores >= bound[:, None]) & (of[:, None] != ids[None, :])
                at, col = np.nonzero(fine)
                order = np.lexsort((ids[col], -scores[at, col], at))
                at, col = at[order], col[order]
                first = np.searchsorted(at, at, side="left")
                best = np.arange(len(at)) - first < k
                at, col = at[best], col[best]
                if len(at):
                    yield pd.DataFrame({"row": rows[at], "query_id": of[at], "vec_id": ids[col], "score": scores[at, col]})

    return reached


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all vectors but its own.

    ``vectors`` and ``queries`` come from ``whole_vectors``. Rows that share the
    query's id are its own; a repeated query is answered each time; vectors of
    another dimension don't take part. Fewer than k candidates are all returned.
    Scores are exact: ``whole_vectors`` bounds the lengths.
    """
    candidates = saved(_pack(vectors, BLOCK), "candidates")
    asked = saved(queries.withColumn("row", F.monotonically_increasing_id()), "queries")
    longest = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    most = vectors.agg(F.max(longest)).first()[0] or 0.0
    # no score is further from 0 than the product of the lengths
    reach = (F.ceil(longest * most) + 2).cast("long")
    state = asked.select("id", "dim", "v", "row", (-reach).alias("low"), (reach + 1).alias("high"), F.ceil((2 * reach + 1) / BINS).cast("long").alias("width"), F.lit(0).cast("long").alias("above"))
    rounds = 0
    while True:
        state = saved(state, f"round{rounds}")
        widest = state.agg(F.max("width")).first()[0]
        if widest is None or widest < 1 or rounds > 64:
            break
        blocks = _pack(state.filter("width > 0"), QUERY_BLOCK, ("row", "low", "high", "width"))
        counts = _pairs(candidates, blocks).mapInPandas(_count(k), "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin"))
        here = counts.withColumn("sum", F.sum("n").over(down)).join(state.select("row", F.col("above").alias("had")), "row")
        found = here.filter(F.col("had") + F.col("sum") >= k).groupBy("row").agg(F.max_by(F.struct("bin", (F.col("sum") - F.col("n")).alias("over")), "bin").alias("hit"))
        # a query with fewer than k scores takes all; width 0 marks a known bound
        low = F.when(F.col("hit").isNull(), F.col("low")).otherwise(F.col("low") + F.col("hit.bin") * F.col("width"))
        high = F.when(F.col("hit").isNull(), F.col("high")).otherwise(F.least("high", low + F.col("width")))
        narrower = F.when((F.col("width") <= 1) | F.col("hit").isNull(), 0).otherwise(F.ceil(F.col("width") / BINS))
        state = state.join(found, "row", "left").select(
            "id", "dim", "v", "row", low.cast("long").alias("low"), high.cast("long").alias("high"), narrower.cast("long").alias("width"),
            (F.col("above") + F.coalesce("hit.over", F.lit(0))).cast("long").alias("above"),
        )
        rounds += 1
    blocks = _pack(state, QUERY_BLOCK, ("row", "low"))
    hits = _pairs(candidates, blocks).mapInPandas(_reach(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
