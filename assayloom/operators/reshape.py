"""Long and wide forms of an intensity table, and identifier clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayloom.plans.storage import written
from assayloom.schema import FEATURE, SAMPLE, col, measure_column

#: The complete grid: samples that are unfolded for a feature, so many in the mean; blocks of them in a band; features of a
#: chunk at most, in the mean; tiles of a band and a chunk for each task.
SAMPLES_UNFOLDED, BLOCKS_OF_BAND, FEATURES_OF_CHUNK, TILES_OF_TASK = 256, 128, 4096, 4


def duplicate_keys(df: DataFrame, *, sample: str = SAMPLE, feature: str = FEATURE) -> DataFrame:
    """(sample, feature) keys that occur more than once; a wide form needs this empty."""
    return df.groupBy(col(sample), col(feature)).agg(F.count("*").alias("n")).filter("n > 1")


def long_to_wide(
    df: DataFrame,
    features: Sequence[str],
    value: str | None = None,
    *,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> DataFrame:
    """One row per sample, one column per listed feature.  For a short list of features.

    A feature that a sample holds twice raises when the rows are read;
    ``duplicate_keys`` lists such keys.
    """
    measure = measure_column(df, value)
    twice = F.raise_error(F.lit("a sample holds a feature twice: see duplicate_keys")).cast(df.schema[measure].dataType)
    cell = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(col(measure), ignorenulls=True))
    return df.groupBy(col(sample)).pivot(feature, list(features)).agg(cell)


def wide_to_long(
    wide: DataFrame, value: str, *, sample: str = SAMPLE, feature: str = FEATURE
) -> DataFrame:
    """The inverse of ``long_to_wide``: every cell becomes a row."""
    names = [c for c in wide.columns if c != sample]
    typed = wide.select(col(sample), *[col(c).cast("double").alias(c) for c in names])
    return typed.unpivot([col(sample)], [col(c) for c in names], feature, value)


def numbered(df: DataFrame, key: str, number: str) -> DataFrame:
    """The distinct keys with a dense number 0..n-1, stable under retries.

    Keys are hashed into slots; slot totals give the shift, so no task orders
    more than one slot. There are several slots for each task of a shuffle.
    """
    slots = max(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(col(key)).distinct().withColumn("__slot", F.pmod(F.xxhash64(col(key)), F.lit(slots)))
    per_slot = keys.groupBy("__slot").agg(F.count("*").alias("__size"))
    shift = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_slot.select("__slot", F.coalesce(F.sum("__size").over(shift), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__slot").orderBy(col(key))
    return (
        keys.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(shifts), "__slot")  # at most `slots` rows
        .select(col(key), (F.col("__rank") + F.col("__shift")).cast("long").alias(number))
    )


def complete_grid(
    df: DataFrame, value: str | None = None, *, sample: str = SAMPLE, feature: str = FEATURE
) -> DataFrame:
    """A row for every sample and feature; absent cells get a null value.

    Cells are written once and dealt out by tiles, bands of samples by chunks of features; what
    is shuffled follows the cells, not the grid. A tile is unfolded as the last step, block by
    block of samples: the same samples come again for each feature, with held cells in
    their places, so files that hold the grid find few values and short patterns, and stay small.
    """
    measure = measure_column(df, value)
    cells = written(df.select(col(sample).alias("s"), col(feature).alias("f"), col(measure).alias("x")), "cells")
    sizes = cells.agg(F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("f").alias("f")).first()
    blocks = max(1, -(-sizes["s"] // SAMPLES_UNFOLDED))
    bands = -(-blocks // BLOCKS_OF_BAND)
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes here become many rows
    chunks = max(-(-TILES_OF_TASK * wanted // bands), -(-sizes["f"] // FEATURES_OF_CHUNK))
    tasks = max(wanted, -(-bands * chunks // TILES_OF_TASK))
    block = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("block")
    band = F.expr(f"cast(block div {BLOCKS_OF_BAND} as int)").alias("band")
    chunk = F.pmod(F.xxhash64("f"), F.lit(chunks)).cast("int").alias("chunk")
    tile = ["band", "chunk"]

    names = cells.select("s").distinct().select("s", block).groupBy(band, "block").agg(F.array_sort(F.collect_list(F.struct("s"))).alias("names"))
    names = names.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("block", F.col("names.s").alias("names")))).alias("names"))
    names = names.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(tasks, *tile)
    features = cells.select("f").distinct().select("f", chunk).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).repartition(tasks, *tile)
    features = features.groupBy(tile).agg(F.collect_list(F.struct("f")).alias("features")).select(*tile, F.col("features.f").alias("features"))
    # a null key is equal to none: its rows are absent ones
    placed = cells.filter("s is not null and f is not null").select("*", block, chunk).select("*", band).repartition(tasks, *tile)
    held = placed.groupBy(*tile, "block", "f", "s").agg(F.collect_list(F.struct("x")).alias("xs"))  # a key may come again
    held = held.groupBy(*tile, "block", "f").agg(F.map_from_entries(F.collect_list(F.struct("s", "xs"))).alias("cells"))
    held = held.groupBy(*tile, "block").agg(F.collect_list(F.struct("f", "cells")).alias("held"))

    nothing = F.lit(None).cast(df.schema[measure].dataType)
    # generated code holds all rows that come of one of its input before it hands on the first; a higher-order function starts it anew
    each = lambda listed: F.explode(F.transform(listed, lambda x: x))
    # eights of samples and what is left over, by themselves: packed in bits, the next feature's begin at a byte again
    eights = F.size("names") - F.size("names") % 8
    parts = F.explode(F.array(F.slice("names", 1, eights), F.slice("names", eights + 1, 8))).alias("names")
    some = held.join(names, tile).select("held", F.try_element_at("names", F.col("block")).alias("names")).select("held", parts).select("names", each("held").alias("held"))
    some = some.select("held.f", "held.cells", F.explode("names").alias("s")).select("f", "s", F.explode_outer(F.try_element_at("cells", F.col("s"))).alias("cell"))
    some = some.select(F.col("s").alias(sample), F.col("f").alias(feature), F.col("cell.x").alias(measure))
    # no list is empty: asking for them lets both branches read one shuffle
    taken = held.filter(F.size(F.element_at("held.cells", 1)) > 0).groupBy(tile).agg(F.map_from_entries(F.collect_list(F.struct("block", "held.f"))).alias("taken"))
    free = F.coalesce(F.array_except("features", F.try_element_at("taken", F.col("block"))), F.col("features"))
    none = features.join(taken, tile, "left").join(names, tile).select("features", "taken", F.explode("names").alias("block", "names")).select("names", free.alias("free"))
    none = none.select("free", parts).select("names", each("free").alias("f")).select("f", F.explode("names").alias("s"))
    return none.select(F.col("s").alias(sample), F.col("f").alias(feature), nothing.alias(measure)).unionByName(some)


def clean_identifier(identifier: Column) -> Column:
    """Cut an accession at its first ``-`` and then at its first ``_``."""
    return F.substring_index(F.substring_index(identifier, "-", 1), "_", 1)


def drop_repeats(items: Column) -> Column:
    """Remove items equal to the one just before them."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))


def clean_group(group: Column) -> Column:
    """Cleaned members of a ``;`` group without consecutive repeats, as an array."""
    return drop_repeats(F.transform(F.split(group, ";"), clean_identifier))


def with_clean_groups(df: DataFrame, *, feature: str = FEATURE) -> DataFrame:
    """Replace each identifier group by its cleaned, ``;``-joined members."""
    return df.withColumn(feature, F.array_join(clean_group(col(feature)), ";"))
