"""Exact duplicates through an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised form. Texts are first grouped
by key and bytes, which tasks do on their own rows before anything is moved, so a
text with any number of copies is one entry per task. The entries make up the
index: a directory over the leading bits of the key points to buckets, a bucket
with too many entries is split by its next bit, and where that bit is beyond the
directory's depth the directory doubles. It is a table that is joined, so its depth
follows the data. Buckets are key ranges; each is owned by one task, which chains
the texts that share a key and picks the row that stays. A row goes through the
directory to its bucket and meets its entry there by key; where a key has a chain,
the bytes of the normalised text decide.

Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assayloom.llm.common import fresh, saved, small_batches
from assayloom.plans.storage import scratch_path

#: Entries of a bucket, and bits of a key.
BUCKET, KEY_BITS = 2000, 64
#: What is deleted before texts are compared; fixed values.
IGNORED = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def text_key(normal: Column) -> Column:
    return F.xxhash64(normal)


def digest(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


class Index(NamedTuple):
    entries: DataFrame  # (bucket, depth, key, text, sha, chain, n, keep_id, keep_points), one row per distinct text
    directory: DataFrame  # (leaf, depth, bucket)
    shared: DataFrame  # (key), those of several texts
    bits: int  # depth of the directory


def entries(documents: DataFrame, key=text_key) -> DataFrame:
    """(key, normal, sha, n, keep_id, keep_points): one row per distinct text, told apart by key and bytes.

    The row that stays is the one with the most code points, then the smallest doc_id;
    rows without doc_id come after all others, whatever their length.
    """
    points = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("normal"), points.alias("points"))
    # one number for the order of rows, so that groups are hashed and not sorted
    scaled = lambda c: F.col(c).cast("decimal(16,0)") * F.lit(str(2**KEY_BITS)).cast("decimal(20,0)")
    order = F.when(F.col("doc_id").isNotNull(), scaled("points") - F.col("doc_id"))
    longest = F.coalesce(F.max(F.when(F.col("doc_id").isNotNull(), F.col("points"))), F.max("points"))
    grouped = rows.withColumn("key", key(F.col("normal"))).groupBy("key", "normal").agg(
        F.count(F.lit(1)).alias("n"), F.max(order).alias("best"), longest.alias("keep_points")
    )
    kept = scaled("keep_points") - F.col("best")
    return grouped.select("key", "normal", digest(F.col("normal")).alias("sha"), "n", kept.cast("long").alias("keep_id"), "keep_points")


def _leading(key: str, bits: int) -> Column:
    """The leading bits of a key as a number; without any, 0."""
    return F.shiftrightunsigned(F.col(key), KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(rows: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """((leaf, depth, bucket), bits): the bucket of each value of the leading bits that occurs.

    The directory doubles until no leaf holds more than ``bucket`` entries; a leaf of
    one key can't be split and ends it too, its entries are a chain. A bucket's depth
    is the least at which no more than ``bucket`` entries share its leading bits, which
    is where splitting ends in whatever order entries come. ``bucket`` is the least leaf
    that could be in it.
    """
    total = rows.count()
    bits = max(0, math.ceil(math.log2(max(total, 1) / bucket)))
    while True:
        leaves = saved(
            rows.groupBy(_leading("key", bits).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")), "leaves"
        )
        if bits == KEY_BITS or leaves.filter((F.col("n") > bucket) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        bits += 1
    # a leaf's bits shifted by as many as it has, or more, leave none; 64 places would leave all
    shorter = lambda depth: F.when(F.lit(bits) - depth < KEY_BITS, F.call_function("shiftrightunsigned", F.col("leaf"), F.lit(bits) - depth)).otherwise(0)
    at = leaves.select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("prefix", shorter(F.col("depth")))
    sums = at.groupBy("depth", "prefix").agg(F.sum("n").alias("total"))
    depths = (
        at.join(sums, ["depth", "prefix"]).filter((F.col("total") <= bucket) | (F.col("depth") == bits))
        .groupBy("leaf").agg(F.min("depth").alias("depth"))
    )
    least = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", shorter(F.col("depth")), F.lit(bits) - F.col("depth")))
    return saved(depths.withColumn("bucket", least), "directory"), bits


def _told(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``normal`` becomes ``text``: the normalised text where its key has several, else empty."""
    marked = rows.join(shared.withColumn("several", F.lit(True)), "key", "left")
    return marked.withColumn("text", F.when(F.col("several"), F.col("normal")).otherwise("")).drop("several", "normal")


def build(documents: DataFrame, bucket: int = BUCKET, key=text_key) -> Index:
    """The index of all distinct texts, written to the shared folder in the order of the key, a file per owner task.

    ``chain`` counts the texts of one key from 0; ``text`` holds the bytes of those
    whose key has several, and is empty for others.
    """
    spark = documents.sparkSession
    rows = saved(entries(documents, key), "entries")
    found, bits = directory(rows, bucket)
    shared = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    owned = _in_buckets(_told(rows, shared), found, bits)
    chained = Window.partitionBy("bucket", "key").orderBy("sha")
    index = owned.withColumn("chain", F.row_number().over(chained) - 1).select(
        "bucket", "depth", "key", "text", "sha", "chain", "n", "keep_id", "keep_points"
    )
    path = scratch_path(spark, "index")
    index.repartitionByRange("key").sortWithinPartitions("key", "chain").write.parquet(path)
    return Index(spark.read.schema(index.schema).parquet(path), found, shared, bits)


def _in_buckets(rows: DataFrame, directory: DataFrame, bits: int) -> DataFrame:
    """Rows with the bucket that the directory names for the leading bits of their key."""
    return rows.withColumn("leaf", _leading("key", bits)).join(directory, "leaf").drop("leaf")


def mark(documents: DataFrame, index: Index, key=text_key) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, through the index of the same documents.

    Null texts count as empty; all texts without other characters are equal. Rows
    without doc_id are grouped like others; they stay only in a group without any
    doc_id. Of rows that repeat both doc_id and text one is kept. Other columns are
    not read.
    """
    normal = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("normal"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
    )
    rows = normal.select("doc_id", "points", key(F.col("normal")).alias("key"), digest(F.col("normal")).alias("text_sha256"), "normal")
    placed = _in_buckets(_told(rows, index.shared), index.directory, index.bits)
    entry = index.entries.select("bucket", "key", "text", F.col("n").alias("group_size"), "keep_id")
    joined = placed.join(entry, ["bucket", "key", "text"])
    # not by the key: else the rows of a large group would have to stay together after the join
    repeated = Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("points"))
    first = (F.row_number().over(repeated) == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256")


def classes(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``mark`` through an index built of the same documents."""
    return mark(documents, build(documents, bucket))


def keep_one(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows that stay, with their own columns.

    Null texts are empty ones, and all empty texts are equal. Of rows that repeat a
    doc_id and a text one stays; rows without doc_id are rows like others. Texts of any
    length are compared whole; an empty table stays empty.
    """
    small_batches(documents.sparkSession)
    pin, turn, points = fresh(documents, "pin", "turn", "points")
    index = build(documents, bucket)
    stay = index.entries.select(F.concat_ws(":", F.coalesce(F.col("keep_id").cast("string"), F.lit("-")), "sha").alias(pin))
    sha = digest(normalised(F.col("text")))
    named = documents.withColumn(
        pin, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), sha)
    ).withColumn(points, F.length("text"))
    once = Window.partitionBy(pin).orderBy(F.desc_nulls_last(points), "text")
    return (
        named.join(stay, pin, "left_semi").withColumn(turn, F.row_number().over(once))
        .filter(F.col(turn) == 1).drop(pin, turn, points)
    )
