"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.plans.storage import scratch_path

#: Rows of an Arrow batch: texts may be long, and a batch is held in a worker's memory.
BATCH_ROWS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the number of rows of an Arrow batch, unless it is lower already."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(setting))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def saved(df: DataFrame, label: str, **options) -> DataFrame:
    """Write the rows below the shared folder and read them again.

    Like ``checkpoint()`` this ends the lineage: lost executors don't lose the
    rows. Unlike it, readers of a few columns read no others. ``options`` are those
    of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of a table, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def fold(column: str | Column, parts: int) -> Column:
    """The rest of crc32 of the value as text; null for a null value."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(value.cast("string").cast("binary")) % parts


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, folds: int) -> DataFrame:
    """(text, label, rows): texts of at most ``per_class`` documents of each label 0 and 1.

    Documents of fold 0 are left out, as are documents with a null id, a null
    text, no label, both labels, or a text longer than ``longest`` characters.
    Those with the smallest hash of their id are taken, so repeated runs agree.
    ``rows`` counts all documents of that label outside fold 0. The sample is
    bounded by its parameters, whatever the size of the tables.
    """
    spark = documents.sparkSession
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold("id", folds) != 0))
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other").select("id", "label", F.xxhash64("id").alias("draw"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.filter(F.col("label") == k).orderBy("draw", "id").limit(per_class) for k in (0, 1)]
    ids = [(r["id"], r["label"], counts[r["label"]]) for part in drawn for r in part.collect()]
    chosen = spark.createDataFrame(ids, "id long, label int, rows long")
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text")).filter(F.length("text") <= longest)
    # at most 2 * per_class rows: small by its parameters
    found = texts.join(F.broadcast(chosen), "id")
    return found.groupBy("id", "label", "rows").agg(F.min("text").alias("text")).orderBy("id").select("text", "label", "rows")


def newton(x, y, weight, rounds: int = 50):
    """Slope and intercept of a weighted logistic curve through one variable."""
    import numpy as np

    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    ridge = 1e-3 * np.eye(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge @ theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        theta -= step if size < 5 else step * 5 / size
        if size < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])
