"""Where intermediate tables go when a plan must be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A folder of its own is made only for local sessions that name none, such as
    tests; a cluster without the setting is refused, for its machines share no
    temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assayloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one run below the shared folder. ``clear`` removes what was written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all scratch paths of this process, once no table that reads them is needed; returns their number."""
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(configuration).delete(path, True)
    return gone


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written below the shared folder and read again.

    For loops of many rounds: a checkpoint hands the constraints known of its rows on
    to the next plan, where they multiply round by round; a file knows of none.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
