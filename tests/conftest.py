import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "3").config("spark.driver.memory", "8g")
        # tiny tables: compiling a plan would take longer than running it
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LONG = "Sample string, `Protein ID` string, Intensity double"


@pytest.fixture
def long(spark):
    """Long table of {feature: [value per sample]}; samples are Sample1, Sample2, ..."""

    def make(columns):
        rows = [(f"Sample{i + 1}", p, None if x is None else float(x)) for p, xs in columns.items() for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, LONG)

    return make


@pytest.fixture
def metadata(spark):
    def make(labels):
        return spark.createDataFrame([(f"Sample{i + 1}", g) for i, g in enumerate(labels)], "Sample string, Group string")

    return make


def cells(df, value=None):
    """{(sample, feature): value} of a long table."""
    value = value or [c for c in df.columns if "Intensity" in c][0]
    return {(r["Sample"], r["Protein ID"]): r[value] for r in df.collect()}


def column(df, key, value, digits=4):
    return {r[key]: None if r[value] is None else round(r[value], digits) for r in df.collect()}


def values(df, name):
    return sorted(r[name] for r in df.select(name).collect())
