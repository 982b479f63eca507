"""A sample of the registered queries next to their SQL; ``check_queries.py`` runs them all."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import check_queries
from assayloom.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"
SAMPLE = [
    "flagship_differential_expression", "flt2_samples_by_intensity_sum", "nrm3_percentile", "sta3_anova", "sta5_mann_whitney",
    "sta7_benjamini_hochberg_by_family", "ptm2_per_sample", "int7_merge_directions", "cht3_histogram", "clu4_external_indices",
    "mlc8_roc_curve", "out3_outside_ellipsoid", "src5_clean_groups", "seq6_position_index",
]


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d", n)]  # those are the optional subpackage's


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() == 25
    assert found.columns == ["feature", "t_statistic", "p_value", "corrected_p_value", "log2_fold_change"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in check_queries.TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    state, note, _ = check_queries.compare(spark, db, FOLDER, name)
    assert state == "ok", note
