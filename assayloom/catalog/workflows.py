"""Chains of steps and their checks, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom import schema
from assayloom.catalog import views as v
from assayloom.catalog.registry import query
from assayloom.plans.storage import scratch_path
from assayloom.plans.workflow import run_workflow
from assayloom.schema import FEATURE, SAMPLE, col


def _step(kind, **settings):
    return {"type": kind, "form_inputs": settings}


@query("pip1_workflow", f"""with {v.BY_BRAND}, m as (select s, quantile_cont(x, 0.5) m from i group by s)
 select s as sample, p as feature, round(log2(x / m), 6) as value from i join m using (s)""")
def pip1(spark, folder):
    """Two steps over a table; their result is written and read again."""
    steps = [_step("NormalisationByMedian", percentile=0.5), _step("TransformationLog", log_base="log2")]
    path = scratch_path(spark, "workflow")
    run_workflow(spark, steps, {"protein_df": v.by_brand(spark, folder)}, folder=path, keep=["protein_df"])
    found = spark.read.parquet(f"{path}/protein_df")
    return found.select(col(SAMPLE).alias("sample"), col(FEATURE).alias("feature"), F.round("Normalised Intensity", 6).alias("value"))


_LOG = _step("TransformationLog", log_base="log2")
_CASES = [
    ("unknown step", [_LOG, _step("Nothing")]),
    ("missing setting", [_LOG, _step("DifferentialExpressionTTest", group1="EUROPE")]),
    ("unknown setting", [_LOG, _step("NormalisationByMedian", percentile=0.5, colour="red")]),
    ("unsupported setting", [_LOG, _step("ClusteringHierarchicalAgglomerative", n_clusters=2, linkage="ward")]),
    ("sound", [_LOG]),
]


@query("pip2_checks", f"""with {v.BY_BRAND}, t as (select count(*) n, round(sum(log2(x)), 3) total from i),
 k as (select unnest(['unknown step', 'missing setting', 'unknown setting', 'unsupported setting', 'sound']) c)
 select c as "case", case when c = 'sound' then n end as rows, case when c = 'sound' then total end as total from k, t""")
def pip2(spark, folder):
    """What lists of steps leave behind: the rows of a sound one are written, a refused one writes nothing."""
    table, found = v.by_brand(spark, folder), None
    for name, steps in _CASES:
        path = scratch_path(spark, "checked")
        left = spark.range(1)
        try:
            run_workflow(spark, steps, {"protein_df": table}, folder=path, keep=["protein_df"])
            left = spark.read.parquet(f"{path}/protein_df").agg(F.count("*").alias("rows"), F.round(F.sum("Intensity"), 3).alias("total"))
        except ValueError:
            left = left.select(F.lit(None).cast("long").alias("rows"), F.lit(None).cast("double").alias("total"))
        left = left.select(F.lit(name).alias("case"), "rows", "total")
        found = left if found is None else found.unionByName(left)
    return found


@query("rsh3_schema_checks", f"""with {v.BY_BRAND}, t as (select s, round(sum(x), 2) total from i group by s),
 k as (select unnest(['long', 'long with genes', 'logged', 'samples']) as "table", unnest([false, true, false, false]) as is_long, unnest([true, true, true, false]) as is_intensity),
 g as (select s, round(sum(log2(x)), 4) total from i group by s)
 select "table", is_long, is_intensity, s as sample, case "table" when 'samples' then null when 'logged' then g.total else t.total end as total from k cross join t join g using (s)""")
def rsh3(spark, folder):
    """Whether tables have the columns of intensity tables, and each sample's sum of the measure that is found in them."""
    plain = v.by_brand(spark, folder)
    genes = plain.select(col(SAMPLE), col(FEATURE), F.lit("g").alias(schema.GENE), "Intensity")
    tables = {
        "long": plain, "long with genes": genes, "samples": plain.select(col(SAMPLE)),
        "logged": plain.select(col(SAMPLE), col(FEATURE), F.length(col(FEATURE)).alias("letters"), F.log2("Intensity").alias("Log Intensity")),
    }
    found = None
    for name, df in tables.items():
        try:
            total = F.round(F.sum(col(schema.measure_column(df))), 4 if name == "logged" else 2)
        except ValueError:
            total = F.lit(None).cast("double")
        one = df.groupBy(col(SAMPLE).alias("sample")).agg(total.alias("total")).select(
            F.lit(name).alias("table"), F.lit(schema.is_long_format(df)).alias("is_long"), F.lit(schema.is_intensity_table(df)).alias("is_intensity"),
            "sample", "total",
        )
        found = one if found is None else found.unionByName(one)
    return found
