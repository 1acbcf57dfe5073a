"""Ingest of a whole experiment: its files into tables, and baselines of the programs that they hold."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.baseline import MINIMUM, build_profiles, registry
from hostlens.sources.layouts import EXPERIMENT
from hostlens.sources.scans import table_csv
from hostlens.sources.sinks import append


def ingest_experiment(spark: SparkSession, run_dir: str, out_dir: str, profiles: bool = False, minimum: int = MINIMUM) -> DataFrame:
    """Append ``run_dir``'s CSV files to tables in ``out_dir``, instances first; (name, rows) of each, 0 for a missing file.

    With ``profiles``, the baselines of all programs that have at least ``minimum`` clean windows are built anew, of all these.
    """
    counts = []
    for name, layout in EXPERIMENT.items():
        try:
            rows = table_csv(spark, f"{run_dir}/{name}.csv", layout)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            counts.append(spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("rows")))
            continue
        seen = Observation()  # counted as they are written: the file is read once
        append(rows.observe(seen, F.count(F.lit(1)).alias("rows")), f"{out_dir}/{name}")
        counts.append(spark.range(1).select(F.lit(name).alias("name"), F.lit(seen.get["rows"]).cast("long").alias("rows")))
    if profiles:
        windows = spark.read.parquet(f"{out_dir}/behaviour_windows").where("profile_id <> ''")
        build_profiles(windows, registry(spark), order_col="start_time", minimum=minimum, max_windows=None).write.mode("overwrite").parquet(f"{out_dir}/process_profiles")
        built = spark.read.parquet(f"{out_dir}/process_profiles")
        counts.append(built.agg(F.count_distinct("profile_id").alias("rows")).select(F.lit("profiles_updated").alias("name"), "rows"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
