"""Sinks. Tables are immutable files: an upsert or status change is a new version of the table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder where the cluster keeps shared files. Without spark.checkpoint.dir only a local session has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-scratch-')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to a new scratch folder and read it back: what follows reads it instead of working it out again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Put df in the place of the table's partitions that it has rows of; all other files stay as they are.

    The rows may come from the table itself: Spark writes them beside it, and moves them into place when all are there.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str, ts_col: str | None = None, files_at_most: int | None = None, every: str = "day") -> None:
    """Append to a table partitioned by the day (or month, year) of a time."""
    if ts_col:
        df = df.withColumn("date", F.to_date(F.date_trunc(every, F.col(ts_col).cast("timestamp"))))
    writer = df.write.mode("append")
    if files_at_most:
        writer = writer.option("maxRecordsPerFile", files_at_most)
    (writer.partitionBy("date") if ts_col else writer).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str], fill: list[str] = (), merge_maps: list[str] = ()) -> DataFrame:
    """Rows of both. For keys in both: ``overwrite`` columns from the new row even if null, ``fill`` columns only where
    the new row has a value, ``merge_maps`` joined with new entries winning."""
    a = old.select(*key, *[F.col(c).alias(f"__o_{c}") for c in old.columns if c not in key], F.lit(1).alias("__old"))
    b = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in key], F.lit(1).alias("__new"))
    both, is_new = a.join(b, key, "full"), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if c in overwrite:
            return F.when(is_new, n).otherwise(o)
        if c in merge_maps:
            kept = F.map_filter(F.coalesce(o, F.create_map().cast(old.schema[c].dataType)), lambda k, v: ~F.map_contains_key(F.coalesce(n, F.create_map().cast(old.schema[c].dataType)), k))
            return F.when(n.isNull(), o).otherwise(F.map_concat(kept, n))
        return F.coalesce(n, o)

    return both.select(*[c if c in key else value(c).alias(c) for c in old.columns])


BUCKET = "bucket"


def with_bucket(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def merge_into(path: str, new: DataFrame, key: list[str], buckets: int, overwrite: list[str] = (), fill: list[str] = (), merge_maps: list[str] = ()) -> list[int]:
    """``upsert`` into a table at a path that is partitioned by a hash of its key; only the buckets of the new rows are read
    and written again. A table that isn't there is begun. Returns those buckets: numbers below ``buckets``.

    The new rows must have one row for a key. Running it again with the same rows changes nothing.
    """
    spark, rows = new.sparkSession, with_bucket(new, key, buckets)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows.write.partitionBy(BUCKET).parquet(path)
        return list(range(buckets))
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    if touched:
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        replace_partitions(upsert(old, rows.select(old.columns), [*key, BUCKET], overwrite, fill, merge_maps), path, BUCKET)
    return touched


def record_exit(processes: DataFrame, exits: DataFrame) -> DataFrame:
    """Set end and exit code of the instances in ``exits``."""
    e = exits.select("instance_id", F.col("end_s").alias("__end"), F.col("exit_code").alias("__code"))
    return processes.join(e, "instance_id", "left").withColumns({"end_s": F.coalesce("__end", "end_s"), "exit_code": F.coalesce("__code", "exit_code")}).drop("__end", "__code")


def change_status(alerts: DataFrame, status: str, ids: list | None = None) -> DataFrame:
    """New status for the given ids, or for all active alerts; ``changed`` tells which."""
    hit = F.col("status") == "ACTIVE" if ids is None else F.col("id").isin(ids)
    return alerts.withColumns({"changed": hit, "status": F.when(hit, F.lit(status)).otherwise(F.col("status"))})


def write_features(df: DataFrame, path: str, features: list[str], meta: list[str]) -> DataFrame:
    """Write a feature matrix in its order of columns, with a table that names them; read both back and compare.

    Returns (position, name, kind). ValueError if rows or columns don't come back as they were written.
    """
    spark = df.sparkSession
    df.select(*features, *meta).write.mode("overwrite").parquet(f"{path}/matrix")
    names = [(i, c, "feature") for i, c in enumerate(features)] + [(len(features) + i, c, "meta") for i, c in enumerate(meta)]
    spark.createDataFrame(names, "position int, name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    back, schema = spark.read.parquet(f"{path}/matrix"), spark.read.parquet(f"{path}/schema")
    if back.columns != [r["name"] for r in schema.orderBy("position").collect()] or back.count() != df.count():
        raise ValueError("the feature matrix was not written as a whole")
    return schema


def file_for_each(df: DataFrame, path: str, at_once: int = 250) -> None:
    """A text file for each row of one string column; a task writes some ``at_once`` of them.

    Tasks move their files into place themselves: else the driver moves all of them, one after another.
    """
    tasks = max(1, -(-df.count() // at_once))
    writer = df.repartition(tasks).write.option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def rotating_csv(df: DataFrame, path: str, rows: int) -> None:
    df.write.option("maxRecordsPerFile", rows).option("header", True).mode("append").csv(path)


def history_csv(df: DataFrame, path: str) -> None:
    """Quotes in values are doubled, as spreadsheets expect."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).mode("overwrite").csv(path)
