"""Retention: what each table keeps, by anti-joins that null keys can't empty, and expiry from tables by date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.sources import sinks

DAY = 86_400


@dataclass(frozen=True)
class Policy:
    """Days to keep (at least 1); None for detections: for ever."""

    events: int = 7
    windows: int = 30
    metrics: int = 30
    detections: int | None = 90
    processes: int = 30
    preserve_flagged: bool = True

    @staticmethod
    def days(text: str | int | None, default: int) -> int | None:
        """A setting as text: none, 0 or unlimited means for ever."""
        if text is None or str(text).strip() == "":
            return default
        if str(text).strip().lower() in ("none", "0", "unlimited"):
            return None
        try:
            return max(1, int(text))
        except ValueError:
            return default


def _flagged(detections: DataFrame, policy: Policy, now: int) -> DataFrame:
    rows = detections.where("is_anomaly and instance_id is not null")
    if policy.detections is not None:
        rows = rows.where(F.col("end_s") >= now - policy.detections * DAY)
    return rows.select("instance_id").distinct()


def expired_events(events: DataFrame, detections: DataFrame, policy: Policy, now: int) -> DataFrame:
    """Old events, but for those of instances with a flagged detection that is itself kept."""
    old = events.where(F.col("end_s") < now - policy.events * DAY)
    return old.join(_flagged(detections, policy, now), "instance_id", "left_anti") if policy.preserve_flagged else old


def expired_windows(windows: DataFrame, detections: DataFrame, policy: Policy, now: int, window_key: list[str]) -> DataFrame:
    """Old windows, but for those that any detection names or whose instance is flagged."""
    old = windows.where(F.col("end_s") < now - policy.windows * DAY)
    if not policy.preserve_flagged:
        return old
    return old.join(detections.select(*window_key).distinct(), window_key, "left_anti").join(_flagged(detections, policy, now), "instance_id", "left_anti")


def expired_metrics(metrics: DataFrame, policy: Policy, now: int) -> DataFrame:
    return metrics.where(F.col("end_s") < now - policy.metrics * DAY)


def expired_detections(detections: DataFrame, policy: Policy, now: int) -> DataFrame:
    return detections.limit(0) if policy.detections is None else detections.where(F.col("end_s") < now - policy.detections * DAY)


def expired_processes(processes: DataFrame, left: list[DataFrame], policy: Policy, now: int, parent_col: str | None = None) -> DataFrame:
    """Ended instances without children and without rows in the tables as they are after their own expiry."""
    dead = processes.where(F.col("end_s").isNotNull() & (F.col("end_s") < now - policy.processes * DAY))
    if parent_col:
        left = [*left, processes.select(F.col(parent_col).alias("instance_id"))]
    for table in left:
        dead = dead.join(table.select("instance_id").distinct(), "instance_id", "left_anti")
    return dead


def kept(df: DataFrame, expired: DataFrame, key: list[str]) -> DataFrame:
    return df.join(expired.select(*key).distinct(), key, "left_anti")


def expire_table(spark: SparkSession, path: str, cutoff: int, expired: Callable[[DataFrame], DataFrame], part: str = "date", dry_run: bool = False) -> DataFrame:
    """Expire rows of a table that is partitioned by a date, the day (or the month, year) of the rows' times.

    Only partitions up to the cutoff's date are read. ``expired`` takes their rows and gives those to go, with all columns.
    Partitions of which nothing stays are dropped, those of which some rows go are written again, and all others are
    left alone. Returns (part, n_rows, n_expired) of the partitions that were read, as they were before.
    """
    last = spark.range(1).select(F.to_date(F.timestamp_seconds(F.lit(cutoff)))).head()[0]
    old = spark.read.parquet(path).where(F.col(part) <= F.lit(last))
    gone = expired(old)
    names = [c for c in old.columns if c != part]
    counts = old.groupBy(part).agg(F.count("*").alias("n_rows")).join(gone.groupBy(part).agg(F.count("*").alias("n_expired")), part, "left").na.fill(0, ["n_expired"])
    counts = sinks.stored(counts)
    if dry_run:
        return counts
    dates = counts.where("n_expired > 0").collect()  # one row for each date that loses rows
    some = [r[part] for r in dates if r["n_expired"] < r["n_rows"]]
    if some:
        # Rows that are alike are told apart by their number.
        counted = lambda df, name: df.where(F.col(part).isin(some)).groupBy(*names, part).agg(F.count("*").alias(name))
        left, out = counted(old, "__times"), counted(gone, "__times_gone").withColumnsRenamed({c: f"__of_{c}" for c in [*names, part]})
        rows = left.join(out, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*names, part]], "left").withColumn("__times", F.col("__times") - F.coalesce("__times_gone", F.lit(0)))
        rows = rows.where("__times > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        sinks.replace_partitions(rows.select(*names, part), path, part)
    for r in dates:
        if r["n_expired"] == r["n_rows"]:
            sinks.removed(spark, f"{path}/{part}={r[part]}")
    return counts
