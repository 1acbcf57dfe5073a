"""Live scoring of a stream: deviation from what a program did before, risk, alerts, and their store.

Each micro-batch is scored against a stored version of the programs' profiles and what came earlier in the batch itself,
so that events get the scores that a batch job over all events would give. Everything is stored under the batch's number:
scored events, alerts and the next version of the profiles are replaced when a batch runs again, and it reads only
what earlier batches left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import baseline, risk, windows

MODEL_COLUMNS = {"ml_available": False, "if_pred": 1, "if_score": 0.0, "xgb_prob": 0.0, "xgb_attack": False}


class LiveScoring:
    """Stores ``scored``, ``alerts`` and ``profiles`` in a folder. Events have ``by``, ``order``, cpu, mem, syscalls, flags, pid.

    ``models`` adds the columns of MODEL_COLUMNS to a batch's rows; without it no model is available.
    """

    def __init__(self, folder: str, by: str = "comm", order: tuple[str, ...] = ("ts", "event_id"), models: Callable[[DataFrame], DataFrame] | None = None):
        self.folder, self.by, self.order, self.models = folder, by, list(order), models

    def profiles(self, spark: SparkSession, version: int) -> DataFrame | None:
        """Moments of each program and metric after that many batches."""
        return spark.read.parquet(f"{self.folder}/profiles/version={version}") if version else None

    def alerts(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        rows = spark.read.parquet(f"{self.folder}/alerts")
        return rows if before is None else rows.where(F.col("batch") < before)

    def scored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/scored")

    def on_batch(self, events: DataFrame, k: int) -> None:
        spark, ts = events.sparkSession, self.order[0]
        known = self.profiles(spark, k)
        rows = windows.live_deviation(events, [self.by], self.order, cut=F.to_date(ts), known=known)
        rows = self.models(rows) if self.models else rows.withColumns({c: F.lit(v) for c, v in MODEL_COLUMNS.items()})
        scored = f"{self.folder}/scored/batch={k}"
        risk.with_floor(risk.score_events(rows)).write.mode("overwrite").parquet(scored)
        made = risk.alerts(spark.read.parquet(scored).withColumn("epoch", F.unix_seconds(ts)), comm_col=self.by)
        first = risk.suppress(made, self.order)
        if k:  # an alert of an earlier batch may hold the key, which has the minute in it
            since = made.agg(F.min(ts) - F.expr(f"INTERVAL {risk.DEDUP_SECONDS} SECONDS")).head()[0]
            first = first.join(self.alerts(spark, k).where(F.col(ts) >= since).select("dedup_key"), "dedup_key", "left_anti")
        first.write.mode("overwrite").parquet(f"{self.folder}/alerts/batch={k}")
        new = windows.live_moments(events, self.by)
        if known is not None:
            new = baseline.combined(known, new, [self.by, "metric"])
        new.write.mode("overwrite").parquet(f"{self.folder}/profiles/version={k + 1}")
