"""Risk scores of live events from statistics, models and rules; alerts and their suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.functions.classify import RULES, activity, activity_floor, dedup_key, risk_band, risk_status

STAT_CAP, FOREST_CAP, CLASSIFIER_CAP = 35.0, 35.0, 45.0
DEDUP_SECONDS = 60
NO_SIGNAL = "No anomaly signals: the event conforms to its baseline."
SIGNAL = "struct<source:string,name:string,observed_value:string,score_contribution:double,description:string>"


def _signal(source: str, name: str, observed: Column, points: Column, text: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), F.lit(name).alias("name"), observed.cast("string").alias("observed_value"), points.cast("double").alias("score_contribution"), text.alias("description"))


def statistical_points(cpu_z: Column, mem_z: Column, sys_z: Column) -> dict[str, Column]:
    """Points of each statistical signal (0: none)."""
    cap = F.lit(STAT_CAP)
    return {
        "cpu_z_score": F.when(cpu_z > 3, F.least(cap, cpu_z * 8)).when(cpu_z > 2, 15.0).otherwise(0.0),
        "mem_z_score": F.when(mem_z > 3.5, F.least(cap, mem_z * 6)).otherwise(0.0),
        "syscall_z_score": F.when(sys_z > 3, F.least(cap, sys_z * 7)).otherwise(0.0),
    }


def forest_points(available: Column, prediction: Column, score: Column) -> Column:
    return F.when(available & ((prediction == -1) | (score < 0)), F.least(F.lit(FOREST_CAP), F.abs(score) * 120 + 20)).otherwise(0.0)


def classifier_points(available: Column, attack: Column, probability: Column) -> Column:
    return F.when(available & attack, F.least(F.lit(CLASSIFIER_CAP), probability * CLASSIFIER_CAP)).otherwise(0.0)


def _weight(flag: Column) -> Column:
    pairs = [(flag == name, F.lit(w)) for name, (w, _) in RULES.items()]
    return reduce(lambda c, p: c.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(F.lit(0.0))


def rule_points(flags: Column) -> Column:
    """Sum of weights of the distinct known flags."""
    return F.aggregate(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>"))), F.lit(0.0), lambda a, f: a + _weight(f))


def score_events(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Score rows with cpu_z, mem_z, syscalls_z, flags, and model columns ml_available, if_pred, if_score, xgb_prob, xgb_attack.

    Numbers that are null, NaN or infinite count as 0 and make the status ``insufficient_data``.
    """
    bad, value = [], {}
    for c in ("cpu_z", "mem_z", "syscalls_z", "if_score", "xgb_prob"):
        x = F.col(c).cast("double")
        wrong = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        if c in ("if_score", "xgb_prob"):
            wrong = F.coalesce(F.col("ml_available"), F.lit(False)) & wrong
        bad.append(F.when(wrong, f"bad {c}"))
        value[c] = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    ml = F.coalesce(F.col("ml_available"), F.lit(False))
    stat = statistical_points(value["cpu_z"], value["mem_z"], value["syscalls_z"])
    forest = forest_points(ml, F.coalesce("if_pred", F.lit(1)), value["if_score"])
    classifier = classifier_points(ml, F.coalesce("xgb_attack", F.lit(False)), value["xgb_prob"])
    flags = F.array_distinct(F.coalesce("flags", F.array().cast("array<string>")))
    observed = {"cpu_z_score": value["cpu_z"], "mem_z_score": value["mem_z"], "syscall_z_score": value["syscalls_z"]}
    texts = {"cpu_z_score": "CPU above baseline", "mem_z_score": "Memory above historical envelope", "syscall_z_score": "System calls above rolling mean"}
    signals = F.concat(
        F.array_compact(F.array(
            *[F.when(p > 0, _signal("statistical", name, F.round(observed[name], 2), p, F.lit(texts[name]))) for name, p in stat.items()],
            F.when(forest > 0, _signal("isolation_forest", "if_anomaly_score", F.round(value["if_score"], 4), forest, F.lit("Isolation forest: unusual sequence"))),
            F.when(classifier > 0, _signal("xgboost", "xgb_attack_probability", F.round(value["xgb_prob"], 4), classifier, F.lit("XGBoost: elevated attack class"))),
        )),
        F.transform(F.filter(flags, lambda f: _weight(f) > 0), lambda f: F.struct(F.lit("heuristic").alias("source"), f.alias("name"), f.alias("observed_value"), _weight(f).alias("score_contribution"), F.concat(F.lit("Analytic rule: "), F.replace(f, F.lit("_"), F.lit(" "))).alias("description"))),
    )
    total = F.least(F.lit(STAT_CAP), sum(stat.values(), F.lit(0.0))) + forest + classifier + rule_points(F.col("flags"))
    rules, models = rule_points(F.col("flags")) > 0, (forest > 0) | (classifier > 0)
    df = df.withColumns({"signals": signals, "input_errors": F.array_compact(F.array(*bad))})
    source = F.when(rules & models, "both").when(rules, "analytic").when(models, "ml").otherwise("none")
    status = F.when(F.size("input_errors") > 0, "insufficient_data").when((F.size("signals") == 0) & ~ml, "insufficient_data").otherwise("evaluated")
    score = F.bround(F.least(F.lit(99.0), F.greatest(F.lit(0.0), total)), 0).cast("int")
    if not enabled:
        score, source, status = F.lit(0), F.lit("none"), F.lit("disabled")
    df = df.withColumns({"risk_score": score, "detection_source": source, "eval_status": status, "reasons": F.transform("signals", lambda s: s["description"])})
    df = df.withColumns({"risk_category": risk_band("risk_score"), "status": risk_status("risk_score"), "category": activity("reasons")})
    return df.withColumn("explanation", F.when(F.size("signals") == 0, NO_SIGNAL).otherwise(F.array_join("reasons", " • ")))


def with_floor(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Give quiet events the points of their activity; bands were set before."""
    return df.withColumn("risk_score", activity_floor(F.col("risk_score"), F.col("cpu"), F.col("max_z"), F.col("syscalls"), enabled))


def is_alert(enabled: bool = True) -> Column:
    flagged = F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0
    return F.lit(enabled) & (F.col("eval_status") == "evaluated") & ((F.col("status") == "ANOMALOUS") | (F.col("risk_score") >= 50) | flagged | F.coalesce("xgb_attack", F.lit(False)))


def alerts(df: DataFrame, comm_col: str = "comm", pid_col: str = "pid", epoch_col: str = "epoch", id_col: str = "event_id", enabled: bool = True) -> DataFrame:
    """Alert records; ids come from content, so a rerun makes the same ones."""
    bucket = F.floor(F.col(epoch_col) / DEDUP_SECONDS)
    key = dedup_key(F.col(comm_col).cast("string"), F.col(pid_col), F.col("detection_source"), F.transform("signals", lambda s: s["name"]), bucket)
    rows = df.where(is_alert(enabled)).withColumn("dedup_key", key)
    alert_id = F.concat(F.lit("AL-"), F.substring(F.sha2(F.concat_ws(":", "dedup_key", F.col(id_col).cast("string")), 256), 1, 16))
    return rows.withColumns({"alert_id": alert_id, "dedup_window_seconds": F.lit(DEDUP_SECONDS), "alert_status": F.lit("ACTIVE")})


def suppress(alert_rows: DataFrame, order: list[str]) -> DataFrame:
    """The first alert of each key and bucket."""
    w = W.partitionBy("dedup_key").orderBy(*order)
    return alert_rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def quick_rating(df: DataFrame) -> DataFrame:
    """Rating of cpu and mem against a given profile (columns cpu_mean, cpu_std, mem_mean, mem_std; null: no profile)."""
    z = lambda m, floor: F.abs(F.col(m) - F.col(f"{m}_mean")) / F.when(F.coalesce(F.col(f"{m}_std"), F.lit(0.0)) == 0, floor).otherwise(F.col(f"{m}_std"))
    top = F.greatest(z("cpu", 0.1), z("mem", 1.0))
    known, risk = F.col("cpu_mean").isNotNull(), F.coalesce(F.col("risk"), F.lit(0))
    up = lambda x: F.floor(x + 0.5).cast("int")
    anomalous, suspicious = known & ((top > 4.5) | (risk > 70)), known & ((top > 2.5) | (risk > 40))
    rating = F.when(~known, 78).when(anomalous, F.least(F.lit(99), up(50 + top * 8))).when(suspicious, up(35 + top * 6)).otherwise(F.greatest(F.lit(4), up(top * 7)))
    status = F.when(~known, "SUSPICIOUS").when(anomalous, "ANOMALOUS").when(suspicious, "SUSPICIOUS").otherwise("SAFE")
    return df.withColumns({"rating": rating, "rating_status": status})
