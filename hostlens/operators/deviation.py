"""Deviation of windows from baselines, and the risk that follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 3.0
TINY = 0.001
# Weight of each category in the composite risk.
CATEGORY_WEIGHTS = {"security": 1.2, "syscall": 0.8, "resource": 0.6, "network": 0.7, "file": 0.6}


KNOWN = ("median", "mean", "std", "high", "effective_scale")


def robust_deviation(long: DataFrame, baselines: DataFrame, features: DataFrame, key: str = "profile_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per window and feature: robust score and classic score (2 digits), whether it deviates, and the risk of an upward
    deviation, which is that of the rounded score; whether it deviates is decided before rounding."""
    rows = long.join(baselines.select(key, "feature", *KNOWN, "maturity", "confidence"), [key, "feature"])
    rows = rows.join(F.broadcast(features), "feature")
    rows = rows.withColumns(_scores(F.col("value"), F.col, threshold))
    return rows.withColumn("feature_risk", _risk(F.col, threshold))


def _scores(value: Column, get: Callable[[str], Column], threshold: float) -> dict[str, Column]:
    scale = F.when(get("effective_scale") <= TINY, get("noise_floor")).otherwise(get("effective_scale"))
    score = (value - get("median")) / scale
    return {
        "is_deviant": score >= threshold - 1e-9,  # a score of just the threshold counts, however it came out
        "robust_score": two_digits(score), "z_classic": two_digits((value - get("mean")) / F.when(get("std") > TINY, get("std")).otherwise(scale)),
    }


def _risk(get: Callable[[str], Column], threshold: float) -> Column:
    risk = F.least(F.lit(40.0), (get("robust_score") - threshold + 1) * 10 * get("weight"))
    return F.when(get("is_deviant") & (get("value") > get("median")), risk).otherwise(0.0)


def window_deviations(windows: DataFrame, keys: list[str], names: list[str], baselines: DataFrame, features: DataFrame, key: str = "profile_id", threshold: float = THRESHOLD) -> DataFrame:
    """(keys, maturity, confidence, devs): ``robust_deviation`` of wide windows. Each window meets its program's baselines as
    a whole and is never taken apart: ``devs`` holds one struct for each of ``names``, null where the program has no
    baseline of it. Windows of programs without any of these baselines are left out."""
    rows = baselines.select(key, "feature", *KNOWN, "maturity", "confidence").join(F.broadcast(features), "feature")
    known = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("feature", *[c for c in features.columns if c != "feature"], *KNOWN)))).alias("at"), F.first("maturity").alias("maturity"), F.first("confidence").alias("confidence"))
    known = known.select(key, F.array(*[F.try_element_at("at", F.lit(f)) for f in names]).alias("known"), "maturity", "confidence").where(F.exists("known", lambda x: x.isNotNull()))
    # Neither side is sent to all: saved windows are far smaller as files, by which Spark judges them, than in memory.
    both = windows.select(*keys, *[F.col(f).cast("double").alias(f"__v_{f}") for f in names]).join(known.hint("merge"), key)

    # One expression a feature, not a lambda over them all: these are interpreted.
    def scored(i: int, value: Column) -> Column:
        x = F.get("known", F.lit(i))
        return F.when(x.isNotNull(), F.struct(x["feature"].alias("feature"), value.alias("value"), *[x[c].alias(c) for c in ("category", "weight", "median", "mean", "high")], *[c.alias(n) for n, c in _scores(value, lambda c: x[c], threshold).items()]))

    def with_risk(x: Column, made: list[str]) -> Column:
        return F.when(x.isNotNull(), F.struct(*[x[c].alias(c) for c in made], _risk(lambda c: x[c], threshold).alias("feature_risk")))

    rows = both.select(*keys, "maturity", "confidence", *[scored(i, F.col(f"__v_{f}")).alias(f"__d_{f}") for i, f in enumerate(names)])
    made = rows.schema[f"__d_{names[0]}"].dataType.names
    return rows.select(*keys, "maturity", "confidence", F.array(*[with_risk(F.col(f"__d_{f}"), made) for f in names]).alias("devs"))


def taken_apart(rows: DataFrame) -> DataFrame:
    """The rows of ``robust_deviation`` from those of ``window_deviations``."""
    rest = [c for c in rows.columns if c != "devs"]
    return rows.select(*rest, F.inline(F.array_compact("devs")))


def two_digits(x: Column) -> Column:
    """Rounded to two digits; the small addend takes halves up, however they came out."""
    return F.round(x + F.when(x < 0, -1e-9).otherwise(1e-9), 2)


def category_risk(deviations: DataFrame, keys: list[str]) -> DataFrame:
    """Highest risk of each category of a window, and how many features deviate."""
    best = [F.max(F.when(F.col("category") == c, F.col("feature_risk")).otherwise(0.0)).alias(f"risk_{c}") for c in CATEGORY_WEIGHTS]
    return deviations.groupBy(*keys).agg(*best, F.count_if("is_deviant").alias("n_deviant"), F.count_if(F.col("feature_risk") > 0).alias("n_reasons"), F.first("maturity").alias("maturity"), F.first("confidence").alias("confidence"))


def window_category_risk(rows: DataFrame) -> DataFrame:
    """``category_risk`` of the rows of ``window_deviations``, each on its own."""
    rows = rows.withColumn("devs", F.array_compact("devs"))

    def most(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.array_max(F.transform("devs", lambda x: F.when(x["category"] == c, x["feature_risk"]).otherwise(0.0))))

    best = {f"risk_{c}": most(c) for c in CATEGORY_WEIGHTS}
    n = lambda f: F.size(F.filter("devs", f)).cast("long")
    return rows.withColumns({**best, "n_deviant": n(lambda x: x["is_deviant"]), "n_reasons": n(lambda x: x["feature_risk"] > 0)}).drop("devs")


def unprecedented(current: dict[str, Column], highest: dict[str, Column], typical: Column) -> Column:
    """Array of (event, risk) of activities that the baseline has never seen."""
    never = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    has = lambda c: F.coalesce(c, F.lit(0)) > 0
    hit = lambda cond, name, risk: F.when(cond, F.struct(F.lit(name).alias("event"), F.lit(risk).alias("risk")))
    return F.array_compact(F.array(
        hit(has(current["connect"]) & (~F.array_contains(typical, "socket_connect") | never(highest["connect"])), "socket_connect", 45.0),
        hit(has(current["sensitive"]) & never(highest["sensitive"]), "sensitive_syscall", 50.0),
        hit(has(current["exec"]) & ~F.array_contains(typical, "execve") & never(highest["exec"]), "execve", 40.0),
        hit((F.coalesce(current["delete"], F.lit(0)) > 5) & never(highest["delete"]), "file_delete", 40.0),
    ))


def composite_risk(df: DataFrame, n_unprecedented: Column) -> DataFrame:
    """Composite and calibrated risk and the verdict, by maturity."""
    raw = F.least(F.lit(100.0), sum((F.col(f"risk_{c}") * w for c, w in CATEGORY_WEIGHTS.items()), F.lit(0.0)))
    df = df.withColumn("raw_risk", raw)
    scaled = F.col("raw_risk") * F.col("confidence")
    level = F.col("maturity")
    df = df.withColumn("risk_score", F.when(level == "COLD_START", F.least(F.lit(30.0), scaled)).when(level == "LEARNING", F.least(F.lit(95.0), scaled)).otherwise(F.least(F.lit(99.0), F.col("raw_risk"))))
    new, risk = n_unprecedented > 0, F.col("risk_score")
    verdict = F.when(level == "COLD_START", new & (risk >= 25)).when(level == "LEARNING", (risk >= 50) | new).otherwise((F.col("n_reasons") > 0) | (risk >= 60) | new)
    return df.withColumn("is_anomaly", verdict)


def deviation_vector(deviations: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Wide ``dev_*`` columns for models, in the given order of features."""
    wide = deviations.groupBy(*keys).pivot("feature", features).agg(F.first("robust_score"))
    return wide.select(*keys, *[F.col(f).alias(f"dev_{f}") for f in features])


def window_deviation_vector(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``deviation_vector`` of the rows of ``window_deviations`` for these features, each row on its own."""
    return rows.select(*keys, *[F.get("devs", F.lit(i))["robust_score"].alias(f"dev_{f}") for i, f in enumerate(features)])
