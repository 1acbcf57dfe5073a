"""Queries of windows, baselines, deviation and risk over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.classify import dedup_key, family_by_parts, lifecycle
from hostlens.operators import baseline as B
from hostlens.operators import deviation as D
from hostlens.operators import risk as R
from hostlens.operators import windows as Wn
from hostlens.plans._bind import FEATURES, LONG_SQL, PROC_SQL, WINDOWS_SQL, Query, daily_windows, processes, secs, t
from hostlens.sources.sinks import stored

Q: dict[str, Query] = {}


def rounded(df, *names, digits=6):
    # Means of short decimals often end in a 5 just past the last digit; the small addend makes all engines round it up.
    return df.withColumns({c: F.round(F.col(c).cast("double") + 1e-9, digits) for c in names})


REG_SQL = "reg(feature, category, noise_floor, weight) AS (VALUES " + ", ".join(f"('{f}', '{c}', {n:.1f}::DOUBLE, {w:.1f}::DOUBLE)" for f, (c, n, w) in B.REGISTRY.items()) + ")"
PCT = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


# W3: the flagship ----------------------------------------------------------------------------------------------------
W3_COLUMNS = ("mean_before", "std_before", "deviation", "ratio", "z")
W3_SQL = WINDOWS_SQL + """, b AS (SELECT profile_id, day, syscall_count, count(*) OVER w AS n_before, coalesce(avg(syscall_count) OVER w, 0) AS mean_before, coalesce(stddev_samp(syscall_count) OVER w, 0) AS std_before
FROM win WINDOW w AS (PARTITION BY profile_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, syscall_count - mean_before AS deviation, CASE WHEN mean_before = 0 THEN 0 ELSE syscall_count / mean_before END AS ratio, CASE WHEN n_before < 2 OR std_before = 0 THEN 0 ELSE (syscall_count - mean_before) / std_before END AS z FROM b)"""


def w3(spark, d):
    rows = Wn.compare_then_update(daily_windows(spark, d), ["profile_id"], ["day"], "syscall_count", exact=False)
    status = F.when(F.abs("z") >= 3, "ANOMALOUS").when(F.abs("z") >= 2, "SUSPICIOUS").otherwise("SAFE")
    return rounded(rows.select("profile_id", day_text(), "syscall_count", "n_before", *W3_COLUMNS, status.alias("status")), *W3_COLUMNS)


Q["W3_compare_then_update"] = Query(w3, f"""WITH {W3_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, syscall_count, n_before, {', '.join(f'round({c}::DOUBLE + 1e-9, 6) AS {c}' for c in W3_COLUMNS)},
CASE WHEN abs(z) >= 3 THEN 'ANOMALOUS' WHEN abs(z) >= 2 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS status FROM z""")


# W4 and the live scoring chain ----------------------------------------------------------------------------------------
def live(e):
    return e.select("event_id", "ts", F.col("user_id").alias("pid"), F.col("event_type").alias("comm"), F.col("value").alias("cpu"), (F.col("value") * 2).alias("mem"), F.floor(F.col("value") * 10).cast("double").alias("syscalls"),
                    F.when((F.col("event_type") == "error") & (F.col("value") > 150), F.array(F.lit("mass_file_traversal"))).when((F.col("event_type") == "purchase") & (F.col("value") > 300), F.array(F.lit("crypto_mining"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def live_z(spark, d):
    return Wn.live_deviation(live(t(spark, d, "events")), ["comm"], ["ts", "event_id"], cut=F.to_date("ts"))


LIVE_SQL = """live AS (SELECT event_id, ts, user_id AS pid, event_type AS comm, value AS cpu, value * 2 AS mem, floor(value * 10) AS syscalls,
CASE WHEN event_type = 'error' AND value > 150 THEN ['mass_file_traversal'] WHEN event_type = 'purchase' AND value > 300 THEN ['crypto_mining'] ELSE [] END AS flags FROM events),
st AS (SELECT *, count(*) OVER w AS n, """ + ", ".join(f"avg({m}) OVER w AS {m}_mean, coalesce(stddev_samp({m}) OVER w, 0) AS {m}_std" for m in Wn.LIVE) + """ FROM live WINDOW w AS (PARTITION BY comm ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dev AS (SELECT *, """ + ", ".join(f"CASE WHEN n >= 3 THEN CASE WHEN abs({m} - {m}_mean) < {band} THEN least(abs({m} - {m}_mean) / greatest({m}_std, {floor}), 1.5) ELSE abs({m} - {m}_mean) / greatest({m}_std, {floor}) END ELSE 0 END AS {m}_z, CASE WHEN n >= 3 THEN {m} - {m}_mean ELSE 0 END AS {m}_deviation" for m, (floor, band) in Wn.LIVE.items()) + """ FROM st),
scored AS (SELECT *, greatest(cpu_z, mem_z, syscalls_z) AS max_z FROM dev)"""
LIVE_COLUMNS = [f"{m}_{k}" for m in Wn.LIVE for k in ("z", "deviation")] + ["max_z"]
Q["W4_live_deviation"] = Query(lambda s, d: rounded(live_z(s, d).select("event_id", *LIVE_COLUMNS), *LIVE_COLUMNS), f"WITH {LIVE_SQL} SELECT event_id, {', '.join(f'round({c}::DOUBLE + 1e-9, 6) AS {c}' for c in LIVE_COLUMNS)} FROM scored")

POINTS_SQL = """pts AS (SELECT *, CASE WHEN cpu_z > 3 THEN least(35.0, cpu_z * 8) WHEN cpu_z > 2 THEN 15.0 ELSE 0 END AS p_cpu, CASE WHEN mem_z > 3.5 THEN least(35.0, mem_z * 6) ELSE 0 END AS p_mem, CASE WHEN syscalls_z > 3 THEN least(35.0, syscalls_z * 7) ELSE 0 END AS p_sys,
CASE WHEN list_contains(flags, 'mass_file_traversal') THEN 75.0 WHEN list_contains(flags, 'crypto_mining') THEN 70.0 ELSE 0 END AS p_rule FROM scored)"""


def p12(spark, d):
    z = live_z(spark, d)
    p = R.statistical_points(F.col("cpu_z"), F.col("mem_z"), F.col("syscalls_z"))
    return rounded(z.select("event_id", p["cpu_z_score"].alias("p_cpu"), p["mem_z_score"].alias("p_mem"), p["syscall_z_score"].alias("p_sys"), F.least(F.lit(35.0), sum(p.values(), F.lit(0.0))).alias("p_stat")), "p_cpu", "p_mem", "p_sys", "p_stat")


Q["P12_statistical_points"] = Query(p12, f"WITH {LIVE_SQL}, {POINTS_SQL} SELECT event_id, round(p_cpu + 1e-9, 6) AS p_cpu, round(p_mem + 1e-9, 6) AS p_mem, round(p_sys + 1e-9, 6) AS p_sys, round(least(35.0, p_cpu + p_mem + p_sys) + 1e-9, 6) AS p_stat FROM pts")


def p13(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("s"), F.abs(F.col("embedding")[1].cast("double")).alias("p"))
    yes = F.lit(True)
    return rounded(e.select("vec_id", R.forest_points(yes, F.when(F.col("s") > 0.5, -1).otherwise(1), F.col("s")).alias("p_forest"), R.classifier_points(yes, F.col("p") > 0.5, F.col("p")).alias("p_classifier")), "p_forest", "p_classifier")


Q["P13_model_points"] = Query(p13, """SELECT vec_id, round(CASE WHEN s > 0.5 OR s < 0 THEN least(35.0, abs(s) * 120 + 20) ELSE 0 END + 1e-9, 6) AS p_forest, round(CASE WHEN p > 0.5 THEN least(45.0, p * 45) ELSE 0 END + 1e-9, 6) AS p_classifier
FROM (SELECT vec_id, embedding[1]::DOUBLE AS s, abs(embedding[2]::DOUBLE) AS p FROM embeddings)""")
Q["P14_rule_points"] = Query(lambda s, d: live(t(s, d, "events")).select("event_id", R.rule_points(F.concat("flags", "flags", F.array(F.lit("unknown")))).alias("p_rule")), f"WITH {LIVE_SQL}, {POINTS_SQL} SELECT event_id, p_rule::DOUBLE AS p_rule FROM pts")


def scored(spark, d, enabled=True):
    none = live_z(spark, d).withColumns({"ml_available": F.lit(True), "if_pred": F.lit(1), "if_score": F.lit(0.1), "xgb_prob": F.lit(0.0), "xgb_attack": F.lit(False)})
    return R.score_events(none, enabled)


SCORE_SQL = POINTS_SQL + """, sc AS (SELECT *, round_even(least(99.0, greatest(0.0, least(35.0, p_cpu + p_mem + p_sys) + p_rule)), 0)::INT AS risk_score FROM pts),
band AS (SELECT *, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_category,
CASE WHEN risk_score >= 70 THEN 'ANOMALOUS' WHEN risk_score >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS status, CASE WHEN p_rule > 0 THEN 'analytic' ELSE 'none' END AS detection_source, 'evaluated' AS eval_status FROM sc)"""
Q["P15_risk_score"] = Query(lambda s, d: scored(s, d).select("event_id", "risk_score", "risk_category", "status", "detection_source", "eval_status"), f"WITH {LIVE_SQL}, {SCORE_SQL} SELECT event_id, risk_score, risk_category, status, detection_source, eval_status FROM band")
Q["P16_scoring_disabled"] = Query(lambda s, d: scored(s, d, False).select("event_id", "risk_score", "status", "eval_status"), "SELECT event_id, 0 AS risk_score, 'SAFE' AS status, 'disabled' AS eval_status FROM events")
FLOOR_SQL = SCORE_SQL + """, fl AS (SELECT * REPLACE (CASE WHEN risk_score = 0 THEN greatest(4, least(24, trunc(4 + 1.5 * cpu + 6 * max_z + least(600, syscalls) / 80)::INT)) ELSE risk_score END AS risk_score) FROM band)"""
Q["F31_activity_floor"] = Query(lambda s, d: R.with_floor(scored(s, d)).select("event_id", "risk_score"), f"WITH {LIVE_SQL}, {FLOOR_SQL} SELECT event_id, risk_score FROM fl")
ALERT_SQL = FLOOR_SQL + """, al AS (SELECT *, floor(epoch(ts) / 60)::BIGINT AS bucket FROM fl WHERE status = 'ANOMALOUS' OR risk_score >= 50 OR len(flags) > 0)"""
Q["P17_alert_decision"] = Query(lambda s, d: R.with_floor(scored(s, d)).where(R.is_alert()).select("event_id", "risk_score", "status"), f"WITH {LIVE_SQL}, {ALERT_SQL} SELECT event_id, risk_score, status FROM al")
SIGNALS_SQL = "list_sort(list_concat(CASE WHEN p_cpu > 0 THEN ['cpu_z_score'] ELSE [] END, CASE WHEN p_mem > 0 THEN ['mem_z_score'] ELSE [] END, CASE WHEN p_sys > 0 THEN ['syscall_z_score'] ELSE [] END, flags))"
KEY_SQL = f"'DK-' || upper(left(sha256(comm || ':' || pid || ':' || detection_source || ':' || array_to_string({SIGNALS_SQL}, ',') || ':' || bucket), 12))"


def alert_rows(spark, d):
    return R.alerts(R.with_floor(scored(spark, d)).withColumn("epoch", secs("ts")))


Q["P18_alert_records"] = Query(lambda s, d: alert_rows(s, d).select("event_id", "comm", "pid", "risk_score", "risk_category", "dedup_key", "alert_id", "alert_status", F.size("signals").alias("n_signals")),
                               f"WITH {LIVE_SQL}, {ALERT_SQL}, k AS (SELECT *, {KEY_SQL} AS dedup_key, len({SIGNALS_SQL}) AS n_signals FROM al) SELECT event_id, comm, pid, risk_score, risk_category, dedup_key, 'AL-' || left(sha256(dedup_key || ':' || event_id), 16) AS alert_id, 'ACTIVE' AS alert_status, n_signals::INT AS n_signals FROM k")
Q["P19_alert_suppression"] = Query(lambda s, d: R.suppress(alert_rows(s, d), ["ts", "event_id"]).select("dedup_key", "event_id"),
                                   f"WITH {LIVE_SQL}, {ALERT_SQL}, k AS (SELECT *, {KEY_SQL} AS dedup_key FROM al) SELECT dedup_key, event_id FROM k QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ts, event_id) = 1")
Q["P20_end_to_end_scoring"] = Query(lambda s, d: rounded(R.with_floor(scored(s, d)).select("event_id", "comm", "risk_score", "risk_category", "status", "category", F.size("signals").alias("n_signals"), "max_z"), "max_z"),
                                    f"WITH {LIVE_SQL}, {FLOOR_SQL}, k AS (SELECT *, len({SIGNALS_SQL})::INT AS n_signals FROM fl) SELECT event_id, comm, risk_score, risk_category, status, CASE WHEN list_contains(flags, 'crypto_mining') THEN 'RESOURCE_HIJACK' WHEN list_contains(flags, 'mass_file_traversal') THEN 'IMPACT' WHEN p_cpu > 0 OR p_mem > 0 OR p_sys > 0 THEN 'RESOURCE_DRIFT' ELSE 'EXECUTION' END AS category, n_signals, round(max_z::DOUBLE + 1e-9, 6) AS max_z FROM k")


def p21(spark, d):
    e = t(spark, d, "events")
    prof = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.avg("value").alias("cpu_mean"), F.stddev_pop("value").alias("cpu_std"), (F.avg("value") * 2).alias("mem_mean"), (F.stddev_pop("value") * 2).alias("mem_std"))
    rows = e.select("event_id", "user_id", F.col("value").alias("cpu"), (F.col("value") * 2).alias("mem"), F.lit(0).alias("risk")).join(prof.where("user_id % 5 <> 0"), "user_id", "left")
    return R.quick_rating(rows).select("event_id", "rating", "rating_status")


Q["P21_quick_rating"] = Query(p21, """WITH p AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY user_id HAVING user_id % 5 <> 0),
z AS (SELECT event_id, m, greatest(abs(value - m) / CASE WHEN s = 0 THEN 0.1 ELSE s END, abs(value * 2 - m * 2) / CASE WHEN s = 0 THEN 1.0 ELSE s * 2 END) AS z FROM events LEFT JOIN p USING (user_id))
SELECT event_id, (CASE WHEN m IS NULL THEN 78 WHEN z > 4.5 THEN least(99, floor(50 + z * 8 + 0.5)) WHEN z > 2.5 THEN floor(35 + z * 6 + 0.5) ELSE greatest(4, floor(z * 7 + 0.5)) END)::INT AS rating, CASE WHEN m IS NULL THEN 'SUSPICIOUS' WHEN z > 4.5 THEN 'ANOMALOUS' WHEN z > 2.5 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS rating_status FROM z""")

# W5 to W8 ---------------------------------------------------------------------------------------------------------
Q["W5_window_number"] = Query(lambda s, d: Wn.window_sequence(t(s, d, "events").withColumn("epoch", secs("ts")), "epoch", 3600, F.col("event_type") == "error"), "SELECT h AS window_index, row_number() OVER (ORDER BY h) AS sequence, count(*) AS events_received, count(*) FILTER (event_type = 'error') AS events_lost FROM (SELECT *, floor(epoch(ts) / 3600)::BIGINT AS h FROM events) GROUP BY h")
Q["W6_last_tokens"] = Query(lambda s, d: Wn.last_tokens(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", F.array_join("recent", " ").alias("recent"), F.size("recent").alias("n")),
                            "SELECT event_id, array_to_string(list(event_type) OVER w, ' ') AS recent, len(list(event_type) OVER w)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)")
Q["W7_latest_per_key"] = Query(lambda s, d: Wn.latest(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type"),
                               "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
Q["W8_alert_bucket"] = Query(lambda s, d: t(s, d, "events").where("event_type = 'error'").groupBy(F.floor(secs("ts") / 60).alias("bucket")).agg(F.count("*").alias("n")), "SELECT floor(epoch(ts) / 60)::BIGINT AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")

# A12 to A19 -------------------------------------------------------------------------------------------------------
MOM = ("mean", "variance", "std_pop", "low", "high")
Q["A12_running_moments"] = Query(lambda s, d: rounded(B.moments(t(s, d, "events"), ["user_id"], "value"), *MOM).drop("std_pop"), "SELECT user_id, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean, round(coalesce(var_samp(value), 0) + 1e-9, 6) AS variance, round(min(value) + 1e-9, 6) AS low, round(max(value) + 1e-9, 6) AS high FROM events GROUP BY 1")
Q["A13_mean_and_std"] = Query(lambda s, d: rounded(B.moments(t(s, d, "events"), ["event_type"], "value"), *MOM).select("event_type", "n", "mean", "std_pop"), "SELECT event_type, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS std_pop FROM events GROUP BY 1")
Q["A14_percentiles"] = Query(lambda s, d: rounded(B.percentiles(t(s, d, "events"), ["user_id"], "value"), *PCT), f"SELECT user_id, {', '.join(f'round(quantile_cont(value, {q}) + 1e-9, 6) AS {c}' for c, q in PCT.items())} FROM events GROUP BY 1")
Q["A15_median_and_mad"] = Query(lambda s, d: rounded(B.median_and_mad(t(s, d, "events"), ["user_id"], "value"), "median", "mad", "nmad"), "SELECT user_id, round(median(value) + 1e-9, 6) AS median, round(mad(value) + 1e-9, 6) AS mad, round(1.4826 * mad(value) + 1e-9, 6) AS nmad FROM events GROUP BY 1")
BASE_SQL = f"""st AS (SELECT profile_id, feature, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high, {', '.join(f'quantile_cont(value, {q}) AS {c}' for c, q in PCT.items())}, median(value) AS median, mad(value) AS mad FROM clean GROUP BY 1, 2),
base AS (SELECT st.*, 1.4826 * mad AS nmad, greatest(0, p75 - p25) AS iqr, noise_floor, greatest(1.4826 * mad, std, 0.05 * abs(median), noise_floor) AS effective_scale FROM st JOIN reg USING (feature))"""
BASE_COLUMNS = ("mean", "std", "low", "high", *PCT, "median", "mad", "nmad", "iqr", "noise_floor", "effective_scale")


def a16(spark, d):
    windows = B.oldest(daily_windows(spark, d), "profile_id", "day", 5000)
    rows = B.wide_baseline(stored(windows), ["profile_id"], list(FEATURES), B.registry(spark))
    return rounded(rows.select("profile_id", "feature", "n", *BASE_COLUMNS), *BASE_COLUMNS)


Q["A16_feature_baseline"] = Query(a16, f"WITH {LONG_SQL}, clean AS (SELECT * FROM long), {REG_SQL}, {BASE_SQL} SELECT profile_id, feature, n, {', '.join(f'round({c}::DOUBLE + 1e-9, 6) AS {c}' for c in BASE_COLUMNS)} FROM base")
TYPICAL = {"file_activity": "syscalls_file", "socket_connect": "syscalls_network", "execve": "syscalls_process", "sensitive": "syscalls_sensitive"}
Q["A17_typical_events"] = Query(lambda s, d: daily_windows(s, d).groupBy("profile_id").agg(F.array_join(B.typical_events({k: F.sum(c) for k, c in TYPICAL.items()}), ",").alias("typical")),
                                f"WITH {WINDOWS_SQL} SELECT profile_id, array_to_string(list_filter([{', '.join(f'CASE WHEN sum({c}) > 0 THEN {k!r} END' for k, c in TYPICAL.items())}], lambda x: x IS NOT NULL), ',') AS typical FROM win GROUP BY 1")


def a19(spark, d):
    e = t(spark, d, "events")
    m = lambda x: x.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"), F.min("value").alias("low"), F.max("value").alias("high"))
    both = B.combined(m(e.where("event_id < 4000")), m(e.where("event_id >= 4000")), ["user_id"])
    return rounded(both, "mean", "m2", "low", "high", digits=4)


Q["A19_combine_moments"] = Query(a19, "SELECT user_id, count(value) AS n, round(avg(value) + 1e-9, 4) AS mean, round(var_pop(value) * count(value) + 1e-9, 4) AS m2, round(min(value) + 1e-9, 4) AS low, round(max(value) + 1e-9, 4) AS high FROM events GROUP BY 1")
A23 = [f"{c}_{k}" for c in ("cpu", "mem", "syscalls") for k in ("avg", "std")]
Q["A23_live_profiles"] = Query(lambda s, d: rounded(B.live_profiles(t(s, d, "events").select(F.col("event_type").alias("comm"), F.col("value").alias("cpu"), (F.col("value") * 2).alias("mem"), F.floor(F.col("value") * 10).alias("syscalls"), F.regexp_extract("props", "[0-9]+", 0).alias("kind")), "comm", family_by_parts("comm", F.lit("")), "kind"), *A23, digits=4),
                               lambda: f"WITH live AS (SELECT event_type AS comm, value AS cpu, value * 2 AS mem, floor(value * 10) AS syscalls, props FROM events) SELECT comm, count(*) AS samples, {', '.join(f'round(coalesce({f}({c}), 0) + 1e-9, 4) AS {c}_{k}' for c in ('cpu', 'mem', 'syscalls') for k, f in (('avg', 'avg'), ('std', 'stddev_samp')))}, array_to_string(list_sort(list(DISTINCT regexp_extract(props, '[0-9]+'))), ',') AS typical, 'systemd' AS family FROM live GROUP BY 1")

# P1 to P10 --------------------------------------------------------------------------------------------------------
CLEAN_SQL = f"WITH {LONG_SQL}, {REG_SQL}, clean AS (SELECT long.* FROM long JOIN win USING (profile_id, day) WHERE coalesce(label_binary, 0) = 0), {BASE_SQL}"
MATURITY_SQL = """seen AS (SELECT profile_id, count(*) AS observations, count(DISTINCT day) AS instances FROM win WHERE coalesce(label_binary, 0) = 0 GROUP BY 1 HAVING count(*) >= 5),
mat AS (SELECT *, CASE WHEN observations < 5 OR instances < 1 THEN 'COLD_START' WHEN observations < 30 THEN 'LEARNING' ELSE 'MATURE' END AS maturity,
CASE WHEN observations < 5 OR instances < 1 THEN least(0.40, greatest(0.10, observations * 0.08)) WHEN observations < 30 THEN least(0.79, 0.45 + 0.30 * (observations - 5) / 25 + least(0.10, (instances - 1) * 0.02)) ELSE least(1.0, 0.80 + least(0.10, (observations - 30) / 100) + least(0.10, (instances - 1) * 0.02)) END AS confidence FROM seen)"""


def profiles(spark, d, windows=None):
    w = (stored(daily_windows(spark, d)) if windows is None else windows).withColumns({"instance_id": F.col("day"), "start": F.col("day")})
    return B.build_profiles(w, B.registry(spark), typical={"socket_connect": "syscalls_network", "execve": "syscalls_process"})


Q["P1_build_profiles"] = Query(lambda s, d: rounded(profiles(s, d).select("profile_id", "feature", "n", "mean", "median", "effective_scale", "observations", "maturity", "confidence", F.array_join("typical", ",").alias("typical"), F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end")), "mean", "median", "effective_scale", "confidence"),
                               f"{CLEAN_SQL}, {MATURITY_SQL} SELECT profile_id, feature, n, round(mean + 1e-9, 6) AS mean, round(median + 1e-9, 6) AS median, round(effective_scale + 1e-9, 6) AS effective_scale, observations, maturity, round(confidence::DOUBLE + 1e-9, 6) AS confidence, typical, period_start, period_end FROM base JOIN mat USING (profile_id) JOIN (SELECT profile_id, array_to_string(list_filter([CASE WHEN sum(syscalls_network) > 0 THEN 'socket_connect' END, CASE WHEN sum(syscalls_process) > 0 THEN 'execve' END], lambda x: x IS NOT NULL), ',') AS typical, strftime(min(day), '%Y-%m-%d') AS period_start, strftime(max(day), '%Y-%m-%d') AS period_end FROM win WHERE coalesce(label_binary, 0) = 0 GROUP BY 1) USING (profile_id)")


def p2(spark, d):
    rows = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("k"))
    level, confidence = B.maturity(F.col("n"), F.col("k"))
    return rounded(rows.select("o_custkey", level.alias("maturity"), confidence.alias("confidence")), "confidence")


Q["P2_maturity"] = Query(p2, """SELECT o_custkey, CASE WHEN n < 5 OR k < 1 THEN 'COLD_START' WHEN n < 30 THEN 'LEARNING' ELSE 'MATURE' END AS maturity,
round((CASE WHEN n < 5 OR k < 1 THEN least(0.40, greatest(0.10, n * 0.08)) WHEN n < 30 THEN least(0.79, 0.45 + 0.30 * (n - 5) / 25 + least(0.10, (k - 1) * 0.02)) ELSE least(1.0, 0.80 + least(0.10, (n - 30) / 100) + least(0.10, (k - 1) * 0.02)) END)::DOUBLE + 1e-9, 6) AS confidence
FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1)""")


def p3(spark, d):
    clean = stored(daily_windows(spark, d).where("label_binary = 0"))
    cut, by = F.lit("2024-01-15").cast("date"), ["profile_id", "feature"]
    old = B.wide_baseline(clean.where(F.col("day") < cut), ["profile_id"], list(FEATURES), B.registry(spark))
    old = old.join(B.new_moments(B.long_form(clean.where(F.col("day") < cut), ["profile_id"], list(FEATURES)), by).select(*by, "sketch"), by)
    both = B.updated_baseline(old, B.new_moments(B.long_form(clean.where(F.col("day") >= cut), ["profile_id"], list(FEATURES)), by), by)
    return rounded(both.select(*by, "n", *P3_COLUMNS), *P3_COLUMNS, digits=4)


P3_COLUMNS = ("mean", "std", "low", "high", "median_estimate", "median")
Q["P3_incremental_update"] = Query(p3, f"""WITH {LONG_SQL} SELECT profile_id, feature, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, round(stddev_pop(value) + 1e-9, 4) AS std, round(min(value) + 1e-9, 4) AS low, round(max(value) + 1e-9, 4) AS high,
round((avg(value) + coalesce(median(value) FILTER (day < DATE '2024-01-15'), avg(value))) / 2 + 1e-9, 4) AS median_estimate, round(quantile_disc(value, 0.5) + 1e-9, 4) AS median FROM long JOIN win USING (profile_id, day) WHERE label_binary = 0 GROUP BY 1, 2""")
Q["P4_recompute_all"] = Query(lambda s, d: profiles(s, d).groupBy("maturity").agg(F.count_distinct("profile_id").alias("programs"), F.count("*").alias("n_features")), f"{CLEAN_SQL}, {MATURITY_SQL} SELECT maturity, count(DISTINCT profile_id) AS programs, count(*) AS n_features FROM base JOIN mat USING (profile_id) GROUP BY 1")
DEV_SQL = f"""{CLEAN_SQL}, {MATURITY_SQL}, dv AS (SELECT l.profile_id, l.day, l.feature, l.value, b.median, b.high, category, weight, maturity, confidence, (l.value - b.median) / b.effective_scale AS raw_score, (l.value - b.mean) / CASE WHEN b.std > 0.001 THEN b.std ELSE b.effective_scale END AS raw_z
FROM long l JOIN base b USING (profile_id, feature) JOIN mat USING (profile_id) JOIN reg USING (feature)),
two AS (SELECT *, raw_score >= 3 - 1e-9 AS is_deviant, round(raw_score + CASE WHEN raw_score < 0 THEN -1e-9 ELSE 1e-9 END, 2) AS robust_score, round(raw_z + CASE WHEN raw_z < 0 THEN -1e-9 ELSE 1e-9 END, 2) AS z_classic FROM dv),
fr AS (SELECT *, CASE WHEN is_deviant AND value > median THEN least(40.0, (robust_score - 2) * 10 * weight) ELSE 0 END AS feature_risk FROM two)"""


def deviations(spark, d, windows=None):
    windows = stored(daily_windows(spark, d)) if windows is None else windows
    return D.window_deviations(windows, ["profile_id", "day"], list(FEATURES), profiles(spark, d, windows), B.registry(spark))


def day_text():
    return F.ltrim(F.date_format("day", "yyyy-MM-dd"), F.lit("+")).alias("day")  # years beyond 9999 have no sign in SQL


Q["J4_window_with_baseline"] = Query(lambda s, d: rounded(D.taken_apart(deviations(s, d)).select("profile_id", day_text(), "feature", "value", "median", "maturity"), "value", "median"), f"{DEV_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, feature, round(value + 1e-9, 6) AS value, round(median + 1e-9, 6) AS median, maturity FROM fr")
Q["P5_robust_deviation"] = Query(lambda s, d: rounded(D.taken_apart(deviations(s, d)).select("profile_id", day_text(), "feature", "robust_score", "z_classic", "is_deviant"), "robust_score", "z_classic"), f"{DEV_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, feature, round(robust_score + 1e-9, 6) AS robust_score, round(z_classic + 1e-9, 6) AS z_classic, is_deviant FROM fr")
CATS = [f"risk_{c}" for c in D.CATEGORY_WEIGHTS]
CAT_SQL = DEV_SQL + ", cr AS (SELECT profile_id, day, " + ", ".join(f"max(CASE WHEN category = '{c}' THEN feature_risk ELSE 0 END)::DOUBLE AS risk_{c}" for c in D.CATEGORY_WEIGHTS) + ", count(*) FILTER (is_deviant) AS n_deviant, count(*) FILTER (feature_risk > 0) AS n_reasons, any_value(maturity) AS maturity, any_value(confidence) AS confidence FROM fr GROUP BY 1, 2)"
Q["P6_category_risk"] = Query(lambda s, d: rounded(D.window_category_risk(deviations(s, d)).select("profile_id", day_text(), *CATS, "n_deviant"), *CATS), f"{CAT_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in CATS)}, n_deviant FROM cr")


def new_events(spark, d, windows=None):
    w = daily_windows(spark, d) if windows is None else windows
    high = w.where("label_binary = 0").groupBy("profile_id").agg(F.max("file_delete_count").alias("h_del"), F.max("syscalls_network").alias("h_net"), F.max("syscalls_sensitive").alias("h_sens"), F.max("syscalls_process").alias("h_exec"), B.typical_events({"socket_connect": F.sum("syscalls_network"), "execve": F.sum("syscalls_process")}).alias("typical"))
    rows = w.join(high.hint("shuffle_hash"), "profile_id")  # neither side is sent to all
    made = D.unprecedented({"connect": F.col("syscalls_network"), "sensitive": F.col("syscalls_sensitive"), "exec": F.col("syscalls_process"), "delete": F.col("file_delete_count")}, {"connect": F.col("h_net"), "sensitive": F.col("h_sens"), "exec": F.col("h_exec"), "delete": F.col("h_del")}, F.col("typical"))
    return rows.select("profile_id", "day", made.alias("new"))


NEW_SQL = """hi AS (SELECT profile_id, max(file_delete_count) AS h_del, max(syscalls_network) AS h_net, max(syscalls_sensitive) AS h_sens, max(syscalls_process) AS h_exec FROM win WHERE label_binary = 0 GROUP BY 1),
nw AS (SELECT profile_id, day, list_filter([CASE WHEN syscalls_network > 0 AND h_net = 0 THEN 'socket_connect' END, CASE WHEN syscalls_sensitive > 0 AND h_sens = 0 THEN 'sensitive_syscall' END, CASE WHEN syscalls_process > 0 AND h_exec = 0 THEN 'execve' END, CASE WHEN file_delete_count > 5 AND h_del = 0 THEN 'file_delete' END], lambda x: x IS NOT NULL) AS events,
greatest(CASE WHEN syscalls_network > 0 AND h_net = 0 THEN 45.0 ELSE 0 END, CASE WHEN syscalls_sensitive > 0 AND h_sens = 0 THEN 50.0 ELSE 0 END, CASE WHEN syscalls_process > 0 AND h_exec = 0 THEN 40.0 ELSE 0 END, CASE WHEN file_delete_count > 5 AND h_del = 0 THEN 40.0 ELSE 0 END) AS new_risk FROM win JOIN hi USING (profile_id))"""


def new_risk():
    return F.coalesce(F.array_max(F.transform("new", lambda x: x["risk"])), F.lit(0.0))


Q["P7_unprecedented_events"] = Query(lambda s, d: new_events(s, d).select("profile_id", day_text(), F.array_join(F.transform("new", lambda x: x["event"]), ",").alias("events"), new_risk().alias("new_risk")), f"WITH {WINDOWS_SQL}, {NEW_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, array_to_string(events, ',') AS events, new_risk::DOUBLE AS new_risk FROM nw")


def verdicts(spark, d):
    windows = stored(daily_windows(spark, d))  # read three times
    risk = D.window_category_risk(deviations(spark, d, windows)).join(new_events(spark, d, windows).hint("merge"), ["profile_id", "day"])
    return D.composite_risk(risk.withColumn("risk_security", F.greatest("risk_security", new_risk())), F.size("new"))


VERDICT_SQL = CAT_SQL + ", " + NEW_SQL + """, vr AS (SELECT *, CASE maturity WHEN 'COLD_START' THEN least(30.0, raw_risk * confidence) WHEN 'LEARNING' THEN least(95.0, raw_risk * confidence) ELSE least(99.0, raw_risk) END AS risk_score FROM
(SELECT *, least(100.0, greatest(risk_security, new_risk) * 1.2 + risk_syscall * 0.8 + risk_resource * 0.6 + risk_network * 0.7 + risk_file * 0.6) AS raw_risk FROM cr JOIN nw USING (profile_id, day))),
vd AS (SELECT *, CASE maturity WHEN 'COLD_START' THEN len(events) > 0 AND risk_score >= 25 WHEN 'LEARNING' THEN risk_score >= 50 OR len(events) > 0 ELSE n_reasons > 0 OR risk_score >= 60 OR len(events) > 0 END AS is_anomaly FROM vr)"""
Q["P8_composite_risk"] = Query(lambda s, d: rounded(verdicts(s, d).select("profile_id", day_text(), "raw_risk", "risk_score", "is_anomaly"), "raw_risk", "risk_score", digits=4), f"{VERDICT_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, round(raw_risk::DOUBLE + 1e-9, 4) AS raw_risk, round(risk_score::DOUBLE + 1e-9, 4) AS risk_score, is_anomaly FROM vd")
Q["P9_deviation_record"] = Query(lambda s, d: rounded(verdicts(s, d).select("profile_id", day_text(), "maturity", "n_deviant", "n_reasons", F.array_join(F.transform("new", lambda x: x["event"]), ",").alias("events"), "risk_score", "is_anomaly"), "risk_score", digits=4), f"{VERDICT_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, maturity, n_deviant, n_reasons, array_to_string(events, ',') AS events, round(risk_score::DOUBLE + 1e-9, 4) AS risk_score, is_anomaly FROM vd")
DEVS = [f"dev_{f}" for f in FEATURES]
Q["P10_deviation_vector"] = Query(lambda s, d: rounded(D.window_deviation_vector(deviations(s, d), ["profile_id", "day"], list(FEATURES)).withColumn("day", day_text()), *DEVS), f"{DEV_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(f'round(max(robust_score) FILTER (feature = {f!r}) + 1e-9, 6) AS dev_{f}' for f in FEATURES)} FROM fr GROUP BY profile_id, day")
Q["F29_dedup_key"] = Query(lambda s, d: t(s, d, "events").where("event_type = 'error'").select("event_id", dedup_key(F.col("event_type"), F.col("user_id"), F.lit("analytic"), F.array(F.lit("b"), F.lit("a")), F.floor(secs("ts") / 60)).alias("dedup_key")),
                           "SELECT event_id, 'DK-' || upper(left(sha256(event_type || ':' || user_id || ':analytic:a,b:' || floor(epoch(ts) / 60)::BIGINT), 12)) AS dedup_key FROM events WHERE event_type = 'error'")
Q["F30_lifecycle"] = Query(lambda s, d: processes(s, d).select("instance_id", lifecycle(F.col("end_s"), F.col("exit_code")).alias("status"), F.greatest(F.lit(0), F.coalesce("end_s", F.lit(1_750_000_000)) - F.col("start_s")).alias("duration_s")),
                           f"WITH {PROC_SQL} SELECT instance_id, CASE WHEN end_s IS NULL THEN 'RUNNING' WHEN exit_code <> 0 THEN 'CRASHED' ELSE 'TERMINATED' END AS status, greatest(0, coalesce(end_s, 1750000000) - start_s) AS duration_s FROM proc")
