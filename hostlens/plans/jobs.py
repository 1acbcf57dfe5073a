"""Queries of scans, sinks, models and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators import ml as M
from hostlens.operators import sequence as S
from hostlens.operators import trace as Tr
from hostlens.operators import windows as Wn
from hostlens.plans._bind import FULL, FULL_SQL, LINE_SQL, PROC_SQL, Query, full_windows, processes, secs, t
from hostlens.plans.behaviour import ALERT_SQL, KEY_SQL, LIVE_SQL, alert_rows, live, rounded
from hostlens.plans.text import ORDER, TR_SQL, W1_COUNTS, W1_FLOATS, W2_COLUMNS, flat_events, process_events, tok, tr, w1_parts, w2_parts
from hostlens.sources import layouts, scans, sinks
from hostlens.sources.ingest import ingest_experiment
from hostlens.sources.sinks import scratch
from hostlens.streaming import jobs as J
from hostlens.streaming.scoring import LiveScoring

Q: dict[str, Query] = {}


# Scans --------------------------------------------------------------------------------------------------------------
def as_csv(spark, df):
    path = scratch(spark)
    df.write.option("header", True).option("emptyValue", "").csv(path)
    return path


def collector_file(spark, df, layout, more=()):
    """Rows as a collector file with all columns of its layout (empty where df has none), read back by the layout."""
    text = df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit("")).alias(c) for c in [*layout, *more]])
    return scans.table_csv(spark, as_csv(spark, text), layout)


def s1(spark, d):
    p = processes(spark, d)
    rows = collector_file(spark, p.select(
        F.concat(F.lit("i"), "instance_id").alias("instance_id"), F.col("profile_id"), (F.col("instance_id") % 32768).alias("pid"), F.when(F.col("instance_id") % 3 != 0, F.col("instance_id") % 7).alias("ppid"), "comm",
        F.when(F.col("profile_id") % 2 == 1, F.col("comm")).alias("executable"), F.when(F.col("exit_code") == 1, "n/a").otherwise(F.col("exit_code").cast("string")).alias("exit_code"), F.col("start_s").alias("start_time"),
        F.col("end_s").alias("end_time"), F.when(F.col("instance_id") % 2 == 0, "True").otherwise("0").alias("preexisting")), layouts.PROCESS_INSTANCES)
    return rows.withColumns({c: F.unix_seconds(c) for c in ("start_time", "end_time")})


Q["S1_process_csv"] = Query(s1, f"""WITH {PROC_SQL} SELECT 'i' || instance_id AS instance_id, profile_id::VARCHAR AS profile_id, (instance_id % 32768)::INT AS pid, CASE WHEN instance_id % 3 <> 0 THEN (instance_id % 7)::INT END AS ppid, NULL::VARCHAR AS parent_instance_id, comm,
CASE WHEN profile_id % 2 = 1 THEN comm END AS executable, NULL::VARCHAR AS executable_hash, NULL::INT AS uid, start_s AS start_time, end_s AS end_time, 0 AS exit_code, instance_id % 2 = 0 AS preexisting, 0 AS windows_written FROM proc""")


def s2(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("i"), "user_id")).alias("instance_id"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("pid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "event_type",
                                     F.when(F.col("event_type") == "purchase", "network").alias("syscall_category"), F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.col("props")).alias("metadata"))
    rows = collector_file(spark, e, layouts.TELEMETRY_EVENTS)
    return rows.select("event_id", "instance_id", "pid", F.unix_seconds("timestamp").alias("timestamp"), "event_type", "syscall_category", "file_identifier", "network_identifier", F.col("metadata")["k"].alias("k"), F.col("metadata")["raw"].alias("raw"))


Q["S2_event_csv"] = Query(s2, """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'i' || user_id END AS instance_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id::INT END AS pid, floor(epoch(ts))::BIGINT AS timestamp, event_type, CASE WHEN event_type = 'purchase' THEN 'network' END AS syscall_category,
NULL::VARCHAR AS file_identifier, NULL::VARCHAR AS network_identifier, CASE WHEN event_id % 3 <> 0 THEN regexp_extract(props, '[0-9]+') END AS k, CASE WHEN event_id % 3 = 0 THEN 'not json' END AS raw FROM events""")
#: Behaviour windows (lines) as their file has them.
WINDOW_COLUMNS = ["instance_id", "profile_id", "start_time", "end_time", "duration_s", "syscall_count", "syscalls_sensitive", "unique_files", "bytes_written", "unique_dest_ips", "tcp_tx_bytes", "tcp_rx_bytes", "udp_tx_bytes", "child_process_count", "exec_count", "cpu_usage", "memory_rss_bytes", "label_binary"]


def window_file(spark, d):
    w = full_windows(spark, d)
    return w.select(F.concat(F.lit("i"), "instance_id").alias("instance_id"), F.concat(F.lit("p"), F.col("supp") % 50).alias("profile_id"), F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"), F.when(F.col("n") == 3, "bad").otherwise(F.col("cpu_usage").cast("string")).alias("cpu_usage"),
                    F.when(F.col("flag") == "R", "1").when(F.col("flag") == "A", "normal").otherwise("").alias("label_binary"), *[c for c in WINDOW_COLUMNS if c in w.columns and c not in ("instance_id", "cpu_usage")])


WINDOW_FILE_SQL = "wf AS (SELECT 'i' || instance_id AS instance_id, 'p' || (supp % 50) AS profile_id, start_s, end_s, CASE WHEN n = 3 THEN 0.0 ELSE cpu_usage END AS cpu_usage, CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS label_binary, " + ", ".join(c for c in WINDOW_COLUMNS if c in FULL) + " FROM fullw)"
SUMS = [c for c in WINDOW_COLUMNS if c in FULL and c != "duration_s"]


def s3(spark, d):
    rows = collector_file(spark, window_file(spark, d), layouts.BEHAVIOUR_WINDOWS)
    rest = [c for c in layouts.BEHAVIOUR_WINDOWS if c not in {*WINDOW_COLUMNS, "window_id", "pid", "ppid", "comm", "executable", "label", "scenario", "experiment_id"}]
    nothing = sum((F.abs(F.col(c)) for c in rest), F.lit(0.0))
    return rounded(rows.groupBy("profile_id", "label_binary", "label", "scenario", "pid", "window_id").agg(F.count("*").alias("n"), F.sum("cpu_usage").alias("cpu_usage"), F.sum("duration_s").alias("duration_s"), F.sum(nothing).alias("nothing"), F.min(F.unix_seconds("start_time")).alias("first"), F.max(F.unix_seconds("end_time")).alias("last"), *[F.sum(c).alias(c) for c in SUMS]), "cpu_usage", "duration_s", "nothing", digits=4)


Q["S3_window_csv"] = Query(s3, f"WITH {LINE_SQL}, {FULL_SQL}, {WINDOW_FILE_SQL} SELECT profile_id, label_binary, '' AS label, '' AS scenario, NULL::INT AS pid, NULL::BIGINT AS window_id, count(*) AS n, round(sum(cpu_usage) + 1e-9, 4) AS cpu_usage, round(sum(duration_s) + 1e-9, 4) AS duration_s, 0.0::DOUBLE AS nothing, min(start_s) AS first, max(end_s) AS last, {', '.join(f'sum({c})::BIGINT AS {c}' for c in SUMS)} FROM wf GROUP BY profile_id, label_binary")


def s4(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("window_index"), F.lit("2024-01-01T00:00:00Z").alias("start_time"), F.col("p_retailprice").alias("cpu_percent_total"), F.when(F.col("p_size") % 2 == 0, "-").otherwise(F.col("p_size").cast("string")).alias("mem_used"), (F.col("p_partkey") * 3).alias("events_received"), F.col("p_brand").alias("label"), F.when(F.col("p_size") > 25, '{"a": "1"}').otherwise("plain").alias("raw_metrics"), F.lit("7").alias("mem_cached"))
    rows = collector_file(spark, p, layouts.SYSTEM_METRICS, layouts.SYSTEM_METRICS_MORE)
    return rounded(rows.select("window_index", F.unix_seconds("start_time").alias("start_time"), F.unix_seconds("end_time").alias("end_time"), "cpu_percent_total", "mem_used", "mem_total", "load_1m", "events_received", "events_lost", "label", "label_binary", F.col("raw_metrics")["a"].alias("a"), F.col("raw_metrics")["raw"].alias("raw"), F.lit(len(rows.columns)).alias("n_columns")), "cpu_percent_total", digits=4)


Q["S4_metric_csv"] = Query(s4, "SELECT p_partkey::INT AS window_index, 1704067200 AS start_time, NULL::BIGINT AS end_time, round(p_retailprice + 1e-9, 4) AS cpu_percent_total, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END::BIGINT AS mem_used, 0::BIGINT AS mem_total, 0.0::DOUBLE AS load_1m, p_partkey * 3 AS events_received, 0::BIGINT AS events_lost, p_brand AS label, NULL::INT AS label_binary, CASE WHEN p_size > 25 THEN '1' END AS a, CASE WHEN p_size <= 25 THEN 'plain' END AS raw, 40 AS n_columns FROM part")
Q["S5_histogram"] = Query(lambda s, d: scans.coerced(scans.raw_csv(s, as_csv(s, t(s, d, "events").groupBy("user_id", "event_type").count().select(F.col("user_id").cast("string"), "event_type", F.col("count").cast("string"))), ["user_id", "event_type", "count"]), {"user_id": "long", "event_type": "text", "count": "long"}), "SELECT user_id, event_type, count(*) AS count FROM events GROUP BY 1, 2")


def trace_folder(spark, rows, folders):
    """A file for each trace (folder, value), in the folders of a collection: one write for each of these few folders."""
    root, rows = scratch(spark), sinks.stored(rows)
    for f in folders:
        sinks.file_for_each(rows.where(F.col("folder") == f).select("value"), f"{root}/{f}")
    return root


INT_FOLDERS = ["Training_Data_Master", "Validation_Data_Master", "Attack_Data_Master/Adduser_1", "Attack_Data_Master/Hydra_SSH_3", "Attack_Data_Master/Odd_2"]
NAMED_FOLDERS = ["attack/ssh_1", "attack/odd_0", "baseline/run_tests", "baseline/idle"]
of = lambda folders: F.element_at(F.array(*map(F.lit, folders)), (F.col("user_id") % len(folders) + 1).cast("int"))


def s7(spark, d):
    rows = tr(spark, d).select(F.array_join(F.transform("tokens", lambda x: F.length(x).cast("string")), " ").alias("value"), of(INT_FOLDERS).alias("folder"))
    rows = rows.unionByName(spark.createDataFrame([("3 x y", INT_FOLDERS[0]), ("", INT_FOLDERS[2])], "value string, folder string"))
    good, bad = scans.int_trace_directory(spark, trace_folder(spark, rows, INT_FOLDERS))
    count = lambda df, kind: df.groupBy("source_split", "category").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), (F.sum("label") if "label" in df.columns else F.lit(0).cast("long")).alias("attacks"), (F.sum(F.size("tokens")) if "tokens" in df.columns else F.sum("n_bad")).alias("tokens"))
    return count(good, "good").unionByName(count(bad, "bad"))


INT_SQL = "CASE user_id % 5 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' ELSE 'attack' END AS source_split, CASE user_id % 5 WHEN 2 THEN 'Adduser' WHEN 3 THEN 'Hydra_SSH' WHEN 4 THEN 'Odd_2' ELSE 'normal' END AS category"
Q["S7_trace_directory"] = Query(s7, f"SELECT source_split, category, 'good' AS kind, count(DISTINCT user_id) AS n, CASE WHEN source_split = 'attack' THEN count(DISTINCT user_id) ELSE 0 END AS attacks, count(*) AS tokens FROM (SELECT user_id, {INT_SQL} FROM events) GROUP BY 1, 2 UNION ALL SELECT 'training', 'normal', 'bad', 1, 0, 2 UNION ALL SELECT 'attack', 'Adduser', 'bad', 1, 0, 0")


def s8(spark, d):
    rows = tr(spark, d).select(F.array_join("tokens", " ").alias("value"), of(NAMED_FOLDERS).alias("folder"))
    rows = rows.unionByName(spark.createDataFrame([("", NAMED_FOLDERS[3])], "value string, folder string"))
    root = trace_folder(spark, rows, NAMED_FOLDERS)
    good, _ = scans.named_trace_directory(spark, root)
    some, _ = scans.named_trace_directory(spark, root, max_baseline=10)
    count = lambda df, kind, *by: df.groupBy(*by).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("label").alias("attacks"), F.count_if(F.length("pid") > 5).alias("named"))
    chosen = some.where("source_split = 'baseline'").agg(F.count("*").between(9, 10).alias("as_many"))
    return count(good, "all", "source_split", "category", "subcategory").crossJoin(F.broadcast(chosen))  # one row


NAMED_SQL = "CASE WHEN user_id % 4 < 2 THEN 'attack' ELSE 'baseline' END AS source_split, CASE user_id % 4 WHEN 0 THEN 'ssh' WHEN 1 THEN 'odd_0' ELSE 'normal' END AS category, CASE user_id % 4 WHEN 0 THEN 'ssh_1' WHEN 1 THEN 'odd_0' WHEN 2 THEN 'run_tests' ELSE 'idle' END AS subcategory"
Q["S8_baseline_subsample"] = Query(s8, f"SELECT source_split, category, subcategory, 'all' AS kind, count(*) AS n, CASE WHEN source_split = 'attack' THEN count(*) ELSE 0 END AS attacks, count(*) AS named, true AS as_many FROM (SELECT DISTINCT user_id, {NAMED_SQL} FROM events) GROUP BY 1, 2, 3")


def s9(spark, d):
    e = t(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), F.col("embedding")[1].cast("double").cast("string").alias("f1"), F.col("embedding")[0].cast("double").cast("string").alias("f0"))
    rows = scans.feature_csv(spark, as_csv(spark, e), ["f0", "f1"], {"label": "int"})
    return rounded(rows.groupBy("label").agg(F.sum("f0").alias("f0"), F.sum("f1").alias("f1")), "f0", "f1")


Q["S9_feature_csv"] = Query(s9, "SELECT label, round(sum(embedding[1]::DOUBLE) + 1e-9, 6) AS f0, round(sum(embedding[2]::DOUBLE) + 1e-9, 6) AS f1 FROM embeddings GROUP BY 1")


def written(spark, df, **how):
    path = scratch(spark)
    sinks.append(df, path, **how)
    return spark.read.parquet(path)


Q["S10_profile_snapshot"] = Query(lambda s, d: rounded(written(s, t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))), "mean"), "SELECT event_type, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean FROM events GROUP BY 1")


def s11(spark, d):
    run = scratch(spark)
    put = lambda df, name, layout: df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit("")).alias(c) for c in layout]).write.option("header", True).option("emptyValue", "").csv(f"{run}/{name}.csv")
    p = processes(spark, d)
    put(p.select(F.concat(F.lit("i"), "instance_id").alias("instance_id"), F.col("start_s").alias("start_time")), "process_instances", layouts.PROCESS_INSTANCES)
    put(t(spark, d, "events").select("event_id", "event_type", F.col("props").alias("metadata")), "telemetry_events", layouts.TELEMETRY_EVENTS)
    put(window_file(spark, d), "behaviour_windows", layouts.BEHAVIOUR_WINDOWS)  # no system metrics: a missing file counts 0
    return ingest_experiment(spark, run, scratch(spark), profiles=True)


Q["S11_experiment_ingest"] = Query(s11, f"""WITH {LINE_SQL}, {FULL_SQL}, {WINDOW_FILE_SQL} SELECT 'process_instances' AS name, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 'telemetry_events', (SELECT count(*) FROM events) UNION ALL SELECT 'behaviour_windows', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'system_metrics', 0
UNION ALL SELECT 'profiles_updated', (SELECT count(*) FROM (SELECT profile_id FROM wf WHERE coalesce(label_binary, 0) = 0 GROUP BY 1 HAVING count(*) >= 5))""")

# Sinks --------------------------------------------------------------------------------------------------------------
Q["K3_append_events"] = Query(lambda s, d: written(s, t(s, d, "events"), ts_col="ts").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n")), "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1")
Q["K4_append_windows"] = Query(lambda s, d: written(s, t(s, d, "lineitem"), ts_col=None).groupBy("l_linenumber").agg(F.count("*").alias("n")), "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
Q["K5_append_metrics"] = Query(lambda s, d: written(s, t(s, d, "part")).agg(F.count("*").alias("n"), F.max("p_size").alias("size")), "SELECT count(*) AS n, max(p_size) AS size FROM part")
Q["K6_append_detections"] = Query(lambda s, d: written(s, t(s, d, "lineitem").where("l_returnflag = 'R'")).groupBy("l_linestatus").agg(F.count("*").alias("n")), "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")


def k11(spark, d):
    path = scratch(spark)
    sinks.rotating_csv(t(spark, d, "customer").select("c_custkey", "c_name"), path, 200)
    rows = spark.read.option("header", True).csv(path).groupBy(F.input_file_name().alias("f")).count()
    return rows.agg((F.max("count") <= 200).alias("within"), F.sum("count").alias("rows"))


Q["K11_rotating_csv"] = Query(k11, "SELECT true AS within, count(*) AS rows FROM customer")
Q["K12_persist_profiles"] = Query(lambda s, d: written(s, t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))), "SELECT user_id, count(*) AS n FROM events GROUP BY 1")


def k13(spark, d):
    m, path = Tr.stats(tok(spark, d), "user_id").drop("entropy"), scratch(spark)
    schema = sinks.write_features(m, path, m.columns[1:], m.columns[:1])
    rows = spark.read.parquet(f"{path}/matrix").agg(F.count("*").alias("rows"))
    return schema.crossJoin(F.broadcast(rows))  # one row


Q["K13_feature_matrix_file"] = Query(k13, "SELECT position::INT AS position, name, kind, (SELECT count(DISTINCT user_id) FROM events) AS rows FROM (VALUES (0, 'length', 'feature'), (1, 'n_distinct', 'feature'), (2, 'diversity', 'feature'), (3, 'repeats', 'feature'), (4, 'repetition_ratio', 'feature'), (5, 'user_id', 'meta')) AS v(position, name, kind)")


def k14(spark, d):
    path = scratch(spark)
    sinks.history_csv(t(spark, d, "events").select("event_id", F.concat(F.lit('say "'), "event_type", F.lit('"')).alias("note")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select(F.col("event_id").cast("long").alias("event_id"), "note")


Q["K14_history_csv"] = Query(k14, """SELECT event_id, 'say "' || event_type || '"' AS note FROM events""")


# Models -------------------------------------------------------------------------------------------------------------
def vectors(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("category"), F.when(F.col("label") == 0, 1).otherwise(0).alias("label"), F.col("embedding"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])


VEC_SQL = "vec AS (SELECT vec_id, label AS category, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, CASE WHEN embedding[1] > 0.1 THEN 1 ELSE 0 END AS prediction, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64)) + " FROM embeddings)"
FEATURES = [f"f{i}" for i in range(64)]
guess = lambda s, d: vectors(s, d).withColumn("prediction", F.when(F.col("embedding")[0] > 0.1, 1).otherwise(0))


def m9(spark, d):
    anomaly, attack = M.verdict(F.when(F.col("f0") > 0.2, -1).otherwise(1), F.col("f1"), F.abs("f2") + 0.8)
    return vectors(spark, d).select("vec_id", anomaly.alias("anomaly"), attack.alias("attack"))


Q["M9_inference_rule"] = Query(m9, f"WITH {VEC_SQL} SELECT vec_id, f0 > 0.2 OR f1 < 0 AS anomaly, abs(f2) + 0.8 > 0.992 OR (abs(f2) + 0.8 > 0.95 AND (f0 > 0.2 OR f1 < 0)) AS attack FROM vec")
SPLIT_SQL = f"WITH {VEC_SQL}, sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5) AS is_train FROM vec)"
split = lambda s, d: M.stratified_split(vectors(s, d), "vec_id", "label")


def m10(spark, d):
    rows = split(spark, d)
    model = M.train_boosted(rows.where("is_train"), FEATURES)
    return M.confusion(M.apply_boosted(model, rows, FEATURES), "label", "prediction", ["is_train"])


def m11(spark, d):
    v = vectors(spark, d)
    nodes = M.isolation_forest(v.where("label = 0"), "vec_id", "embedding")
    return M.with_anomaly(M.forest_scores(v, "vec_id", "embedding", nodes), 0.05)


Q["M10_boosted_trees"] = Query(m10)
Q["M11_isolation_forest"] = Query(m11)
Q["M12_stratified_split"] = Query(lambda s, d: split(s, d).select("vec_id", "label", "is_train"), f"{SPLIT_SQL} SELECT vec_id, label, is_train FROM sp")
MEASURES = ("accuracy", "precision", "recall", "fpr", "fnr", "f1")
CONF_SQL = "cm AS (SELECT {by} count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM {rows} {group}), ms AS (SELECT *, (tp + tn) / greatest(1, tp + fp + tn + fn) AS accuracy, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall, fp / greatest(1, fp + tn) AS fpr, fn / greatest(1, fn + tp) AS fnr FROM cm), mf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ms)"
Q["M13_confusion"] = Query(lambda s, d: rounded(M.confusion(guess(s, d), "label", "prediction"), *MEASURES), f"WITH {VEC_SQL}, {CONF_SQL.format(by='', rows='vec', group='')} SELECT tp, fp, tn, fn, {', '.join(f'round({m} + 1e-9, 6) AS {m}' for m in MEASURES)} FROM mf")
Q["M14_recall_by_category"] = Query(lambda s, d: rounded(M.recall_by_category(guess(s, d).withColumn("label", F.when(F.col("category") < 4, 1).otherwise(0)), "label", "prediction", "category"), "recall"), f"WITH {VEC_SQL} SELECT category, count(*) AS n, round(count(*) FILTER (prediction = 1) / count(*) + 1e-9, 6) AS recall FROM vec WHERE category < 4 GROUP BY 1")


def m15(spark, d):
    return M.importances(M.train_boosted(vectors(spark, d), FEATURES), FEATURES, spark)


Q["M15_importances"] = Query(m15)


def m16(spark, d):
    g = guess(spark, d).withColumn("model", F.pmod("vec_id", F.lit(4)))
    m = M.confusion(g, "label", "prediction", ["model"])
    base = M.confusion(g.withColumn("prediction", F.when(F.col("f1") > 0, 1).otherwise(0)), "label", "prediction", ["model"])
    return M.acceptance(m, base, ["model"], min_recall=0.1, min_f1=0.05, max_fpr=0.3).select("model", F.array_join("reasons", ",").alias("reasons"), "accepted")


Q["M16_acceptance_gate"] = Query(m16, f"""WITH {VEC_SQL}, a AS (SELECT *, vec_id % 4 AS model FROM vec), {CONF_SQL.format(by='model,', rows='a', group='GROUP BY model')}, b AS (SELECT model, count(*) FILTER (label = 1 AND f1 > 0) / greatest(1, count(*) FILTER (label = 1)) AS b_recall, count(*) FILTER (label = 0 AND f1 > 0) / greatest(1, count(*) FILTER (label = 0)) AS b_fpr FROM a GROUP BY 1),
r AS (SELECT model, list_filter([CASE WHEN recall < 0.1 THEN 'recall too low' END, CASE WHEN f1 < 0.05 THEN 'f1 too low' END, CASE WHEN fpr > 0.3 THEN 'fpr too high' END, CASE WHEN b_recall - recall > 0.02 THEN 'recall fell' END, CASE WHEN fpr - b_fpr > 0.02 THEN 'fpr rose' END], lambda x: x IS NOT NULL) AS reasons FROM mf JOIN b USING (model)) SELECT model, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM r""")
def j10(spark, d):
    g = guess(spark, d).withColumn("model", F.pmod("vec_id", F.lit(4)))
    measures = lambda p: M.confusion(g.withColumn("prediction", p), "label", "prediction", ["model"])
    new = measures(F.col("prediction")).select("model", F.col("recall").alias("candidate"))
    old = measures(F.when(F.col("f1") > 0, 1).otherwise(0)).select("model", F.col("recall").alias("approved"))
    return rounded(new.join(old, "model"), "candidate", "approved")


Q["J10_candidate_with_approved"] = Query(j10, f"WITH {VEC_SQL} SELECT vec_id % 4 AS model, round(count(*) FILTER (label = 1 AND prediction = 1) / greatest(1, count(*) FILTER (label = 1)) + 1e-9, 6) AS candidate, round(count(*) FILTER (label = 1 AND f1 > 0) / greatest(1, count(*) FILTER (label = 1)) + 1e-9, 6) AS approved FROM vec GROUP BY 1")
def m17(spark, d):
    """Training data as it should be, with two columns of raw events, and with numbered tokens among named ones."""
    li = t(spark, d, "lineitem")
    rows = li.select(F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") == 2, F.lit(None).cast("double")).otherwise(F.col("l_discount")).alias("b"), F.when(F.col("l_linenumber") == 4, float("nan")).otherwise(F.col("l_tax")).alias("c"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 0).otherwise(2).alias("label"))
    raw = rows.withColumns({"comm": F.lit("x"), "tid": F.lit(1)})
    mixed = rows.withColumns({"sc_open": F.lit(1), "sc_12": F.lit(1), "sc_3_4": F.lit(2)})
    found = [M.validate(df, ["a", "b", "c", "z"], tokens="names").withColumn("data", F.lit(name)) for name, df in (("plain", rows), ("raw", raw), ("mixed", mixed))]
    return found[0].unionByName(found[1]).unionByName(found[2])


Q["M17_validate_training_data"] = Query(m17, """WITH x AS (SELECT l_quantity AS a, CASE WHEN l_linenumber <> 2 THEN l_discount END AS b, CASE WHEN l_linenumber = 4 THEN 'NaN'::DOUBLE ELSE l_tax END AS c, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 ELSE 2 END AS label FROM lineitem),
s AS (SELECT count(*) AS rows, 1 AS missing_features, count(*) FILTER (label = 2) AS bad_labels, count(*) FILTER (b IS NULL) AS nulls, count(*) FILTER (isnan(c)) AS not_finite, 0 AS not_numeric, count(*) - count(DISTINCT (a, b, c)) AS repeated_rows, count(DISTINCT label) AS classes FROM x)
SELECT s.*, k.* FROM s, (VALUES (0, 0, true, 'plain'), (2, 0, false, 'raw'), (0, 2, false, 'mixed')) k(raw_columns, mixed_columns, usable, data)""")
Q["M18_split_leakage"] = Query(lambda s, d: rounded(M.split_leakage(t(s, d, "lineitem").where("l_orderkey % 5 <> 0"), t(s, d, "lineitem").where("l_orderkey % 5 = 0"), ["l_quantity", "l_discount", "l_tax"]), "leakage_ratio"), """WITH a AS (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem WHERE l_orderkey % 5 <> 0), b AS (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem WHERE l_orderkey % 5 = 0), o AS (SELECT * FROM a INTERSECT SELECT * FROM b)
SELECT (SELECT count(*) FROM a) AS n_train, (SELECT count(*) FROM b) AS n_val, (SELECT count(*) FROM o) AS overlap, round((SELECT count(*) FROM o) / greatest(1, (SELECT count(*) FROM b)) + 1e-9, 6) AS leakage_ratio""")


def shared_features(spark, d):
    """Structural features of user traces and of document traces, with their labels."""
    links = tok(spark, d)
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("doc_id", F.col("toxic").alias("label"), F.split("text", r"\s+").alias("tokens"))
    early = Wn.latest(t(spark, d, "events"), ["user_id"], [F.asc(c) for c in ORDER], 5).groupBy("user_id").agg(F.max((F.col("event_type") == "error").cast("int")).alias("label"))
    users = Tr.structural_features(links, "user_id", ORDER).join(early, "user_id")
    return users, S.structural_features(docs, "doc_id").join(docs.select("doc_id", "label"), "doc_id")


def m19(spark, d):
    users, docs = map(sinks.stored, shared_features(spark, d))  # each is learned from and judged
    names = list(S.SHARED)
    model, back = M.train_boosted(users, names), M.train_boosted(docs, names)
    one = M.confusion(M.apply_boosted(model, docs, names), "label", "prediction").withColumn("direction", F.lit("users to documents"))
    return one.unionByName(M.confusion(M.apply_boosted(back, users, names), "label", "prediction").withColumn("direction", F.lit("documents to users")))


Q["M19_transfer"] = Query(m19)
Q["M20_schema_overlap"] = Query(lambda s, d: Tr.grams(tok(s, d, "user_id < 30"), "trigram").select("gram").intersect(Tr.grams(tok(s, d, "user_id >= 30"), "trigram").select("gram")), f"WITH {TR_SQL} SELECT a || ' ' || b || ' ' || c AS gram FROM tok WHERE c IS NOT NULL AND user_id < 30 INTERSECT SELECT a || ' ' || b || ' ' || c FROM tok WHERE c IS NOT NULL AND user_id >= 30")


def m21(spark, d):
    """Two runs of the retraining job: each has a ledger row, and a promotion where it is accepted."""
    folder, rows = scratch(spark), vectors(spark, d)
    for step in (0.1, 0.3):
        M.retrain(rows, FEATURES, "vec_id", "label", folder, dataset="vectors", step=step, min_recall=0.05, min_f1=0.05)
    return spark.read.parquet(f"{folder}/ledger").select("run_no", "dataset", "model", "action", "status", "rows", "n_train", "n_test", "leakage_ratio", "recall", "fpr", "f1", F.array_join("reasons", ",").alias("reasons"), (F.length("path") > 0).alias("saved"))


Q["M21_retraining_run"] = Query(m21)
Q["M22_model_ledger"] = Query(lambda s, d: M.active_runs(t(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("ACCEPTED").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "promote").otherwise("append").alias("action"), secs("o_orderdate").alias("at")), ["model"], ["at", "run_id"]),
                               "WITH r AS (SELECT o_orderpriority AS model, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(epoch(o_orderdate)) DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0) SELECT model, max(run_id) FILTER (n = 1) AS active, max(run_id) FILTER (n = 2) AS previous FROM r GROUP BY 1")


# Streams ------------------------------------------------------------------------------------------------------------
def feed(spark, d, parts=3):
    """The events as files that arrive in order of time: ranges of ids, each in several files that come together."""
    path = scratch(spark)
    e = t(spark, d, "events")
    top = e.agg(F.max("event_id").alias("m")).first()["m"] or 0
    for k in range(parts):
        e.where(F.col("event_id").between(k * (top + 1) // parts, (k + 1) * (top + 1) // parts - 1)).repartitionByRange(2, "event_id").write.mode("append").parquet(path)
    return J.read_events(spark, path, 2)


def streamed(spark, df, mode="append"):
    path = scratch(spark)
    J.run(df, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.parquet(f"{path}/out")


def t1(spark, d):
    w = Wn.process_windows(process_events(spark, feed(spark, d)), ["user_id"], "ts", "1 hour", J.WATERMARK)
    return rounded(streamed(spark, w.select("user_id", F.unix_seconds("start_time").alias("start_s"), *W1_COUNTS, *W1_FLOATS, "label")), *W1_FLOATS, digits=4)


def t1b(spark, d):
    w = Wn.feature_windows(flat_events(feed(spark, d)), length="60 minutes", watermark=J.WATERMARK)
    return rounded(streamed(spark, w.select("process_name", F.unix_seconds("start_time").alias("start_s"), *W2_COLUMNS, "cpu_mean", "memory_mean")), "cpu_mean", "memory_mean")


#: A window is closed once an event has come that is later than its end by the watermark.
CLOSED = "(b + 1) * 3600 <= (SELECT max(epoch(ts)) FROM {}) - 600"


def t1_sql():
    fields, one = w1_parts()
    return f"WITH {fields} {one(3600, CLOSED.format('events'))}"


def t1b_sql():
    fields, one = w2_parts()
    return f"WITH {fields} SELECT * EXCLUDE (length) FROM ({one(3600, CLOSED.format('fe'))})"


Q["T1_streamed_windows"] = Query(t1, t1_sql)
Q["T1_streamed_feature_windows"] = Query(t1b, t1b_sql)
#: Keys are idle after two days; their state begins anew then.
IDLE_S = 2 * 86400
LIVES_SQL = f"lives AS (SELECT *, sum(CASE WHEN gap > {IDLE_S} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM (SELECT * REPLACE (date_trunc('milliseconds', ts) AS ts) FROM events)))"
Q["T2_running_stats"] = Query(lambda s, d: rounded(streamed(s, J.running_stats(feed(s, d), "user_id", "value", "event_id", IDLE_S * 1000)), "mean_before", "std_before", digits=4), f"WITH {LIVES_SQL} SELECT user_id, event_id, count(*) OVER w AS n_before, round(coalesce(avg(value) OVER w, 0) + 1e-9, 4) AS mean_before, round(coalesce(stddev_samp(value) OVER w, 0) + 1e-9, 4) AS std_before FROM lives WINDOW w AS (PARTITION BY user_id, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def t3(spark, d):
    # Alerts by their times come as a feed of their own.
    path = scratch(spark)
    rows = sinks.stored(alert_rows(spark, d).select("event_id", "ts", "dedup_key"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).head()
    for k in range(4):  # files one after another, as a feed reads them in the order in which they came
        share = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))) / F.greatest(F.lit(1), F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")))
        rows.where(F.least(F.floor(share * 4), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    return streamed(spark, J.first_alerts(J.read_events(spark, path, 1), ["dedup_key"]).select("dedup_key"))


Q["T3_streamed_alert_dedup"] = Query(t3, lambda: f"WITH {LIVE_SQL}, {ALERT_SQL}, k AS (SELECT {KEY_SQL} AS dedup_key FROM al) SELECT DISTINCT dedup_key FROM k")


def t4(spark, d):
    path = scratch(spark)
    store = LiveScoring(f"{path}/store", models=lambda rows: rows.withColumns({"ml_available": F.lit(True), "if_pred": F.lit(1), "if_score": F.lit(0.1), "xgb_prob": F.lit(0.0), "xgb_attack": F.lit(False)}))
    J.run_batches(live(feed(spark, d)), store.on_batch, f"{path}/checkpoint")
    return store.alerts(spark).select("event_id", "comm", "pid", "risk_score", "risk_category", "dedup_key", "alert_id", "alert_status")


Q["T4_score_and_store"] = Query(t4, lambda: f"WITH {LIVE_SQL}, {ALERT_SQL}, k AS (SELECT *, {KEY_SQL} AS dedup_key FROM al) SELECT event_id, comm, pid, risk_score, risk_category, dedup_key, 'AL-' || left(sha256(dedup_key || ':' || event_id), 16) AS alert_id, 'ACTIVE' AS alert_status FROM k QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ts, event_id) = 1")


def t5(spark, d):
    e = feed(spark, d).withColumn("value", F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 101 == 0, -F.col("value")).otherwise(F.col("value")))
    path = scratch(spark)

    def store(batch, n):
        good, bad = J.split_bad(batch, "value is null or value < 0")
        good.select("event_id").write.mode("overwrite").parquet(f"{path}/good/batch={n}")
        bad.select("event_id").write.mode("overwrite").parquet(f"{path}/bad/batch={n}")

    counters = {"received": F.count("*"), "invalid": F.count_if(F.col("value").isNull()), "failed": F.count_if(F.col("value") < 0)}
    counts = J.run_counted(e, counters, store, f"{path}/checkpoint", f"ingest-{path.rsplit('/', 1)[-1]}")
    stored = spark.read.parquet(f"{path}/good").select(F.lit("stored").alias("kind")).unionByName(spark.read.parquet(f"{path}/bad").select(F.lit("quarantined").alias("kind")))
    observed = spark.createDataFrame(list(counts.items()), "kind string, n long")
    return stored.groupBy("kind").agg(F.count("*").alias("n")).unionByName(observed)


Q["T5_quarantine"] = Query(t5, """WITH e AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN -value ELSE value END AS value FROM events)
SELECT unnest(['received', 'invalid', 'failed', 'stored', 'quarantined']) AS kind, unnest([count(*), count(*) FILTER (value IS NULL), count(*) FILTER (value < 0), count(*) FILTER (value >= 0), count(*) FILTER (value IS NULL OR value < 0)]) AS n FROM e""")
Q["T6_last_tokens_state"] = Query(lambda s, d: streamed(s, J.last_tokens(feed(s, d), "user_id", "event_type", "event_id", idle_ms=IDLE_S * 1000)).select("event_id", "recent"), f"WITH {LIVES_SQL} SELECT event_id, array_to_string(list(event_type) OVER w, ' ') AS recent FROM lives WINDOW w AS (PARTITION BY user_id, life ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)")


def t7(spark, d):
    e = feed(spark, d).withWatermark("ts", J.WATERMARK).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("received"), F.count_if(F.col("event_type") == "error").alias("lost"))
    return streamed(spark, e.select(F.unix_seconds("w.start").alias("start_s"), "received", "lost"))


Q["T7_event_counters"] = Query(t7, f"SELECT b * 3600 AS start_s, count(*) AS received, count(*) FILTER (event_type = 'error') AS lost FROM (SELECT *, floor(epoch(ts) / 3600)::BIGINT AS b FROM events) WHERE {CLOSED.format('events')} GROUP BY b")
Q["T8_exit_closes_state"] = Query(lambda s, d: streamed(s, J.last_tokens(feed(s, d), "user_id", "event_type", "event_id", 1000, "signup", IDLE_S * 1000)).select("event_id", F.size(F.split("recent", " ")).alias("n")), f"WITH {LIVES_SQL} SELECT event_id, count(*) OVER (PARTITION BY user_id, life, g ORDER BY ts, event_id)::INT AS n FROM (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM lives)")


def t9(spark, d):
    path = scratch(spark)
    feeds = J.Newest(f"{path}/events", 500, ["ts", "event_id"]), J.Newest(f"{path}/alerts", 100, ["ts", "event_id"])

    def keep(batch, k):
        rows = batch.select("event_id", "ts", "value", "event_type")
        feeds[0].on_batch(rows, k)
        feeds[1].on_batch(rows.where("event_type = 'error'"), k)

    J.run_batches(feed(spark, d), keep, f"{path}/checkpoint")
    both = [f.rows(spark, f.latest).select(F.lit(name).alias("feed"), "event_id", "value") for f, name in zip(feeds, ("events", "alerts"), strict=True)]
    return both[0].unionByName(both[1])


Q["T9_latest_feed"] = Query(t9, "(SELECT 'events' AS feed, event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) UNION ALL (SELECT 'alerts', event_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100)")
Q["S12_live_feed"] = Query(lambda s, d: streamed(s, feed(s, d).select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
