"""Queries of look-ups, joins, aggregates, set operations and retention over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.classify import risk_status
from hostlens.operators import history as H
from hostlens.operators import retention as Rt
from hostlens.operators import windows as Wn
from hostlens.functions.classify import FAMILY_PARTS, family_by_parts
from hostlens.operators import baseline as B
from hostlens.plans._bind import DET_SQL, FULL_SQL, LINE_SQL, PROC_SQL, WINDOWS_SQL, Query, daily_windows, detections, full_windows, lines, processes, secs, t
from hostlens.plans.behaviour import rounded
from hostlens.sources.sinks import stored

Q: dict[str, Query] = {}
NOW = 1_750_000_000
P, L, DT = f"WITH {PROC_SQL}", f"WITH {LINE_SQL}", f"WITH {LINE_SQL}, {DET_SQL}"
LKEY = ["instance_id", "n", "part", "supp", "end_s"]
LORDER = ", ".join(f"{c} DESC" for c in ["end_s", "instance_id", "n", "part", "supp"])

# Look-ups -----------------------------------------------------------------------------------------------------------
PCOLS = ["instance_id", "profile_id", "comm", "start_s", "end_s", "exit_code"]
Q["Q1_process_by_id"] = Query(lambda s, d: processes(s, d).where("instance_id = 7"), f"{P} SELECT * FROM proc WHERE instance_id = 7")
Q["Q2_processes_by_pid"] = Query(lambda s, d: processes(s, d).where("profile_id = 10 and end_s is null").orderBy(F.desc("start_s"), F.desc("instance_id")), f"{P} SELECT * FROM proc WHERE profile_id = 10 AND end_s IS NULL")
Q["Q3_processes_by_name"] = Query(lambda s, d: H.newest(processes(s, d).where("comm = '1-URGENT'"), "start_s", ["instance_id"], 50), f"{P} SELECT * FROM proc WHERE comm = '1-URGENT' ORDER BY start_s DESC, instance_id DESC LIMIT 50")
Q["Q4_processes_by_program"] = Query(lambda s, d: H.in_range(processes(s, d).where("profile_id between 1 and 40"), "start_s", 800_000_000, 1_700_000_000), f"{P} SELECT * FROM proc WHERE profile_id BETWEEN 1 AND 40 AND start_s BETWEEN 800000000 AND 1700000000")
Q["Q5_events_of_process"] = Query(lambda s, d: H.in_range(lines(s, d).where("instance_id between 1 and 100"), "end_s", 700_000_000).select("instance_id", "n", "part", "supp", "end_s"), f"{L} SELECT instance_id, n, part, supp, end_s FROM line WHERE instance_id BETWEEN 1 AND 100 AND end_s >= 700000000")
Q["Q6_events_in_range"] = Query(lambda s, d: H.in_range(t(s, d, "events").where(F.col("event_type").isin("error", "purchase")).withColumn("at", secs("ts")), "at", 1_704_300_000, 1_705_500_000).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND floor(epoch(ts))::BIGINT BETWEEN 1704300000 AND 1705500000")
Q["Q7_latest_events"] = Query(lambda s, d: H.newest(t(s, d, "events"), "ts", ["event_id"], 100).select("event_id", "user_id", "event_type"), "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
Q["Q8_windows_of_process"] = Query(lambda s, d: H.in_range(lines(s, d).join(processes(s, d).select("instance_id", "start_s"), "instance_id").where("instance_id between 100 and 300"), "start_s", 700_000_000, 1_720_000_000, "end_s").select("instance_id", "n", "part", "start_s", "end_s"), f"WITH {LINE_SQL}, {PROC_SQL} SELECT instance_id, n, part, start_s, line.end_s FROM line JOIN proc USING (instance_id) WHERE instance_id BETWEEN 100 AND 300 AND start_s >= 700000000 AND line.end_s <= 1720000000")
Q["Q9_windows_of_program"] = Query(lambda s, d: daily_windows(s, d).where("profile_id = 5 and day >= '2024-01-05'").select("profile_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "syscall_count"), f"WITH {WINDOWS_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day, syscall_count FROM win WHERE profile_id = 5 AND day >= DATE '2024-01-05'")
Q["Q10_clean_windows"] = Query(lambda s, d: H.clean_windows(daily_windows(s, d), "label_binary").select("profile_id", F.date_format("day", "yyyy-MM-dd").alias("day")), f"WITH {WINDOWS_SQL} SELECT profile_id, strftime(day, '%Y-%m-%d') AS day FROM win WHERE label_binary IS NULL OR label_binary = 0")
Q["Q11_latest_detections"] = Query(lambda s, d: H.newest(detections(s, d), "end_s", ["instance_id", "n", "part", "supp"], 50).select(*LKEY, "risk_score"), f"{DT} SELECT {', '.join(LKEY)}, risk_score FROM det ORDER BY {LORDER} LIMIT 50")
Q["Q12_detections_of_instance"] = Query(lambda s, d: detections(s, d).where("instance_id between 1 and 50").orderBy("end_s").select(*LKEY, "is_anomaly"), f"{DT} SELECT {', '.join(LKEY)}, is_anomaly FROM det WHERE instance_id BETWEEN 1 AND 50")


def versions(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("profile_id"), F.year("o_orderdate").alias("version")).agg(F.count("*").alias("n"), F.max(secs("o_orderdate")).alias("updated_s"))


VER_SQL = "ver AS (SELECT o_custkey AS profile_id, year(o_orderdate)::INT AS version, count(*) AS n, max(epoch(o_orderdate)::BIGINT) AS updated_s FROM orders GROUP BY 1, 2)"
Q["Q13_profile_latest_version"] = Query(lambda s, d: Wn.latest(versions(s, d), ["profile_id"], [F.desc("version")]), f"WITH {VER_SQL} SELECT * FROM ver QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY version DESC) = 1")
Q["Q14_recent_profiles"] = Query(lambda s, d: versions(s, d).orderBy(F.desc("updated_s"), "profile_id", "version").limit(25), f"WITH {VER_SQL} SELECT * FROM ver ORDER BY updated_s DESC, profile_id, version LIMIT 25")
Q["Q15_active_alerts"] = Query(lambda s, d: H.newest(t(s, d, "events").where("event_type = 'error' and value > 100"), "ts", ["event_id"], 50).select("event_id", "value"), "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 100 ORDER BY ts DESC, event_id DESC LIMIT 50")
Q["Q16_alert_page"] = Query(lambda s, d: H.page(t(s, d, "events").where("event_type = 'error'"), [F.desc("ts"), F.desc("event_id")], 40, 20).select("event_id", "total"), "SELECT event_id, total FROM (SELECT event_id, ts, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error') ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
Q["Q17_alert_by_id"] = Query(lambda s, d: t(s, d, "events").withColumn("alert_id", F.concat(F.lit("AL-"), F.col("event_id"))).where((F.col("alert_id") == "AL-77") & F.col("alert_id").rlike("^AL-[0-9]+$")).select("alert_id", "event_type"), "SELECT 'AL-' || event_id AS alert_id, event_type FROM events WHERE event_id = 77")
# The live feed: programs and users by turns, gauges from the value.
FEED_COMMS, FEED_USERS = ["nginx", "sshd", "dockerd", "kworker", "python3", "bash", "systemd", "redis-server", "curl"], ["root", "alice", "", "system"]


def live_feed(spark, d):
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    e = ev(spark, d).withColumns({"comm": at(FEED_COMMS), "user": at(FEED_USERS), "pid": F.col("user_id"), "eventType": F.when(F.col("event_type") == "purchase", "socket_connect").otherwise(F.col("event_type"))})
    return e.withColumns({"cpu": F.col("value") / 10, "mem": F.col("value") * 2, "net_kb": F.col("value") / 4, "syscalls": F.floor(F.col("value") * 10), "status": F.col("st"), "family": family_by_parts("comm", "user"), "threads": (F.col("event_id") % 8 + 1).cast("int")})


HAS_SQL = {k: " OR ".join(f"contains(lower(comm), '{p}')" for p in v.split()) for k, v in FAMILY_PARTS.items()}
FEED_SQL = f"""{{EV}}, f0 AS (SELECT *, [{', '.join(f"'{x}'" for x in FEED_COMMS)}][event_id % {len(FEED_COMMS)} + 1] AS comm, [{', '.join(f"'{x}'" for x in FEED_USERS)}][event_id % {len(FEED_USERS)} + 1] AS usr, user_id AS pid,
CASE event_type WHEN 'purchase' THEN 'socket_connect' ELSE event_type END AS etype, value / 10 AS cpu, value * 2 AS mem, value / 4 AS net_kb, floor(value * 10)::BIGINT AS syscalls, (event_id % 8 + 1)::INT AS threads FROM ev),
feed AS (SELECT *, CASE WHEN {HAS_SQL['nginx']} THEN 'nginx' WHEN {HAS_SQL['dockerd']} THEN 'dockerd' WHEN {HAS_SQL['bash']} OR usr = 'alice' THEN 'bash' ELSE 'systemd' END AS family FROM f0)"""
Q["Q18_feed_search"] = Query(lambda s, d: H.feed_search(live_feed(s, d), "UR", "nginx", "cpu").select("event_id", "comm", "user", "family").withColumnRenamed("user", "usr").unionByName(H.feed_search(live_feed(s, d), "", "bash", "network").select("event_id", "comm", F.col("user").alias("usr"), "family")).unionByName(H.feed_search(live_feed(s, d), "ali", "", "anomalies").select("event_id", "comm", F.col("user").alias("usr"), "family")),
                            lambda: f"""WITH {FEED_SQL.replace('{EV}', EV_SQL)} SELECT event_id, comm, usr, family FROM feed WHERE (contains(lower(comm), 'ur') OR contains(lower(usr), 'ur') OR contains(pid::VARCHAR, 'ur') OR contains(lower(etype), 'ur')) AND (family = 'nginx' OR contains(comm, 'nginx')) AND cpu > 2
UNION ALL SELECT event_id, comm, usr, family FROM feed WHERE (family = 'bash' OR contains(comm, 'bash')) AND (etype = 'socket_connect' OR comm IN ('nginx', 'sshd', 'curl'))
UNION ALL SELECT event_id, comm, usr, family FROM feed WHERE (contains(lower(comm), 'ali') OR contains(lower(usr), 'ali') OR contains(pid::VARCHAR, 'ali') OR contains(lower(etype), 'ali')) AND st = 'ANOMALOUS'""")
Q["Q19_include_exclude"] = Query(lambda s, d: t(s, d, "pages").where(~F.col("url").startswith("https://www.") & ~F.element_at(F.split("url", "/"), 3).isin("example.com", "example.org")).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'https://www.') AND split_part(url, '/', 3) NOT IN ('example.com', 'example.org')")
Q["Q20_drop_idle_windows"] = Query(lambda s, d: daily_windows(s, d).where("syscalls_network + syscalls_process + syscalls_sensitive > 0").groupBy("profile_id").agg(F.count("*").alias("n")), f"WITH {WINDOWS_SQL} SELECT profile_id, count(*) AS n FROM win WHERE syscalls_network + syscalls_process + syscalls_sensitive > 0 GROUP BY 1")
Q["Q21_most_active_per_snapshot"] = Query(lambda s, d: H.top_per_group(daily_windows(s, d), ["day"], [F.desc("syscall_count"), F.desc("memory_usage"), F.asc("profile_id")], 3).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "profile_id", "place"), f"WITH {WINDOWS_SQL} SELECT strftime(day, '%Y-%m-%d') AS day, profile_id, place::INT AS place FROM (SELECT day, profile_id, row_number() OVER (PARTITION BY day ORDER BY syscall_count DESC, memory_usage DESC, profile_id) AS place FROM win) WHERE place <= 3")

# Joins --------------------------------------------------------------------------------------------------------------


def j1(spark, d):
    # A customer is as a pid that one order after another uses: events know the pid only, and find the lifetimes they fall into.
    p = processes(spark, d).select("instance_id", F.col("profile_id").alias("pid"), "start_s", "end_s")
    e = lines(spark, d).join(p.select("instance_id", "pid"), "instance_id").select("pid", F.col("instance_id").alias("line_of"), "n", "part", "supp", F.col("end_s").alias("at_s"))
    return H.interval_join(e, p, ["pid"], "at_s", "start_s", "end_s").select("pid", "line_of", "n", "part", "supp", "at_s", "instance_id")


Q["J1_event_to_instance"] = Query(j1, f"""WITH {LINE_SQL}, {PROC_SQL}, e AS (SELECT profile_id AS pid, instance_id AS line_of, n, part, supp, line.end_s AS at_s FROM line JOIN proc USING (instance_id))
SELECT pid, line_of, n, part, supp, at_s, instance_id FROM e JOIN proc ON pid = profile_id WHERE at_s >= start_s AND at_s < coalesce(proc.end_s, 4611686018427387904)""")
TREE_SQL = "tree AS (SELECT instance_id, instance_id - instance_id % 7 AS parent_instance_id FROM proc)"
Q["J2_children_of_parent"] = Query(lambda s, d: H.children(processes(s, d).withColumn("parent_instance_id", F.col("instance_id") - F.col("instance_id") % 7))[1],
                                   f"WITH {PROC_SQL}, {TREE_SQL}, e AS (SELECT c.parent_instance_id AS parent FROM tree c JOIN proc p ON p.instance_id = c.parent_instance_id WHERE c.parent_instance_id <> c.instance_id) SELECT instance_id, (SELECT count(*) FROM e WHERE e.parent = proc.instance_id) AS children FROM proc")


def j3(spark, d):
    e = t(spark, d, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").cast("string").alias("label"))
    return Wn.label_in_force(e.where("event_type = 'error'").select("user_id", "ts", "event_id"), marks, ["user_id"], "ts").select("event_id", F.col("label_in_force").cast("long").alias("label"))


Q["J3_label_in_force"] = Query(j3, "SELECT e.event_id, l.event_id AS label FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') l ON e.user_id = l.user_id AND e.ts >= l.ts")
Q["J5_lifecycle_summary"] = Query(lambda s, d: rounded(H.lifecycle_summary(processes(s, d), lines(s, d), lines(s, d).where("status = 'F'"), detections(s, d), NOW).select("instance_id", "status", "duration_s", "total_windows", "total_events", "detections", "peak_cpu", "avg_cpu", "max_risk"), "peak_cpu", "avg_cpu", "max_risk"),
                                  f"""WITH {LINE_SQL}, {DET_SQL}, {PROC_SQL}, w AS (SELECT instance_id, count(*) AS total_windows, max(cpu_usage) AS peak_cpu, avg(cpu_usage) AS avg_cpu, count(*) FILTER (status = 'F') AS total_events FROM line GROUP BY 1), x AS (SELECT instance_id, count(*) AS detections, max(risk_score) AS max_risk FROM det GROUP BY 1)
SELECT instance_id, CASE WHEN end_s IS NULL THEN 'RUNNING' WHEN exit_code <> 0 THEN 'CRASHED' ELSE 'TERMINATED' END AS status, greatest(0, coalesce(end_s, {NOW}) - start_s) AS duration_s, coalesce(total_windows, 0) AS total_windows, coalesce(total_events, 0) AS total_events, coalesce(detections, 0) AS detections, round(coalesce(peak_cpu, 0) + 1e-9, 6) AS peak_cpu, round(coalesce(avg_cpu, 0) + 1e-9, 6) AS avg_cpu, round(coalesce(max_risk, 0) + 1e-9, 6) AS max_risk FROM proc LEFT JOIN w USING (instance_id) LEFT JOIN x USING (instance_id)""")


def j6(spark, d):
    p = processes(spark, d)
    n = p.groupBy("profile_id").agg(F.count("*").alias("instances"), F.min("start_s").alias("first_s"), F.max("start_s").alias("last_s"))
    w = lines(spark, d).join(p.select("instance_id", "profile_id"), "instance_id").groupBy("profile_id").agg(F.count("*").alias("windows"), F.count_if(F.col("flag") == "R").alias("detections"))
    v = Wn.latest(versions(spark, d), ["profile_id"], [F.desc("version")]).select("profile_id", "version")
    return n.join(w, "profile_id", "left").join(v, "profile_id", "left").select("profile_id", "instances", "first_s", "last_s", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("detections", F.lit(0)).alias("detections"), "version")


Q["J6_program_history"] = Query(j6, f"""WITH {LINE_SQL}, {PROC_SQL}, {VER_SQL}, n AS (SELECT profile_id, count(*) AS instances, min(start_s) AS first_s, max(start_s) AS last_s FROM proc GROUP BY 1), w AS (SELECT profile_id, count(*) AS windows, count(*) FILTER (flag = 'R') AS detections FROM line JOIN proc USING (instance_id) GROUP BY 1), v AS (SELECT profile_id, max(version) AS version FROM ver GROUP BY 1)
SELECT profile_id, instances, first_s, last_s, coalesce(windows, 0) AS windows, coalesce(detections, 0) AS detections, version FROM n LEFT JOIN w USING (profile_id) LEFT JOIN v USING (profile_id)""")
Q["J7_anti_join_with_nulls"] = Query(lambda s, d: processes(s, d).join(detections(s, d).select(F.when(F.col("instance_id") % 2 == 0, F.col("instance_id")).alias("instance_id")), "instance_id", "left_anti").select("instance_id"),
                                     f"WITH {LINE_SQL}, {DET_SQL}, {PROC_SQL} SELECT instance_id FROM proc p WHERE NOT EXISTS (SELECT 1 FROM det x WHERE CASE WHEN x.instance_id % 2 = 0 THEN x.instance_id END = p.instance_id)")


def j9(spark, d):
    dim = spark.createDataFrame([("click", "file", False), ("view", "file", False), ("purchase", "network", False), ("signup", "process", False)], "syscall string, category string, sensitive boolean")
    hist = t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    win = daily_windows(spark, d).select(F.col("profile_id").alias("user_id"), "day", "syscall_count")
    rows = hist.join(win, ["user_id", "day"]).join(F.broadcast(dim), F.col("event_type") == F.col("syscall"), "left")
    return rows.groupBy("user_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.sum("n").alias("n"), F.sum("syscall_count").alias("of"))


Q["J9_histogram_with_dimension"] = Query(j9, f"""WITH {WINDOWS_SQL}, h AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT user_id, CASE event_type WHEN 'click' THEN 'file' WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'network' WHEN 'signup' THEN 'process' ELSE 'other' END AS category, sum(n)::BIGINT AS n, sum(syscall_count)::BIGINT AS of FROM h JOIN win ON h.user_id = win.profile_id AND h.day = win.day GROUP BY 1, 2""")


def snapshots(spark, d):
    return t(spark, d, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("snap")).distinct()


SNAP_SQL = "snaps AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS snap FROM events)"
CONN_SQL = "conn AS (SELECT DISTINCT user_id, event_id % 5 AS dst_port, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS snap FROM events WHERE event_type IN ('purchase', 'view'))"


def j11(spark, d):
    """Processes that start and exit between snapshots; connections first seen and seen again, without and with forgetting."""
    seen = t(spark, d, "events").where("event_type IN ('purchase', 'view')").select("user_id", (F.col("event_id") % 5).alias("dst_port"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("snap"))
    again = H.connection_events(seen, ["user_id", "dst_port"], "snap", forget=3)
    changes = H.snapshot_changes(snapshots(spark, d), "user_id", "snap").withColumn("dst_port", F.lit(None).cast("long"))
    return changes.unionByName(H.connection_events(seen, ["user_id", "dst_port"], "snap")).unionByName(again.withColumn("change", F.concat("change", F.lit(" again"))))


Q["J11_snapshot_changes"] = Query(j11, f"""WITH {SNAP_SQL}, {CONN_SQL}, x AS (SELECT user_id, snap, lag(snap) OVER w AS p, lead(snap) OVER w AS n, (SELECT max(snap) FROM snaps) AS last FROM snaps WINDOW w AS (PARTITION BY user_id ORDER BY snap))
SELECT user_id, snap, 'START' AS change, NULL::BIGINT AS dst_port FROM x WHERE p IS NULL OR p < snap - 1 UNION ALL SELECT user_id, (snap + 1)::INT, 'EXIT', NULL FROM x WHERE (n IS NULL OR n > snap + 1) AND snap < last
UNION ALL SELECT user_id, snap, CASE WHEN snap = min(snap) OVER (PARTITION BY user_id, dst_port) THEN 'CONNECT' ELSE 'STATUS' END, dst_port FROM conn
UNION ALL SELECT user_id, snap, CASE WHEN snap - lag(snap, 1, -100) OVER (PARTITION BY user_id, dst_port ORDER BY snap) > 4 THEN 'CONNECT again' ELSE 'STATUS again' END, dst_port FROM conn""")


def j12(spark, d):
    e = live_feed(spark, d).withColumn("family", F.when(F.col("event_id") % 3 == 0, F.col("family")))
    base = B.live_profiles(live_feed(spark, d).where("comm <> 'bash'"), "comm", F.when(F.col("comm") != "curl", "known"), "event_type").select("comm", F.col("cpu_avg").alias("mean"), "family")
    return rounded(H.current_with_baseline(e, base, "comm", ["ts", "event_id"], family_by_parts("comm", F.lit(""))), "current", "mean", "share")


Q["J12_current_with_baseline"] = Query(j12, lambda: f"""WITH {FEED_SQL.replace('{EV}', EV_SQL)}, n AS (SELECT comm, arg_max(cpu, (ts, event_id)) AS current, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(family, (ts, event_id)) AS fam FROM feed GROUP BY 1), b AS (SELECT comm, avg(cpu) AS mean FROM feed WHERE comm <> 'bash' GROUP BY 1)
SELECT n.comm, round(current + 1e-9, 6) AS current, round(mean + 1e-9, 6) AS mean, round(least(100.0, current / coalesce(nullif(mean * 2.5, 0), 5.0) * 100) + 1e-9, 6) AS share,
CASE WHEN last_id % 3 = 0 THEN fam WHEN b.comm IS NOT NULL AND n.comm <> 'curl' THEN 'known' WHEN {HAS_SQL['nginx'].replace('comm', 'n.comm')} THEN 'nginx' WHEN {HAS_SQL['dockerd'].replace('comm', 'n.comm')} THEN 'dockerd' WHEN {HAS_SQL['bash'].replace('comm', 'n.comm')} THEN 'bash' ELSE 'systemd' END AS family FROM n LEFT JOIN b USING (comm)""")

# Aggregates ---------------------------------------------------------------------------------------------------------
A1_FLOATS = ("total_duration_s", "total_bytes_read", "peak_cpu", "avg_cpu", "peak_memory")
A1_SQL = "count(*) AS total_windows, sum(duration_s) AS total_duration_s, sum(syscall_count)::BIGINT AS total_syscalls, max(cpu_usage) AS peak_cpu, avg(cpu_usage) AS avg_cpu, max(memory_usage) AS peak_memory, max(memory_rss_bytes) AS peak_memory_rss, sum(bytes_read) AS total_bytes_read, sum(bytes_written)::BIGINT AS total_bytes_written, sum(tcp_tx_bytes + udp_tx_bytes)::BIGINT AS total_net_tx, sum(tcp_rx_bytes)::BIGINT AS total_net_rx, sum(child_process_count)::BIGINT AS total_children, sum(exec_count)::BIGINT AS total_execs, sum(syscalls_sensitive)::BIGINT AS total_sensitive_syscalls, max(unique_files) AS max_unique_files, max(unique_dest_ips) AS max_unique_ips, min(start_s) AS first_window_start, max(end_s) AS last_window_end"
Q["A1_instance_metrics"] = Query(lambda s, d: rounded(H.instance_metrics(full_windows(s, d)), *A1_FLOATS, digits=4), f"{L}, {FULL_SQL} SELECT * REPLACE ({', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in A1_FLOATS)}) FROM (SELECT instance_id, {A1_SQL} FROM fullw GROUP BY 1)")


def a2(spark, d):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(processes(spark, d).where("end_s is null"), "active").crossJoin(one(t(spark, d, "events"), "total_events")).crossJoin(one(lines(spark, d), "total_windows")).crossJoin(one(detections(spark, d).where("is_anomaly"), "total_anomalies"))


Q["A2_activity_overview"] = Query(a2, f"WITH {LINE_SQL}, {DET_SQL}, {PROC_SQL} SELECT (SELECT count(*) FROM proc WHERE end_s IS NULL) AS active, (SELECT count(*) FROM events) AS total_events, (SELECT count(*) FROM line) AS total_windows, (SELECT count(*) FROM det WHERE is_anomaly) AS total_anomalies")
Q["A3_top_programs"] = Query(lambda s, d: rounded(daily_windows(s, d).groupBy("profile_id").agg(F.count("*").alias("n"), F.avg("cpu_usage").alias("avg_cpu")).orderBy(F.desc("n"), "profile_id").limit(10), "avg_cpu", digits=2), f"WITH {WINDOWS_SQL} SELECT profile_id, count(*) AS n, round(avg(cpu_usage) + 1e-9, 2) AS avg_cpu FROM win GROUP BY 1 ORDER BY n DESC, profile_id LIMIT 10")
Q["A4_instances_per_program"] = Query(lambda s, d: processes(s, d).groupBy("profile_id").agg(F.count("*").alias("n")), f"{P} SELECT profile_id, count(*) AS n FROM proc GROUP BY 1")


def a5(spark, d):
    last = F.lit(1_706_000_000)  # a fixed moment inside the data; programs without rows in the week before it show all
    summary, _ = H.process_history(live_feed(spark, d), ["user_id"], "ts", "event_id", last, days=7, limit=40)
    return rounded(summary, "avg_cpu", "peak_cpu", "min_cpu", "avg_mem", "peak_mem", "min_mem", "avg_net_kb", "peak_net_kb", digits=4)


ST_SQL = "CASE WHEN risk >= 70 THEN 'ANOMALOUS' WHEN risk >= 40 THEN 'SUSPICIOUS' ELSE 'SAFE' END"
EV_SQL = f"ev AS (SELECT *, {ST_SQL} AS st FROM (SELECT *, least(99, floor(value / 3))::INT AS risk FROM events))"
Q["A5_process_history"] = Query(a5, lambda: f"""WITH {FEED_SQL.replace('{EV}', EV_SQL)}, x AS (SELECT *, floor(epoch(ts)) >= 1706000000 - 7 * 86400 AS fresh FROM feed), y AS (SELECT *, bool_or(fresh) OVER (PARTITION BY user_id) AS recent FROM x),
z AS (SELECT * FROM y WHERE fresh OR NOT recent QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 40)
SELECT user_id, count(*) AS total_snapshots, {', '.join(f"round({f}({c}) + 1e-9, 4) AS {k}_{n}" for n, c in (("cpu", "cpu"), ("mem", "mem")) for k, f in (("avg", "avg"), ("peak", "max"), ("min", "min")))}, round(avg(net_kb) + 1e-9, 4) AS avg_net_kb, round(max(net_kb) + 1e-9, 4) AS peak_net_kb,
floor(avg(syscalls))::BIGINT AS avg_syscalls, max(syscalls) AS peak_syscalls, count(*) FILTER (st IN ('ANOMALOUS', 'SUSPICIOUS') OR risk >= 40) AS anomaly_count, arg_max(st, (ts, event_id)) AS latest_status, arg_max(risk, (ts, event_id)) AS latest_risk FROM z GROUP BY 1""")


def ev(spark, d):
    return t(spark, d, "events").withColumn("risk", F.least(F.lit(99), F.floor(F.col("value") / 3)).cast("int")).withColumn("st", risk_status("risk"))


LAST = "ORDER BY ts DESC, event_id DESC LIMIT"
Q["A6_normalcy_percent"] = Query(lambda s, d: H.normalcy(ev(s, d), "st", [F.desc("ts"), F.desc("event_id")]), f"WITH {EV_SQL} SELECT greatest(50, least(99, 100 - floor(count(*) FILTER (st = 'ANOMALOUS') * 100 / count(*))))::INT AS normalcy FROM (SELECT * FROM ev {LAST} 500)")
Q["A7_status_counts"] = Query(lambda s, d: ev(s, d).agg(F.count_if(F.col("st") == "ANOMALOUS").alias("anomalous"), F.count_if(F.col("st") == "SUSPICIOUS").alias("suspicious"), F.count_if(F.col("value").isNull()).alias("invalid")), f"WITH {EV_SQL} SELECT count(*) FILTER (st = 'ANOMALOUS') AS anomalous, count(*) FILTER (st = 'SUSPICIOUS') AS suspicious, count(*) FILTER (value IS NULL) AS invalid FROM ev")


def a8(spark, d):
    pct = lambda c: F.floor(F.count_if(c) / F.count("*") * 100 + 0.5)
    rows = ev(spark, d).agg(pct(F.col("st") == "ANOMALOUS").alias("anomalous"), pct((F.col("st") == "SUSPICIOUS") | F.col("risk").between(40, 69)).alias("suspicious"), pct((F.col("event_type") == "view") & (F.col("st") == "SAFE")).alias("system"))
    return rows.withColumns({"user": F.greatest(F.lit(0), 100 - F.col("anomalous") - F.col("suspicious") - F.col("system")), "health": F.greatest(F.lit(15), 100 - (F.col("anomalous") * 6 + F.col("suspicious") * 2))})


Q["A8_gauge_shares"] = Query(a8, f"""WITH {EV_SQL}, g AS (SELECT floor(count(*) FILTER (st = 'ANOMALOUS') / count(*) * 100 + 0.5)::BIGINT AS anomalous, floor(count(*) FILTER (st = 'SUSPICIOUS' OR risk BETWEEN 40 AND 69) / count(*) * 100 + 0.5)::BIGINT AS suspicious, floor(count(*) FILTER (event_type = 'view' AND st = 'SAFE') / count(*) * 100 + 0.5)::BIGINT AS system FROM ev)
SELECT *, greatest(0, 100 - anomalous - suspicious - system) AS user, greatest(15, 100 - (anomalous * 6 + suspicious * 2)) AS health FROM g""")
Q["A9_threat_distribution"] = Query(lambda s, d: ev(s, d).agg(F.count_if((F.col("st") == "SAFE") & (F.col("event_type") != "view")).alias("user"), F.count_if(F.col("st") == "SUSPICIOUS").alias("suspicious"), F.count_if(F.col("st") == "ANOMALOUS").alias("anomalous"), F.count("*").alias("total")), f"WITH {EV_SQL} SELECT count(*) FILTER (st = 'SAFE' AND event_type <> 'view') AS user, count(*) FILTER (st = 'SUSPICIOUS') AS suspicious, count(*) FILTER (st = 'ANOMALOUS') AS anomalous, count(*) AS total FROM ev")
Q["A10_recent_risk"] = Query(lambda s, d: rounded(H.recent_risk(ev(s, d), "risk", [F.desc("ts"), F.desc("event_id")]), "mean_risk"), f"WITH {EV_SQL} SELECT round(avg(risk) + 1e-9, 6) AS mean_risk, round(avg(risk) / 20 + 1e-9, 2) AS trend FROM (SELECT * FROM ev {LAST} 12)")
FAMILIES = ["systemd", "nginx", "bash", "dockerd"]
Q["A11_family_counts"] = Query(lambda s, d: H.family_counts(live_feed(s, d).withColumn("day", F.to_date("ts").cast("string")), ["day"], F.col("family"), FAMILIES, F.when(F.col("threads") < 8, F.col("threads"))), lambda: f"WITH {FEED_SQL.replace('{EV}', EV_SQL)} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {', '.join(f"count(*) FILTER (family = '{x}') AS n_{x}" for x in FAMILIES)}, count(*) AS process_count, sum(CASE WHEN threads < 8 THEN threads ELSE 1 END)::BIGINT AS thread_count FROM feed GROUP BY 1")
Q["A18_distinct_programs"] = Query(lambda s, d: H.programs(processes(s, d), daily_windows(s, d)).orderBy("profile_id"), f"{P} SELECT profile_id FROM proc UNION SELECT user_id FROM events")
Q["A20_keep_top_profiles"] = Query(lambda s, d: t(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(100), "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 100")

# Sets ---------------------------------------------------------------------------------------------------------------
Q["U1_union_distinct"] = Query(lambda s, d: t(s, d, "orders").select(F.col("o_custkey").alias("id")).union(t(s, d, "events").select("user_id")).where("id is not null").distinct().orderBy("id"), "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
Q["U2_intersection"] = Query(lambda s, d: t(s, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_quantity").intersect(t(s, d, "lineitem").where("l_returnflag = 'A'").select("l_partkey", "l_quantity")), "SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'")
Q["U3_snapshot_difference"] = Query(lambda s, d: snapshots(s, d).where("snap = 3").select("user_id").exceptAll(snapshots(s, d).where("snap = 2").select("user_id")), f"WITH {SNAP_SQL} SELECT user_id FROM snaps WHERE snap = 3 EXCEPT SELECT user_id FROM snaps WHERE snap = 2")
Q["U4_pooled_sets"] = Query(lambda s, d: t(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind")).unionByName(t(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"))).groupBy("nation", "kind").agg(F.count("*").alias("n")), "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1, 2")

# Retention ----------------------------------------------------------------------------------------------------------
AT = 1_000_000_000
POLICY = Rt.Policy(events=800, windows=1200, metrics=1000, detections=700, processes=900)
C = {k: AT - getattr(POLICY, k) * Rt.DAY for k in ("events", "windows", "metrics", "detections", "processes")}
FLAG_SQL = f"{DT}, {PROC_SQL}, flagged AS (SELECT DISTINCT instance_id FROM det WHERE is_anomaly AND end_s >= {C['detections']}), named AS (SELECT DISTINCT {', '.join(LKEY)} FROM det)"
R1_SQL = f"r1 AS (SELECT * FROM line l WHERE end_s < {C['events']} AND NOT EXISTS (SELECT 1 FROM flagged f WHERE f.instance_id = l.instance_id))"
R2_SQL = f"r2 AS (SELECT * FROM line l WHERE end_s < {C['windows']} AND NOT EXISTS (SELECT 1 FROM named x WHERE x.instance_id = l.instance_id AND x.n = l.n AND x.part = l.part AND x.supp = l.supp AND x.end_s = l.end_s) AND NOT EXISTS (SELECT 1 FROM flagged f WHERE f.instance_id = l.instance_id))"
LS = ", ".join(LKEY)


def expired(spark, d):
    """What goes from each table, worked out when it is asked for."""
    li, de, pr = lines(spark, d), detections(spark, d), processes(spark, d)
    go = {"events": lambda: Rt.expired_events(li, de, POLICY, AT), "windows": lambda: Rt.expired_windows(li, de, POLICY, AT, LKEY), "metrics": lambda: Rt.expired_metrics(li, POLICY, AT), "detections": lambda: Rt.expired_detections(de, POLICY, AT)}
    # What the other tables keep is written down once, as instances, before processes are looked up in it.
    left = lambda: [stored(Rt.kept(df, go[name](), LKEY).select("instance_id").distinct()) for name, df in (("events", li), ("windows", li), ("detections", de))]
    return go | {"processes": lambda: Rt.expired_processes(pr, left(), POLICY, AT)}


R5_SQL = f"""r5 AS (SELECT instance_id FROM proc p WHERE end_s IS NOT NULL AND end_s < {C['processes']} AND NOT EXISTS (SELECT 1 FROM line l WHERE l.instance_id = p.instance_id AND ({LS.replace('instance_id', 'l.instance_id')}) NOT IN (SELECT {LS} FROM r1))
AND NOT EXISTS (SELECT 1 FROM line l WHERE l.instance_id = p.instance_id AND ({LS.replace('instance_id', 'l.instance_id')}) NOT IN (SELECT {LS} FROM r2)) AND NOT EXISTS (SELECT 1 FROM det x WHERE x.instance_id = p.instance_id AND x.end_s >= {C['detections']}))"""
Q["R1_expired_events"] = Query(lambda s, d: expired(s, d)["events"]().select(*LKEY), f"{FLAG_SQL}, {R1_SQL} SELECT {LS} FROM r1")
Q["R2_expired_windows"] = Query(lambda s, d: expired(s, d)["windows"]().select(*LKEY), f"{FLAG_SQL}, {R2_SQL} SELECT {LS} FROM r2")
Q["R3_expired_metrics"] = Query(lambda s, d: expired(s, d)["metrics"]().select(*LKEY), f"{L} SELECT {LS} FROM line WHERE end_s < {C['metrics']}")
Q["R4_expired_detections"] = Query(lambda s, d: expired(s, d)["detections"]().select(*LKEY), f"{DT} SELECT {LS} FROM det WHERE end_s < {C['detections']}")
Q["R5_expired_processes"] = Query(lambda s, d: expired(s, d)["processes"]().select("instance_id"), f"{FLAG_SQL}, {R1_SQL}, {R2_SQL}, {R5_SQL} SELECT instance_id FROM r5")


def r6(spark, d):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in ((k, go()) for k, go in expired(spark, d).items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


Q["R6_retention_dry_run"] = Query(r6, f"{FLAG_SQL}, {R1_SQL}, {R2_SQL}, {R5_SQL} SELECT 'events' AS name, (SELECT count(*) FROM r1) AS n UNION ALL SELECT 'windows', (SELECT count(*) FROM r2) UNION ALL SELECT 'metrics', (SELECT count(*) FROM line WHERE end_s < {C['metrics']}) UNION ALL SELECT 'detections', (SELECT count(*) FROM det WHERE end_s < {C['detections']}) UNION ALL SELECT 'processes', (SELECT count(*) FROM r5)")


def r7(spark, d):
    """Retention run on tables partitioned by month: what each keeps, and how many of its partitions were left alone."""
    from hostlens.sources import sinks

    folder, de = sinks.scratch(spark), detections(spark, d)
    source = {"events": lines(spark, d), "windows": lines(spark, d), "metrics": lines(spark, d), "detections": de}
    expire = {
        "events": lambda old: Rt.expired_events(old, de, POLICY, AT), "windows": lambda old: Rt.expired_windows(old, de, POLICY, AT, LKEY),
        "metrics": lambda old: Rt.expired_metrics(old, POLICY, AT), "detections": lambda old: Rt.expired_detections(old, POLICY, AT),
    }
    out = None
    for name, rows in source.items():
        path = f"{folder}/{name}"
        sinks.append(rows.withColumn("end_ts", F.timestamp_seconds("end_s")), path, "end_ts", every="year")
        Rt.expire_table(spark, path, C[name], expire[name])
        kept = spark.read.parquet(path)
        sums = kept.agg(F.lit(name).alias("name"), F.count("*").alias("n_kept"), F.sum("part").alias("part_sum"), F.min("end_s").alias("oldest"), F.count_distinct("date").alias("partitions"))
        out = sums if out is None else out.unionByName(sums)
    return out


KEPT_SQL = "SELECT '{}' AS name, count(*) AS n_kept, sum(part)::BIGINT AS part_sum, min(end_s) AS oldest, count(DISTINCT year(to_timestamp(end_s))) AS partitions FROM {} x WHERE {}"
NOT_IN = "NOT EXISTS (SELECT 1 FROM {r} r WHERE " + " AND ".join(f"r.{c} = x.{c}" for c in LKEY) + ")"
Q["R6_retention_run"] = Query(r7, f"{FLAG_SQL}, {R1_SQL}, {R2_SQL} " + " UNION ALL ".join([KEPT_SQL.format("events", "line", NOT_IN.format(r="r1")), KEPT_SQL.format("windows", "line", NOT_IN.format(r="r2")), KEPT_SQL.format("metrics", "line", f"end_s >= {C['metrics']}"), KEPT_SQL.format("detections", "det", f"end_s >= {C['detections']}")]))


# Sinks whose result is a table --------------------------------------------------------------------------------------
def k1(spark, d):
    """A table of processes by buckets of their ids, and a batch of news that is merged into it, twice."""
    from hostlens.sources import sinks

    more = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs]))
    p = processes(spark, d).select("instance_id", "comm", "end_s", "exit_code", "profile_id")
    old = p.where("instance_id % 3 <> 0").select("instance_id", "comm", "end_s", "exit_code", more(("by", F.col("profile_id")), ("seen", F.lit("old"))).alias("metadata"))
    new = p.where("instance_id % 2 = 0").select(
        "instance_id", F.when(F.col("instance_id") % 4 == 0, F.concat("comm", F.lit("!"))).alias("comm"), (F.col("end_s") + 1).alias("end_s"), F.lit(9).alias("exit_code"),
        F.when(F.col("instance_id") % 5 != 0, more(("seen", F.lit("new")), ("n", F.col("instance_id")))).alias("metadata"),
    )
    path, how = sinks.scratch(spark), {"overwrite": ["end_s", "exit_code"], "fill": ["comm"], "merge_maps": ["metadata"]}
    for rows in (old, new, new):
        sinks.merge_into(path, rows, ["instance_id"], 8, **how)
    out = spark.read.parquet(path)
    entries = F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.concat_ws("=", k, F.element_at("metadata", k)))
    return out.select("instance_id", "comm", "end_s", "exit_code", F.array_join(entries, ",").alias("metadata"))


Q["K1_upsert_process"] = Query(k1, f"""{P}, o AS (SELECT instance_id, comm, end_s, exit_code, profile_id FROM proc WHERE instance_id % 3 <> 0), n AS (SELECT instance_id, CASE WHEN instance_id % 4 = 0 THEN comm || '!' END AS comm, end_s + 1 AS end_s, 9 AS exit_code, instance_id % 5 <> 0 AS more FROM proc WHERE instance_id % 2 = 0)
SELECT instance_id, coalesce(n.comm, o.comm) AS comm, CASE WHEN n.exit_code IS NOT NULL THEN n.end_s ELSE o.end_s END AS end_s, coalesce(n.exit_code, o.exit_code) AS exit_code,
CASE WHEN o.profile_id IS NULL AND NOT more THEN NULL ELSE concat_ws(',', 'by=' || o.profile_id, CASE WHEN more THEN 'n=' || instance_id END, CASE WHEN more THEN 'seen=new' ELSE 'seen=old' END) END AS metadata FROM o FULL JOIN n USING (instance_id)""")


def k2(spark, d):
    from hostlens.sources.sinks import record_exit

    p = processes(spark, d).select("instance_id", "end_s", "exit_code")
    exits = p.where("instance_id % 5 = 0").select("instance_id", F.lit(NOW).cast("long").alias("end_s"), F.lit(1).alias("exit_code"))
    return record_exit(p, exits)


Q["K2_record_exit"] = Query(k2, f"{P} SELECT instance_id, CASE WHEN instance_id % 5 = 0 THEN {NOW} ELSE end_s END AS end_s, CASE WHEN instance_id % 5 = 0 THEN 1 ELSE exit_code END AS exit_code FROM proc")


def k7(spark, d):
    from hostlens.sources import sinks

    v, path = versions(spark, d).select("profile_id", "version", "n", "updated_s"), sinks.scratch(spark)
    news = v.where("version % 2 = 0").withColumns({"n": F.col("n") + 100, "updated_s": F.lit(None).cast("long")})
    for rows in (v, news):
        sinks.merge_into(path, rows, ["profile_id", "version"], 8, overwrite=["n"], fill=["updated_s"])
    return spark.read.parquet(path).drop(sinks.BUCKET)


Q["K7_upsert_profile"] = Query(k7, f"WITH {VER_SQL} SELECT profile_id, version, CASE WHEN version % 2 = 0 THEN n + 100 ELSE n END AS n, updated_s FROM ver")
Q["K8_delete_profile"] = Query(lambda s, d: versions(s, d).join(s.createDataFrame([(5,), (7,)], "profile_id long"), "profile_id", "left_anti").select("profile_id", "version"), f"WITH {VER_SQL} SELECT profile_id, version FROM ver WHERE profile_id NOT IN (5, 7)")
def k9(spark, d):
    """Live rows come in three batches; each replaces the rows of its keys, and the second comes twice."""
    from hostlens.sources import sinks

    e, path = t(spark, d, "events").select("event_type", "user_id", "event_id", "ts", "value"), sinks.scratch(spark)
    for k in (0, 1, 1, 2):
        batch = Wn.latest(e.where(F.col("event_id") % 3 == k), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")])
        sinks.merge_into(path, batch, ["event_type", "user_id"], 8, overwrite=["event_id", "ts", "value"])
    return spark.read.parquet(path).select("event_type", "user_id", "event_id", "value")


Q["K9_insert_or_replace"] = Query(k9, """WITH l AS (SELECT event_type, user_id, event_id % 3 AS k, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3)
SELECT event_type, user_id, max_by(event_id, k) AS event_id, max_by(value, k) AS value FROM l GROUP BY 1, 2""")
Q["K9_keep_last_per_id"] = Query(lambda s, d: Wn.latest(t(s, d, "events"), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "user_id", "event_id"), "SELECT event_type, user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")


def k10(spark, d):
    from hostlens.sources.sinks import change_status

    a = t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "RESOLVED").otherwise("ACTIVE").alias("status"))
    return change_status(a, "ACKNOWLEDGED")


Q["K10_alert_status_change"] = Query(k10, "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS status, event_id % 3 <> 0 AS changed FROM events WHERE event_type = 'error'")


# P11 and J10 are the summary of single instances and the pairing of measures, as library users call them ---------------
Q["P11_instance_summary"] = Query(lambda s, d: rounded(H.lifecycle_summary(processes(s, d), full_windows(s, d), lines(s, d), detections(s, d), NOW).select("instance_id", "comm", "total_windows", "total_syscalls", "total_net_tx", "detections", "max_risk"), "max_risk"),
                                  f"""WITH {LINE_SQL}, {FULL_SQL}, {DET_SQL}, {PROC_SQL}, w AS (SELECT instance_id, count(*) AS total_windows, sum(syscall_count)::BIGINT AS total_syscalls, sum(tcp_tx_bytes + udp_tx_bytes)::BIGINT AS total_net_tx FROM fullw GROUP BY 1), x AS (SELECT instance_id, count(*) AS detections, max(risk_score) AS max_risk FROM det GROUP BY 1)
SELECT instance_id, comm, coalesce(total_windows, 0) AS total_windows, coalesce(total_syscalls, 0) AS total_syscalls, coalesce(total_net_tx, 0) AS total_net_tx, coalesce(detections, 0) AS detections, round(coalesce(max_risk, 0) + 1e-9, 6) AS max_risk FROM proc LEFT JOIN w USING (instance_id) LEFT JOIN x USING (instance_id)""")
