"""How the general operators' columns are bound to the tables that queries read, in DataFrame and SQL form."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import baseline


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | Callable[[], str] | None = None  #: or what makes it, where it uses names defined further down


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def secs(c: str) -> F.Column:
    """Seconds since 1970 of a zone-less or UTC timestamp."""
    return F.unix_seconds(F.col(c).cast("timestamp"))


#: The features of a daily behaviour window of a program (a user), as text that both engines read: events that count ...
COUNTED = {
    "syscalls_file": "event_type IN ('click', 'view')", "syscalls_network": "event_type = 'purchase'", "syscalls_process": "event_type = 'signup'", "syscalls_memory": "event_id % 11 = 0", "syscalls_ipc": "event_id % 13 = 0",
    "syscalls_other": "event_type = 'error'", "syscalls_sensitive": "event_type = 'error'", "file_read_count": "event_type = 'view'", "file_write_count": "event_type = 'click' AND value > 50", "file_open_count": "event_type IN ('click', 'view') AND value > 20",
    "file_open_write_count": "event_type = 'click' AND value > 80", "file_create_count": "event_type = 'view' AND value > 100", "file_delete_count": "event_type = 'view' AND value > 150", "file_rename_count": "event_type = 'view' AND value < 5",
    "network_count": "event_type IN ('purchase', 'signup')", "net_connect_count": "event_type = 'purchase' AND value > 10", "net_accept_count": "event_type = 'signup' AND value > 10", "child_process_count": "event_type = 'signup' AND event_id % 2 = 0",
    "thread_create_count": "event_type = 'signup' AND event_id % 3 = 0", "exec_count": "event_type = 'signup' AND value > 60",
}
#: ... what is added up ...
ADDED = {
    "bytes_read": "CASE WHEN event_type = 'view' THEN value * 1000 ELSE 0 END", "bytes_written": "CASE WHEN event_type = 'click' THEN value * 1000 ELSE 0 END", "tcp_tx_bytes": "value * 512", "tcp_rx_bytes": "event_id % 1000", "udp_tx_bytes": "event_id % 97 * 100",
    "disk_read_bytes": "event_id % 31 * 4096", "disk_write_bytes": "event_id % 37 * 4096", "ctx_switches_voluntary": "event_id % 41", "ctx_switches_involuntary": "event_id % 7", "duration_s": "5",
}
#: ... and gauges, of which the highest counts.
HIGHEST = {"memory_usage": "value", "memory_rss_bytes": "value * 4096", "memory_vms_bytes": "value * 8192", "memory_percent": "value / 4", "num_threads": "event_id % 19", "num_fds": "event_id % 53"}
DISTINCT = {"distinct_syscalls": ("event_type",) * 2, "unique_files": ("regexp_extract(props, '[0-9]+', 0)", "regexp_extract(props, '[0-9]+')"), "unique_dest_ips": ("event_id % 9",) * 2, "unique_dest_ports": ("event_id % 5",) * 2}
MADE = {"syscall_count": "count(*)", "cpu_usage": "avg(value)", **{f: f"sum(CASE WHEN {x} THEN 1 ELSE 0 END)" for f, x in COUNTED.items()}, **{f: f"sum(CAST(floor({x}) AS BIGINT))" for f, x in ADDED.items()}, **{f: f"max({x})" for f, x in HIGHEST.items()}}
FEATURES = tuple(baseline.REGISTRY)
WINDOWS_SQL = f"""win AS (SELECT user_id AS profile_id, CAST(ts AS DATE) AS day, {', '.join(f"({x})::{'DOUBLE' if f in ('cpu_usage', *HIGHEST) else 'BIGINT'} AS {f}" for f, x in MADE.items())}, {', '.join(f'count(DISTINCT {x[1]}) AS {f}' for f, x in DISTINCT.items())},
max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS label_binary FROM events GROUP BY 1, 2)"""
LONG_SQL = WINDOWS_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT profile_id, day, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM win" for f in FEATURES) + ")"


def daily_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows with all features of the registry. Items to be told apart are in one row each before they are counted."""
    e = t(spark, d, "events").select(F.col("user_id").alias("profile_id"), F.to_date("ts").alias("day"), "*")
    aggs = {f: F.expr(x) for f, x in MADE.items()}
    counts = {f: F.size(F.collect_set(F.expr(x))).cast("long") for f, (x, _) in DISTINCT.items()}  # few different values a day
    return e.groupBy("profile_id", "day").agg(
        *[x.cast("double" if f in HIGHEST else "long" if f != "cpu_usage" else "double").alias(f) for f, x in aggs.items()], *[x.alias(f) for f, x in counts.items()],
        F.max(F.expr("CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END")).alias("label_binary"),
    )


#: Processes (orders), their windows (lineitem) and detections (returned lines).
PROC_SQL = """proc AS (SELECT o_orderkey AS instance_id, o_custkey AS profile_id, o_orderpriority AS comm, epoch(o_orderdate)::BIGINT AS start_s,
CASE WHEN o_orderstatus = 'O' THEN NULL ELSE epoch(o_orderdate)::BIGINT + 2592000 END AS end_s, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS exit_code FROM orders)"""
LINE_SQL = """line AS (SELECT l_orderkey AS instance_id, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, epoch(l_shipdate)::BIGINT AS end_s, l_quantity AS cpu_usage, l_extendedprice AS bytes_read,
l_tax AS memory_usage, l_returnflag AS flag, l_linestatus AS status, l_discount AS score FROM lineitem)"""
#: The same with the counters of a behaviour window, made up from the line's numbers.
FULL = {
    "start_s": ("end_s - 5 * n", lambda: F.col("end_s") - 5 * F.col("n")), "duration_s": ("n * 5.0::DOUBLE", lambda: F.col("n") * F.lit(5.0)), "syscall_count": ("cpu_usage::BIGINT", lambda: F.col("cpu_usage").cast("long")),
    "bytes_written": ("supp * 10", lambda: F.col("supp") * 10), "tcp_tx_bytes": ("part % 1000", lambda: F.col("part") % 1000), "udp_tx_bytes": ("supp % 100", lambda: F.col("supp") % 100),
    "tcp_rx_bytes": ("(part + supp) % 500", lambda: (F.col("part") + F.col("supp")) % 500), "child_process_count": ("n % 2", lambda: F.col("n") % 2), "exec_count": ("n % 3", lambda: F.col("n") % 3),
    "syscalls_sensitive": ("part % 4", lambda: F.col("part") % 4), "memory_rss_bytes": ("part * 4096", lambda: F.col("part") * 4096), "unique_files": ("supp % 7", lambda: F.col("supp") % 7), "unique_dest_ips": ("part % 5", lambda: F.col("part") % 5),
}
FULL_SQL = "fullw AS (SELECT *, " + ", ".join(f"{sql} AS {c}" for c, (sql, _) in FULL.items()) + " FROM line)"
DET_SQL = """det AS (SELECT instance_id, n, part, supp, end_s, score > 0.05 AS is_anomaly, cpu_usage * 2 AS risk_score, score FROM line WHERE flag = 'R')"""


def processes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("instance_id"), F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("comm"), secs("o_orderdate").alias("start_s"),
        F.when(F.col("o_orderstatus") != "O", secs("o_orderdate") + 2_592_000).alias("end_s"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("exit_code"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), secs("l_shipdate").alias("end_s"),
        F.col("l_quantity").alias("cpu_usage"), F.col("l_extendedprice").alias("bytes_read"), F.col("l_tax").alias("memory_usage"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"), F.col("l_discount").alias("score"),
    )


def full_windows(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumns({c: make() for c, (_, make) in FULL.items()})


def detections(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where("flag = 'R'").select("instance_id", "n", "part", "supp", "end_s", (F.col("score") > 0.05).alias("is_anomaly"), (F.col("cpu_usage") * 2).alias("risk_score"), "score")
