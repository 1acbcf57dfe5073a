"""Look-ups, joins and aggregates over process history. Every top-k has the id as its last order, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_range(df: DataFrame, ts_col: str, start=None, end=None, end_col: str | None = None) -> DataFrame:
    """Optional bounds, both inclusive; ``end_col`` when the upper bound is on another column."""
    if start is not None:
        df = df.where(F.col(ts_col) >= start)
    if end is not None:
        df = df.where(F.col(end_col or ts_col) <= end)
    return df


def newest(df: DataFrame, ts_col: str, id_cols: list[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(ts_col), *map(F.desc, id_cols)).limit(n)


def clean_windows(df: DataFrame, binary_col: str, label_col: str | None = None) -> DataFrame:
    """Windows not known to be attacks: null labels count as clean."""
    ok = F.col(binary_col).isNull() | (F.col(binary_col) == 0)
    if label_col:
        ok = ok & (F.col(label_col).isNull() | ~F.col(label_col).isin("malicious", "attack"))
    return df.where(ok)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of rows (limit within 1 to 200, offset not negative) with the total count on each."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))
    return rows.crossJoin(F.broadcast(total))  # one row by construction


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows where any column contains the text, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower()))
    return df.where(hit)


FOR_EVER = 2**62  #: the end of a span that has none
FEW_SPANS = 64  #: spans of a key that each of its events may be compared with


def interval_join(events: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each event with the spans of its key that it falls into; an open end lasts for ever. Times are whole numbers.

    An event meets all spans of its key where these are few, so it travels once. Those of the other keys meet in bins of time.
    """
    rows = spans.where(F.col(end).isNull() | (F.col(end) > F.col(start)))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.coalesce(F.col(end), F.lit(FOR_EVER)))
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > FEW_SPANS).drop("__n")
    if not many.count():
        return events.join(rows, keys).where(inside)
    few = events.join(many, keys, "left_anti").join(rows, keys)
    binned = _meet_in_bins(events.join(many, keys, "left_semi"), rows.join(many, keys, "left_semi"), keys, at, start, end)
    return few.unionByName(binned).where(inside)


def _meet_in_bins(events: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each event with the spans of its key that it may fall into.

    Spans are sorted into bins as wide as they are long, to the next power of two, so each lies in one or two; an event
    looks into one bin of each width in use (at most 64). So a key that was used ten thousand times, one after another,
    isn't all its spans times all its events: a bin holds no more spans than can be there at about one time.
    """
    length = F.col(end) - F.col(start)
    level = F.when(F.col(end).isNull(), 63).otherwise(F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int"))
    # Open spans have one bin for all times. A bin of level n is n bits of time wide.
    bin_of = lambda c, n: F.when(n == 63, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", c.cast("long"), n))
    rows = spans.withColumn("__level", level)
    rows = rows.withColumn("__bin", F.explode(F.array_distinct(F.array(bin_of(F.col(start), F.col("__level")), bin_of(F.coalesce(F.col(end), F.lit(0)) - 1, F.col("__level"))))))
    levels = sorted(r[0] for r in rows.select("__level").distinct().collect())
    looks = events.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    looks = looks.withColumn("__bin", bin_of(F.col(at), F.col("__level")))
    return looks.join(rows, [*keys, "__level", "__bin"]).drop("__level", "__bin")


def connection_events(seen: DataFrame, keys: list[str], snapshot: str, forget: int | None = None) -> DataFrame:
    """Sightings of connections as events: CONNECT where one is first seen, STATUS each time after that.

    One that was gone and is back is still known, unless it was missing from more than ``forget`` snapshots.
    """
    rows = seen.distinct()
    if forget is None:
        first = rows.groupBy(*keys).agg(F.min(snapshot).alias("__first"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        rows = rows.join(first.withColumnsRenamed({k: f"__{k}" for k in keys}), same).withColumn("new", F.col(snapshot) == F.col("__first"))
    else:
        before = F.lag(snapshot).over(W.partitionBy(*keys).orderBy(snapshot))
        rows = rows.withColumn("__before", before).withColumn("new", F.col("__before").isNull() | (F.col(snapshot) - F.col("__before") > forget + 1))
    return rows.select(*seen.columns, F.when(F.col("new"), "CONNECT").otherwise("STATUS").alias("change"))


def instance_metrics(windows: DataFrame, by: str = "instance_id", start_col: str = "start_s", end_col: str = "end_s") -> DataFrame:
    """Lifetime metrics of each instance from its windows; columns that these lack count as 0."""
    v = lambda c: F.col(c) if c in windows.columns else F.lit(0)
    z = lambda c: F.coalesce(c, F.lit(0))
    total = {"total_duration_s": v("duration_s"), "total_syscalls": v("syscall_count"), "total_bytes_read": v("bytes_read"), "total_bytes_written": v("bytes_written"), "total_net_tx": v("tcp_tx_bytes") + v("udp_tx_bytes"),
             "total_net_rx": v("tcp_rx_bytes"), "total_children": v("child_process_count"), "total_execs": v("exec_count"), "total_sensitive_syscalls": v("syscalls_sensitive")}
    most = {"peak_cpu": "cpu_usage", "peak_memory": "memory_usage", "peak_memory_rss": "memory_rss_bytes", "max_unique_files": "unique_files", "max_unique_ips": "unique_dest_ips"}
    return windows.groupBy(by).agg(
        F.count("*").alias("total_windows"), *[z(F.sum(c)).alias(n) for n, c in total.items()], *[z(F.max(v(c))).alias(n) for n, c in most.items()], z(F.avg(v("cpu_usage"))).alias("avg_cpu"),
        F.min(v(start_col)).alias("first_window_start"), F.max(v(end_col)).alias("last_window_end"),
    )


def lifecycle_summary(processes: DataFrame, windows: DataFrame, events: DataFrame, detections: DataFrame, as_of: int) -> DataFrame:
    """One row per instance. Each side is aggregated before its join, so nothing fans out."""
    from hostlens.functions.classify import lifecycle

    w = instance_metrics(windows).drop("first_window_start", "last_window_end")
    e = events.groupBy("instance_id").agg(F.count("*").alias("total_events"))
    d = detections.groupBy("instance_id").agg(F.count("*").alias("detections"), F.max("risk_score").alias("max_risk"))
    rows = processes.join(w, "instance_id", "left").join(e, "instance_id", "left").join(d, "instance_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in [*w.drop("instance_id").columns, "total_events", "detections", "max_risk"]}
    return rows.withColumns({**zero, "status": lifecycle(F.col("end_s"), F.col("exit_code")), "duration_s": F.greatest(F.lit(0), F.coalesce("end_s", F.lit(as_of)) - F.col("start_s"))})


def snapshot_changes(seen: DataFrame, key: str, snapshot: str) -> DataFrame:
    """(key, snapshot, change) from (key, snapshot) sightings over consecutive snapshot numbers: START, EXIT at the first
    snapshot without it, none where it stays."""
    w = W.partitionBy(key).orderBy(snapshot)
    rows = seen.distinct().withColumns({"prev": F.lag(snapshot).over(w), "next": F.lead(snapshot).over(w)})
    last = seen.agg(F.max(snapshot).alias("last"))
    start = rows.where(F.col("prev").isNull() | (F.col("prev") < F.col(snapshot) - 1)).select(key, F.col(snapshot), F.lit("START").alias("change"))
    gone = rows.where(F.col("next").isNull() | (F.col("next") > F.col(snapshot) + 1)).crossJoin(F.broadcast(last)).where(F.col(snapshot) < F.col("last"))
    return start.unionByName(gone.select(key, (F.col(snapshot) + 1).alias(snapshot), F.lit("EXIT").alias("change")))


def process_history(events: DataFrame, by: list[str], ts_col: str, id_col: str, as_of: Column, days: int = 7, limit: int = 200, cpu: str = "cpu", mem: str = "mem", net: str = "net_kb", syscalls: str = "syscalls", risk: str = "risk", status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Summary per program, and its rows in order of time: those of the last days, or all where it has none in these; of
    them the oldest ``limit``."""
    seconds = F.unix_seconds(F.col(ts_col).cast("timestamp"))
    rows = events.withColumn("__new", seconds >= as_of - days * 86_400)
    fresh = rows.groupBy(*by).agg(F.max("__new").alias("__any"))
    rows = rows.join(fresh, by).where("__new or not __any").drop("__new", "__any")
    rows = top_per_group(rows, by, [F.asc(ts_col), F.asc(id_col)], limit)
    last = lambda c: F.max_by(c, "place")
    mean = lambda c: F.avg(c)
    summary = rows.groupBy(*by).agg(
        F.count("*").alias("total_snapshots"), *[f(c).alias(f"{k}_{n}") for n, c in (("cpu", cpu), ("mem", mem)) for k, f in (("avg", mean), ("peak", F.max), ("min", F.min))],
        mean(net).alias("avg_net_kb"), F.max(net).alias("peak_net_kb"), F.floor(F.avg(syscalls)).alias("avg_syscalls"), F.max(syscalls).alias("peak_syscalls"),
        F.count_if(F.col(status).isin("ANOMALOUS", "SUSPICIOUS") | (F.col(risk) >= 40)).alias("anomaly_count"), last(status).alias("latest_status"), last(risk).alias("latest_risk"),
    )
    return summary, rows


def recent_risk(df: DataFrame, risk_col: str, order: list[Column], n: int = 12, scale: float = 20.0) -> DataFrame:
    """Mean risk of the last n rows (12 without rows), and that over the scale as a trend."""
    mean = df.orderBy(*order).limit(n).agg(F.coalesce(F.avg(risk_col), F.lit(12.0)).alias("mean_risk"))
    return mean.withColumn("trend", F.round(F.col("mean_risk") / scale + 1e-9, 2))


def family_counts(df: DataFrame, by: list[str], family: Column, families: list[str], threads: Column) -> DataFrame:
    """Per snapshot: processes of each family, their number, and the sum of threads (1 where unknown)."""
    rows = df.withColumns({"__family": family, "__threads": F.coalesce(threads, F.lit(1))})
    return rows.groupBy(*by).agg(*[F.count_if(F.col("__family") == f).alias(f"n_{f}") for f in families], F.count("*").alias("process_count"), F.sum("__threads").alias("thread_count"))


def feed_search(df: DataFrame, needle: str = "", family: str = "", segment: str = "", columns: tuple[str, ...] = ("comm", "user", "pid", "eventType")) -> DataFrame:
    """Feed rows by text, family and segment (cpu, memory, network, anomalies); an empty filter lets all rows pass."""
    rows = search(df, list(columns), needle) if needle else df
    if family:
        rows = rows.where((F.col("family") == family) | F.contains("comm", F.lit(family)))
    segments = {"cpu": F.col("cpu") > 2, "memory": F.col("mem") > 40, "network": (F.col("eventType") == "socket_connect") | F.col("comm").isin("nginx", "sshd", "curl"), "anomalies": F.col("status") == "ANOMALOUS"}
    return rows.where(segments[segment]) if segment else rows


def children(processes: DataFrame, id_col: str = "instance_id", parent_col: str = "parent_instance_id") -> tuple[DataFrame, DataFrame]:
    """Edges (parent, child) between instances that are both known, and (instance, children) for all instances."""
    known = processes.select(F.col(id_col).alias("parent"))
    edges = processes.where(F.col(parent_col) != F.col(id_col)).select(F.col(parent_col).alias("parent"), F.col(id_col).alias("child")).join(known, "parent")
    n = edges.groupBy("parent").agg(F.count("*").alias("children"))
    return edges, processes.select(F.col(id_col).alias("parent")).join(n, "parent", "left").select(F.col("parent").alias(id_col), F.coalesce("children", F.lit(0)).alias("children"))


def current_with_baseline(events: DataFrame, profiles: DataFrame, by: str, order: list[str], family: Column) -> DataFrame:
    """The latest event of each program with its profile: cpu as a share of 2.5 times the mean (of 5 where that is 0), at
    most 100; the family is the event's, else the profile's, else the given one."""
    now = events.groupBy(by).agg(F.max_by(F.struct("cpu", F.col("family").alias("event_family")), F.struct(*order)).alias("e"))
    rows = now.join(profiles.select(by, "mean", F.col("family").alias("profile_family")), by, "left")
    room = F.coalesce(F.nullif(F.col("mean") * 2.5, F.lit(0.0)), F.lit(5.0))
    return rows.select(by, F.col("e.cpu").alias("current"), "mean", F.least(F.lit(100.0), F.col("e.cpu") / room * 100).alias("share"), F.coalesce("e.event_family", "profile_family", family).alias("family"))


def programs(instances: DataFrame, windows: DataFrame, col: str = "profile_id") -> DataFrame:
    """Distinct programs of instances and windows together."""
    return instances.select(col).union(windows.select(col)).where(F.col(col).isNotNull() & (F.col(col).cast("string") != "")).distinct()


def normalcy(df: DataFrame, status_col: str, order: list[Column], n: int = 500) -> DataFrame:
    """Share of rows that aren't anomalous among the last n, within 50 and 99; 96 without rows."""
    last = df.orderBy(*order).limit(n)
    share = (100 - F.floor(F.count_if(F.col(status_col) == "ANOMALOUS") * 100 / F.count("*"))).cast("int")
    return last.agg(F.when(F.count("*") == 0, 96).otherwise(F.greatest(F.lit(50), F.least(F.lit(99), share))).alias("normalcy"))
