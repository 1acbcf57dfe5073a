"""Time windows and comparisons with what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: What a window keeps of the gauges of a process: the last value seen.
GAUGES = ("cpu_usage", "memory_rss_bytes", "memory_vms_bytes", "memory_percent", "num_threads", "num_fds")
SUMMED = ("bytes_read", "bytes_written", "tcp_tx_bytes", "tcp_rx_bytes", "udp_tx_bytes", "disk_read_bytes", "disk_write_bytes", "ctx_switches_voluntary", "ctx_switches_involuntary")
KINDS = {"file_open_count": "file_open", "file_open_write_count": "file_open_write", "file_create_count": "file_create", "file_delete_count": "file_delete", "file_rename_count": "file_rename", "net_connect_count": "net_connect", "net_accept_count": "net_accept", "child_process_count": "child_process", "thread_create_count": "thread_create", "exec_count": "exec"}
CATEGORIES = ("file", "network", "process", "memory", "ipc", "other")


def _tagged(rows: DataFrame, by: list[str], ts_col: str, length: str, watermark: str | None, tags: list[tuple[Column, str, Column]]) -> DataFrame:
    """Rows by key and window ``__w``, each once for every item to be told apart (``__what``, ``__item``), ``__main`` once.

    What is grouped by these too, and then by key and window alone, has each different item in one row: distinct counts
    need neither sets nor a copy of the rows for each of them, and work on streams.
    """
    ts = F.col(ts_col).cast("timestamp")
    if watermark:
        rows = rows.withColumn(ts_col, ts).withWatermark(ts_col, watermark)
        ts = F.col(ts_col)
    none = F.struct(F.lit("").alias("what"), F.lit(None).cast("string").alias("item"))
    found = F.array_compact(F.array(*[F.when(cond & item.isNotNull(), F.struct(F.lit(what).alias("what"), item.cast("string").alias("item"))) for cond, what, item in tags]))
    rows = rows.select("*", F.window(ts, length).alias("__w"), F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(none))).alias("__at", "__tag"))
    return rows.select("*", F.col("__tag.what").alias("__what"), F.col("__tag.item").alias("__item"), (F.col("__at") == 0).alias("__main")).drop("__at", "__tag")


def _in_window(by: list[str], length: str, watermark: str | None) -> list:
    return [*by, F.window(F.window_time("__w"), length).alias("__v") if watermark else F.col("__w").alias("__v")]


def process_windows(events: DataFrame, by: list[str], ts_col: str = "ts", length: str = "5 seconds", watermark: str | None = None) -> DataFrame:
    """Behaviour windows of process instances with all their metrics, one row per instance and window that holds events.

    Events have a ``kind`` (syscall, file_open, file_open_write, file_create, file_delete, file_rename, net_connect,
    net_accept, child_process, thread_create, exec), and where it applies syscall, category, sensitive, is_read, is_write,
    path, dest_ip, dest_port, SUMMED, GAUGES, exited, label, process_start. Missing columns count as null. A window
    doesn't start before its process. With a ``watermark`` events are a stream, and windows come when they are closed.
    """
    have = lambda c, kind: F.col(c) if c in events.columns else F.lit(None).cast(kind)
    kind = F.col("kind")
    call = kind == "syscall"
    true = lambda c: F.coalesce(have(c, "boolean"), F.lit(False))
    file, net = kind.startswith("file_"), kind.startswith("net_")
    rows = _tagged(events, by, ts_col, length, watermark, [(call, "syscall", have("syscall", "string")), (file, "path", have("path", "string")), (net, "ip", have("dest_ip", "string")), (net, "port", have("dest_port", "string"))])
    main, order = F.col("__main"), [F.col(ts_col).cast("timestamp").alias("at"), *[F.col(x) for x in ("event_id",) if x in events.columns]]
    last = lambda c, k="double": F.max(F.when(main & have(c, k).isNotNull(), F.struct(*order, have(c, k).alias("x")))).alias(c)
    counts = {
        "syscall_count": call, **{f"syscalls_{c}": call & (F.coalesce(have("category", "string"), F.lit("other")) == c) for c in CATEGORIES}, "syscalls_sensitive": call & true("sensitive"),
        "file_read_count": call & true("is_read"), "file_write_count": call & true("is_write"), **{name: kind == k for name, k in KINDS.items()}, "events_received": F.lit(True),
    }
    lasts = {**dict.fromkeys(GAUGES, "double"), "label": "string"}
    parts = rows.groupBy(*by, "__w", "__what", "__item").agg(
        *[F.count_if(main & when).alias(c) for c, when in counts.items()], *[F.sum(F.when(main, have(c, "long"))).alias(c) for c in SUMMED], *[last(c, k) for c, k in lasts.items()],
        F.max(true("exited").cast("int")).alias("exited"), F.min(have("process_start", "timestamp")).alias("process_start"),
    )
    distinct = lambda what: F.count_if(F.col("__what") == what)
    windows = parts.groupBy(*_in_window(by, length, watermark)).agg(
        *[F.sum(c).alias(c) for c in counts], distinct("syscall").alias("distinct_syscalls"), distinct("path").alias("unique_files"), distinct("ip").alias("unique_dest_ips"), distinct("port").alias("unique_dest_ports"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED], *[F.max(c).alias(c) for c in lasts], (1 - F.max("exited")).alias("alive_at_end"), F.min("process_start").alias("process_start"),
    )
    windows = windows.withColumns({**{c: F.coalesce(F.col(f"{c}.x"), F.lit(0.0)) for c in GAUGES}, "label": F.col("label.x"), "network_count": F.col("net_connect_count") + F.col("net_accept_count")})
    windows = windows.withColumns({"memory_usage": F.round(F.col("memory_rss_bytes") / 1_048_576, 3), "end_time": F.col("__v.end"), "duration_s": (F.unix_micros("__v.end") - F.unix_micros("__v.start")) / 1e6})
    return windows.withColumn("start_time", F.greatest("__v.start", F.coalesce("process_start", "__v.start"))).drop("__v", "process_start")


def feature_windows(events: DataFrame, name_col: str = "process_name", ts_col: str = "ts", length: str = "60 seconds", watermark: str | None = None) -> DataFrame:
    """Feature windows of process names with their 13 metrics, from flat events; events without a name don't count.

    With a ``watermark`` events are a stream, and windows come when they are closed.
    """
    kind = F.col("event_type")
    file, net, metric, sent = kind.startswith("FILE_"), kind.isin("NETWORK_CONNECT", "NETWORK_STATUS"), kind == "PROCESS_METRIC", kind == "NETWORK_STATUS_BYTES"
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    rows = _tagged(events.where(F.coalesce(name_col, F.lit("")) != ""), [name_col], ts_col, length, watermark, [(net, "ip", text("dst_ip")), (net, "port", text("dst_port")), (file, "path", text("file_path"))])
    main = F.col("__main")
    counts = {"syscall_count": kind == "SYSCALL", "file_event_count": file, "network_connection_count": net, "child_process_count": kind == "PROCESS_START"}
    sums = {"network_bytes_sent": sent, "network_bytes_received": sent, "cpu_percent": metric, "memory_percent": metric}
    parts = rows.groupBy(name_col, "__w", "__what", "__item").agg(
        *[F.count_if(main & when).alias(c) for c, when in counts.items()], *[F.sum(F.when(main & when, F.col(c))).alias(c) for c, when in sums.items()], *[F.count(F.when(main & metric, F.col(c))).alias(f"n_{c}") for c in ("cpu_percent", "memory_percent")],
    )
    mean = lambda c: F.coalesce(F.sum(c) / F.nullif(F.sum(f"n_{c}"), F.lit(0)), F.lit(0.0))
    distinct = lambda what: F.count_if(F.col("__what") == what)
    windows = parts.groupBy(*_in_window([name_col], length, watermark)).agg(
        *[F.sum(c).alias(c) for c in counts], mean("cpu_percent").alias("cpu_mean"), mean("memory_percent").alias("memory_mean"), F.lit(0).alias("disk_read_bytes"), F.lit(0).alias("disk_write_bytes"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("network_bytes_sent", "network_bytes_received")], distinct("ip").alias("unique_destinations"), distinct("port").alias("unique_ports"), distinct("path").alias("unique_files"),
    )
    return windows.withColumns({"start_time": F.col("__v.start"), "end_time": F.col("__v.end")}).drop("__v")


def before(by: list[str], order: list[str]) -> W:
    """All earlier rows of the same key; rows without a time come last, as nothing is known to be before them."""
    return W.partitionBy(*by).orderBy(*map(F.asc_nulls_last, order)).rowsBetween(W.unboundedPreceding, -1)


WHOLE = ("tinyint", "smallint", "int", "bigint")
EXACT = 2.0**53  #: up to here doubles hold all whole numbers


def _deviation(df: DataFrame, c: str, w: W, exact: bool) -> Column:
    """Sample deviation over a window. A mean kept up to date row by row is off in its last digits, and so is a score that is
    just a threshold; sums of whole numbers and of their squares aren't. SQL keeps it up to date nevertheless: with ``exact``
    false the covariance of a column with itself is taken, which goes by the same steps."""
    if not exact:
        return F.sqrt(F.covar_samp(c, c).over(w))
    std = F.stddev_samp(c).over(w)
    if dict(df.dtypes)[c] not in WHOLE:
        return std
    x = F.col(c).cast("double")
    n, first, second = F.count(c).over(w), F.sum(x).over(w), F.sum(x * x).over(w)
    return F.when((n > 1) & (n * second < EXACT), F.sqrt((n * second - first * first) / (n * (n - 1)))).otherwise(std)


def earlier_moments(df: DataFrame, by: list[str], order: list[str], cols: list[str], cut: Column | None = None, exact: bool = True) -> DataFrame:
    """Add, for each column, how many earlier rows of the key have a value, their mean and sample deviation (null where
    not defined), as ``__n_``, ``__mean_``, ``__std_``.

    With ``cut``, a column that never falls along ``order`` (a date, say), no task holds a key's whole time line: rows
    are put in order within (key, cut) only, and what is known of the cuts before comes from one row for each cut.
    Without it the deviation of whole numbers comes from their exact sums, as far as doubles hold these; with ``exact``
    false it has the last digits that it has in SQL, which decide on scores that are just a threshold.
    """
    if cut is None:
        w = before(by, order)
        return df.withColumns({f"__{k}_{c}": f(c).over(w) for c in cols for k, f in (("n", F.count), ("mean", F.avg))} | {f"__std_{c}": _deviation(df, c, w, exact) for c in cols})
    rows = df.withColumn("__cut", cut)
    inside = [*by, "__cut"]
    w = before(inside, order)
    rows = rows.withColumns({f"__{k}_{c}": f(F.col(c)).over(w) for c in cols for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))})
    made = [e for c in cols for e in (F.count(c).alias(f"__n_{c}"), F.avg(c).alias(f"__mean_{c}"), F.var_pop(c).alias(f"__var_{c}"))]
    parts = df.withColumn("__cut", cut).groupBy(*inside).agg(*made)
    past = before(by, ["__cut"])
    # Moments about a value near the key's own mean, so that their difference keeps its digits.
    near = W.partitionBy(*by).orderBy("__cut").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for c in cols:
        n, mean, var = F.col(f"__n_{c}"), F.col(f"__mean_{c}"), F.col(f"__var_{c}")
        parts = parts.withColumn(f"__near_{c}", F.first(mean, ignorenulls=True).over(near))
        gap = mean - F.col(f"__near_{c}")
        total, first, second = (F.sum(x).over(past) for x in (n, n * gap, n * (F.coalesce(var, F.lit(0.0)) + gap * gap)))
        parts = parts.withColumns({f"__past_n_{c}": F.coalesce(total, F.lit(0)), f"__past_gap_{c}": F.coalesce(first / F.nullif(total, F.lit(0)), F.lit(0.0)), f"__past_sq_{c}": F.coalesce(second, F.lit(0.0))})
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(inside)], *[f"__{k}_{c}" for c in cols for k in ("near", "past_n", "past_gap", "past_sq")])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(inside)]
    rows = rows.join(parts, same)
    out = {}
    for c in cols:
        n1, n2 = F.col(f"__past_n_{c}"), F.col(f"__n_{c}")
        mean1, mean2 = F.col(f"__near_{c}") + F.col(f"__past_gap_{c}"), F.coalesce(f"__mean_{c}", F.lit(0.0))
        m2 = F.col(f"__past_sq_{c}") - n1 * F.col(f"__past_gap_{c}") ** 2 + n2 * F.coalesce(f"__var_{c}", F.lit(0.0))
        n = n1 + n2
        apart = F.when((n1 > 0) & (n2 > 0), (mean2 - mean1) ** 2 * n1 * n2 / n).otherwise(0.0)
        mean = F.when(n > 0, (F.when(n1 > 0, n1 * mean1).otherwise(0.0) + n2 * mean2) / n)
        out |= {f"__n_{c}": n, f"__mean_{c}": mean, f"__std_{c}": F.when(n > 1, F.sqrt(F.greatest(m2 + apart, F.lit(0.0)) / (n - 1)))}
    return rows.withColumns(out).select(*df.columns, *out)


def compare_then_update(df: DataFrame, by: list[str], order: list[str], value_col: str, cut: Column | None = None, exact: bool = True) -> DataFrame:
    """Compare a row with all earlier rows: mean, std, deviation, ratio, signed z (0 where it isn't defined). ``cut`` and
    ``exact``: see ``earlier_moments``."""
    v = F.col(value_col)
    rows = earlier_moments(df, by, order, [value_col], cut, exact)
    n, mean, std = (F.col(f"__{k}_{value_col}") for k in ("n", "mean", "std"))
    rows = rows.withColumns({"n_before": n, "mean_before": F.coalesce(mean, F.lit(0.0)), "std_before": F.coalesce(std, F.lit(0.0))}).select(*df.columns, "n_before", "mean_before", "std_before")
    rows = rows.withColumn("deviation", v - F.col("mean_before"))
    ratio = F.when(F.col("mean_before") == 0, 0.0).otherwise(v / F.col("mean_before"))
    z = F.when((F.col("n_before") < 2) | (F.col("std_before") == 0), 0.0).otherwise(F.col("deviation") / F.col("std_before"))
    return rows.withColumns({"ratio": ratio, "z": z})


#: For each live metric the floor of its deviation and the noise band in which the score is capped.
LIVE = {"cpu": (2.0, 4.0), "mem": (25.0, 25.0), "syscalls": (50.0, 60.0)}
NOISE_CAP = 1.5


def live_moments(df: DataFrame, by: str) -> DataFrame:
    """(by, metric, n, mean, m2, low, high) of the live metrics, and of ``__row``, which counts rows."""
    rows = df.withColumn("__row", F.lit(1)).select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in (*LIVE, "__row")])).alias("v")).select(by, "v.*")
    return rows.groupBy(by, "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"))


def after_known(rows: DataFrame, known: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Bring the columns of ``earlier_moments`` up to date with moments known from before: (by, metric, n, mean, m2)."""
    wide = known.groupBy(by).agg(*[F.max(F.when(F.col("metric") == c, F.struct("n", "mean", "m2"))).alias(f"__known_{c}") for c in cols]).withColumnRenamed(by, "__by")
    both = rows.join(wide, F.col(by).eqNullSafe(F.col("__by")), "left")
    out: dict[str, Column] = {}
    for c in cols:
        n1, n2 = F.coalesce(f"__known_{c}.n", F.lit(0)), F.col(f"__n_{c}")
        mean1, mean2 = F.coalesce(f"__known_{c}.mean", F.lit(0.0)), F.coalesce(f"__mean_{c}", F.lit(0.0))
        n, gap = n1 + n2, mean2 - mean1
        m2 = F.coalesce(f"__known_{c}.m2", F.lit(0.0)) + F.coalesce(F.col(f"__std_{c}") ** 2 * (n2 - 1), F.lit(0.0)) + F.when((n1 > 0) & (n2 > 0), gap * gap * n1 * n2 / n).otherwise(0.0)
        out |= {f"__n_{c}": n, f"__mean_{c}": F.when(n > 0, mean1 + F.when(n2 > 0, gap * n2 / n).otherwise(0.0)), f"__std_{c}": F.when(n > 1, F.sqrt(m2 / (n - 1)))}
    return both.withColumns(out).select(*rows.columns)


def live_deviation(df: DataFrame, by: list[str], order: list[str], two_sided: bool = True, cut: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """Score of cpu, mem and syscalls against all earlier rows of the program; 0 until there are three. ``cut``: see
    ``earlier_moments``. ``known`` has the moments of rows before these, as from ``live_moments`` (one key only)."""
    rows = earlier_moments(df.withColumn("__row", F.lit(1)), by, order, [*LIVE, "__row"], cut)
    if known is not None:
        rows = after_known(rows, known, by[0], [*LIVE, "__row"])
    n = F.col("__n___row")
    out: dict[str, Column] = {}
    for m, (floor, band) in LIVE.items():
        gap = F.col(m) - F.col(f"__mean_{m}")
        z = (F.abs(gap) if two_sided else gap) / F.greatest(F.coalesce(f"__std_{m}", F.lit(0.0)), F.lit(floor))
        out[f"{m}_z"] = F.when(n >= 3, F.when(F.abs(gap) < band, F.least(z, F.lit(NOISE_CAP))).otherwise(z)).otherwise(0.0)
        out[f"{m}_deviation"] = F.when(n >= 3, gap).otherwise(0.0)
    rows = rows.withColumns(out).select(*df.columns, *out)
    return rows.withColumn("max_z", F.greatest(*(F.col(f"{m}_z") for m in LIVE)))


def window_number(df: DataFrame, epoch_col: str, seconds: int) -> DataFrame:
    """Number of the window that a time falls into."""
    return df.withColumn("window_index", F.floor(F.col(epoch_col) / seconds).cast("long"))


def window_sequence(df: DataFrame, epoch_col: str, seconds: int, lost: Column) -> DataFrame:
    """One row per window that holds rows: window_index, its sequence number from 1, events received and lost."""
    counts = window_number(df, epoch_col, seconds).groupBy("window_index").agg(F.count("*").alias("events_received"), F.count_if(lost).alias("events_lost"))
    # Ranks by blocks of windows: only the number of windows in each block is added up in one place.
    counts = counts.withColumn("__block", F.floor(F.col("window_index") / 10_000))
    blocks = counts.groupBy("__block").agg(F.count("*").alias("__m"))
    blocks = blocks.select("__block", (F.sum("__m").over(W.orderBy("__block")) - F.col("__m")).alias("__before"))
    rank = F.row_number().over(W.partitionBy("__block").orderBy("window_index"))
    return counts.withColumn("sequence", rank).join(blocks, "__block").select("window_index", (F.col("sequence") + F.col("__before")).alias("sequence"), "events_received", "events_lost")


def last_tokens(df: DataFrame, by: list[str], order: list[str], token_col: str, n: int = 64) -> DataFrame:
    """The last n tokens of the key at each row, oldest first."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("recent", F.collect_list(token_col).over(w))


def latest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def label_in_force(rows: DataFrame, labels: DataFrame, by: list[str], ts_col: str, label_col: str = "label") -> DataFrame:
    """As-of join: each row gets the key's last label at or before its time, through one union and a running window."""
    names = [c for c in rows.columns]
    marks = labels.select(*by, ts_col, F.col(label_col).alias("__label"), F.lit(0).alias("__kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names if c not in {*by, ts_col}])
    both = rows.select(*names, F.lit(None).cast(labels.schema[label_col].dataType).alias("__label"), F.lit(1).alias("__kind")).unionByName(marks)
    w = W.partitionBy(*by).orderBy(ts_col, "__kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("label_in_force", F.last("__label", ignorenulls=True).over(w)).where("__kind = 1").drop("__label", "__kind")
