"""Baselines: robust statistics of each feature of each program, their maturity, and updates of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.sources.sinks import stored

# Category, noise floor and weight of each feature of a behaviour window.
REGISTRY = {
    "syscall_count": ("syscall", 5.0, 1.0), "distinct_syscalls": ("syscall", 1.0, 1.0), "syscalls_file": ("syscall", 2.0, 0.8),
    "syscalls_network": ("syscall", 1.0, 1.2), "syscalls_process": ("syscall", 1.0, 1.2), "syscalls_memory": ("syscall", 1.0, 0.8),
    "syscalls_ipc": ("syscall", 1.0, 0.8), "syscalls_other": ("syscall", 1.0, 0.5), "syscalls_sensitive": ("security", 0.5, 2.5),
    "file_read_count": ("file", 1.0, 0.8), "file_write_count": ("file", 1.0, 1.0), "file_open_count": ("file", 1.0, 0.8),
    "file_open_write_count": ("file", 1.0, 1.2), "file_create_count": ("file", 0.5, 1.2), "file_delete_count": ("security", 0.5, 2.0),
    "file_rename_count": ("file", 0.5, 1.2), "unique_files": ("file", 1.0, 1.0), "bytes_read": ("file", 1024.0, 0.7), "bytes_written": ("file", 1024.0, 0.9),
    "network_count": ("network", 1.0, 1.0), "net_connect_count": ("security", 0.5, 2.2), "net_accept_count": ("network", 0.5, 1.2),
    "unique_dest_ips": ("network", 0.5, 1.5), "unique_dest_ports": ("network", 0.5, 1.2), "tcp_tx_bytes": ("network", 512.0, 0.9),
    "tcp_rx_bytes": ("network", 512.0, 0.7), "udp_tx_bytes": ("network", 512.0, 1.2), "child_process_count": ("security", 0.5, 2.0),
    "thread_create_count": ("security", 1.0, 1.0), "exec_count": ("security", 0.5, 2.5), "cpu_usage": ("resource", 0.5, 1.2),
    "memory_usage": ("resource", 1.0, 1.0), "memory_rss_bytes": ("resource", 1048576.0, 0.8), "memory_vms_bytes": ("resource", 2097152.0, 0.6),
    "memory_percent": ("resource", 0.5, 1.0), "num_threads": ("resource", 1.0, 0.8), "num_fds": ("resource", 1.0, 0.8), "disk_read_bytes": ("resource", 4096.0, 0.6),
    "disk_write_bytes": ("resource", 4096.0, 0.7), "ctx_switches_voluntary": ("resource", 10.0, 0.5), "ctx_switches_involuntary": ("resource", 5.0, 0.7),
    "duration_s": ("resource", 0.1, 0.3),
}
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
NORMAL = 1.4826  #: scales a median absolute deviation to a standard deviation
MINIMUM = 5
# Activities that are typical of a program, by the counter that shows them.
TYPICAL = {"file_open": "file_open_count", "file_modify": "file_write_count", "socket_connect": "net_connect_count", "fork": "child_process_count", "execve": "exec_count", "file_delete": "file_delete_count"}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGISTRY.items()], "feature string, category string, noise_floor double, weight double")


def long_form(windows: DataFrame, keys: list[str], features: list[str] | None = None) -> DataFrame:
    """(keys, feature, value): the registry's features that the windows have, one row each."""
    names = features or [f for f in REGISTRY if f in windows.columns]
    wide = windows.select(*keys, *[F.col(f).cast("double").alias(f) for f in names])
    return wide.unpivot(keys, names, "feature", "value")


def moments(df: DataFrame, by: list[str], value_col: str) -> DataFrame:
    """Count, mean, sample variance (0 for one row), population deviation, extremes."""
    v = F.col(value_col)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("low"), F.max(v).alias("high"))


def combined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Moments (n, mean, m2, low, high) of two disjoint sets of rows from the moments of each; either side may lack a key."""
    names = ("n", "mean", "m2", "low", "high")
    x = a.select(*by, *[F.col(c).alias(f"{c}_a") for c in names])
    y = b.select(*by, *[F.col(c).alias(f"{c}_b") for c in names])
    z = x.join(y, by, "full")
    f = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, gap = f("n_a") + f("n_b"), f("mean_b") - f("mean_a")
    return z.select(
        *by, n.alias("n"), ((f("n_a") * f("mean_a") + f("n_b") * f("mean_b")) / n).alias("mean"), (f("m2_a") + f("m2_b") + gap * gap * f("n_a") * f("n_b") / n).alias("m2"),
        F.least("low_a", "low_b").alias("low"), F.greatest("high_a", "high_b").alias("high"),
    )


def exact_quantiles(df: DataFrame, by: list[str], value_col: str, points: tuple[float, ...] = PERCENTILES, digits: int = 1024, weight_col: str | None = None) -> DataFrame:
    """(by, n, p): exact quantiles of each group, by linear interpolation, as an array in the order of ``points``.

    A selection by digits: the range of each rank that is looked for is divided into ``digits`` parts whose rows are
    counted (before they are shuffled), and the part that holds the rank is divided next, until all its values are equal.
    No task holds a group's values, so a group may have a third of all rows. Nulls and NaN don't count. A row stands for
    ``weight_col`` (whole, at least 1) rows alike.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    many = F.col(weight_col) if weight_col else F.lit(1)
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(value_col).cast("double").alias("v"), many.cast("long").alias("w")).where("v is not null and not isnan(v)")
    total = stored(rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    spots = F.array(*[F.lit(p) * (F.col("n") - 1) for p in points])
    ranks = F.array_distinct(F.concat(F.transform(spots, lambda x: F.floor(x)), F.transform(spots, lambda x: F.ceil(x))))
    open_ = total.select(*keys, "low", "high", F.explode(ranks).alias("rank")).withColumn("left", F.col("rank"))
    found = open_.where("low = high")
    open_ = stored(open_.where("low < high"))
    while not open_.isEmpty():
        ranges = open_.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        inside = rows.join(ranges, [*same, F.col("v") >= F.col("_low"), F.col("v") <= F.col("_high")])
        share = (F.col("v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        cells = inside.withColumn("cell", F.least(F.floor(share * digits), F.lit(digits - 1))).groupBy(*keys, "_low", "cell").agg(F.sum("w").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*keys, "_low").orderBy("cell")) - F.col("c")  # of ``digits`` rows at most
        cells = cells.withColumn("before", before).withColumnsRenamed({k: f"_{k}" for k in keys})
        hit = open_.join(cells, [*same, F.col("low") == F.col("_low"), F.col("left") >= F.col("before"), F.col("left") < F.col("before") + F.col("c")])
        next_ = stored(hit.select(*keys, F.col("least").alias("low"), F.col("most").alias("high"), "rank", (F.col("left") - F.col("before")).alias("left")))
        found, open_ = found.unionByName(next_.where("low = high")), next_.where("low < high")
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at")).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = total.join(values, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    value = lambda x: F.element_at("at", F.floor(x)) + (F.element_at("at", F.ceil(x)) - F.element_at("at", F.floor(x))) * (x - F.floor(x))
    return out.select(*[F.col(n).alias(k) for k, n in zip(by, keys, strict=True)], "n", F.transform(spots, value).alias("p"))


def percentiles(df: DataFrame, by: list[str], value_col: str, exact: bool = True) -> DataFrame:
    """Percentiles by linear interpolation; ``exact=False`` takes them from sketches, in one pass."""
    if exact:
        rows = exact_quantiles(df, by, value_col)
    else:
        rows = df.groupBy(*by).agg(F.percentile_approx(value_col, F.array(*map(F.lit, PERCENTILES)), 10_000).alias("p"))
    return rows.select(*by, *[F.col("p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(PERCENTILES)])


def median_and_mad(df: DataFrame, by: list[str], value_col: str, exact: bool = True) -> DataFrame:
    """Median, median absolute deviation, and that scaled to a deviation; ``exact=False`` takes them from sketches."""

    def middle(rows: DataFrame, keys: list[str], c: str, name: str) -> DataFrame:
        if exact:
            return exact_quantiles(rows, keys, c, (0.5,)).select(*keys, F.col("p")[0].alias(name))
        return rows.groupBy(*keys).agg(F.percentile_approx(c, 0.5, 10_000).alias(name))

    med = middle(df, by, value_col, "median")
    away = df.join(med, by).withColumn("__away", F.abs(F.col(value_col) - F.col("median")))
    return middle(away, [*by, "median"], "__away", "mad").withColumn("nmad", NORMAL * F.col("mad"))


def feature_baseline(long: DataFrame, keys: list[str], features: DataFrame, exact: bool = True) -> DataFrame:
    """All statistics of (keys, feature, value) rows, with the scale by which deviations are measured.

    Groups may be of any size: exact percentiles are selected by counting, others come from sketches.
    """
    by = [*keys, "feature"]
    first = long.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    if exact:
        p = exact_quantiles(long, by, "value").drop("n")
    else:
        p = long.groupBy(*by).agg(F.percentile_approx("value", F.array(*map(F.lit, PERCENTILES)), 10_000).alias("p"))
    mad = median_and_mad(long, by, "value", exact).select(*by, "mad")
    return _scaled(first.join(p, by).join(mad, by).join(F.broadcast(features.select("feature", "noise_floor")), "feature"))


def oldest(windows: DataFrame, key: str, order_col: str, most: int) -> DataFrame:
    """The oldest so many windows of each program."""
    return _first_windows(windows, key, order_col, most)


def oldest_counted(windows: DataFrame, key: str, order_col: str, most: int) -> DataFrame:
    """``oldest`` for programs of very many windows: these are counted by time first, and only those up to the time at which a
    program has enough are put in order. Reads ``windows`` twice, so they should be saved."""
    times = windows.groupBy(F.col(key).alias("__key"), F.col(order_col).alias("__at")).agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy("__key").orderBy("__at")) - F.col("__m")
    last = stored(times.withColumn("__before", before).where(F.col("__before") < most).groupBy("__key").agg(F.max("__at").alias("__last")))
    some = windows.join(last, F.col(key).eqNullSafe(F.col("__key"))).where(F.col(order_col).isNull() | (F.col(order_col) <= F.col("__last")))  # nulls come first
    return _first_windows(some.drop("__key", "__last"), key, order_col, most)


def _first_windows(windows: DataFrame, key: str, order_col: str, most: int) -> DataFrame:
    return windows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order_col))).where(F.col("__n") <= most).drop("__n")


def wide_baseline(windows: DataFrame, keys: list[str], names: list[str], features: DataFrame, exact: bool = True) -> DataFrame:
    """``feature_baseline`` of wide windows: rows meet once by key for all features, and each key's values are sorted there.

    Exact percentiles hold a program's values, so its windows must be bounded (``oldest``); ``exact=False`` takes them from
    sketches, and ``feature_baseline`` selects exact ones whatever the number of windows.
    """
    wide = windows.select(*keys, *[F.col(f).cast("double").alias(f) for f in names])
    moments_of = lambda f: [F.lit(f).alias("feature"), F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.min(f).alias("low"), F.max(f).alias("high")]
    if exact:
        first = wide.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("__rows"), *[F.struct(*moments_of(f)).alias(f"__s_{f}") for f in names])
        values = lambda f: F.transform("__rows", lambda x: x[f])
        rows = first.select(*keys, F.explode(F.array(*[F.struct(F.col(f"__s_{f}").alias("s"), values(f).alias("v")) for f in names])).alias("r"))
        rows = rows.select(*keys, "r.s.*", F.sort_array(F.array_compact("r.v")).alias("v"))
        rows = rows.withColumn("p", F.array(*[_between("v", q) for q in PERCENTILES]))
        rows = rows.select(*keys, "feature", "n", "mean", "std", "low", "high", "p", F.col("p")[1].alias("__m"), "v").withColumn("v", F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("__m")))))
        rows = rows.withColumn("mad", _between("v", 0.5)).drop("v", "__m")
        return _scaled(rows.join(F.broadcast(features.select("feature", "noise_floor")), "feature"))
    points = F.array(*map(F.lit, PERCENTILES))
    one = lambda f: F.struct(*moments_of(f), F.percentile_approx(f, points, 10_000).alias("p")).alias(f)
    first = wide.groupBy(*keys).agg(*map(one, names))
    same = [wide[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    medians = first.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f"{f}.p")[1].alias(f"__m_{f}") for f in names])
    second = wide.join(medians, same).groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(f) - F.col(f"__m_{f}")), 0.5, 10_000).alias(f"__mad_{f}") for f in names])
    second = second.select(*[F.col(k).alias(f"__{k}") for k in keys], *[f"__mad_{f}" for f in names])
    both = first.join(second, [first[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    rows = both.select(*keys, F.explode(F.array(*[F.struct(F.col(f).alias("s"), F.col(f"__mad_{f}").alias("mad")) for f in names])).alias("r")).select(*keys, "r.s.*", "r.mad")
    return _scaled(rows.join(F.broadcast(features.select("feature", "noise_floor")), "feature"))


def counted_baseline(windows: DataFrame, keys: list[str], names: list[str], features: DataFrame) -> DataFrame:
    """``wide_baseline`` with exact percentiles of any number of windows: equal values are counted before they are shuffled,
    and all statistics come from these counts, so that no task holds a program's values. NaN doesn't count."""
    by = [*keys, "feature"]
    counts = stored(long_form(windows, keys, names).where("value is not null and not isnan(value)").groupBy(*by, "value").agg(F.count("*").alias("c")))
    first = counts.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    first = stored(first.join(exact_quantiles(counts, by, "value", weight_col="c").drop("n"), by))
    away = counts.join(first.select(*by, "mean", F.col("p")[1].alias("median")), by)
    away = stored(away.select(*by, "c", F.abs(F.col("value") - F.col("median")).alias("away"), (F.pow(F.col("value") - F.col("mean"), F.lit(2.0)) * F.col("c")).alias("square")))
    std = away.groupBy(*by).agg(F.sqrt(F.sum("square") / F.sum("c")).alias("std"))
    mad = exact_quantiles(away, by, "away", (0.5,), weight_col="c").select(*by, F.col("p")[0].alias("mad"))
    return _scaled(first.join(std, by).join(mad, by).join(F.broadcast(features.select("feature", "noise_floor")), "feature"))


def _between(values: str, q: float) -> Column:
    """Quantile of a sorted array by linear interpolation, null of an empty one."""
    at = F.lit(q) * (F.size(values) - 1)
    low, high = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def _scaled(rows: DataFrame) -> DataFrame:
    named = {f"p{round(100 * q)}": F.col("p")[i] for i, q in enumerate(PERCENTILES)}
    rows = rows.withColumns(named).drop("p").withColumns({"median": F.col("p50"), "nmad": NORMAL * F.col("mad"), "iqr": F.greatest(F.lit(0.0), F.col("p75") - F.col("p25"))})
    return rows.withColumn("effective_scale", F.greatest("nmad", "std", 0.05 * F.abs("median"), "noise_floor"))


SKETCH = 400  #: the sketches' size; up to so many values they are exact


def new_moments(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, std, low, high, sketch) of (by, value) rows: what ``updated_baseline`` needs of new windows."""
    v = F.col("value")
    return long.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"))


def updated_baseline(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Baselines (keys, n, mean, std, low, high, median, noise_floor) brought up to date with moments of new windows.

    Exact but for the median, of which moments know nothing: ``median_estimate`` is halfway between the old one and the
    mean, and the scale is the deviation, at least the noise floor. With sketches on both sides (column ``sketch``) these
    are merged, and ``median`` is theirs.
    """
    squares = lambda df: df.withColumn("m2", F.col("std") ** 2 * F.col("n"))
    sketches = "sketch" in old.columns and "sketch" in new.columns
    rows = combined(squares(old), squares(new), keys).join(old.select(*keys, F.col("median").alias("__median"), "noise_floor", *["sketch"] * sketches), keys, "left")
    floor = F.coalesce("noise_floor", F.lit(1.0))
    rows = rows.withColumns({"std": F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")), "median_estimate": (F.col("mean") + F.coalesce("__median", "mean")) / 2})
    if sketches:
        rows = rows.join(new.select(*keys, F.col("sketch").alias("__new")), keys, "left")
        both = F.when(F.col("sketch").isNull(), F.col("__new")).when(F.col("__new").isNull(), F.col("sketch")).otherwise(F.kll_sketch_merge_double("sketch", "__new"))
        rows = rows.withColumn("sketch", both).withColumn("median", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).drop("__new")
    return rows.withColumn("effective_scale", F.greatest(F.col("std"), floor)).drop("m2", "__median", "noise_floor")


def live_profiles(df: DataFrame, by: str, family: Column, kind_col: str, cols: tuple[str, ...] = ("cpu", "mem", "syscalls")) -> DataFrame:
    """Per program: samples, mean and sample deviation of each live metric, family, and the kinds of events that it has had."""
    made = [e for c in cols for e in (F.avg(c).alias(f"{c}_avg"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    rows = df.groupBy(by).agg(F.count("*").alias("samples"), *made)
    kinds = df.select(by, kind_col).distinct().groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(kind_col)), ",").alias("typical"))
    return rows.join(kinds, by).withColumn("family", family)


def maturity(n: Column, instances: Column) -> tuple[Column, Column]:
    """How far a baseline can be trusted: level and confidence."""
    extra = F.least(F.lit(0.10), (instances - 1) * 0.02)
    cold = (n < 5) | (instances < 1)
    level = F.when(cold, "COLD_START").when(n < 30, "LEARNING").otherwise("MATURE")
    confidence = (
        F.when(cold, F.least(F.lit(0.40), F.greatest(F.lit(0.10), n * 0.08)))
        .when(n < 30, F.least(F.lit(0.79), 0.45 + 0.30 * (n - 5) / 25 + extra))
        .otherwise(F.least(F.lit(1.0), 0.80 + F.least(F.lit(0.10), (n - 30) / 100) + extra))
    )
    return level, confidence


def typical_events(sums: dict[str, Column]) -> Column:
    """Names of the activities whose sum is above 0."""
    return F.array_compact(F.array(*[F.when(c > 0, name) for name, c in sums.items()])).cast("array<string>")


def build_profiles(windows: DataFrame, features: DataFrame, key: str = "profile_id", instance_col: str = "instance_id", order_col: str = "start", label_col: str = "label_binary", minimum: int = MINIMUM, max_windows: int | None = 5000, as_of=None, typical: dict[str, str] | None = None, exact: bool = True, counted: bool = False) -> DataFrame:
    """Baselines of all programs in one job: (key, feature, statistics, observations, instances, period, maturity, confidence, typical).

    Windows labelled as attacks don't count; ``max_windows`` keeps the oldest so many of each program (None: all; exact
    percentiles are then selected by counting, as programs may have any number of windows).
    ``typical`` names the activities that are typical where the sum of a column is above 0. ``counted`` finds the oldest
    windows by counting them by time first.
    """
    typical = {k: c for k, c in (typical or TYPICAL).items() if c in windows.columns}
    clean = windows.where(F.coalesce(F.col(label_col), F.lit(0)) == 0)
    if as_of is not None:
        clean = clean.where(F.col(order_col) <= as_of)
    if max_windows is not None:
        clean = (oldest_counted if counted else oldest)(clean, key, order_col, max_windows)
    seen = clean.groupBy(key).agg(
        F.count("*").alias("observations"), F.count_distinct(instance_col).alias("instances"), F.min(order_col).alias("period_start"), F.max(order_col).alias("period_end"),
        typical_events({k: F.sum(c) for k, c in typical.items()}).alias("typical"),
    ).where(F.col("observations") >= minimum)
    level, confidence = maturity(F.col("observations"), F.col("instances"))
    seen = seen.withColumns({"maturity": level, "confidence": confidence})
    names = [f for f in REGISTRY if f in clean.columns]
    rows = counted_baseline(clean, [key], names, features) if exact and max_windows is None else wide_baseline(clean, [key], names, features, exact)
    return rows.join(seen.hint("shuffle_hash"), key)
