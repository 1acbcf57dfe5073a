"""Coercion of raw fields: every function gives a defined value for bad input instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_time(text: str | Column) -> Column:
    """ISO text (with or without zone; none means UTC) or a number of seconds; anything else is null."""
    c = F.trim(_c(text))
    number = F.when(c != "", c.try_cast("double"))
    iso = F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d\d-\d\d"), c))
    return F.coalesce(iso, F.when(F.abs(number) < 1e12, F.timestamp_micros(F.round(number * 1_000_000).try_cast("long"))))


def to_iso(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_int(c: str | Column, default: int = 0) -> Column:
    return F.coalesce(_c(c).try_cast("int"), F.lit(default))


def safe_float(c: str | Column, default: float = 0.0) -> Column:
    return F.coalesce(_c(c).try_cast("double"), F.lit(default))


def finite(c: str | Column, name: str) -> Column:
    """struct(value, error): the number, or 0 and why it isn't one."""
    x = _c(c)
    v = x.try_cast("double")
    error = (
        F.when(x.isNull(), f"{name} is None").when(v.isNull(), f"{name} is not numeric")
        .when(F.isnan(v), f"{name} is NaN").when(F.abs(v) == float("inf"), f"{name} is infinite")
    )
    return F.struct(F.when(error.isNull(), v).otherwise(F.lit(0.0)).alias("value"), error.alias("error"))


def label_binary(label: str | Column) -> Column:
    """0 for ordinary, null for unlabelled, 1 for anything else."""
    c = F.lower(F.trim(F.coalesce(_c(label), F.lit(""))))
    return F.when(c.isin("benign", "normal", "0"), 0).when(c.isin("unlabeled", "unlabelled", ""), F.lit(None)).otherwise(1).cast("int")


def split_label(label: str | Column) -> tuple[Column, Column]:
    """Label and scenario of ``label:scenario``."""
    parts = F.split(_c(label), ":", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def int_trace(text: str | Column) -> tuple[Column, Column]:
    """Valid ids and bad tokens of a text of numbers."""
    tokens = F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda t: t != "")
    return F.transform(F.filter(tokens, lambda t: t.rlike(r"^[+-]?\d{1,9}$")), lambda t: t.cast("int")), F.filter(tokens, lambda t: ~t.rlike(r"^[+-]?\d{1,9}$"))


def named_trace(text: str | Column) -> tuple[Column, Column]:
    """Valid lower-case names, cut at a parenthesis, and the tokens that aren't names."""
    tokens = F.transform(F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda t: t != ""), lambda t: F.lower(F.substring_index(t, "(", 1)))
    return F.filter(tokens, lambda t: t.rlike("^[a-z][a-z0-9_]*$")), F.filter(tokens, lambda t: ~t.rlike("^[a-z][a-z0-9_]*$"))


def trace_problems(tokens: Column, label: Column, category: Column) -> Column:
    """Why a trace record can't be used (empty: it can)."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.size(tokens), F.lit(0)) < 1, "empty sequence"),
        F.when(~F.coalesce(label.isin(0, 1), F.lit(False)), "bad label"),
        F.when(F.coalesce(F.trim(category), F.lit("")) == "", "no category"),
    ))


def open_flags(flags: str | Column) -> Column:
    """struct(ops, writes, creates) of an open() flag word."""
    f = _c(flags)
    access = f.bitwiseAND(3)
    bit = lambda n: f.bitwiseAND(n) != 0
    ops = F.array_compact(F.array(
        F.when(access == 0, "read"), F.when(access == 1, "write"), F.when(access == 2, "readwrite"),
        F.when(bit(0o100), "create"), F.when(bit(0o1000), "truncate"), F.when(bit(0o2000), "append"),
    ))
    return F.struct(ops.alias("ops"), access.isin(1, 2).alias("writes"), bit(0o100).alias("creates"))


def endpoint(ip: Column, port: Column) -> Column:
    return F.when(ip.isNotNull() & (ip != ""), F.concat_ws(":", ip, port.cast("string")))


def counter_delta(value: str | Column, by: list[str], order: list[str], clamp: bool = False) -> Column:
    """Growth of a counter since the row before. A fall is a reset: the new value counts, or 0 if clamped."""
    v = _c(value)
    d = v - F.lag(v).over(W.partitionBy(*by).orderBy(*order))
    return F.when(d < 0, F.lit(0) if clamp else v).otherwise(d)


def counter_rate(counter: str | Column, seconds: str | Column, by: list[str], order: list[str]) -> Column:
    """Growth of a counter since the row before, per second; 0 where it fell, null at the first row."""
    w = W.partitionBy(*by).orderBy(*order)
    grown, elapsed = _c(counter) - F.lag(_c(counter)).over(w), _c(seconds) - F.lag(_c(seconds)).over(w)
    return F.when(grown.isNotNull(), F.greatest(grown, F.lit(0))) / F.greatest(elapsed, F.lit(1e-6))
