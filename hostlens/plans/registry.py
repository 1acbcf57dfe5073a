"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostlens.plans import behaviour, history, jobs, text
from hostlens.plans._bind import Query

MODULES = (behaviour, history, text, jobs)


def _all() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.Q.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() if callable(q.sql) else q.sql for name, q in _all().items() if q.sql}
