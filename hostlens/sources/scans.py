"""Scans of collector files: everything is read as text and coerced by name, so a bad field never loses a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.functions.normalize import int_trace, label_binary, named_trace, parse_time
from hostlens.sources.layouts import EVENT_FIELDS, INT_CATEGORIES, NAMED_CATEGORIES, NOT_TRACES, SESSION_FIELDS


def raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").csv(path)


def table_csv(spark: SparkSession, path: str, layout: dict[str, str]) -> DataFrame:
    """A collector file by its layout. Columns are found by name: others are left out, missing ones get their default."""
    return coerced(spark.read.option("header", True).option("emptyValue", "").csv(path), layout)


def coerced(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns by kind: plain, text (empty: null), int, long, double (bad: 0), time, flag (1/true/True), label, json (else wrapped).

    ``int?`` and the like are null where the field is empty; ``kind=value`` is what a column has that df lacks.
    """
    out = {}
    for c, kind in kinds.items():
        kind, _, default = kind.partition("=")
        optional, kind = kind.endswith("?"), kind.rstrip("?")
        x = F.col(c) if c in df.columns else F.lit(default or None).cast("string")
        if kind == "plain":
            y = F.coalesce(x, F.lit(""))
        elif kind == "text":
            y = F.nullif(x, F.lit(""))
        elif optional:
            y = F.when(F.coalesce(x, F.lit("")) != "", F.coalesce(x.try_cast(kind), F.lit(0).cast(kind)))
        elif kind in ("int", "long", "double"):
            y = F.coalesce(F.when(x != "", x.try_cast(kind)), F.lit(0).cast(kind))  # an empty field is no number: casting it to find out is slow
        elif kind == "time":
            y = parse_time(x)
        elif kind == "flag":
            y = F.coalesce(x.isin("1", "true", "True"), F.lit(False))
        elif kind == "label":
            y = F.coalesce(x.try_cast("int"), label_binary(x))
        else:
            y = F.coalesce(F.from_json(x, "map<string,string>"), F.when(F.coalesce(x, F.lit("")) != "", F.create_map(F.lit("raw"), x)))
        out[c] = y.alias(c)
    return df.select(*out.values())


def trace_directory(spark: SparkSession, root: str, named: bool = False, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """Traces under ``root/split=*/category=*``: (path, split, category, tokens, bad), and a quarantine of those without valid tokens."""
    reader = spark.read.option("wholetext", whole_files).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    rows = reader.text(root).withColumn("path", F.input_file_name())
    part = lambda k: F.regexp_extract("path", rf"{k}=([^/]+)", 1)
    good, bad = (named_trace if named else int_trace)("value")
    rows = rows.select("path", part("split").alias("split"), part("category").alias("category"), good.alias("tokens"), bad.alias("bad"))
    return rows.where(F.size("tokens") > 0), rows.where(F.size("tokens") == 0)


def _trace_files(spark: SparkSession, root: str, named: bool) -> DataFrame:
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    good, bad = (named_trace if named else int_trace)("value")
    path = F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+/[^/]+|[^/]+/[^/]+)$", 1)
    rows = rows.select(F.input_file_name().alias("file"), path.alias("path"), good.alias("tokens"), F.size(bad).alias("n_bad"))
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))  # a plus is no blank in a path
    return rows.withColumn("file_name", name).where(~F.col("file_name").startswith(".") & ~F.col("file_name").isin(*NOT_TRACES))


def int_trace_directory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Traces of numbers under Training_Data_Master, Validation_Data_Master (normal) and Attack_Data_Master/<category>_<n>.

    (file_name, tokens, label, category, source_split); and the files that are empty or hold anything else, which don't count.
    """
    rows = _trace_files(spark, root, False)
    folder = F.regexp_extract("file", r"/(Training|Validation|Attack)_Data_Master/", 1)
    inner = F.regexp_extract("file", r"/Attack_Data_Master/([^/.][^/]*)/[^/]+$", 1)
    rows = rows.withColumns({"__f": folder, "__d": inner}).where("__f in ('Training', 'Validation') or __d <> ''")
    category = F.col("__d")
    for c in reversed(INT_CATEGORIES):
        category = F.when(F.col("__d").startswith(c), c).otherwise(category)
    attack = F.col("__f") == "Attack"
    rows = rows.withColumns({"label": attack.cast("int"), "category": F.when(attack, category).otherwise("normal"), "source_split": F.lower("__f"), "file_name": F.regexp_replace("file_name", r"\.txt$", "")})
    good = (F.size("tokens") > 0) & (F.col("n_bad") == 0)
    return rows.where(good).select("file_name", "tokens", "label", "category", "source_split"), rows.where(~good).select("file_name", "category", "source_split", "n_bad")


def named_trace_directory(spark: SparkSession, root: str, max_baseline: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Traces of names under attack/<category>_<n> and baseline/<activity>; the file's stem is the process.

    (pid, tokens, label, category, subcategory, source_split, file_path), and the files without tokens. Of baseline traces
    at most ``max_baseline`` are kept, chosen by a seeded hash of their paths.
    """
    rows = _trace_files(spark, root, True)
    split, inner = F.element_at(F.split("path", "/"), -3), F.element_at(F.split("path", "/"), -2)
    rows = rows.withColumns({"source_split": split, "subcategory": inner}).where("source_split in ('attack', 'baseline') and not startswith(subcategory, '.')")
    head = F.substring_index("subcategory", "_", 1)
    attack = F.col("source_split") == "attack"
    category = F.when(~attack, "normal").when(head.isin(*NAMED_CATEGORIES), head).otherwise(F.col("subcategory"))
    rows = rows.withColumns({"label": attack.cast("int"), "category": category, "pid": F.regexp_replace("file_name", r"\.txt$", ""), "file_path": F.col("path")})
    if max_baseline is not None:
        rows = subsample(rows, "source_split = 'baseline'", max_baseline, "file_path", seed)
    columns = ["pid", "tokens", "label", "category", "subcategory", "source_split", "file_path"]
    return rows.where(F.size("tokens") > 0).select(*columns), rows.where(F.size("tokens") == 0).select("pid", "subcategory", "source_split", "n_bad")


def session_rows(df: DataFrame, session: dict[str, str]) -> DataFrame:
    """Events in the columns of the flat event file: those they lack are null, empty session columns get the session's value."""
    out = []
    for c in EVENT_FIELDS:
        x = F.col(c) if c in df.columns else F.lit(None).cast("string")
        out.append((F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(session.get(c))) if c in SESSION_FIELDS else x).alias(c))
    return df.select(*out)


def subsample(df: DataFrame, where: str, most: int, id_col: str, seed: int = 42) -> DataFrame:
    """All other rows, and of those that match at most that many, chosen by a seeded hash of the id."""
    picked = df.where(where).orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed).cast("string")))).limit(most)
    return df.where(f"not ({where}) or ({where}) is null").unionByName(picked)


def feature_csv(spark: SparkSession, path: str, features: list[str], meta: dict[str, str]) -> DataFrame:
    """A feature matrix with its columns in the authoritative order, whatever order the file has."""
    header = spark.read.option("header", True).csv(path)
    missing = [c for c in [*features, *meta] if c not in header.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return header.select(*[F.col(c).try_cast("double").alias(c) for c in features], *[F.col(c).try_cast(k).alias(c) for c, k in meta.items()])
