"""From documents to token ids, in five stages, each calling one operator of ``hostlens.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents. Each row is a document of its own: rows whose ids are null or repeated, and columns named like
a stage's own, pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from hostlens.llm._common import dropped, saved, small, table, tables_dropped


def names() -> list[Column]:
    """What finds a row again by its id and text, on which all decisions depend: rows alike are treated alike."""
    return [F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes")]


def named(docs: DataFrame) -> DataFrame:
    """The names, and the row's columns within a struct, where theirs clash with none."""
    return docs.select(*names(), F.struct(*docs.columns).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose calibrated quality score is below the classifier's threshold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit_on_labels(docs.select("doc_id", "text"), labels)
    scored = quality.scored(docs, model, out="__score", keep_text=True)
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more. Null ids join no group."""
    temporary: list[str] = []
    # Saved, so that the numbers stay; they are unique, which ids need not be.
    rows = saved(docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("number"), *names(), "text"), "numbered", temporary)
    groups = ngram_join.jaccard_components(rows.select("number", "text"), id_col="number", k=5, num=8, den=10).select("number", "component_id")
    ids = saved(groups, "groups", temporary).join(rows.drop("text"), "number")
    first = saved(ids.groupBy("component_id").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("component_id", "first"), "firsts", temporary)
    other = saved(ids.join(small(first, ngram_join.FEW_IDS), "component_id").where("id > first").select("id", "key", "n_bytes").distinct(), "other")
    dropped(spark, temporary)
    return named(docs).join(small(other, ngram_join.FEW_IDS), ["id", "key", "n_bytes"], "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id holds; drop documents of which nothing is left by that."""
    cut = suffix_dedup.remove_repeats(docs.select(*names(), "text"), id_col="id", keep_text=True, key_col="key", as_text=True)
    # Only the rows that are cut have another text than before; the others pass as they are.
    changed = cut.where("n_removed > 0").groupBy("id", "key", "n_bytes").agg(F.first("kept").alias("left"))
    after = named(docs).join(changed, ["id", "key", "n_bytes"], "left").where("left is null or length(left) > 0")
    whole = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        whole = whole.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    return after.select(F.when(F.col("left").isNull(), F.col("row")).otherwise(whole).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; the text's length follows where a document is cut at its target."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: little-endian 32-bit integers in a binary column, and their number."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: SQL can't express the classifier, the seeded mix or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage saved on its way, and the table that it read, are dropped once its own table is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        written: list[str] = []
        with tables_dropped(spark):
            docs = saved(stage(spark, docs, sf_dir), name, written)
        dropped(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
