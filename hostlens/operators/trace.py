"""Features of traces of any length: rows of one token each, never gathered into an array (but by ``traces``, whose result is
whole texts).

A trace is cut by a column that doesn't fall along its order (a span of time, say). Within a cut rows are put in order by
a window; what lies across its border comes from one row for each cut, so a key with a third of all rows is as many
tasks as it has cuts. Null tokens are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.operators.sequence import TOP_BIGRAMS, TOP_TRIGRAMS

SIZES = {"token": ("a",), "bigram": ("a", "b"), "trigram": ("a", "b", "c")}


def linked(df: DataFrame, key: str, order: list[str], token_col: str, cut: Column) -> DataFrame:
    """(key, cut, order, a, b, c, p, first, last): each token with the two after it and the one before, null where none
    is; ``first`` and ``last`` tell the ends of a cut."""
    rows = df.select(key, cut.alias("cut"), *order, F.col(token_col).cast("string").alias("a")).where("a is not null")
    w = W.partitionBy(key, "cut").orderBy(*order)
    rows = rows.withColumns({"b": F.lead("a").over(w), "c": F.lead("a", 2).over(w), "p": F.lag("a").over(w)})
    at = F.struct(*order)
    ends = rows.groupBy(key, "cut").agg(
        F.min_by(F.struct("a", "b"), at).alias("head"), F.max_by("a", at).alias("tail"), F.count("*").alias("n"),
    )
    by_cut = W.partitionBy(key).orderBy("cut")
    # The next cut may have one token only; the second one to come is then the first of the cut after it.
    next1, next2 = F.lead("head.a").over(by_cut), F.coalesce(F.lead("head.b").over(by_cut), F.lead("head.a", 2).over(by_cut))
    ends = ends.select(F.col(key).alias("__key"), F.col("cut").alias("__cut"), next1.alias("__next1"), next2.alias("__next2"), F.lag("tail").over(by_cut).alias("__tail"))
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & F.col("cut").eqNullSafe(F.col("__cut")))
    b = F.coalesce("b", "__next1")
    c = F.coalesce("c", F.when(F.col("b").isNotNull(), F.col("__next1")).otherwise(F.col("__next2")))
    return rows.select(key, "cut", *order, "a", b.alias("b"), c.alias("c"), F.coalesce("p", "__tail").alias("p"), F.col("p").isNull().alias("first"), F.col("b").isNull().alias("last"))


def pieces(df: DataFrame, key: str, order: list[str], token_col: str, cut: Column) -> DataFrame:
    """(key, piece, n, tokens): each trace's tokens in order, as one array for each cut; pieces are numbered from 0."""
    rows = df.select(key, cut.alias("cut"), *order, F.col(token_col).alias("__t")).where("__t is not null")
    made = rows.groupBy(key, "cut").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "__t"))), lambda x: x["__t"]).alias("tokens"))
    return made.select(key, (F.row_number().over(W.partitionBy(key).orderBy("cut")) - 1).alias("piece"), F.size("tokens").alias("n"), "tokens")


def traces(df: DataFrame, key: str, order: list[str], token_col: str, cut: Column) -> DataFrame:
    """(key, trace): each key's whole trace as one text. Cuts are put in order on their own; a key's row joins their texts."""
    parts = pieces(df, key, order, token_col, cut).select(key, F.struct("piece", F.array_join("tokens", " ").alias("text")).alias("p"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["text"]), " ").alias("trace"))


def grams(links: DataFrame, kind: str, by: list[str] = ()) -> DataFrame:
    """(by, gram, n) of all traces. Counts combine before the shuffle, so hot grams don't skew it."""
    parts = SIZES[kind]
    return links.where(F.col(parts[-1]).isNotNull()).select(*by, F.concat_ws(" ", *parts).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("n"))


def gram_schema(links: DataFrame, bigrams: int = TOP_BIGRAMS, trigrams: int = TOP_TRIGRAMS) -> DataFrame:
    """(kind, position, gram, n): the vocabulary, and the most frequent bigrams and trigrams (ties in order of wording)."""
    # Tokens are numbered within blocks of equal beginnings; only the blocks' sizes are added up in one place.
    vocab = grams(links, "token").withColumn("__block", F.substring("gram", 1, 2))
    blocks = vocab.groupBy("__block").agg(F.count("*").alias("__m")).withColumn("__before", F.sum("__m").over(W.orderBy("__block")) - F.col("__m"))
    place = F.row_number().over(W.partitionBy("__block").orderBy("gram")) - 1
    out = vocab.withColumn("__place", place).join(blocks, "__block").select(F.lit("token").alias("kind"), (F.col("__place") + F.col("__before")).cast("int").alias("position"), "gram", "n")
    for kind, most in (("bigram", bigrams), ("trigram", trigrams)):
        top = grams(links, kind).orderBy(F.desc("n"), "gram").limit(most)
        out = out.unionByName(top.select(F.lit(kind).alias("kind"), (F.row_number().over(W.orderBy(F.desc("n"), "gram")) - 1).alias("position"), "gram", "n"))
    return out


def stats(links: DataFrame, key: str) -> DataFrame:
    """(key, length, n_distinct, diversity, repeats, repetition_ratio, entropy): from the counts of each key's tokens."""
    n = links.groupBy(key, "a").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    rows = n.groupBy(key).agg(F.sum("n").alias("length"), F.count("*").alias("n_distinct"), F.sum("same").alias("repeats"), F.sum(F.col("n") * F.log2("n")).alias("__s"))
    per = F.col("n_distinct") / F.col("length")
    return rows.select(key, "length", "n_distinct", per.alias("diversity"), "repeats", (1 - per).alias("repetition_ratio"), (F.log2("length") - F.col("__s") / F.col("length")).alias("entropy"))


def runs(links: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, longest, n_runs): the longest run of one token, and the number of runs longer than 1.

    A cut sums up to its first and last run and to what lies between; first and last ones are joined across borders.
    """
    w = W.partitionBy(key, "cut").orderBy(*order)
    new = F.col("first") | (F.col("p") != F.col("a"))
    each = links.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy(key, "cut", "run").agg(F.first("a").alias("token"), F.count("*").alias("n"), F.max("last").alias("ends"))
    each = each.withColumns({"begins": F.col("run") == 1, "n_more": (F.col("n") > 1).cast("long")})
    inner = each.where(~F.col("begins") & ~F.col("ends")).groupBy(key).agg(F.max("n").alias("longest"), F.sum("n_more").alias("n_runs"))
    by_key = W.partitionBy(key).orderBy("cut", "run")
    edge = each.where(F.col("begins") | F.col("ends"))
    opens = ~(F.col("begins") & F.lag("ends").over(by_key) & (F.lag("token").over(by_key) == F.col("token")))
    edge = edge.withColumn("group", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(by_key)).groupBy(key, "group").agg(F.sum("n").alias("n"))
    edge = edge.groupBy(key).agg(F.max("n").alias("longest"), F.count_if(F.col("n") > 1).alias("n_runs"))
    return edge.unionByName(inner).groupBy(key).agg(F.max("longest").alias("longest"), F.sum("n_runs").alias("n_runs"))


def number_stats(df: DataFrame, key: str, number_col: str) -> DataFrame:
    """Mean, population deviation and extremes of each key's numbers, whatever their order."""
    x = F.col(number_col).cast("double")
    return df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))


def gram_counts(links: DataFrame, key: str, schema: DataFrame) -> DataFrame:
    """(key, kind, position, gram, count) of the schema's grams: the sparse form of the feature matrix."""
    out = None
    for kind in SIZES:
        c = grams(links, kind, [key]).select(key, F.lit(kind).alias("kind"), "gram", F.col("n").alias("count"))
        out = c if out is None else out.unionByName(c)
    return out.join(schema.select("kind", "gram", "position"), ["kind", "gram"]).select(key, "kind", "position", "gram", "count")


def feature_matrix(links: DataFrame, key: str, order: list[str], schema: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """Wide features in a given order of (kind, gram): statistics, runs, entropy, then one count per gram."""
    wide = gram_counts(links, key, schema).withColumn("name", F.concat_ws(":", "kind", "gram")).groupBy(key).pivot("name", [f"{k}:{g}" for k, g in names]).agg(F.first("count"))
    rows = stats(links, key).join(runs(links, key, order), key).join(wide, key, "left")
    return rows.fillna(0, [f"{k}:{g}" for k, g in names])


def structural_features(links: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Features that mean the same whatever the vocabulary, as ``sequence.structural_features`` has them for arrays."""
    rows = stats(links, key).join(runs(links, key, order), key)
    names = ("length", "n_distinct", "diversity", "repeats", "longest", "n_runs", "entropy")
    return rows.select(key, *[F.col(c).cast("double").alias(c) for c in names], (F.col("n_runs") / F.greatest(F.lit(1), F.col("length"))).alias("run_ratio"))
