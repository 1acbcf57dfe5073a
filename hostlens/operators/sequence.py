"""N-gram features of token sequences, with higher-order functions and grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_BIGRAMS, TOP_TRIGRAMS = 50, 30


def traces(df: DataFrame, by: list[str], order: list[str], token_col: str) -> DataFrame:
    """One ordered token array per key."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(token_col).alias("__t")))), lambda x: x["__t"]).alias("tokens"))


def ngrams(tokens: Column | str, n: int) -> Column:
    """All runs of n tokens, joined by blanks (empty for shorter sequences)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))


def counts(df: DataFrame, tokens_col: str, n: int = 1) -> DataFrame:
    """(gram, n): how often each occurs. Counts combine before the shuffle, so hot grams don't skew it."""
    grams = F.col(tokens_col) if n == 1 else ngrams(tokens_col, n)
    return df.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def feature_schema(df: DataFrame, tokens_col: str = "tokens", bigrams: int = TOP_BIGRAMS, trigrams: int = TOP_TRIGRAMS) -> DataFrame:
    """(kind, position, gram, n): the vocabulary, and the most frequent bigrams and trigrams (ties in order of wording)."""
    from pyspark.sql import Window as W

    # Tokens are numbered within blocks of equal beginnings; only the blocks' sizes are added up in one place.
    vocab = counts(df, tokens_col).withColumn("__block", F.substring("gram", 1, 2))
    blocks = vocab.groupBy("__block").agg(F.count("*").alias("__m")).withColumn("__before", F.sum("__m").over(W.orderBy("__block")) - F.col("__m"))
    place = F.row_number().over(W.partitionBy("__block").orderBy("gram")) - 1
    vocab = vocab.withColumn("__place", place).join(blocks, "__block").select("gram", "n", F.lit("token").alias("kind"), (F.col("__place") + F.col("__before")).cast("int").alias("position"))
    parts = [vocab]
    for n, kind, most in ((2, "bigram", bigrams), (3, "trigram", trigrams)):
        top = counts(df, tokens_col, n).orderBy(F.desc("n"), "gram").limit(most)
        parts.append(top.withColumn("kind", F.lit(kind)).withColumn("position", F.row_number().over(W.orderBy(F.desc("n"), "gram")) - 1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "position", "gram", "n")


def sequence_stats(tokens: Column | str) -> dict[str, Column]:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    size, unique = F.size(t), F.size(F.array_distinct(t))
    pairs = F.when(size >= 2, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    repeats = F.size(F.filter(pairs, lambda i: F.element_at(t, i) == F.element_at(t, i + 1)))
    per = F.greatest(F.lit(1), size)
    return {"length": size, "n_distinct": unique, "diversity": unique / per, "repeats": repeats, "repetition_ratio": 1 - unique / per}


def int_stats(tokens: Column | str) -> dict[str, Column]:
    """Mean, population deviation and extremes of a sequence of numbers (0 for an empty one)."""
    t = F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda x: x.cast("double"))
    n = F.greatest(F.lit(1), F.size(t))
    mean = F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(t, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")))["s"]
    return {"mean": mean, "std": F.sqrt(square / n), "low": F.coalesce(F.array_min(t), F.lit(0.0)), "high": F.coalesce(F.array_max(t), F.lit(0.0))}


def schema_names(schema: DataFrame) -> DataFrame:
    """(column, name): the names of a feature matrix's columns, tokens first, then bigrams and trigrams, each in its order."""
    order = F.when(F.col("kind") == "token", 0).when(F.col("kind") == "bigram", 1).otherwise(2)
    return schema.select(order.alias("part"), "position", F.concat_ws(":", "kind", "gram").alias("name"))


def schema_from_names(names: DataFrame) -> DataFrame:
    """(kind, position, gram) from the names of ``schema_names``: what an extractor needs is in the columns' names."""
    cut = F.instr("name", ":")
    return names.select(F.substring_index("name", ":", 1).alias("kind"), "position", F.substring(F.col("name"), cut + 1, F.length("name")).alias("gram"))


def structural_features(df: DataFrame, key: str, tokens_col: str = "tokens") -> DataFrame:
    """(key, SHARED): features that mean the same whatever the vocabulary, for models that pass between domains."""
    stats = sequence_stats(tokens_col)
    rows = df.select(key, *[stats[n].cast("double").alias(n) for n in ("length", "n_distinct", "diversity", "repeats")], run_features(tokens_col).alias("r"))
    rows = rows.withColumns({"longest": F.col("r.longest").cast("double"), "n_runs": F.col("r.n_runs").cast("double")}).drop("r")
    rows = rows.withColumn("run_ratio", F.col("n_runs") / F.greatest(F.lit(1.0), F.col("length")))
    return rows.join(entropy(df, key, tokens_col), key, "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


SHARED = ("length", "n_distinct", "diversity", "repeats", "entropy", "longest", "n_runs", "run_ratio")


def run_features(tokens: Column | str) -> Column:
    """struct(longest, n_runs): the longest run of one token, and the number of runs longer than 1."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    kind = "struct<last:string,size:int,longest:int,runs:int>"
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("size"), F.lit(0).alias("longest"), F.lit(0).alias("runs")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        same = a["last"].eqNullSafe(x.cast("string"))
        size = F.when(same, a["size"] + 1).otherwise(1)
        return F.struct(x.cast("string").alias("last"), size.alias("size"), F.greatest(a["longest"], size).alias("longest"), (a["runs"] + F.when(same & (a["size"] == 1), 1).otherwise(0)).alias("runs")).cast(kind)

    return F.aggregate(t, start, step, lambda a: F.struct(a["longest"].alias("longest"), a["runs"].alias("n_runs")))


def entropy(df: DataFrame, key: str, tokens_col: str = "tokens") -> DataFrame:
    """(key, entropy) in bits of each sequence's token distribution; works on sequences of any length."""
    n = df.select(key, F.explode(tokens_col).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n"))).alias("s"))
    return total.select(key, (F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))


def gram_matrix(df: DataFrame, key: str, schema: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(key, kind, position, count) of the schema's grams: the sparse form of the feature matrix."""
    out = None
    for n, kind in ((1, "token"), (2, "bigram"), (3, "trigram")):
        grams = F.col(tokens_col) if n == 1 else ngrams(tokens_col, n)
        c = df.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("count")).withColumn("kind", F.lit(kind))
        out = c if out is None else out.unionByName(c)
    return out.join(schema.select("kind", "gram", "position"), ["kind", "gram"]).select(key, "kind", "position", "gram", "count")


def feature_matrix(df: DataFrame, key: str, schema: DataFrame, names: list[tuple[str, str]], tokens_col: str = "tokens") -> DataFrame:
    """Wide features in a given order of (kind, gram): statistics, runs, entropy, then one count per gram."""
    wide = gram_matrix(df, key, schema, tokens_col).withColumn("name", F.concat_ws(":", "kind", "gram")).groupBy(key).pivot("name", [f"{k}:{g}" for k, g in names]).agg(F.first("count"))
    stats = df.select(key, *[c.alias(n) for n, c in sequence_stats(tokens_col).items()], run_features(tokens_col).alias("r")).select("*", "r.longest", "r.n_runs").drop("r")
    rows = stats.join(entropy(df, key, tokens_col), key, "left").join(wide, key, "left")
    return rows.fillna(0, [f"{k}:{g}" for k, g in names])
