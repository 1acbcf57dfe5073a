"""Mix sources to target weights by whole blocks of documents, split exactly over output shards.

Sizes are words. Each source's documents are cut into blocks by a hash of their names; a seeded permutation orders the
blocks. A source whose target is r times its size has every document floor(r) times and a prefix of the permuted
blocks once more; inside the block where the target is reached, documents follow in permuted order and the last one
is taken only as far as the target goes, so each source's words equal its rounded target.

The drawn blocks of all sources are then dealt to output shards by a splitting tree: at each node the number of
blocks of each source that go left is a multivariate hypergeometric draw, so every shard's total is exact and every
split of the blocks is equally likely. A shard gets disjoint runs of each source's permuted blocks and is shuffled
locally by a seeded hash. Everything is a function of ids, sources, sizes and the seed, so reruns agree.

Null texts and texts without words have size 0 and are never taken; a null source is a source of its own, last in
order. A source without words has target 0. No rows: no targets. Each row is a document of its own: its name is made of
id, text and source, and of a number from 0 among rows that are alike in these, so that rows that repeat an id or have
none are spread over blocks as any others. Rows that are alike share out what is taken of them: which is which is chance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.llm._common import partitions, saved, small

WEIGHTS = (3, 1, 2)
FACTOR, MOST = 1.5, 2.0
BLOCK_WORDS = 100_000  #: a source has one block for so many words, up to MAX_BLOCKS; blocks then grow with the source
MAX_BLOCKS = 65_536
SHARDS = 16  #: at least; there is one for each SHARD_WORDS of the corpus
SHARD_WORDS = 50_000_000
SEED = 7
FEW_BLOCKS = 500_000  #: most rows of a few numbers that are broadcast: blocks, or rows of which there are several
MADE = ("size", "source_size", "target", "taken", "shard", "place")  #: what a mix says of each document


def words(text: str | Column) -> Column:
    r"""The number of runs [^\x20\x09-\x0D]+ in a text; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """One row per source (source, source_size, target): weights repeat over sources in code-point order, null last.

    Targets share factor times all words by weight; what exceeds most times a source's size is shared again among the
    others. The limit is where all sources with size / weight below a level are full, found by one ordered sum.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: these windows are over sources, not documents.
    everywhere = W.partitionBy()
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("room", most * F.col("source_size")).withColumn("budget", factor * F.sum("source_size").over(everywhere))
    order = W.orderBy(F.col("room") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    # The first source in order whose room exceeds its share at its own level sets the level for all after it.
    ranked = ranked.withColumn("fits", F.col("room") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("fits"), F.struct(F.col("room") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everywhere)["level"]
    target = F.when(F.coalesce(F.col("weight") * final >= F.col("room"), F.lit(True)), F.col("room")).otherwise(F.col("weight") * final)
    return ranked.select("source", "source_size", target.alias("target"))


def split_blocks(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal counts[s] blocks of each source s to shards: a (shards, sources) matrix whose rows have equal sums (+-1)."""
    if shards == 1:
        return counts[None, :]
    left, total = shards // 2, int(counts.sum())
    room = sum(total // shards + (k < total % shards) for k in range(left))
    drawn = rng.multivariate_hypergeometric(counts, room, method="marginals") if total else counts * 0
    return np.concatenate([split_blocks(drawn, left, rng), split_blocks(counts - drawn, shards - left, rng)])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = SEED, keep: bool = False) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words the mix takes), shard and place in it.

    ``shard`` and ``place`` say where a document's taken words go and in which order (null where none are taken).
    ``keep`` keeps all other columns too, except ones named like an output.
    """
    extra = [c for c in docs.columns if c not in {*MADE, id_col, source_col}] if keep else []
    rows = _mixed(docs, id_col, text_col, source_col, shards, seed, extra)
    return rows.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), *MADE, *[F.col(f"__x_{c}").alias(c) for c in extra])


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int | None, seed: int, extra: list[str]) -> DataFrame:
    """__id, __source, MADE, and the columns ``extra`` with __x_ before their names, which clash with none of these."""
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), words(text_col).alias("size"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("__text"), *[F.col(c).alias(f"__x_{c}") for c in extra])
    narrow = saved(sized.select("__id", "__source", "size", "__text"), "sizes")
    again = saved(narrow.groupBy("__id", "__source", "__text").agg(F.count("*").alias("n")).where("n > 1"), "again")
    narrow, sized = _named(narrow, again, seed), _named(sized, again, seed) if extra else None
    shards = shards or max(SHARDS, (narrow.agg(F.sum("size").alias("n")).head()["n"] or 0) // SHARD_WORDS)
    plan, dealt = _plan(narrow, shards, seed)
    rows = sized if extra else narrow
    rows = rows.join(small(plan), rows["__source"].eqNullSafe(plan["source"])).withColumns(_position(seed))
    rows = rows.join(small(dealt, FEW_BLOCKS), ["source_key", "block"], "left")
    after = F.struct("spot", "block") > F.struct("edge_spot", "edge_block")
    at_edge = F.struct("spot", "block") == F.struct("edge_spot", "edge_block")
    in_edge = F.when(F.col("turn") < F.col("last_turn"), F.col("size")).when(F.col("turn") == F.col("last_turn"), F.least("size", "last_part")).otherwise(0)
    once = F.when(F.col("edge_spot").isNull() | after, 0).when(at_edge, in_edge).otherwise(F.col("size"))
    taken = (F.col("whole") * F.col("size") + once).cast("long")
    return rows.select(
        "__id", "__source", "size", "source_size", "target", taken.alias("taken"), F.when(taken > 0, F.col("shard")).alias("shard"),
        F.when(taken > 0, F.xxhash64("name", F.lit(seed + 1))).alias("place"), *[f"__x_{c}" for c in extra],
    )


def _named(rows: DataFrame, again: DataFrame, seed: int) -> DataFrame:
    """Add ``name``, a hash of id, source, text and of the row's number among rows alike.

    Only rows of which there are several (``again``) are numbered: within each of the partitions in which they are found,
    and on from partition to partition, so that the copies of one row, however many, don't meet in a task.
    """
    keys = ["__id", "__source", "__text"]
    name = lambda number: F.xxhash64(F.lit(seed), F.coalesce(F.col("__id").cast("string"), F.lit("\0null")), F.coalesce("__source", F.lit("\0null")), "__text", number)
    if again.isEmpty():
        return rows.withColumn("name", name(F.lit(0).cast("long")))
    few = small(again.select(*[F.col(k).alias(f"_{k}") for k in keys]), FEW_BLOCKS)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    once = rows.join(few, same, "left_anti").withColumn("name", name(F.lit(0).cast("long")))
    many = saved(rows.join(few, same, "left_semi").withColumn("__part", F.spark_partition_id()), "many")
    parts = many.groupBy(*keys, "__part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(W.partitionBy(*keys).orderBy("__part")) - F.col("n"))  # one row for each partition
    parts = saved(parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("__part").alias("_part"), "before"), "parts")
    place = F.row_number().over(W.partitionBy(*keys, "__part").orderBy("size")) - 1
    many = many.withColumn("place", place).join(parts, [*same, F.col("__part") == F.col("_part")])
    return once.unionByName(many.withColumn("name", name((F.col("before") + F.col("place")).cast("long"))).select(*rows.columns, "name"))


def _position(seed: int) -> dict[str, Column]:
    """Where a document stands in its source's permuted order: its block, the block's spot, its turn in the block."""
    block = F.pmod(F.xxhash64("source_key", "name"), F.col("n_blocks"))
    return {"block": block, "spot": F.xxhash64("source_key", block, F.lit(seed)), "turn": F.xxhash64("name", F.lit(seed))}


def _plan(narrow: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """All decisions of the mix in one row per source, and the shard of each block; saved, as document rows are joined with them.

    ``edge_*`` name the block in which the target is reached, ``last_*`` the document in it and the words of it.
    """
    goal = targets(narrow.select(F.col("__source").alias("source"), "size"))
    n_blocks = F.least(F.lit(MAX_BLOCKS), F.floor(F.col("source_size") / BLOCK_WORDS) + 1)
    goal = goal.withColumns({"n_blocks": n_blocks, "goal": F.floor(F.col("target") + 0.5), "source_key": F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null")))})
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0))
    goal = saved(goal.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size")), "goals")
    keyed = narrow.join(small(goal), narrow["__source"].eqNullSafe(goal["source"])).drop("__source").withColumns(_position(seed))
    blocks = keyed.groupBy("source_key", "spot", "block", "whole", "rest").agg(F.sum("size").alias("block_size"))
    order = W.partitionBy("source_key").orderBy("spot", "block")
    blocks = saved(blocks.withColumn("before", F.sum("block_size").over(order) - F.col("block_size")), "blocks")
    edge = blocks.where("before < rest and before + block_size >= rest").select("source_key", F.col("spot").alias("edge_spot"), F.col("block").alias("edge_block"), (F.col("rest") - F.col("before")).alias("left"))
    # One block of each source, of some BLOCK_WORDS words up to MAX_BLOCKS blocks: the only place where documents themselves
    # are put in order.
    inside = keyed.join(small(edge), "source_key").where("spot = edge_spot and block = edge_block")
    turns = W.partitionBy("source_key").orderBy("turn", F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("here", F.sum("size").over(turns) - F.col("size")).where("here < left and here + size >= left")
    last = inside.groupBy("source_key").agg(F.min_by(F.struct("turn", (F.col("left") - F.col("here")).alias("part")), "here").alias("last"))
    last = last.select("source_key", F.col("last.turn").alias("last_turn"), F.col("last.part").alias("last_part"))
    plan = goal.join(edge.drop("left"), "source_key", "left").join(last, "source_key", "left")
    return saved(plan.drop("goal", "rest"), "plan"), saved(_deal(blocks, shards, seed), "dealt")


def _deal(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_key, block, shard) of the blocks that are drawn. The tree works on one count per source."""
    drawn = blocks.where("block_size > 0 and (whole > 0 or before < rest)")
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("source_key").orderBy("spot", "block")) - 1)
    counts = drawn.groupBy("source_key").agg(F.count("*").alias("n"))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_key")
        dealt = split_blocks(rows["n"].to_numpy(), shards, np.random.default_rng(seed))
        k, s = np.nonzero(dealt)
        return pd.DataFrame({"source_key": rows["source_key"].to_numpy()[s], "shard": k.astype("int32"), "rank": (dealt.cumsum(axis=0) - dealt)[k, s]})

    spans = counts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(tree, "source_key long, shard int, rank long")
    # A span begins at one of the source's ranks; the blocks after it, MAX_BLOCKS of a source at most, go to the same shard.
    begins = ranked.join(spans, ["source_key", "rank"], "left")
    shard = F.last("shard", ignorenulls=True).over(W.partitionBy("source_key").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return begins.select("source_key", "block", shard.alias("shard"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The mix itself with the columns of docs: whole passes repeat a row, a partial one keeps the text's first words.

    Rows are dealt to partitions by ranges of shard and place and in order there, so files read one after another give
    shard after shard, each shuffled within. Columns of docs named like an output of ``mix`` pass as they are.
    """
    rows = _mixed(docs, id_col, text_col, source_col, shards, seed, docs.columns).where("taken > 0")
    passes = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = rows.withColumn("__pass", F.explode(passes))
    rest = F.col("taken") - (F.col("__pass") - 1) * F.col("size")
    whole = F.col(f"__x_{text_col}")
    head = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), rest.cast("int")), "")
    text = F.when(rest < F.col("size"), head).otherwise(whole)
    rows = rows.withColumn(f"__x_{text_col}", text).repartitionByRange(partitions(rows), "shard", "place").sortWithinPartitions("shard", "place")
    return rows.select(*[F.col(f"__x_{c}").alias(c) for c in docs.columns])
