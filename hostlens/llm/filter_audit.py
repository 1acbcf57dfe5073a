"""How filters interact: what each removes in every order, kept up to date by a stream that takes back what it said.

Files come as available-now micro-batches. Filters A to D judge a text alone; E fails a text of which a row with a
smaller id has a copy, wherever it is in the table, so a later file may change what was counted. The state has a row for
each text: the smallest id so far and its part. A smaller id takes its place, and the row's earlier mask (the set of
filters that it fails) is taken back from its part's counters and counted again with E.

State is a table in the shared folder, in segments by batch numbers. A batch writes what it changed; segments of equal
length are merged, as digits carry in a binary counter, so there are few and each row is rewritten seldom. Which segments
a batch reads and writes follows from its number, so a batch that runs again writes the same.

Copies meet by a digest of 128 bits, added up before they are shuffled, so a text with a third of all rows is a few
rows. The 120 orders are worked out from each part's 32 counters at the end.

Null texts are empty; null parts count as the empty string. A row without an id is no copy of another and has none. Of
rows that repeat an id and a text none is smaller. Labels count if any row for the id has a 1. Only the named columns are
read. An empty table has no parts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.llm._common import dropped, mapped, saved, shared_dir, small

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
BATCHES = 4
FEW_LABELS = 200_000
LONG = 4 << 20  #: bytes beyond which a text's words aren't held at once
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes(range(65, 91))
ODD = b"#$%&*|"


def alone(text: bytes, n_chars: int) -> int:
    """The mask of filters A to D."""
    if len(text) > LONG:
        n, different = 0, set()
        for word in WORD.finditer(text):
            n += 1
            different.add(word[0])
    else:
        words = text.split()  # bytes split at 9 to 13 and 32
        n, different = len(words), set(words)
    upper = len(text) - len(text.translate(None, UPPER))
    return (n < 50) | (100 * len(different) < 65 * n) << 1 | (100 * upper > 5 * n_chars) << 2 | (len(text.translate(None, ODD)) < len(text)) << 3


def masked(docs: DataFrame) -> DataFrame:
    """(id, part, mask, digest) of documents (id long, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            raw = texts.cast(pa.binary())
            masks, digests = [], []
            for text, n in zip(raw, pc.utf8_length(texts).to_pylist(), strict=True):
                text = text.as_py()
                masks.append(alone(text, n))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    return docs.transform(mapped, run, "id long, part string, mask int, digest binary")


WHAT = ["part", "good", "toxic"]  #: what rows are counted by, besides their mask


def segments(n: int) -> list[tuple[int, int]]:
    """First and last batch of each segment after n batches."""
    out, end = [], n
    while end:
        out.append((end - (end & -end), end - 1))
        end -= end & -end
    return out


class Audit:
    """The stream's state and counters in a folder."""

    def __init__(self, labels: DataFrame | None, folder: str):
        self.labels, self.folder = labels, folder
        self.state_schema = "digest binary, id long, part string, good boolean, toxic boolean, mask int, n long"

    def segment(self, spark: SparkSession, span: tuple[int, int]) -> DataFrame:
        rows = spark.read.schema(self.state_schema).parquet(f"{self.folder}/state/{span[0]}-{span[1]}")
        return rows.withColumn("newest", F.lit(-span[1]).cast("long"))  # of rows with equal ids the newest segment's hold

    def on_batch(self, docs: DataFrame, k: int) -> None:
        spark, temporary = docs.sparkSession, []
        rows = masked(docs)
        if self.labels is None:
            rows = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
        else:
            rows = rows.join(small(self.labels, FEW_LABELS), "id", "left").na.fill(False, ["good", "toxic"])
        same = rows.groupBy("digest", "mask", "id", *WHAT).agg(F.count("*").alias("n"))
        # Rows without an id stay on their own; of the others those of the smallest id are told from the rest.
        groups = same.groupBy("digest", "mask", *WHAT, F.col("id").isNotNull().alias("named")).agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("total"))
        batch = groups.select("digest", "least.id", *WHAT, "mask", F.when(F.col("named"), F.col("least.n")).otherwise(F.col("total")).alias("n"), (F.col("total") - F.col("least.n")).alias("rest"), F.lit(None).cast("long").alias("newest"))
        met = batch
        for span in segments(k):
            met = met.unionByName(self.segment(spark, span).withColumn("rest", F.lit(0).cast("long")))
        by_text = W.partitionBy("digest")
        old = F.col("newest").isNotNull()
        met = met.withColumns({
            "touched": F.max(~old).over(by_text), "least": F.min("id").over(by_text), "now": F.min(F.when(old, F.struct("id", "newest"))).over(by_text),
            "least_new": F.min(F.when(~old, F.col("id"))).over(by_text),
        }).where(F.col("touched") & (~old | (F.struct("id", "newest") == F.col("now"))))
        met = saved(met.withColumn("old", old).drop("touched", "now", "newest"), "met", temporary)
        first = F.col("id") == F.col("least")
        copy = F.col("mask").bitwiseOR(COPY)
        said = lambda mask, n: F.struct(mask.alias("mask"), n.cast("long").alias("n"))
        changes = F.when(F.col("id").isNull(), F.array(said(F.col("mask"), F.col("n"))))
        changes = changes.when(F.col("old") & first, F.array().cast("array<struct<mask:int,n:bigint>>")).when(F.col("old"), F.array(said(F.col("mask"), -F.col("n")), said(copy, F.col("n"))))
        changes = changes.when(first, F.array(said(F.col("mask"), F.col("n")), said(copy, F.col("rest")))).otherwise(F.array(said(copy, F.col("n") + F.col("rest"))))
        counters = met.select(*WHAT, F.explode(changes).alias("c")).groupBy(*WHAT, "c.mask").agg(F.sum("c.n").alias("n")).where("n <> 0")
        counters.write.mode("overwrite").parquet(f"{self.folder}/counters/batch={k}")
        changed = met.where(first & (F.col("least") == F.col("least_new"))).groupBy("digest", "id", *WHAT, "mask").agg(F.sum("n").alias("n"))
        span = segments(k + 1)[0]
        merged = [s for s in segments(k) if s[0] >= span[0]]
        if merged:
            changed = changed.withColumn("newest", F.lit(-k).cast("long"))
            for s in merged:
                changed = changed.unionByName(self.segment(spark, s))
            best = F.min(F.struct("id", "newest")).over(by_text)
            changed = changed.withColumn("best", best).where(F.struct("id", "newest") == F.col("best")).drop("best", "newest")
        changed.write.mode("overwrite").parquet(f"{self.folder}/state/{span[0]}-{span[1]}")
        dropped(spark, temporary)
        # What the batch before read is read no more, not even if this one runs again.
        dropped(spark, [f"{self.folder}/state/{a}-{b}" for a, b in set(segments(max(k - 1, 0))) - set(segments(k)) - set(segments(k + 1))])

    def counters(self, spark: SparkSession) -> DataFrame:
        """(part, good, toxic, mask, n) of all batches."""
        schema = "part string, good boolean, toxic boolean, mask int, n long, batch int"
        return spark.read.schema(schema).parquet(f"{self.folder}/counters").groupBy(*WHAT, "mask").agg(F.sum("n").alias("n"))


def audited(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters of masks."""
    sums = [F.sum(F.when(c & (F.col("mask") == m), F.col("n")).otherwise(0)) for c in (F.lit(True), F.col("good"), F.col("toxic")) for m in range(1 << len(FILTERS))]
    size = 1 << len(FILTERS)
    parts = counters.groupBy("part").agg(F.array(*sums[:size]).alias("all"), F.array(*sums[size : 2 * size]).alias("good"), F.array(*sums[2 * size :]).alias("toxic"))
    steps = [(order, i + 1, 1 << FILTERS.index(order[i]), sum(1 << FILTERS.index(f) for f in order[:i])) for order in map("".join, permutations(FILTERS)) for i in range(len(order))]
    orders = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), s, strict=True)) for s in steps])), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.select("*", F.explode(orders).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")
    over = lambda counts, keep: F.aggregate(F.transform(counts, lambda n, m: F.when(keep(m), n).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    removed = lambda counts: over(F.col(counts), lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0))
    out = rows.select(
        "part", "s.filter_order", "s.step", bit.alias("bit"), over(F.col("all"), lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), removed("all").alias("removed"),
        over(F.col("all"), lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"), over(F.col("all"), lambda m: m == bit).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def audit(spark: SparkSession, path: str, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", batches: int = BATCHES, folder: str | None = None) -> DataFrame:
    """Audit the Parquet files at ``path``, in about ``batches`` micro-batches.

    ``labels`` has the id column, quality and toxic. With a ``folder`` (shared by driver and executors) another call
    goes on from the last one's state: only files that are new since then are read.
    """
    files = spark.read.parquet(path)
    if labels is not None:
        known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        labels = saved(known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).na.fill(False), "labels")
    state = Audit(labels, folder or shared_dir(spark))
    place = path.rstrip("/")
    place = f"{place[:-1]}[{place[-1]}]"  # a stream takes a pattern for a folder or for a single file, a plain path for a folder only
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", -(-len(files.inputFiles()) // batches) or 1).parquet(place)
    docs = stream.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    query = docs.writeStream.foreachBatch(state.on_batch).option("checkpointLocation", f"{state.folder}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return audited(state.counters(spark))
