"""Resampling of documents towards a target distribution, by the importance of their hashed n-grams.

Each feature (a run of one to LONGEST words) falls into one of BUCKETS buckets. A bucket's gain says by how much the
target's share of it exceeds the corpus's; the gains, an array of fixed size, score every document in one pass. With
Gumbel noise added, the highest scores are a sample without replacement by importance.

The cutoff is selected, not sorted for: every part of the remaining keys gives its median, the weighted median of these
is the pivot, and each round discards at least a quarter of what remains (``cutoff_key``). Only the winners are sorted.

Words are runs of the letters a to z (A to Z count as these), digits and all characters beyond ASCII. Null texts have
none. A null id gets the noise of an empty name and comes first among equal scores. Rows that repeat an id have the
same noise; rows with equal scores and ids are drawn by their number of features. An empty corpus gives no rows, an
empty target an even distribution over buckets. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.llm._common import SLICE_BYTES, mapped, partitions, saved, slices, small, strings

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
SUMS = 64  #: tasks that add up the counts of all others; the driver gets one array from each
PART = 1 << 20  #: keys of which one median is taken
LOWEST = -(2**63)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The register after one byte; after 0 to 63 zero bytes; after 64, 128, 256... zero bytes: by each of its four bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    steps = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(64):
        steps.append(one[steps[-1] & 255] ^ (steps[-1] >> 8))
    powers = [steps[64]]
    for _ in range(30):
        powers.append(_applied(powers[-1], powers[-1]))
    return one, np.stack(steps[:64]), np.stack(powers)


def _applied(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


ONE, STEPS, POWERS = _crc_tables()
FLAT = STEPS.reshape(-1)


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after n more bytes, less what those bytes add: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    base = (n & 63) << 10
    c = FLAT[base + (c & 255)] ^ FLAT[base + 256 + ((c >> 8) & 255)] ^ FLAT[base + 512 + ((c >> 16) & 255)] ^ FLAT[base + 768 + (c >> 24)]
    at = np.flatnonzero(n >> 6)  # longer than any usual word
    for i in at:
        high, j = int(n[i]) >> 6, 0
        while high:
            if high & 1:
                c[i] = _applied(POWERS[j], c[i : i + 1])[0]
            high, j = high >> 1, j + 1
    return c


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and text of each word. ``data`` is in lower case."""
    inside = IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return start, end - start, np.searchsorted(offsets, start, "right") - 1


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of each word."""
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at, j = np.flatnonzero(size <= 64), 0
    while len(at):
        c[at] = ONE[(c[at] ^ data[start[at] + j]) & 255] ^ (c[at] >> 8)
        j += 1
        at = at[size[at] > j]
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64):
        c[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes())
    return c


def features(data: np.ndarray, offsets: np.ndarray, longest: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Checksums of all features, the text of each, and the words of each text.

    The first ``skip`` words of a text were counted before: only features that end after them count.
    """
    start, size, doc = words_of(data, offsets)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.arange(len(doc)) - (np.cumsum(n_words) - n_words)[doc]  # of each word in its text
    new = place >= skip[doc]
    word = checksums(data, start, size)
    spaced = shifted(np.full(len(word), zlib.crc32(b" "), np.uint32), size) ^ word
    found, owner, run = [word[new]], [doc[new]], word
    for n in range(1, longest):
        run = shifted(run[:-1], size[n:] + 1) ^ spaced[n:]
        fits = new[n:] & (place[n:] >= n)
        found.append(run[fits])
        owner.append(doc[n:][fits])
    return np.concatenate(found), np.concatenate(owner), n_words - np.minimum(skip, n_words)


def taken_apart(batch: pa.RecordBatch, longest: int, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of some texts, then checksums of features, the text of each and the words, as from ``features``.

    A text beyond ``most`` bytes comes in parts, cut between words; each part has the last words of the one before.
    """
    first = 0
    for part in slices(batch, "text", most):
        data, offsets = strings(part.column("text"))
        data, rows = LOWER[data], np.arange(first, first + part.num_rows)
        first += part.num_rows
        if len(data) <= most:
            yield rows, *features(data, offsets, longest, np.zeros(part.num_rows, np.int64))
            continue
        at, held, skip = 0, np.empty(0, np.uint8), 0  # such a slice has one text
        while at < len(data):
            end = min(at + most, len(data))
            while end < len(data):
                gap = np.flatnonzero(~IN_WORD[data[end : end + most]])[:1]
                end += int(gap[0]) if len(gap) else min(most, len(data) - end)
                if len(gap):
                    break
            piece = np.concatenate([held, data[at:end]])
            yield rows, *features(piece, np.array([0, len(piece)]), longest, np.array([skip]))
            start, _, _ = words_of(piece, np.array([0, len(piece)]))
            skip, at = min(longest - 1, len(start)), end
            held = np.concatenate([piece[start[-skip] :], np.array([32], np.uint8)]) if skip else np.empty(0, np.uint8)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features fall into each bucket: an array from each task, added up in SUMS tasks, then on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _, _ in taken_apart(batch, longest):
                total += np.bincount(found % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    rows = texts.transform(mapped, count, "counts binary").repartition(SUMS).transform(mapped, add, "counts binary").collect()
    return sum((np.frombuffer(r["counts"], np.int64) for r in rows), np.zeros(buckets, np.int64))


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the smoothed ratio of shares, rounded down."""
    ratio = (target + 1.0) * float(corpus.sum() + len(corpus)) / ((corpus + 1.0) * float(target.sum() + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of documents (id long, text)."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for rows, found, owner, n_words in taken_apart(batch, longest):
                out[0, rows] += n_words
                out[1, rows] += np.bincount(owner, minlength=len(rows))
                np.add.at(out[2], rows[owner], gains[found % buckets])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x) for x in out)], ["id", "n_words", "n_features", "weight"])

    return docs.transform(mapped, run, "id long, n_words long, n_features long, weight long")


def noise(seed: int, id_col: str) -> Column:
    """1000 times a standard Gumbel variable that the id decides, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


Key = tuple[int, int]


def cutoff_key(keys: DataFrame, k: int, part: int = PART) -> Key:
    """The k-th smallest key (a long, b long, no nulls), k from 1, by weighted medians of medians.

    Every task takes the median of each ``part`` keys that it reads. A round is one job: for the present pivot it counts
    what lies on either side and takes the medians of both sides, so that the next pivot is known when a side is chosen.
    The driver gets a few numbers for each part.
    """
    low: Key | None = None
    high: Key | None = None
    pivot: Key | None = None
    while True:
        remaining = keys
        if low:
            remaining = remaining.where((F.col("a") > low[0]) | ((F.col("a") == low[0]) & (F.col("b") > low[1])))
        if high:
            remaining = remaining.where((F.col("a") < high[0]) | ((F.col("a") == high[0]) & (F.col("b") < high[1])))
        rows = remaining.transform(mapped, _halves(pivot, part), "side int, n long, a long, b long").collect()
        sides = {s: [((r["a"], r["b"]), r["n"]) for r in rows if r["side"] == s] for s in (-1, 0, 1)}
        less, equal = (sum(n for _, n in sides[s]) for s in (-1, 0))
        if pivot is None or k > less + equal:
            low, k, side = pivot, k - less - equal, 1
        elif k > less:
            return pivot
        else:
            high, side = pivot, -1
        pivot = _weighted_median(sides[side])


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            break
    return key


def _halves(pivot: Key | None, part: int):
    """For each part of the keys and each side of the pivot (below, equal, above; all are above none): size and median."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size >= part:
                yield medians(held)
                held, size = [], 0
        if size:
            yield medians(held)

    def medians(held: list) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        side = np.ones(len(a), np.int64)
        if pivot is not None:
            side = np.select([a < pivot[0], a > pivot[0], b < pivot[1], b > pivot[1]], [-1, 1, -1, 1], 0)
        rows = []
        for s in (-1, 0, 1):
            x, y = a[side == s], b[side == s]
            if len(x):
                middle = np.lexsort((y, x))[(len(x) - 1) // 2]
                rows.append((s, len(x), int(x[middle]), int(y[middle])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["side", "n", "a", "b"])

    return run


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number rows from 1 in an order, with a column ``rank``: sorted by ranges; equal rows don't meet in one task."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(partitions(rows), *order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    placed = saved(ordered.withColumn("place", F.monotonically_increasing_id()), "ranked")  # the task's number and the row's within it
    counts = placed.groupBy(F.shiftright("place", 33).alias("task")).agg(F.count("*").alias("n"))
    # One row for each task of the sort.
    base = small(saved(counts.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("base")), "bases"))
    numbered = placed.withColumn("task", F.shiftright("place", 33)).join(base, "task")
    return numbered.select(*rows.columns, (F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 5, den: int = 100, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = 42, part: int = PART) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, and its rank among the drawn (else null).

    ``target`` has a column ``text``. Of the documents with ``min_words`` words ``num`` in ``den`` are drawn.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gains = gains_of(bucket_counts(texts.select("text"), buckets, longest), bucket_counts(target.select("text"), buckets, longest))
    scores = weighed(texts, gains, longest).withColumn("score", F.col("weight") + noise(seed, "id"))
    # In order within each file, so that later rounds of the selection skip most row groups.
    scores = scores.withColumns({"a": -F.col("score"), "b": F.coalesce("id", F.lit(LOWEST))}).sortWithinPartitions("a", "b")
    scores = saved(scores, "scores")
    fit = F.col("n_words") >= min_words
    k = num * scores.where(fit).count() // den
    names = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scores.select(*names, none)
    a, b = cutoff_key(scores.where(fit).select("a", "b"), k, part)
    ahead = fit & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b)))
    drawn = ranked(scores.where(ahead), ["a", "b", "n_features"]).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.select(*names, "rank").unionByName(scores.where(~ahead).select(*names, none))
