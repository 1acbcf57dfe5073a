"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every document gets bounded statistics of its whole text. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; ridge scores come from normal equations summed over partitions (fixed size: one matrix
of FEATURES + 1 columns, whatever the corpus holds); an isotonic fit on a held-back part of the training labels,
pooled over BINS score bins, turns raw scores into probabilities.

All sums over rows are sums of integers (features and scores are rounded to multiples of a power of two first), and the
weights are rounded so that a score is one too: neither the order of rows nor how they are dealt changes a result.

Null texts count as empty; an empty text has all statistics at 0 and is scored like any other. Labels that are null
or not 0/1 are not learned from. A document counts once, however often its label is repeated; one with both labels is
not learned from. Null ids have no label. Rows that repeat an id all have its label. Other columns pass or are dropped,
as each function says. Without usable labels of both kinds every score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm._common import mapped, mixed, ragged, saved, slices, strings

FEATURES = 256  #: random Fourier features
GAMMA = 0.02  #: of the kernel exp(-GAMMA * squared distance)
RIDGE = 0.3
BINS = 512
STEP = 1 << 12  #: statistics are whole numbers of 1 / STEP where their mean and spread are worked out
GROUP = 64  #: tasks whose sums are added up together first
SEED = 20_011
ONE = 1 << 16  #: features are whole numbers of 1 / ONE; their products are below 2^32, so sums of 2^31 rows fit
THRESHOLD = 0.7
#: Statistics of a text; all are ratios or logarithms and so bounded whatever the text's length.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "long_words", "spaces", "newlines", "line_length", "upper", "digits",
    "sentence_marks", "inner_marks", "bars", "symbols", "exclamations", "other_ascii", "high_bytes", "capital_words", "upper_words",
    "symbol_words", "distinct_words", "top_repeat", "distinct_lines", "distinct_pairs",
)


def _kinds() -> np.ndarray:
    """A class for each byte: 0 lower case, 1 upper, 2 digit, 3 blank, 4 newline, 5 . ? ; :, 6 , ' - ( ) ", 7 bar,
    8 symbols, 9 !, 10 other ASCII, 11 bytes of other letters."""
    kind = np.full(256, 10, np.uint8)
    kind[128:] = 11
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".?;:", ",'-()\"", "|", "#$%&*+/<=>@[\\]^_`{}~", "!")):
        kind[[ord(c) for c in chars]] = k
    return kind


KIND = _kinds()


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values in each group, and how often the most frequent occurs. Groups ascend."""
    if not len(group):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(g)]]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, g[at], size)
    return np.bincount(g[at], minlength=n).astype(float), most.astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text of a byte buffer."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    kind = KIND[data]
    count = np.bincount(doc * 12 + kind, minlength=12 * n).reshape(n, 12).astype(float)
    blank = (kind == 3) | (kind == 4)
    before = np.concatenate([[True], blank[:-1]]) if len(data) else np.empty(0, bool)
    before[offsets[:-1][size > 0]] = True
    begin = np.flatnonzero(~blank & before)
    after = np.concatenate([blank[1:], [True]]) if len(data) else np.empty(0, bool)
    after[offsets[1:][size > 0] - 1] = True
    end = np.flatnonzero(~blank & after) + 1
    length, owner = (end - begin).astype(float), doc[begin]
    per = lambda x: np.bincount(owner, weights=x, minlength=n)
    words = per(np.ones(len(begin)))
    some = np.maximum(words, 1)
    mean = per(length) / some
    total = lambda mask: np.add.reduceat(np.concatenate([mask, [False]]).astype(np.int64), begin) if len(begin) else np.empty(0)
    upper_in = total((kind == 1) & ~blank)
    symbol_in = total((kind == 8) | (kind == 7) | (kind == 9))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        index = ragged(begin, (end - begin))
        place = ragged(np.zeros(len(begin), np.int64), (end - begin))
        word = mixed(np.add.reduceat((data[index].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(end - begin) - (end - begin))) if len(begin) else np.empty(0, np.uint64)
        pair = mixed(word[:-1] * np.uint64(3) + word[1:])
    kept = owner[:-1] == owner[1:]
    distinct, repeat = _distinct(owner, word, n)
    pairs, _ = _distinct(owner[:-1][kept], pair[kept], n)
    line = np.cumsum(np.concatenate([[False], kind[:-1] == 4])) if len(data) else np.empty(0, np.int64)
    line_of = line[begin] + owner  # lines of different texts differ
    edge = np.flatnonzero(np.diff(line_of, prepend=-1)) if len(begin) else np.empty(0, np.int64)
    lines = np.add.reduceat(word, edge) if len(edge) else np.empty(0, np.uint64)  # a line is known by the sum of its words' hashes
    n_lines = np.bincount(owner[edge], minlength=n).astype(float)
    distinct_lines, _ = _distinct(owner[edge], lines, n)
    byte = np.maximum(size, 1).astype(float)
    columns = [
        np.log1p(size) / 12, np.log1p(words) / 10, mean / 10, np.sqrt(np.maximum(per(length * length) / some - mean * mean, 0)) / 10, per(length > 12) / some,
        count[:, 3] / byte, count[:, 4] / byte * 10, np.log1p(words / np.maximum(n_lines, 1)) / 6, count[:, 1] / byte, count[:, 2] / byte,
        count[:, 5] / byte * 10, count[:, 6] / byte * 10, count[:, 7] / byte * 10, count[:, 8] / byte * 4, count[:, 9] / byte * 10, count[:, 10] / byte * 10, count[:, 11] / byte,
        per(upper_in > 0) / some, per((upper_in > 1) & (upper_in >= 0.6 * length)) / some, per(symbol_in > 0) / some,
        distinct / some, repeat / some, distinct_lines / np.maximum(n_lines, 1), pairs / np.maximum(words - 1, 1),
    ]
    return np.minimum(np.column_stack(columns), 8.0)


@dataclass
class Model:
    """All that scoring needs; its size doesn't depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    bins: np.ndarray | None = None  #: raw score at which each step of the calibration begins
    steps: np.ndarray | None = None
    share: float = 0.5
    features: int = FEATURES
    unit: float = 1.0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.frequency = rng.normal(0, np.sqrt(2 * GAMMA), (len(self.mean), self.features))
        self.phase = rng.uniform(0, 2 * np.pi, self.features)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Cosines of random Fourier features and a constant, as whole numbers of 1 / ONE. Added up column by column, so
        that a row's features don't depend on the rows beside it."""
        angle = np.broadcast_to(self.phase, (len(x), self.features)).copy()
        for column, frequency in zip(((x - self.mean) / self.scale).T, self.frequency, strict=True):
            angle += column[:, None] * frequency
        return np.column_stack([np.round(np.cos(angle) * ONE), np.full(len(x), ONE)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores before calibration. Products and sums are of whole numbers below 2^53, so they are exact."""
        return (self.lifted(x) @ self.weights) * self.unit

    def weigh(self, weights: np.ndarray) -> None:
        """Take weights of cosines, rounded to 27 bits of the largest."""
        exponent = int(np.ceil(np.log2(max(np.abs(weights).max(), 1e-9)))) - 27
        self.weights, self.unit = np.round(weights * 2.0**-exponent), 2.0**exponent / ONE

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return np.interp(self.raw(x), self.bins, self.steps)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit (pools adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def with_statistics(df: DataFrame, text_col: str = "text", out: str = "statistics") -> DataFrame:
    """Replace the text by the array column of its statistics."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, out)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 19):
                x = statistics(*strings(part.column("__text")))
                made = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], [*names, out])

    return df.select(*names, df[text_col].alias("__text")).transform(mapped, run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(STATISTICS))


def _summed(df: DataFrame, columns: list[str], product) -> np.ndarray:
    """Sum over all rows of product(batch): a matrix of integers of fixed size. Added up in each task, then row by row:
    first those of GROUP tasks, then all."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                made = product(batch.slice(at, 2048))
                total = made if total is None else total + made
        if total is not None:
            task = np.full(len(total), TaskContext.get().partitionId() // GROUP)
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], ["task", "i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
                x = row.values.to_numpy(zero_copy_only=False)
                held[i] = held[i] + x if i in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["i", "row"])

    rows = df.select(*columns).transform(mapped, part, "task int, i int, row array<long>")
    rows = rows.repartition("task", "i").select("i", "row").transform(mapped, add, "i int, row array<long>")
    rows = rows.repartition("i").transform(mapped, add, "i int, row array<long>").collect()  # one matrix of fixed size
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def fit(labelled: DataFrame, label_col: str = "label", calibrate_col: str = "calibrate", statistics_col: str = "statistics") -> Model:
    """Fit on rows with statistics, a 0/1 label, and whether the row is for calibration instead of regression."""
    rows = labelled.select(F.col(statistics_col).alias("x"), F.col(label_col).cast("int").alias("y"), F.col(calibrate_col).alias("c")).where("y in (0, 1) and c is not null")
    m = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = np.round(_matrix(batch, "x") * STEP).astype(np.int64)
        out = np.zeros((3, m), np.int64)
        out[0], out[1] = x.sum(axis=0), (x * x).sum(axis=0)
        out[2, :2] = len(x), batch.column("y").to_numpy().sum()
        return out

    s = _summed(rows, ["x", "y"], moments)
    if not len(s):
        return Model(np.zeros(m), np.ones(m))
    n, ones = (int(v) for v in s[2, :2])
    mean = s[0] / n / STEP
    spread = np.sqrt(np.maximum(s[1] / n / STEP**2 - mean * mean, 0))
    model = Model(mean, np.maximum(spread, 1e-3), share=ones / n)
    if ones in (0, n):
        return model

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        """Products of features for label 0, the same for label 1; the last column of each is also the sum of features."""
        z, y = model.lifted(_matrix(batch, "x")), batch.column("y").to_numpy()
        return np.concatenate([(z[y == k].T @ z[y == k]).astype(np.int64) for k in (0, 1)])

    a = _summed(rows.where("not c"), ["x", "y"], normal)
    if not len(a):
        return model
    model.weigh(ridge(*np.split(a, 2), ones / n))
    edges = np.linspace(-1, 1, BINS - 1)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(_matrix(batch, "x")), batch.column("y").to_numpy()
        at = np.searchsorted(edges, raw)
        total = np.zeros(BINS, np.int64)
        np.add.at(total, at, np.round(raw * ONE).astype(np.int64))
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at[y == 1], minlength=BINS), total])

    b = _summed(rows.where("c"), ["x", "y"], binned)
    if not len(b):
        b = _summed(rows, ["x", "y"], binned)
    used = b[0] > 0
    count, positive, raw = b[0][used], b[1][used], b[2][used] / ONE
    # A pseudo-count keeps the ends off 0 and 1; a vanishing slope keeps ranks within a step.
    model.bins = raw / count
    model.steps = np.clip(isotonic((positive + model.share) / (count + 1), count) * 0.999 + 0.001 * (model.bins + 1) / 2, 0, 1)
    return model


def ridge(zero: np.ndarray, one: np.ndarray, share: float, penalty: float = RIDGE) -> np.ndarray:
    """Weights of cosines (and of the constant) from the summed products of features of either label.

    Rows of the rarer label weigh as much in all as those of the other, so the regression looks at both. The goal is
    1/2 for label 1, -1/2 for label 0. The penalty is on weights of features of length sqrt(2 / number of features).
    """
    low, high = 1 / (2 * (1 - share)), 1 / (2 * share)
    length = np.append(np.full(len(zero) - 1, np.sqrt(2 / (len(zero) - 1))), 1.0) / ONE
    a = (zero * low + one * high) * np.outer(length, length)
    goal = (one[:, -1] * high - zero[:, -1] * low) * length / ONE * 0.5
    return np.linalg.solve(a + np.diag(np.append(np.full(len(a) - 1, penalty), 1e-9)), goal) * length * ONE


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 4 (null: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % 4


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def scored(df: DataFrame, model: Model, text_col: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """Add the score of each text; the other columns pass (the text only if asked)."""
    kept = [f for f in df.schema.fields if f.name != out and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 19):
                made = pa.array(np.clip(model.score(statistics(*strings(part.column("__text")))), 0.0, 1.0))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], [*names, out])

    return df.select(*names, df[text_col].alias("__text")).transform(mapped, run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, calibration: int = 3) -> Model:
    """Fit on the labelled documents outside the held-out fold; one fold of those calibrates."""
    mine = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")).where((fold("__id") != held_out) & F.col("label").isin(0, 1))
    mine = mine.groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    # The labels are narrow; their documents' statistics are made before the join, so no text is shuffled.
    stats = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(fold("__id") != held_out))
    # Saved, as fitting reads it three times: some 200 bytes for each labelled document.
    return fit(saved(stats.join(mine, "__id").withColumn("calibrate", fold("__id") == calibration), "labelled"))
