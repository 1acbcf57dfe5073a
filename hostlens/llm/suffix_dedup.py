"""Removal of repeated passages by a suffix sort that stops at the threshold's depth.

A byte goes if a string of LENGTH bytes covering it also starts in a document with a smaller id. Suffixes are compared
through LENGTH bytes only: passes over digits of eight bytes, most significant first, split groups of equal suffixes
and drop those that stand alone; the groups left after the last pass are exactly the repeated strings.

To sort a corpus by parts, suffixes are first dealt by a digit that equal strings share: the smallest hash of the
GRAM-byte strings in the first LENGTH bytes. Neighbouring suffixes mostly share it, so they travel as one run of text
(``Runs``). Steps, each over packed units of documents rather than rows:

1. documents are packed into units, compressed; exact copies stay out (all their bytes go, if they have enough);
2. each unit sends its digits, one time each; digits found in one unit and one document only are dropped;
3. each unit sends the text of the other runs, equal ones once with their smallest document; buckets of them are
   sorted as said and tell each run which of its suffixes have a smaller document elsewhere;
4. each unit marks the bytes and cuts them.

A digit with very many different runs (the edges of a passage that much of the corpus shares) would fill one bucket:
its suffixes are dealt one by one by their whole hash instead. The number of buckets follows the corpus (one for
BUCKET bytes), so a bucket's size doesn't; units have UNIT bytes and at least one text.

Null texts are empty. Null ids keep all their bytes and count for no other row. Rows that repeat an id don't count as
smaller than each other. A text shorter than LENGTH bytes never changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm._common import mapped, mixed, partitions, ragged, released, saved, slices, small, strings

LENGTH = 50
GRAM = 24
UNIT = 4 << 20  #: bytes of text in a unit
SLICE = 1 << 19  #: bytes that are taken apart at a time
BUCKET = 16 << 20  #: bytes of the corpus for which there is a bucket
FINE = 8  #: sorted buckets in each shuffle partition
HOT = 200_000  #: runs of one digit from which its suffixes are dealt one by one
FEW_IDS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)
LARGEST = np.uint64(2**64 - 1)


def digits_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; data has eight spare bytes at its end."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,)).copy()


@dataclass
class Runs:
    """Runs of neighbouring suffixes with one digit: first position, number of suffixes, digit, document number."""

    data: np.ndarray
    start: np.ndarray
    count: np.ndarray
    digit: np.ndarray
    doc: np.ndarray
    length: int

    def hashes(self) -> np.ndarray:
        """A hash of each run's text."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(self.data) + 1, STEP, np.uint64))
            back = np.cumprod(np.full(len(self.data) + 1, pow(int(STEP), -1, 2**64), np.uint64))
            total = np.concatenate([[np.uint64(0)], np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
            end = self.start + self.count + self.length - 1
            return mixed((total[end] - total[self.start]) * back[self.start] + self.count.astype(np.uint64))

    def alone(self, hot: np.ndarray) -> Runs:
        """The same with the suffixes of hot runs as runs of their own, whose digit is a hash of all their bytes."""
        if not hot.any():
            return self
        cold = ~hot
        start = ragged(self.start[hot], self.count[hot])
        one = Runs(self.data, start, np.ones(len(start), np.int64), np.empty(0, np.uint64), np.repeat(self.doc[hot], self.count[hot]), self.length)
        one.digit = mixed(one.hashes() + STEP)
        join = lambda a: np.concatenate([getattr(self, a)[cold], getattr(one, a)])
        return Runs(self.data, join("start"), join("count"), join("digit"), join("doc"), self.length)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    """Take texts apart. The digit of a suffix is the smallest hash of the grams within its first ``length`` bytes."""
    n = len(data)
    none = Runs(data, *(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64), np.empty(0, np.int64), length)
    if n < length:
        return none
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = digits_at(padded)
    m = n - gram + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for at in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
            h = (h + eight[at : at + m]) * STEP
            h ^= h >> np.uint64(29)
        h = mixed(h)
    width, span = length - gram + 1, 1
    least = h
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    size = np.diff(offsets)
    fits = np.maximum(size - length + 1, 0)
    place = ragged(offsets[:-1], fits)  # positions of all suffixes that are long enough
    if not len(place):
        return none
    doc = np.repeat(np.arange(len(size)), fits)
    digit = mixed(least[place])  # a minimum of hashes is small; mixed again it spreads evenly over buckets
    head = np.ones(len(place), bool)
    head[1:] = (digit[1:] != digit[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    return Runs(data, place[at], np.diff(np.append(at, len(place))), digit[at], doc[at], length)


def repeated(data: np.ndarray, start: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes through ``length`` bytes: the indices of those that another one equals, and their group numbers.

    ``owner`` breaks no ties; it only lets groups of one owner go early.
    """
    eight = digits_at(np.concatenate([data, np.zeros(16, np.uint8)]))
    active, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        digit = eight[start[active] + depth]
        order = np.lexsort((digit, group)) if depth else np.argsort(digit)
        active, group, digit = active[order], group[order], digit[order]
        head = np.ones(len(active), bool)
        head[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(head) - 1
        low = np.minimum.reduceat(owner[active], np.flatnonzero(head)) if len(active) else owner[:0]
        high = np.maximum.reduceat(owner[active], np.flatnonzero(head)) if len(active) else owner[:0]
        keep = (low < high)[group]
        active, group = active[keep], group[keep]
        if not len(active):
            break
    return active, group


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


UNITS = "unit long, ids binary, keys binary, sizes binary, slices binary, texts array<binary>"


def _units(docs: DataFrame) -> DataFrame:
    """Pack documents (id long, not null; key long, not null; text): ids, keys, sizes, how many documents each slice has, compressed slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, size = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = strings(part.column("text"))
                held.append((part.column("id").to_numpy(), part.column("key").to_numpy(), np.diff(offsets), zstandard.compress(data.tobytes(), 3)))
                size += len(data)
                if size >= UNIT:
                    yield unit(name, held)
                    name, held, size = name + 1, [], 0
        if held:
            yield unit(name, held)

    def unit(name: int, held: list) -> pa.RecordBatch:
        ids, keys, sizes, texts = zip(*held, strict=True)
        packed = [*(_pack(np.concatenate(x)) for x in (ids, keys, sizes)), _pack(np.array([len(x) for x in ids]))]
        return pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.binary()) for x in packed), pa.array([list(texts)], pa.list_(pa.binary()))], ["unit", "ids", "keys", "sizes", "slices", "texts"])

    return docs.transform(mapped, run, UNITS)


def _slices_of(batch: pa.RecordBatch, k: int, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Runs]]:
    """Ids, bytes, offsets and runs of each slice of the unit in row k."""
    ids, sizes, counts = (_unpack(batch.column(c)[k].as_py(), "<i8") for c in ("ids", "sizes", "slices"))
    at = 0
    for i, n in enumerate(counts):
        data = np.frombuffer(zstandard.decompress(batch.column("texts")[k].values[i].as_py()), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes[at : at + n])])
        yield ids[at : at + n], data, offsets, runs_of(data, offsets, length, gram)
        at += n


def _tallied(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit's digits in order, whether several of its documents have each, and how many runs each has."""
    digit, owner = (np.concatenate(x) for x in zip(*((runs.digit, ids[runs.doc]) for ids, _, _, runs in parts), strict=True))
    order = np.argsort(digit, kind="stable")
    digit, owner = digit[order], owner[order]
    head = np.ones(len(digit), bool)
    head[1:] = digit[1:] != digit[:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return digit, head, at
    several = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)
    return digit[at], several, np.diff(np.append(at, len(digit)))


def _edges(digit: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among digits in order: buckets are equal ranges of the upper half of a digit."""
    bucket = ((digit >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _shared_digits(units: DataFrame, buckets: int, length: int, gram: int, hot_runs: int) -> DataFrame:
    """(unit, marks): for each unit and bucket, which of its digits another unit has too, and which are hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                digit, _, times = _tallied(list(_slices_of(batch, k, length, gram)))
                edges = _edges(digit, buckets)
                used = np.flatnonzero(np.diff(edges))
                # The half of a digit that its bucket doesn't stand for: a chance agreement only sends a run in vain.
                rows = [[x[edges[b] : edges[b + 1]] for b in used] for x in (digit.astype("<u4"), times)]
                many = [np.flatnonzero(x > 1) for x in rows[1]]
                columns = [[x.tobytes() for x in rows[0]], [_pack(x.astype("<u4")) for x in many], [_pack(x[m].astype("<u4")) for x, m in zip(rows[1], many, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([batch.column("unit")[k].as_py()] * len(used), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "unit", "digits", "many", "times"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in ("bucket", "unit", "digits", "many", "times")]
                if row[0] != now:
                    yield from marks(now, held)
                    now, held = row[0], []
                held.append(row[1:])
        yield from marks(now, held)

    def marks(bucket: int | None, held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        digits = [np.frombuffer(r[1], "<u4") for r in held]
        times = [np.ones(len(d), np.int64) for d in digits]
        for t, row in zip(times, held, strict=True):
            t[_unpack(row[2], "<u4")] = _unpack(row[3], "<u4")
        sizes = np.array([len(d) for d in digits])
        digit, total = np.concatenate(digits), np.concatenate(times)
        _, at, count = np.unique(digit, return_inverse=True, return_counts=True)
        shared = (count > 1)[at]
        hot = (np.bincount(at, weights=total) > hot_runs)[at]
        ends = np.cumsum(sizes)
        packed = [[np.packbits(x[e - s : e]).tobytes() for e, s in zip(ends, sizes, strict=True)] for x in (shared, hot)]
        packed[1] = [_pack(np.frombuffer(x, np.uint8)) for x in packed[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["unit", "bucket", "shared", "hot"])

    sent = units.transform(mapped, send, "bucket int, unit long, digits binary, many binary, times binary")
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").transform(mapped, meet, "unit long, bucket int, shared binary, hot binary")
    return met.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "shared", "hot"))).alias("marks"))


def _wanted(batch: pa.RecordBatch, k: int, buckets: int, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Runs]]:
    """As ``_slices_of`` with only the runs that may repeat; suffixes of hot digits stand alone."""
    parts = list(_slices_of(batch, k, length, gram))
    digit, several, _ = _tallied(parts)
    keep, hot = several.copy(), np.zeros(len(digit), bool)
    edges = _edges(digit, buckets)
    for mark in batch.column("marks")[k].as_py() or []:
        at, end = edges[mark["bucket"]], edges[mark["bucket"] + 1]
        keep[at:end] |= np.unpackbits(np.frombuffer(mark["shared"], np.uint8), count=end - at).astype(bool)
        hot[at:end] = np.unpackbits(_unpack(mark["hot"], np.uint8), count=end - at).astype(bool)
    for ids, data, offsets, runs in parts:
        at = np.searchsorted(digit, runs.digit)
        pick = keep[at]
        some = Runs(data, *(x[pick] for x in (runs.start, runs.count, runs.digit, runs.doc)), length)
        yield ids, data, offsets, some.alone(hot[at][pick])


def _distinct(batch: pa.RecordBatch, k: int, buckets: int, length: int, gram: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A unit's slices; and of its different runs, by bucket: the place of the first (over all slices), smallest id,
    digit; and for each run of each slice the number of its kind."""
    parts = list(_wanted(batch, k, buckets, length, gram))
    digit, name, owner = (np.concatenate(x) for x in zip(*((r.digit, r.hashes(), ids[r.doc]) for ids, _, _, r in parts), strict=True))
    order = np.lexsort((owner, name, digit))
    head = np.ones(len(order), bool)
    head[1:] = (digit[order][1:] != digit[order][:-1]) | (name[order][1:] != name[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(head) - 1
    first = order[head]
    return parts, first, owner[first], digit[first], kind


def _smaller(units: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """(unit, found): for each unit and bucket the runs some of whose suffixes have a smaller document elsewhere."""
    fine = buckets * FINE

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts, first, least, digit, _ = _distinct(batch, k, buckets, length, gram)
                if not len(first):
                    continue
                start, count = (np.concatenate([getattr(r, c) for *_, r in parts]) for c in ("start", "count"))
                base = np.concatenate([[0], np.cumsum([len(d) for _, d, _, _ in parts])])
                start = start + np.repeat(base[:-1], [len(r.start) for *_, r in parts])
                text = np.concatenate([d for _, d, _, _ in parts])
                edges = _edges(digit, fine)
                used = np.flatnonzero(np.diff(edges))
                columns: list[list[bytes]] = [[], [], []]
                for b in used:
                    some = first[edges[b] : edges[b + 1]]
                    columns[0].append(_pack(text[ragged(start[some], count[some] + length - 1)]))
                    columns[1].append(_pack(count[some].astype("<u4")))
                    columns[2].append(_pack(least[edges[b] : edges[b + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([batch.column("unit")[k].as_py()] * len(used), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "unit", "text", "counts", "least"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in ("bucket", "unit", "text", "counts", "least")]
                if row[0] != now:
                    yield from compare(now, held)
                    now, held = row[0], []
                held.append(row[1:])
        yield from compare(now, held)

    def compare(bucket: int | None, held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        text = np.concatenate([_unpack(r[1], np.uint8) for r in held])
        counts = [_unpack(r[2], "<u4").astype(np.int64) for r in held]
        least = np.concatenate([_unpack(r[3], "<i8") for r in held])
        count = np.concatenate(counts)
        run_start = np.cumsum(count + length - 1) - (count + length - 1)
        suffix = ragged(run_start, count)
        run = np.repeat(np.arange(len(count)), count)
        at, group = repeated(text, suffix, least[run], length)
        if not len(at):
            return
        best = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, group, least[run[at]])
        gain = best[group] < least[run[at]]
        at, value = at[gain], best[group[gain]]
        order = np.argsort(at)
        at, value = at[order], value[order]
        if not len(at):
            return
        # Neighbouring suffixes of one run with one smallest document form a span.
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]]) | (value[1:] != value[:-1])
        h = np.flatnonzero(head)
        of = run[at[h]]
        begin = suffix[at[h]] - run_start[of]
        size = np.diff(np.append(h, len(at)))
        edges = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
        cut = np.searchsorted(of, edges)
        rows = [i for i in range(len(held)) if cut[i] < cut[i + 1]]
        packed = [[_pack(x[cut[i] : cut[i + 1]] - (edges[i] if j == 0 else 0)) for i in rows] for j, x in enumerate((of, begin, size, value[h]))]
        yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["unit", "bucket", "run", "begin", "size", "best"])

    sent = units.transform(mapped, send, "bucket int, unit long, text binary, counts binary, least binary")
    met = sent.repartition(buckets, F.floor(F.col("bucket") / FINE)).sortWithinPartitions("bucket").transform(mapped, meet, "unit long, bucket int, run binary, begin binary, size binary, best binary")
    return met.groupBy("unit").agg(F.collect_list(F.struct("bucket", "run", "begin", "size", "best")).alias("found"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(units: DataFrame, buckets: int, length: int, gram: int, keep_text: bool, as_text: bool) -> DataFrame:
    """Mark and cut: one row per document (id, key, RESULT, and the bytes or characters left if asked)."""
    fine = buckets * FINE
    names = ["id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts, _, least, digit, kind = _distinct(batch, k, buckets, length, gram)
                edges = _edges(digit, fine)
                spans = [(np.empty(0, np.int64),) * 4]
                for f in batch.column("found")[k].as_py() or []:
                    of, *rest = (_unpack(f[c], "<i8") for c in ("run", "begin", "size", "best"))
                    spans.append((of + edges[f["bucket"]], *rest))
                of, begin, size, best = (np.concatenate(x) for x in zip(*spans, strict=True))
                order = np.argsort(of, kind="stable")
                of, begin, size, best = of[order], begin[order], size[order], best[order]
                at, row, keys = 0, 0, _unpack(batch.column("keys")[k].as_py(), "<i8")
                for ids, data, offsets, runs in parts:
                    mine = kind[at : at + len(runs.start)]
                    at, row = at + len(mine), row + len(ids)
                    yield done(ids, keys[row - len(ids) : row], data, offsets, runs, mine, least, of, begin, size, best)

    def done(ids: np.ndarray, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, runs: Runs, kind: np.ndarray, least: np.ndarray, of: np.ndarray, begin: np.ndarray, size: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        owner = ids[runs.doc]
        depth = np.zeros(len(data) + 1, np.int32)
        whole = owner > least[kind]  # an equal run of a smaller document is in this unit
        np.add.at(depth, runs.start[whole], 1)
        np.add.at(depth, runs.start[whole] + runs.count[whole] + length - 1, -1)
        low, high = np.searchsorted(of, kind), np.searchsorted(of, kind, "right")
        times = np.where(whole, 0, high - low)
        r, s = np.repeat(np.arange(len(kind)), times), ragged(low, times)
        hit = best[s] < owner[r]
        start = runs.start[r[hit]] + begin[s[hit]]
        np.add.at(depth, start, 1)
        np.add.at(depth, start + size[s[hit]] + length - 1, -1)
        gone = np.cumsum(depth[:-1]) > 0
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(ids)), sizes)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
        removed, n_spans = np.bincount(doc[gone], minlength=len(ids)), np.bincount(doc[opens], minlength=len(ids))
        left = data[~gone]
        ends = np.cumsum(sizes - removed)
        kept = [left[e - n : e].tobytes() for e, n in zip(ends, sizes - removed, strict=True)]
        columns = [pa.array(ids), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        if keep_text:  # a cut may fall within a character; what is left of it goes too
            columns.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names)

    return units.transform(mapped, run, f"id long, key long, {RESULT}{f', kept {"string" if as_text else "binary"}' * keep_text}")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, hot_runs: int = HOT, key_col: str | None = None, as_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` if asked.

    ``kept`` has the bytes that are left, or with ``as_text`` the characters of which all bytes are left.
    ``key_col`` (long, not null) passes, so that rows can be told apart whose ids are null or repeated.
    """
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and below length")
    key = (F.col(key_col) if key_col else F.lit(0)).cast("long")
    docs = df.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumns({"n_bytes": F.octet_length("text").cast("long"), "sha": F.sha2("text", 256)})
    # Equal texts: only the smallest id's can keep anything, so the rest needs no sorting.
    same = saved(docs.where("id is not null").select("id", "key", "n_bytes", "sha"), "digests")
    # Saved before its join, as Spark splits a hot group of a join only where both sides come as they are.
    first = saved(same.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "firsts")
    # By id and text, as another row of the same id may hold another text. A pair may come up twice: it is only looked up.
    few = small(saved(same.join(first, "sha").where("id > first").select("id", "sha"), "copies"), FEW_IDS)
    total = same.agg(F.sum("n_bytes").alias("n")).head()["n"] or 0
    buckets = max(partitions(docs, 12), -(-total // BUCKET))
    texts = docs.where("id is not null").join(few, ["id", "sha"], "left_anti").select("id", "key", "text")
    units = saved(_units(texts), "units")
    released(docs.sparkSession)
    marks = saved(_shared_digits(units, buckets, length, gram, hot_runs), "marks")
    released(docs.sparkSession)
    marked = units.join(marks, "unit", "left")
    found = saved(_smaller(marked, buckets, length, gram), "found")
    released(docs.sparkSession)
    result = _cut(marked.join(found, "unit", "left"), buckets, length, gram, keep_text, as_text)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    gone = F.col("n_bytes") >= length
    names = ["id", "key", "n_bytes", "sha", "gone", *["text"] * keep_text]
    extra = docs.where("id is null").withColumn("gone", F.lit(False)).select(names)
    plain = (docs if keep_text else same).join(few, ["id", "sha"], "left_semi").withColumn("gone", gone).select(names)
    other = plain.unionByName(extra).select(
        "id", "key", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.col("gone").cast("long").alias("n_spans"), F.when(F.col("gone"), empty).otherwise(F.col("sha")).alias("kept_sha256"),
        *[F.when(F.col("gone"), F.lit("")).otherwise(F.col("text")).cast("string" if as_text else "binary").alias("kept")] * keep_text,
    )
    rows = result.unionByName(other).withColumnRenamed("id", id_col)
    return rows.withColumnRenamed("key", key_col) if key_col else rows.drop("key")
