"""Removal of long repeated passages by a compacted de Bruijn graph of words.

An edge of the graph is a window of WORDS consecutive words, leading from its first to its last WORDS - 1 words; windows
that follow each other in a text are neighbouring edges. An edge is repeated if its window occurs twice. Repeated edges
whose only follower, wherever they occur, is an edge with no other predecessor make one nonbranching path. Whatever
window of it a text holds, the text holds the path as a whole, so the path's words are compared at all its coordinates,
and windows count only where another place has the same words.

1. Texts are packed into units (one row each: numbered words are found again by unit and place).
2. Each unit sends its windows by runs: neighbouring windows that share the smallest hash of their GRAM-word strings
   travel in one row, keyed by it, with the edges before and after; equal rows of a unit once.
3. Where all windows of a key meet, edges are counted and branches found; flags go back to the units.
4. Joined with their flags, units compact paths and send a digest of each path's words. A digest that stands alone is a
   chance agreement of hashes, and its windows don't count.
5. Units cut the words that are covered by the others.

A key with more than its share of rows (the edge of a passage that much of the corpus holds) is split: its windows go
one by one, keyed by their own hash, each once for a unit. Units give estimates of such keys, whose number is bounded by
the number of partitions.

Words are what stands between the bytes 9 to 13 and 32. Null and empty texts have none, and a text with fewer than WORDS
words loses none. Ids only name rows: they may be null or repeated. Windows are told apart by 48 bits of hash next to a
64-bit key, and what these find is checked by digests of 128 bits.
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

from hostlens.llm._common import dropped, mapped, mixed, partitions, ragged, saved, slices, small, strings

WORDS = 35
GRAM = 6
UNIT = 4 << 20  #: bytes of text in a unit (or one text)
CHUNK = 1 << 20  #: bytes that are cut into words at a time
MOST = 64  #: windows in a row
MEET = 400_000  #: windows that are compared at a time, to the end of their key
HEAVY = 4096  #: keys that a unit may report as frequent
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
NONE, MANY = 0, 1  #: no neighbouring edge; several different ones
REPEATED, ONE_BEFORE, ONE_AFTER = 1, 2, 4
SPACE = np.zeros(256, bool)
SPACE[32] = SPACE[9:14] = True


def spans_hash(values: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A hash of each run of 64-bit values, the same wherever the run stands."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), STEP)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1], dtype=np.uint64)])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), BACK)]), dtype=np.uint64)
        return mixed((total[start + size] - total[start]) * back[start] + np.asarray(size).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each word of texts that lie one after another."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    inside = ~SPACE[data]
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    return start, end - start


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK)))
        low, high = start[at], start[stop - 1] + size[stop - 1]
        out[at:stop] = spans_hash(data[low:high].astype(np.uint64) + np.uint64(1), start[at:stop] - low, size[at:stop])
        at = stop
    return out


def windows_least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


@dataclass
class Unit:
    """A unit's texts and words; its windows by runs; its different rows (kinds)."""

    name: int
    ids: list
    data: np.ndarray
    start: np.ndarray  #: first byte of each word
    size: np.ndarray
    n_words: np.ndarray  #: of each text
    place: np.ndarray  #: the first word of each run's first window
    count: np.ndarray  #: windows of each run
    kind: np.ndarray  #: of each run
    key: np.ndarray  #: of each kind
    width: np.ndarray  #: windows of each kind
    twice: np.ndarray  #: whether several runs of the unit are of the kind
    body: np.ndarray  #: edges of all kinds: the one before, those of its windows, the one after


def _runs(words: np.ndarray, n_words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First word, windows and key of each run, then the hash of each window by its first word (0 where none starts)."""
    fits = np.maximum(n_words - length + 1, 0)
    edge = np.zeros(len(words), np.uint64)
    first = ragged(np.cumsum(n_words) - n_words, fits)
    if not len(first):
        return (*(np.empty(0, np.int64),) * 2, np.empty(0, np.uint64), edge)
    grams = spans_hash(words, np.arange(len(words) - gram + 1), gram)
    key = mixed(windows_least(grams, length - gram + 1)[first])  # a minimum is small; mixed again it spreads evenly
    edge[first] = np.maximum(spans_hash(words, first, length) >> np.uint64(16), np.uint64(MANY + 1))
    doc = np.repeat(np.arange(len(n_words)), fits)
    head = np.ones(len(first), bool)
    head[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(first)))
    pieces = -(-size // MOST)  # a long run, as of one word again and again, is cut
    begin = np.repeat(at, pieces) + ragged(np.zeros(len(at), np.int64), pieces) * MOST
    return first[begin], np.minimum(np.repeat(at + size, pieces) - begin, MOST), key[begin], edge


def taken_apart(batch: pa.RecordBatch, k: int, hot: np.ndarray, length: int, gram: int) -> Unit:
    """The unit in row k. ``hot`` has the keys, in order, whose windows go one by one."""
    get = lambda c: batch.column(c)[k].as_py()
    data = np.frombuffer(zstandard.decompress(get("text")), np.uint8)
    sizes = np.frombuffer(get("sizes"), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    start, size = words_of(data, offsets)
    n_words = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=len(sizes))
    place, count, key, edge = _runs(word_hashes(data, start, size), n_words, length, gram)
    if len(hot) and len(key):
        burst = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        alone = ragged(place[burst], count[burst])
        single = np.concatenate([np.zeros(int((~burst).sum()), bool), np.ones(len(alone), bool)])
        place, count = np.concatenate([place[~burst], alone]), np.concatenate([count[~burst], np.ones(len(alone), np.int64)])
        key = np.concatenate([key[~burst], mixed(edge[alone] * STEP)])
        order = np.argsort(place)
        place, count, key, single = place[order], count[order], key[order], single[order]
    else:
        single = np.zeros(len(key), bool)
    # The edges before and after each window: 0 at either end of a text, where no window starts.
    padded = np.concatenate([[np.uint64(0)], edge, [np.uint64(0)]])
    ends = np.cumsum(n_words)
    before = np.where(np.isin(place, ends - n_words), np.uint64(NONE), padded[place])
    after = np.where(np.isin(place + count, ends), np.uint64(NONE), padded[np.minimum(place + count, len(edge)) + 1]) if len(place) else before
    total = spans_hash(edge, place, count)
    with np.errstate(over="ignore"):
        name = np.where(single, total + STEP, mixed(total + mixed(before) * STEP + mixed(after + np.uint64(7))))
    order = np.lexsort((name, key))
    head = np.ones(len(order), bool)
    head[1:] = (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    one = order[head]
    width = count[one]
    body = np.empty(int((width + 2).sum()), np.uint64)
    last = np.cumsum(width + 2)
    body[ragged(last - width - 1, width)] = edge[ragged(place[one], width)]
    for x, to in ((before[order], last - width - 2), (after[order], last - 1)):
        if len(at):
            low, high = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
            body[to] = np.where(low == high, low, np.uint64(MANY))
    return Unit(get("unit"), batch.column("ids")[k].as_py(), data, start, size, n_words, place, count, kind, key[one], width, np.diff(np.append(at, len(order))) > 1, body)


UNITS = "unit long, ids array<long>, sizes binary, text binary, heavy array<struct<key: long, n: double>>, n_runs long"


def _units(docs: DataFrame, tasks: int, length: int, gram: int) -> DataFrame:
    """Pack documents (id long, text). ``heavy`` estimates, without bias, how many runs frequent keys have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, size = TaskContext.get().partitionId() << 12, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text", UNIT):
                data, offsets = strings(part.column("text"))
                if held and size + len(data) > UNIT:
                    yield unit(name, held)
                    name, held, size = name + 1, [], 0
                held.append((part.column("id").to_pylist(), np.diff(offsets), data.copy()))
                size += len(data)
        if held:
            yield unit(name, held)

    def unit(name: int, held: list) -> pa.RecordBatch:
        sizes, data = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        start, size = words_of(data, offsets)
        n_words = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=len(sizes))
        _, _, key, _ = _runs(word_hashes(data, start, size), n_words, length, gram)
        keys, n = np.unique(key, return_counts=True)
        least = max(1.0, len(key) / HEAVY, len(key) / (8 * tasks))
        with np.errstate(over="ignore"):
            lot = (mixed(keys + np.uint64(name) * STEP) >> np.uint64(11)).astype(float) / 2**53
        pick = lot < n / least
        heavy = [{"key": int(k), "n": float(max(c, least))} for k, c in zip(keys[pick].view(np.int64), n[pick], strict=True)]
        row = [[name], [[i for x in held for i in x[0]]], [sizes.tobytes()], [zstandard.compress(data.tobytes(), 3)], [heavy], [len(key)]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.struct([("key", pa.int64()), ("n", pa.float64())])), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["unit", "ids", "sizes", "text", "heavy", "n_runs"])

    return docs.transform(mapped, run, UNITS)


def _hot(units: DataFrame, tasks: int) -> np.ndarray:
    """Keys with more than a small part of a task's share of all runs: at most some 8 for each task."""
    total = units.agg(F.sum("n_runs").alias("n")).head()["n"] or 0
    keys = units.select(F.explode("heavy").alias("h")).groupBy("h.key").agg(F.sum("h.n").alias("n"))
    rows = keys.where(F.col("n") >= max(total / (8 * tasks), 2)).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _sent(units: DataFrame, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """(key, at, edges): the unit's different rows; ``at`` has the unit, the kind and whether it has several runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                u = taken_apart(batch, k, hot, length, gram)
                at = ((np.int64(u.name) << 26 | np.arange(len(u.key))) << 1) | u.twice
                ends = np.cumsum(u.width + 2)
                for i in range(0, len(u.key), 50_000):
                    j = min(i + 50_000, len(u.key))
                    low = ends[i] - u.width[i] - 2
                    edges = np.ascontiguousarray(u.body[low : ends[j - 1]].view(np.uint8).reshape(-1, 8)[:, :6])
                    offsets = np.concatenate([[0], (ends[i:j] - low) * 6]).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(edges)])
                    yield pa.RecordBatch.from_arrays([pa.array(u.key[i:j].view(np.int64)), pa.array(at[i:j], pa.int64()), packed], ["key", "at", "edges"])

    return units.transform(mapped, run, "key long, at long, edges binary")


def _met(sent: DataFrame) -> DataFrame:
    """(unit, kind, flags): a byte for each window of the kinds of which any is repeated. Rows come in order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            key, at = batch.column("key").to_numpy(), batch.column("at").to_numpy()
            column = batch.column("edges").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            six = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 6)
            edges = np.zeros((len(six), 8), np.uint8)
            edges[:, :6] = six
            held.append((key, at, np.diff(offsets) // 6, edges.reshape(-1).view(np.uint64)))
            size += len(six)
            if size >= MEET:
                key, at, width, edges = (np.concatenate(x) for x in zip(*held, strict=True))
                rows = int(np.searchsorted(key, key[-1]))  # the last key may go on
                cut = int(width[:rows].sum())
                if rows:
                    yield counted(key[:rows], at[:rows], width[:rows], edges[:cut])
                held, size = [(key[rows:], at[rows:], width[rows:], edges[cut:])], len(edges) - cut
        if size:
            yield counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def counted(key: np.ndarray, at: np.ndarray, width: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        n = width - 2
        row = np.repeat(np.arange(len(n)), n)
        own = ragged(np.cumsum(width) - width + 1, n)
        with np.errstate(over="ignore"):
            name = mixed(key.view(np.uint64)[row] + edges[own] * STEP)
        order = np.argsort(name)
        head = np.ones(len(order), bool)
        head[1:] = name[order][1:] != name[order][:-1]
        first = np.flatnonzero(head)
        flags = (np.add.reduceat(1 + (at[row] & 1)[order], first) > 1).astype(np.uint8) * REPEATED
        for x, flag in ((edges[own - 1], ONE_BEFORE), (edges[own + 1], ONE_AFTER)):
            low, high = np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)
            flags |= ((low == high) & (low > MANY)).astype(np.uint8) * np.uint8(flag)
        each = np.empty(len(order), np.uint8)
        each[order] = np.repeat(flags, np.diff(np.append(first, len(order))))
        some = np.flatnonzero(np.bitwise_or.reduceat(each, np.cumsum(n) - n) & REPEATED)
        packed = each[ragged((np.cumsum(n) - n)[some], n[some])]
        offsets = np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([pa.array(at[some] >> 27), pa.array((at[some] >> 1) & ((1 << 26) - 1), pa.int32()), binary], ["unit", "kind", "flags"])

    return sent.transform(mapped, run, "unit long, kind int, flags binary")


def _paths(batch: pa.RecordBatch, k: int, hot: np.ndarray, length: int, gram: int) -> tuple[Unit, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A unit; first word and windows of each path that it holds, the number of each in the unit, digests by number."""
    u = taken_apart(batch, k, hot, length, gram)
    marks = batch.column("marks")[k].values if batch.column("marks")[k].is_valid else None
    flags = np.zeros(int(u.width.sum()), np.uint8)
    if marks is not None and len(marks):
        kind = marks.field("kind").to_numpy()
        given = np.frombuffer(b"".join(marks.field("flags").to_pylist()), np.uint8)
        flags[ragged((np.cumsum(u.width) - u.width)[kind], u.width[kind])] = given
    each = np.zeros(len(u.start) + 1, np.uint8)  # by the first word of the window
    each[ragged(u.place, u.count)] = flags[ragged((np.cumsum(u.width) - u.width)[u.kind], u.count)]
    repeated = (each & REPEATED) > 0
    # No window starts at the last words of a text, so paths don't lead from one text to the next.
    on = repeated[:-1] & repeated[1:] & ((each[:-1] & ONE_AFTER) > 0) & ((each[1:] & ONE_BEFORE) > 0)
    head = repeated.copy()
    head[1:] &= ~on
    tail = repeated.copy()
    tail[:-1] &= ~on
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    known: dict[bytes, int] = {}
    if len(first):
        text, ends = joined(u.data, u.start, u.size)
        view = memoryview(text)
        digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip((ends - u.size)[first] - 1, ends[last + length - 1] - 1, strict=True)]
    else:
        digests = []
    number = np.array([known.setdefault(d, len(known)) for d in digests], np.int64)
    return u, first, last - first + 1, number, list(known)


def joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a space after each, and where each one ends with its space."""
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    for i in range(0, len(start), 200_000):
        some = slice(i, i + 200_000)
        out[ragged(ends[some] - size[some] - 1, size[some])] = data[ragged(start[some], size[some])]
    return out, ends


def _chance(marked: DataFrame, hot: np.ndarray, length: int, gram: int) -> DataFrame:
    """(unit, digest) of the paths whose words stand in one place only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                u, _, _, number, digests = _paths(batch, k, hot, length, gram)
                times = np.bincount(number, minlength=len(digests))
                yield pa.RecordBatch.from_arrays([pa.array([u.name] * len(digests), pa.int64()), pa.array(digests, pa.binary()), pa.array(times, pa.int64())], ["unit", "digest", "times"])

    paths = marked.where("marks is not null").transform(mapped, run, "unit long, digest binary, times long")
    return paths.groupBy("digest").agg(F.sum("times").alias("times"), F.min("unit").alias("unit")).where("times < 2").select("unit", "digest")


def _cut(marked: DataFrame, hot: np.ndarray, length: int, gram: int, keep_text: bool) -> DataFrame:
    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                u, first, count, number, digests = _paths(batch, k, hot, length, gram)
                chance = set(batch.column("chance")[k].as_py() or [])
                real = np.array([d not in chance for d in digests], bool)[number]
                depth = np.zeros(len(u.start) + 1, np.int32)
                np.add.at(depth, first[real], 1)
                np.add.at(depth, (first + count + length - 1)[real], -1)
                gone = np.cumsum(depth[:-1]) > 0
                doc = np.repeat(np.arange(len(u.n_words)), u.n_words)
                removed = np.bincount(doc[gone], minlength=len(u.n_words))
                text, ends = joined(u.data, u.start[~gone], u.size[~gone])
                stop = np.concatenate([[0], ends])[np.cumsum(u.n_words - removed)]
                view = memoryview(text)
                kept = [view[a : max(a, b - 1)] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
                columns = [pa.array(u.ids, pa.int64()), pa.array(u.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if keep_text:
                    columns.append(pa.array([bytes(x).decode() for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return marked.transform(mapped, run, f"id long, n_words long, n_removed long, kept_sha256 string{', kept string' * keep_text}")


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WORDS, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and the words left, joined by spaces, if asked.

    Words covered by ``length`` consecutive words that also start anywhere else are removed, there and here.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    spark, temporary, tasks = df.sparkSession, [], partitions(df)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = saved(_units(docs, tasks, length, gram), "units", temporary)
    hot = _hot(units, tasks)
    texts = units.select("unit", "ids", "sizes", "text")
    sent = _sent(texts, hot, length, gram).repartition(tasks, "key").sortWithinPartitions("key")
    marks = saved(_met(sent), "marks", temporary)
    by_unit = marks.groupBy("unit").agg(F.collect_list(F.struct("kind", "flags")).alias("marks"))
    marked = saved(texts.join(by_unit, "unit", "left"), "marked")
    dropped(spark, temporary)
    alone = saved(_chance(marked, hot, length, gram), "alone")
    chance = alone.groupBy("unit").agg(F.collect_list("digest").alias("chance"))
    return _cut(marked.join(small(saved(chance, "chance")), "unit", "left"), hot, length, gram, keep_text).withColumnRenamed("id", id_col)
