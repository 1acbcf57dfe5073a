"""N-gram Jaccard join over points of group counts.

A document's set holds its distinct shingles of K words (a shorter text is one shingle; no words: empty, links with
nothing). Shingles are hashed into groups; the numbers of shingles in the groups are the document's point. The sum of
the smaller coordinates of two points bounds their overlap from above; pairs that the bound can't rule out are
verified on the sets.

A plain R-tree over such points can't prune: unrelated texts of one length lie about equally far apart, in all of
many dimensions, so nearly every rectangle meets nearly every query. The groups are therefore arranged in parts. Two
sets with Jaccard >= t, the smaller of size a, differ in at most tau = a (1 - t) / t shingles; with more than tau usable
parts, some part has equal counts in all its groups. So the tree's top level branches by (size class, part), and the
search in a part has radius 0: documents whose points are equal in one part meet in one leaf, found by a shuffle on
the hash of the part's point. A part with few shingles is not usable (it would join unrelated texts); a document with
too few usable parts is dealt again with other hashes, and only then may it meet by a key for all such documents.

Documents of a leaf aren't paired. First each document is checked (bound, then sets) with the smallest one that has the
same smallest key: that joins most of a group of near copies, at one check for each. Then each is checked with the
smallest document of each of its leaves that is not in its component yet. Only leaves whose documents still don't all
fall into one component are searched on: blocks of points with their rectangles, bound by rectangle and by point, so
that no link between different texts is lost. The documents that the bound leaves with a partner, not the pairs, go on:
their sets meet in cells, and a cell gives a forest of verified links. Equal sets are one point from the start. Only
component membership and verified links are kept, so a group of copies costs no pair rows.

Null ids: the set's size is given, the component is null. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm._common import dropped, mapped, mixed, partitions, ragged, released, saved, slices, small, strings
from hostlens.llm.components import components

GROUPS = 64  #: least coordinates of a document's point; larger sets have more, up to MOST_GROUPS, so that the bound stays sharp
MOST_GROUPS = 1 << 16
BUFFER = 500_000  #: leaf keys that a task holds before it passes them on
BUCKET = 2_000_000  #: leaf keys for which there is a bucket
BLOCK = 256  #: points of a rectangle
CELL = 4096  #: points of a large leaf that one task holds
SETS = 1_000_000  #: shingles of a cell whose sets one task holds
SEEDS = 8
SHARE = 256  #: pairs of one document that are verified together
SMALL = 64  #: below this size any part with a shingle is usable
FEW_IDS = 200_000  #: ids of at most this number are broadcast

ODD = np.uint64(0x9E3779B97F4A7C15)
SEED_STEP = [np.uint64(i * 0x9E3779B97F4A7C15 % 2**64) for i in range(SEEDS + 1)]
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each distinct shingle, ordered by both."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    blank = BLANK[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][size > 0]] = True
    begin = np.flatnonzero(~blank & before)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    after[offsets[1:][size > 0] - 1] = True
    length = np.flatnonzero(~blank & after) + 1 - begin
    owner = np.searchsorted(offsets, begin, "right") - 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()) + 1, ODD, np.uint64))
        place = ragged(np.zeros(len(begin), np.int64), length)
        letters = (LOWER[data[~blank]].astype(np.uint64) + np.uint64(1)) * power[place]
        word = mixed(np.add.reduceat(letters, np.cumsum(length) - length))
        words = np.bincount(owner, minlength=n)
        first = np.cumsum(words) - words
        made = np.where(words >= k, words - k + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(n), made)
        start = ragged(first, made)
        h = np.zeros(len(doc), np.uint64)
        many = words[doc]
        for j in range(k):
            on = j < many
            at = np.minimum(start + j, len(word) - 1)
            h = mixed(h * ODD + np.where(on, word[at], np.uint64(j + 1)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


class Parts:
    """Size classes and the parts of each, for threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, low[-1] * den // num + 1))
        self.low = np.array(low)
        high = self.low[1:] - 1
        self.tau = high * (den - num) // num
        # Shingles per part: few enough that enough parts are usable, see the module's text.
        load, need = (7, 3) if 10 * num >= 9 * den else (3, 1)
        self.parts = np.maximum(self.tau + 1, high // load).astype(np.uint64)
        self.need = np.where(high >= SMALL, need, 1)

    def class_of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def keys(self, doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and leaf key for the usable parts of all texts, in their own class and the one below.

        The smaller of two near texts is in the class of the larger or the one below.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for below in (0, 1):
            kind = self.class_of(np.maximum(size, 1)) - below
            wanted = (size > 0) & (kind >= 0)
            for seed in range(SEEDS + 1):
                if not wanted.any():
                    break
                if seed == SEEDS:
                    texts = np.flatnonzero(wanted)
                    out.append((texts, self._key(np.full(len(texts), seed), kind[texts], np.full(len(texts), -1), np.zeros(len(texts), np.uint64))))
                    break
                pick = wanted[doc]
                d, x = doc[pick], h[pick]
                if seed:
                    x = mixed(x + SEED_STEP[seed])
                    order = np.lexsort((x, d))
                    d, x = d[order], x[order]
                part = ((x >> np.uint64(32)) * self.parts[kind[d]]) >> np.uint64(32)
                start = np.ones(len(d), bool)
                start[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
                at = np.flatnonzero(start)
                if not len(at):
                    break
                # The point of a part: how many shingles each of its 2^64 groups holds, as a sum of group hashes.
                point = np.add.reduceat(mixed(x + ODD), at)
                usable = np.diff(np.append(at, len(d))) >= self.need[kind[d[at]]]
                texts = d[at][usable]
                out.append((texts, self._key(np.full(len(texts), seed), kind[texts], part[at][usable].astype(np.int64), point[usable])))
                wanted = wanted & (np.bincount(texts, minlength=len(size)) <= self.tau[np.maximum(kind, 0)])
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        texts, keys = (np.concatenate(x) for x in zip(*out, strict=True))
        return texts, keys

    @staticmethod
    def _key(seed: np.ndarray, kind: np.ndarray, part: np.ndarray, point: np.ndarray) -> np.ndarray:
        where = (seed.astype(np.uint64) << np.uint64(56)) ^ (kind.astype(np.uint64) << np.uint64(44)) ^ part.astype(np.uint64)
        return mixed(point + mixed(where))

    def may_link(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b with that overlap reach the threshold."""
        return overlap * (self.num + self.den) >= self.num * (a + b)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def groups_of(size: np.ndarray) -> np.ndarray:
    """Coordinates for a set of that size: a power of two, about a quarter of it. Groups nest: they are a hash's top bits."""
    return (1 << np.ceil(np.log2(np.clip(size / 4, GROUPS, MOST_GROUPS))).astype(np.int64))


def _folded(point: bytes, groups: int) -> np.ndarray:
    """The point with fewer coordinates."""
    x = np.frombuffer(point, "<u2").astype(np.int64)
    return x if len(x) == groups else x.reshape(groups, -1).sum(axis=1)


def overlap_bound(x: bytes, y: bytes) -> int:
    """The sum of the smaller coordinates, at the resolution that both points have."""
    groups = min(len(x), len(y)) // 2
    return int(np.minimum(_folded(x, groups), _folded(y, groups)).sum())


def _points(docs: DataFrame, k: int, parts: Parts) -> DataFrame:
    """(id, n, sum1, sum2, door, counts): size, two order-free digests, smallest key, and the point of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                doc, h = shingles(*strings(part.column("text")), k)
                size = np.bincount(doc, minlength=n)
                sums = [_sums(doc, mixed(h + SEED_STEP[s]), size) for s in (1, 2)]
                width = groups_of(size)
                edges = np.concatenate([[0], np.cumsum(width)])
                counts = np.bincount(edges[doc] + (h >> (np.uint64(64) - np.log2(width).astype(np.uint64)[doc])).astype(np.int64), minlength=edges[-1]).astype("<u2")
                points = [counts[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                door = np.full(n, 2**64 - 1, np.uint64)
                texts, keys = parts.keys(doc, h, size)
                np.minimum.at(door, texts, keys)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size, pa.int64()), *(pa.array(s.view(np.int64)) for s in (*sums, door)), pa.array(points, pa.binary())], ["id", "n", "sum1", "sum2", "door", "counts"])

    return docs.transform(mapped, run, "id long, n long, sum1 long, sum2 long, door long, counts binary")


def _sums(doc: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(size), np.uint64)
    if len(x):
        total[size > 0] = np.add.reduceat(x, np.unique(doc, return_index=True)[1])
    return total


PACKED = "bucket int, low binary, high binary, docs binary, groups binary, leaders binary, leader_groups binary"


def _leaves(docs: DataFrame, k: int, parts: Parts, shingles_in_all: int) -> DataFrame:
    """(key, doc, component, leader, of_leader): documents (id, text, component) that meet another in a leaf, each with a
    smaller document of the leaf and the components of both.

    Keys travel packed. A task first groups the keys that it holds, and passes on one document of each group, so a
    leaf that much of the corpus falls into arrives as one row per run of keys.
    """
    # A set has at most one key for each of its shingles and class; the number of buckets follows the corpus.
    buckets = max(partitions(docs, 16), -(-2 * shingles_in_all // BUCKET))

    def packed(bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, group: np.ndarray, leader: np.ndarray | None, of_leader: np.ndarray | None) -> pa.RecordBatch:
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edges))
        cut = lambda x: pa.nulls(len(used), pa.binary()) if x is None else pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), cut(key.astype("<u4")), cut((key >> np.uint64(32)).astype("<u2")), *map(cut, (doc, group, leader, of_leader))], [f.split()[0] for f in PACKED.split(", ")])

    def grouped(key: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((doc, key))
        key, doc, group = key[order], doc[order], group[order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.empty(0, np.int64)
        return key, doc, group, doc[first], group[first], head

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, doc, group, leader, of_leader, head = grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
        # 48 bits of a key travel, next to its bucket: a chance agreement only adds a pair that the bound rules out.
        bucket = (((key >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        of, rest = np.argsort(bucket[head], kind="stable"), ~head & (doc != leader)
        yield packed(bucket[head][of], *(x[head][of] for x in (key, doc, group)), None, None)
        if rest.any():  # these are linked already and go anywhere
            spread = doc[rest] % buckets
            order = np.argsort(spread, kind="stable")
            yield packed(spread[order], *(x[rest][order] for x in (key, doc, group, leader, of_leader)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                doc, h = shingles(*strings(part.column("text")), k)
                texts, keys = parts.keys(doc, h, np.bincount(doc, minlength=part.num_rows))
                held.append((keys, *(part.column(c).to_numpy()[texts] for c in ("id", "component"))))
                size += len(keys)
                if size >= BUFFER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for low, high, *rest in zip(*(batch.column(c) for c in ("low", "high", "docs", "groups", "leaders", "leader_groups")), strict=True):
                key = np.frombuffer(low.as_buffer(), "<u4").astype(np.uint64) | np.frombuffer(high.as_buffer(), "<u2").astype(np.uint64) << np.uint64(32)
                rest = [np.frombuffer(x.as_buffer(), np.int64) for x in rest if x.is_valid]
                if len(rest) == 4:
                    yield out(key, *rest)
                else:
                    held.append((key, *rest))
        if held:
            key, doc, group, leader, of_leader, _ = grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
            del held
            other = doc != leader
            yield out(*(x[other] for x in (key, doc, group, leader, of_leader)))

    def out(key: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, rest)], ["key", "doc", "component", "leader", "of_leader"])

    return docs.transform(mapped, make, PACKED).repartition(buckets, "bucket").transform(mapped, meet, "key long, doc long, component long, leader long, of_leader long")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of the texts with a saved table of ids; the ids are broadcast where they are few."""
    return docs.join(small(ids.select("id").distinct(), FEW_IDS), "id", how)


def _verified(docs: DataFrame, pairs: DataFrame, k: int, parts: Parts, temporary: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Sets meet by b, b's own first, so a task holds two sets.

    A b with many pairs has shares of them, and its own set goes once to each.
    """
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    to = pairs.join(shares, "b").groupBy(F.col("a").alias("id")).agg(F.collect_set(F.struct("b", "shares")).alias("others"))
    sent = to.join(shares.select(F.col("b").alias("id"), F.col("shares").alias("own")), "id", "full")
    sent = saved(sent.select("id", F.coalesce("others", F.array().cast("array<struct<b:bigint,shares:int>>")).alias("others"), F.coalesce("own", F.lit(0)).alias("own")), "sent", temporary)
    texts = docs.join(small(sent, FEW_IDS), "id").dropDuplicates(["id"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, h = shingles(*strings(part.column("text")), k)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, (name, others, own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "others", "own")), strict=True)):
                    data = h[edges[i] : edges[i + 1]].tobytes()
                    to = [(x["b"], name % x["shares"], False) for x in others] + [(name, s, True) for s in range(own)]
                    for at in range(0, len(to), 64):
                        bs, share, mine = zip(*to[at : at + 64], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int64()), pa.array(share, pa.int64()), pa.array([name] * len(bs), pa.int64()), pa.array(mine), pa.array([data] * len(bs), pa.binary())], ["b", "share", "a", "own", "set"])

    rows = texts.transform(mapped, sets, "b long, share long, a long, own boolean, set binary")
    rows = rows.repartition(partitions(docs), "b", "share").sortWithinPartitions("b", "share", F.desc("own"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, name = None, None
        for batch in batches:
            hits: list[tuple[int, int]] = []
            for a, b, own, data in zip(*(batch.column(c) for c in ("a", "b", "own", "set")), strict=True):
                x = np.frombuffer(data.as_buffer(), np.uint64)
                if own.as_py():
                    mine, name = x, b.as_py()
                elif name == b.as_py() and len(mine) and len(x):
                    at = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
                    if parts.may_link(int((mine[at] == x).sum()), len(x), len(mine)):
                        hits.append((a.as_py(), name))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in hits], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.transform(mapped, check, "a long, b long")


def _bounded(pairs: DataFrame, points: DataFrame, parts: Parts) -> DataFrame:
    """The pairs that the sum of smaller coordinates can't rule out."""
    a = points.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    b = points.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = np.array([overlap_bound(x.as_py(), y.as_py()) for x, y in zip(batch.column("ca"), batch.column("cb"), strict=True)], np.int64)
            may = parts.may_link(bound, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ca", "cb").transform(mapped, run, "a long, b long")


def _in_cells(members: DataFrame) -> DataFrame:
    """The members (key, id, cells, ..) once for each pair (i, j) of their leaf's cells that their own cell is in."""
    cell = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    members = members.withColumn("cell", cell).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return members.withColumns({"i": F.least("cell", "with"), "j": F.greatest("cell", "with")}).drop("cells", "cell", "with")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each run of rows of one (key, i, j)."""
    now, held = None, []
    for batch in batches:
        key = np.column_stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for at, stop in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if at == stop:
                continue
            if now != tuple(key[at]):
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                now, held = tuple(key[at]), []
            held.append(batch.slice(at, stop - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searched(leaves: DataFrame, points: DataFrame, groups: DataFrame, parts: Parts, temporary: list[str]) -> DataFrame:
    """(key, id, component, n): documents under a leader (key) for which the bound can't rule out a link with one there that is
    of another component.

    All documents of a leaf have one leader, and near copies share most of their leaves: by leader, a pair comes up once.
    ``groups`` has the components by now of those in the leaves: first the few components under each leader are looked at.
    """
    now = groups.select(F.col("id").alias("was"), F.col("component").alias("now"))
    under = leaves.select("leader", F.explode(F.array_distinct(F.array("component", "of_leader"))).alias("was"), F.lit(1).alias("m"))
    under = under.groupBy("leader", "was").agg(F.sum("m").alias("m")).join(now, "was", "left").withColumn("now", F.coalesce("now", "was"))
    several = under.groupBy("leader").agg(F.min("now").alias("low"), F.max("now").alias("high"), F.sum("m").alias("m")).where("low <> high")
    several = saved(several.select(F.col("leader").alias("key"), F.ceil((F.col("m") + 1) / CELL).cast("int").alias("cells")), "several", temporary)
    some = leaves.join(several.select(F.col("key").alias("leader")), "leader", "left_semi")
    renew = lambda rows, c: rows.join(now.select(F.col("was").alias(c), F.col("now").alias(f"{c}_now")), c, "left").withColumn(c, F.coalesce(f"{c}_now", c)).drop(f"{c}_now")
    rows = renew(renew(some, "component"), "of_leader").select("doc", "leader", F.col("component").alias("of_doc"), "of_leader")
    own = rows.select(F.col("leader").alias("key"), F.col("leader").alias("id"), F.col("of_leader").alias("component")).distinct()
    members = rows.select(F.col("leader").alias("key"), F.col("doc").alias("id"), F.col("of_doc").alias("component")).unionByName(own).join(several, "key")
    # A large leaf is searched as pairs of cells; every document goes to all pairs that its cell is in.
    members = _in_cells(members).join(points.select("id", "n", "counts"), "id").select("key", "i", "j", "id", "component", "n", "counts")
    members = members.repartition(partitions(leaves), "key", "i", "j").sortWithinPartitions("key", "i", "j", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            yield rows.filter(pa.array(search(rows))).select(["key", "id", "component", "n"])

    def search(rows: pa.RecordBatch) -> np.ndarray:
        component, n = (rows.column(c).to_numpy() for c in ("component", "n"))
        fine = rows.column("counts").to_pylist()
        points = np.stack([_folded(x, GROUPS) for x in fine])
        found = np.zeros(len(n), bool)
        # Rows come by size; a block's rectangle runs from 0 to the largest count of each coordinate.
        starts = range(0, len(n), BLOCK)
        corners = [points[s : s + BLOCK].max(axis=0) for s in starts]
        for x, s in enumerate(starts):
            for y in range(x, len(corners)):
                e = y * BLOCK
                smallest, largest = n[e], n[min(s + BLOCK, len(n)) - 1]
                if smallest * parts.num > largest * parts.den or not parts.may_link(np.minimum(corners[x], corners[y]).sum(), n[s], smallest):
                    continue
                i, j = np.nonzero(component[s : s + BLOCK, None] != component[None, e : e + BLOCK])
                i, j = i + s, j + e
                keep = (i < j) & (n[i] * parts.den >= n[j] * parts.num) if x == y else n[i] * parts.den >= n[j] * parts.num
                i, j = i[keep], j[keep]
                for c in range(0, len(i), 8192):
                    a, b = i[c : c + 8192], j[c : c + 8192]
                    open_ = ~(found[a] & found[b])
                    a, b = a[open_], b[open_]
                    may = parts.may_link(np.minimum(points[a], points[b]).sum(axis=1), n[a], n[b])
                    for u, v in zip(a[may], b[may], strict=True):
                        if not (found[u] and found[v]) and parts.may_link(overlap_bound(fine[u], fine[v]), n[u], n[v]):
                            found[[u, v]] = True
        return found

    return members.transform(mapped, run, "key long, id long, component long, n long").distinct()


def _joined(docs: DataFrame, found: DataFrame, k: int, parts: Parts, temporary: list[str]) -> DataFrame:
    """Links (a, b) that connect what all links between the documents of one key in ``found`` (key, id, component, n) connect.

    The sets of a key meet in pairs of cells of at most some SETS shingles, or of one text; each gives a forest.
    """
    cells = saved(found.groupBy("key").agg(F.ceil(F.sum("n") / SETS).cast("int").alias("cells")), "cells", temporary)
    members = _in_cells(found.join(cells, "key"))
    sent = saved(members.groupBy("id").agg(F.first("component").alias("component"), F.collect_set(F.struct("key", "i", "j")).alias("to")), "sent", temporary)
    texts = docs.join(small(sent, FEW_IDS), "id").dropDuplicates(["id"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, h = shingles(*strings(part.column("text")), k)
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, (name, component, to) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "component", "to")), strict=True)):
                    data, n = h[edges[i] : edges[i + 1]].tobytes(), int(edges[i + 1] - edges[i])
                    for at in range(0, len(to), 64):
                        some = to[at : at + 64]
                        same = lambda x: [x] * len(some)  # noqa: E731, B023
                        columns = [pa.array([x[c] for x in some], t) for c, t in (("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
                        columns += [pa.array(same(x), t) for x, t in ((name, pa.int64()), (component, pa.int64()), (n, pa.int64()), (data, pa.binary()))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "i", "j", "id", "component", "n", "set"])

    rows = texts.transform(mapped, sets, "key long, i int, j int, id long, component long, n long, set binary")
    rows = rows.repartition(partitions(docs), "key", "i", "j").sortWithinPartitions("key", "i", "j", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            links = link(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    def link(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        ids, n = (rows.column(c).to_numpy() for c in ("id", "n"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        flat, first = np.concatenate(own), np.cumsum(n) - n
        points = np.stack([np.bincount((x >> np.uint64(64 - 6)).astype(np.int64), minlength=GROUPS) for x in own])
        label = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        links: list[tuple[int, int]] = []
        for a in range(len(ids)):
            b = np.arange(a + 1, np.searchsorted(n, n[a] * parts.den // parts.num, "right"))
            b = b[label[b] != label[a]]
            b = b[parts.may_link(np.minimum(points[a], points[b]).sum(axis=1), n[a], n[b])]
            if not len(b):
                continue
            values = flat[ragged(first[b], n[b])]
            same = own[a][np.minimum(np.searchsorted(own[a], values), n[a] - 1)] == values
            b = b[parts.may_link(np.add.reduceat(same.astype(np.int64), np.cumsum(n[b]) - n[b]), n[a], n[b])]
            others, at = np.unique(label[b], return_index=True)
            links += [(int(max(ids[a], x)), int(min(ids[a], x))) for x in ids[b[at]]]
            label[np.isin(label, others)] = label[a]
        return links

    return rows.transform(mapped, run, "a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per document: id, n_shingles, representative (smallest id with the same set), component_id.

    Each row is a document of its own, with the set of its own text. Where rows repeat an id, rows are linked by their
    numbers, and each gets the smallest id among those that it is connected with; rows of one id are connected by their
    texts only. Rows without an id link with nothing.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if docs.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return _components_of(docs, k, num, den).withColumnRenamed("id", id_col)
    rows = saved(docs.where("id is not null").select(F.monotonically_increasing_id().alias("number"), "id", "text"), "numbered")
    found = saved(_components_of(rows.select(F.col("number").alias("id"), "text"), k, num, den).withColumnRenamed("id", "number"), "found")
    found = saved(found.join(rows.select("number", "id"), "number"), "named")
    least = lambda c: saved(found.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(f"least_{c}")), "least")
    named = found.join(least("representative"), "representative", "left").join(least("component_id"), "component_id", "left")
    named = named.select("id", "n_shingles", F.col("least_representative").alias("representative"), F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least_component_id")).alias("component_id"))
    return named.unionByName(_components_of(docs.where("id is null"), k, num, den)).withColumnRenamed("id", id_col)


def _components_of(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The same for documents (id long, text) whose ids are null or different."""
    sets, links = jaccard_links(docs, "id", "text", k, num, den)
    groups = components(links)
    rows = sets.join(groups.select(F.col("id").alias("representative"), "component"), "representative", "left")
    component = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "representative"))
    return rows.select("id", F.col("n").alias("n_shingles"), "representative", component.alias("component_id"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """Membership (id, n, representative) and verified links (a, b) between representatives.

    The links connect what all links of the join connect; they leave out links inside what is connected already. Ids must
    be null or different (``jaccard_components`` sees to it).
    """
    parts, spark, temporary = Parts(num, den), df.sparkSession, []
    docs = _docs(df, id_col, text_col)
    points = saved(_points(docs, k, parts), "points", temporary)
    # Saved before its join, as Spark splits a hot group of a join only where both sides come as they are.
    same = points.where("n > 0 and id is not null").groupBy("n", "sum1", "sum2").agg(F.min("id").alias("same"), F.count("*").alias("times")).where("times > 1").drop("times")
    same = saved(same, "same", temporary)
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("same", "id"))
    sets = saved(points.drop("counts", "door").join(same, ["n", "sum1", "sum2"], "left").select("id", "n", own.alias("representative")), "sets")
    copies = sets.where("id is not null and (n = 0 or representative <> id)")
    single = _only(docs.where("id is not null"), copies, "left_anti")
    points = points.where("n > 0 and id is not null").join(sets.where("representative = id").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    total = sets.where("representative = id").agg(F.sum("n").alias("n")).head()["n"] or 0
    # Documents with one smallest key, each with the smallest of them.
    doors = points.select("id", "door")
    first = saved(doors.groupBy("door").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b < last").drop("last"), "doors", temporary)
    stars = doors.join(first, "door").where("id > b").select(F.col("id").alias("a"), "b")
    links = saved(_verified(single, saved(_bounded(stars, points, parts), "stars", temporary), k, parts, temporary), "links")
    groups = components(links)
    named = single.join(small(groups, FEW_IDS), "id", "left").select("id", "text", F.coalesce("component", "id").alias("component"))
    met = saved(_leaves(named, k, parts, total), "met", temporary)
    # A document linked before the shuffle has the leader of its run of keys, whose own row names the leaf's leader.
    top = met.select("key", F.col("doc").alias("leader"), F.col("leader").alias("top"), F.col("of_leader").alias("of_top"))
    leaves = met.join(top, ["key", "leader"], "left").select("doc", "component", F.coalesce("top", "leader").alias("leader"), F.coalesce("of_top", "of_leader").alias("of_leader"))
    leaves = saved(leaves.distinct(), "leaves", temporary)
    released(spark)
    stars = leaves.where("component <> of_leader").select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    links = links.unionByName(saved(_verified(single, saved(_bounded(stars, points, parts), "stars", temporary), k, parts, temporary), "links"))
    released(spark)
    rest = saved(_searched(leaves, points, components(links), parts, temporary), "rest", temporary)
    if not rest.isEmpty():
        links = links.unionByName(saved(_joined(single, rest, k, parts, temporary), "more"))
    dropped(spark, temporary)
    released(spark)
    return sets, links
