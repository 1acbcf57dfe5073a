"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1 in double precision; equal unit vectors are one point with a count. Coarse centroids
(k-means on a bounded sample) cut the points into inverted lists; the residual to the centroid is cut into SUBSPACES
parts, each coded by one of CODES centroids (k-means on residuals of the same sample). A query probes every list whose
border is within half the reach, so that of two neighbours at least one probes the other's list (see ``probes``); it
computes distances to the list's points from tables of its distances to all codes, keeps those that the stored coding
error of the point can't rule out, and reranks these by exact cosine. A pair counts for both ends: the one that asks
credits the other where that one doesn't ask itself.

The number of lists grows with the square root of the number of points. A list is cut into parts of at most PART
points, and the queries of a part into sets; parts are dealt to buckets of some MEMBERS points, to which a query is sent
once, so a task holds one bucket's points and a batch of queries whatever the corpus holds.
Tasks report counts and a spanning forest of the links they find, never pairs, so a group of copies costs no pair rows.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of different lengths don't
link; each length has an index of its own. Each row is a vector of its own, whatever its id: rows that repeat an id or
have none are counted as links, have links and get a result row of their own. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm._common import dropped, mapped, mixed, partitions, released, saved
from hostlens.llm.components import components, forest

SAMPLE = 20_000  #: most points from which centroids and codes are learned
SUBSPACES, CODES = 8, 256
PART = 4096  #: most members of a cell
ROWS = 512  #: members whose distances are looked up at a time
MEMBERS = 50_000  #: a task holds about so many members of cells
QUERIES = 1_000_000  #: a cell has one set of queries for so many points
ROUNDS = 8
SEED = 5


def unit_points(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, digest, unit): unit vectors as little-endian doubles and a digest of them; null for vectors that don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _scaled(batch.column("v"))
            digests = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["id", "digest", "unit"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).transform(mapped, run, "id long, digest binary, unit binary")


def _scaled(column: pa.Array) -> list[bytes | None]:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    units: list[bytes | None] = [None] * len(column)
    for size in np.unique(sizes[sizes > 0]):  # rows of one length together
        rows = np.flatnonzero(sizes == size)
        v = values[starts[rows][:, None] + np.arange(size)]
        big = np.abs(v).max(axis=1)  # NaN if any component is
        good = np.isfinite(big) & (big > 0)
        v = v[good] / big[good][:, None]  # so that squares neither overflow nor vanish
        v = np.round(v / np.sqrt((v * v).sum(axis=1))[:, None], 15) + 0.0
        for row, unit in zip(rows[good], v.astype("<f8"), strict=True):
            units[row] = unit.tobytes()
    return units


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=k)
        used = count > 0
        centres[used] = total[used] / count[used][:, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Index:
    """Centroids and codes; its size is bounded by SAMPLE and doesn't depend on the corpus otherwise."""

    def __init__(self, sample: np.ndarray, points: int, threshold: float):
        rng = np.random.default_rng(SEED)
        self.dims = sample.shape[1]
        self.reach = np.sqrt(2 - 2 * threshold)
        self.centres = kmeans(sample, int(max(1, min(np.sqrt(points), len(sample) / 4))), rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(self.dims), min(SUBSPACES, self.dims))
        self.books = [kmeans(rest[:, c], CODES, rng) for c in self.cuts]

    def coded(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they miss."""
        rest = x - self.centres[at]
        codes = np.column_stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)]).astype(np.uint8)
        miss = rest - self.decoded(codes)
        return codes, np.sqrt((miss * miss).sum(1))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.dims))
        for j, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, c] = b[codes[:, j]]
        return out

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which lists to search for each row: the own list, and lists whose border is within half the reach.

        The distances of two neighbours in different lists to the border of these add up to at most the distance of the
        neighbours, whatever the direction or number of dimensions. So one of them is within half the reach.
        """
        d = distances(x, self.centres)
        some, at = np.unique(own, return_inverse=True)
        gap = np.sqrt(np.maximum(distances(self.centres[some], self.centres), 1e-8))[at]  # too large a gap only brings borders nearer
        border = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap)
        border[np.arange(len(x)), own] = 0
        return border <= self.reach / 2 + 1e-6

    def candidates(self, x: np.ndarray, list_no: int, codes: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point of a list, query) that may be within reach: table look-ups, less the point's coding error.

        A table has a row for each code and a column for each query, so a look-up copies a row of distances.
        """
        rest = x - self.centres[list_no]
        tables = [np.ascontiguousarray(distances(rest[:, c], b).T, np.float32) for c, b in zip(self.cuts, self.books, strict=True)]
        limit = ((self.reach + miss + 1e-4) ** 2).astype(np.float32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(codes), ROWS):
            some = codes[at : at + ROWS]
            total = tables[0][some[:, 0]]
            for j in range(1, len(tables)):
                total += tables[j][some[:, j]]
            i, q = np.nonzero(total <= limit[at : at + ROWS, None])
            found.append((i + at, q))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links (other vectors at that cosine or above), component_id, kept.

    ``component_id`` is the smallest id that is reached by links; null where none that is reached has an id.
    """
    rows = saved(unit_points(df, id_col, vector_col), "units")
    points = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    points = saved(points.withColumn("size", F.length("unit")).withColumn("point", F.monotonically_increasing_id()), "points")
    known = None
    for size, n in points.groupBy("size").count().orderBy("size").collect():  # one number per length
        some = _known(points.where(F.col("size") == size), n, threshold)
        known = some if known is None else known.unionByName(some)
    if known is None:
        known = rows.select("digest", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")).limit(0)
    component = F.coalesce("component", "id")
    found = rows.where("digest is not null").select("id", "digest").join(known, "digest", "left")
    none = [F.lit(None).cast("long").alias(c) for c in ("n_links", "component")]
    found = found.unionByName(rows.where("digest is null").select("id", "digest", *none))  # vectors that don't count aren't joined
    return found.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _known(points: DataFrame, n: int, threshold: float) -> DataFrame:
    """(digest, n_links, component) of n points that have one length."""
    if n == 1:
        return points.select("digest", (F.col("copies") - 1).alias("n_links"), F.col("first").alias("component"))
    spark, temporary = points.sparkSession, []
    shared = spark.sparkContext.broadcast(_fitted(points, n, threshold))  # bounded: SAMPLE points at most
    found = saved(_search(points, shared, threshold, n, temporary), "found", temporary)
    released(spark)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("point")).agg(F.sum("b").alias("linked"))
    groups = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("id", "point")
    known = saved(points.select("digest", "point", "first", "copies").join(counts, "point", "left").join(groups, "point", "left"), "known")
    dropped(spark, temporary)
    # Points are numbered at random as to ids: the smallest id of each component that has links at all.
    least = known.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    # Points without links, often most, take no part in the join: their null component would be one hot key.
    alone = known.where("component is null").withColumn("least", F.col("first"))
    known = known.where("component is not null").join(least, "component").select(alone.columns).unionByName(alone)
    return known.select("digest", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component"))


def _fitted(points: DataFrame, n: int, threshold: float) -> Index:
    """Learn from a bounded sample in a fixed order (by digest)."""
    sample = points.orderBy("digest").limit(SAMPLE) if n > SAMPLE else points.orderBy("digest")
    units = [bytes(r["unit"]) for r in sample.select("unit").toLocalIterator()]
    return Index(np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1), n, threshold)


def _units(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(n, -1)


#: A row holds many members of a bucket's cells, or many queries and which cell each asks: each column has their values
#: one after another. ``row`` and ``cell`` say which of the vectors belongs to, or asks in, which cell; ``to`` is its list.
PACKED = "bucket int, asks boolean, n int, unit binary, point binary, copies binary, home binary, codes binary, miss binary, asked binary, row binary, cell binary, to binary"


def _search(points: DataFrame, shared, threshold: float, n: int, temporary: list[str]) -> DataFrame:
    """Rows (kind, a, b): 0: point a has links to b vectors of other points; 1: a and b are connected."""
    names = [f.split()[0] for f in PACKED.split(", ")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(b"".join(batch.column("unit").to_pylist()), batch.num_rows)
            at = nearest(x, index.centres)
            codes, miss = index.coded(x, at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(batch.column(c) for c in ("point", "copies", "unit")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(miss)], ["list", "point", "copies", "unit", "codes", "miss"])

    listed = points.select("point", "copies", "unit").transform(mapped, assign, "list int, point long, copies long, unit binary, codes binary, miss double")
    listed = saved(listed, "lists", temporary)
    # Lists may be of any size: each is cut into parts by the point's number.
    parts = listed.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    sets = n // QUERIES + 1
    buckets = max(partitions(points), n * sets // MEMBERS + 1)
    parts_of = {r["list"]: r["parts"] for r in parts.collect()}  # one number per list, as many as the index has centroids

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        several = np.array([parts_of.get(k, 0) for k in range(len(index.centres))])
        first_cell = np.concatenate([[0], np.cumsum(several)])
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                m = piece.num_rows
                own, point, copies, miss = (piece.column(c).to_numpy() for c in ("list", "point", "copies", "miss"))
                x = _units(b"".join(piece.column("unit").to_pylist()), m)
                codes = np.frombuffer(b"".join(piece.column("codes").to_pylist()), np.uint8).reshape(m, -1)
                asked = index.probes(x, own)
                # Which lists a member asks itself, as bits; a query names the list where it is a member.
                columns = {"unit": x, "point": point, "copies": copies, "home": own, "codes": codes, "miss": miss, "asked": np.packbits(asked, axis=1)}
                spread = mixed(point.astype(np.uint64)).view(np.int64) & (2**62 - 1)
                cell = first_cell[own] + spread % several[own]
                # Members go to each of the cell's sets of queries, a query to one of them in each part of a list.
                member = np.repeat(np.arange(m), sets)
                yield from packed(cell[member] * sets + np.tile(np.arange(sets), m), member, own[member], columns, False)
                row, to = np.nonzero(asked)
                times = several[to]
                row, to = np.repeat(row, times), np.repeat(to, times)
                step = np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)
                yield from packed((first_cell[to] + step) * sets + spread[row] // 64 % sets, row, to, columns, True)

    def packed(cell: np.ndarray, row: np.ndarray, to: np.ndarray, columns: dict[str, np.ndarray], asks: bool) -> Iterator[pa.RecordBatch]:
        """A vector goes to a bucket once, however many of its cells it is in or asks."""
        order = np.lexsort((cell, cell % buckets))
        cell, row, to = cell[order], row[order], to[order]
        edges = np.flatnonzero(np.diff(cell % buckets, prepend=-1, append=-1))
        kept = {"unit", "point", "copies", "home"} if asks else {"unit", "point", "copies", "codes", "miss", "asked"}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some, at = np.unique(row[a:b], return_inverse=True)
            made = {"bucket": pa.array([cell[a] % buckets], pa.int32()), "asks": pa.array([asks]), "n": pa.array([len(some)], pa.int32())}
            made |= {c: pa.array([columns[c][some].tobytes() if c in kept else None], pa.binary()) for c in columns}
            made |= {c: pa.array([x.astype(np.int64).tobytes()], pa.binary()) for c, x in (("row", at), ("cell", cell[a:b]), ("to", to[a:b]))}
            yield pa.RecordBatch.from_arrays([made[c] for c in names], names)

    sent = listed.transform(mapped, route, PACKED)
    sent = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after another, members first: a task holds one bucket's members and one row of queries."""
        index: Index = shared.value
        now, held, cells = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["bucket"] != now:
                    now, held, cells = r["bucket"], [], None
                if not r["asks"]:
                    held.append(r)
                    continue
                if cells is None:
                    cells, held = members(held), []
                x, mine, copies, home = (np.frombuffer(r[c], k).reshape(r["n"], -1) for c, k in (("unit", "<f8"), ("point", np.int64), ("copies", np.int64), ("home", np.int32)))
                row, cell, to = (np.frombuffer(r[c], np.int64) for c in ("row", "cell", "to"))
                edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if cell[a] in cells:
                        stored = cells[cell[a]]
                        for i in range(a, b, 256):
                            some = row[i : min(i + 256, b)]
                            yield from linked(index, int(to[a]), x[some], mine.ravel()[some], copies.ravel()[some], home.ravel()[some], *stored)

    def members(held: list[dict]) -> dict[int, tuple[np.ndarray, ...]]:
        """The members of each cell: vectors, codes, lists asked, coding errors, numbers, copies."""
        if not held:
            return {}
        kinds = (("unit", "<f8"), ("codes", np.uint8), ("asked", np.uint8), ("miss", np.float64), ("point", np.int64), ("copies", np.int64))
        parts = [[np.frombuffer(r[c], kind).reshape(r["n"], -1) for r in held] for c, kind in kinds]
        whole = [np.concatenate(x) for x in parts]
        base = np.cumsum([0, *(r["n"] for r in held)])
        row = np.concatenate([np.frombuffer(r["row"], np.int64) + b for r, b in zip(held, base, strict=False)])
        cell = np.concatenate([np.frombuffer(r["cell"], np.int64) for r in held])
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1))
        out = {}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            unit, codes, asked, *rest = (x[row[order[a:b]]] for x in whole)
            out[cell[order[a]]] = unit, codes, asked, *(x.ravel() for x in rest)
        return out

    def linked(index: Index, list_no: int, x: np.ndarray, mine: np.ndarray, times: np.ndarray, home: np.ndarray, y: np.ndarray, codes: np.ndarray, asked: np.ndarray, miss: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        j, i = index.candidates(x, list_no, codes, miss)
        other = mine[i] != ids[j]
        j, i = j[other], i[other]
        real = np.concatenate([np.einsum("ij,ij->i", x[i[at : at + 32_768]], y[j[at : at + 32_768]]) >= threshold for at in range(0, len(i), 32_768)] or [np.empty(0, bool)])
        j, i = j[real], i[real]
        if len(i):
            total = np.bincount(i, weights=copies[j], minlength=len(mine)).astype(np.int64)
            some = np.flatnonzero(total)
            # Members that don't ask in the query's list have this link from here.
            lists = home[i]
            silent = (asked[j, lists >> 3] >> (7 - (lists & 7))) & 1 == 0
            back = np.bincount(j[silent], weights=times[i[silent]], minlength=len(ids)).astype(np.int64)
            told = np.flatnonzero(back)
            # Pairs come by member: a member is tied to its first query, and its other queries to that one.
            head = np.diff(j, prepend=-1) > 0
            first = i[head][np.cumsum(head) - 1]
            tied = np.zeros((len(mine), len(mine)), bool)
            tied[i, first] = True
            p, q = np.nonzero(tied)
            vertex, root = forest(np.concatenate([ids[j[head]], mine[p]]), np.concatenate([mine[i[head]], mine[q]]))
            rest = vertex != root
            kinds = np.concatenate([np.zeros(len(some) + len(told), np.int32), np.ones(int(rest.sum()), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([mine[some], ids[told], vertex[rest]])), pa.array(np.concatenate([total[some], back[told], root[rest]]))], ["kind", "a", "b"])

    return sent.transform(mapped, search, "kind int, a long, b long")
