"""Connected components of links between ids, as joins and aggregates over edges.

Each round every vertex takes the smallest label among its own and its neighbours' labels (aggregated before the
shuffle) and then its label's label, so the distance to the smallest id shrinks geometrically on paths as well as
in large groups. Edges whose ends agree stay, as their labels still fall together; rounds end when none differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm._common import dropped, mapped, saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of edges (a, b) and the smallest vertex of each one's component, all in memory."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[x], label[y])
        if (label[x] == label[y]).all():
            return names, names[label]
        # Hook the larger label of each edge to the smaller, then compress paths.
        np.minimum.at(label, np.maximum(label[x], label[y]), least)
        while (label[label] != label).any():
            label = label[label]


def shrunk(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Replace the edges (a, b) of a partition, by runs of at most that many, by a star for each component of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size >= most:
                yield star(held)
                held, size = [], 0
        if held:
            yield star(held)

    def star(held: list) -> pa.RecordBatch:
        vertex, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        other = vertex != root
        return pa.RecordBatch.from_arrays([pa.array(vertex[other]), pa.array(root[other])], ["a", "b"])

    return edges.select("a", "b").transform(mapped, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in ``edges`` (a long, b long, no nulls): component is the smallest connected id."""
    spark, temporary, before = edges.sparkSession, [], []
    edges = saved(shrunk(edges.where("a <> b")).distinct(), "edges", temporary)
    labels = saved(edges.select(F.col("a").alias("id"), F.least("a", "b").alias("component")).union(edges.select("b", F.least("a", "b"))).groupBy("id").agg(F.min("component").alias("component")), "labels", before)
    while True:
        left = labels.select(F.col("id").alias("a"), F.col("component").alias("la"))
        right = labels.select(F.col("id").alias("b"), F.col("component").alias("lb"))
        open_edges = edges.join(left, "a").join(right, "b").where("la <> lb")
        # Each end, and each end's present label, may take the smaller label.
        low, high = F.least("la", "lb"), F.greatest("la", "lb")
        offers = open_edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), low.alias("offer")), F.struct(F.col("b").alias("id"), low.alias("offer")), F.struct(high.alias("id"), low.alias("offer")))).alias("o")).select("o.*")
        offers = saved(offers.groupBy("id").agg(F.min("offer").alias("offer")), "offers", temporary)
        if offers.isEmpty():
            dropped(spark, temporary)
            return labels
        hooked = labels.join(offers, "id", "left").select("id", F.least("component", F.coalesce("offer", "component")).alias("component"))
        hooked = saved(hooked, "hooked", temporary)
        upper = hooked.select(F.col("id").alias("component"), F.col("component").alias("above"))
        temporary += before
        before = []
        labels = saved(hooked.join(upper, "component", "left").select("id", F.coalesce("above", "component").alias("component")), "labels", before)
