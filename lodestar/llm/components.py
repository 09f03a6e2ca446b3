"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(vertex, least vertex of its tree) of some edges; least vertices are left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    rows = np.array(forest(edges), dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])


def components(edges: DataFrame, one_task: int = 500_000) -> DataFrame:
    """(doc, root) for each end of ``edges`` (u, v) with distinct ends; the root is the least id.

    Each partition first replaces its own edges by a forest, which holds no more edges than vertices. Up
    to ``one_task`` edges that are left, one task finishes them. Beyond, in each round every vertex points to the one of
    least hash among itself and its neighbours, and the edges are drawn between what their ends point
    to. Hashes differ from round to round, so the vertices shrink by a constant share, whatever their
    shape. Least hashes are aggregated before they are joined back: no neighbourhood is gathered.
    """
    edges = cut(edges.where("u <> v").distinct().mapInArrow(_forests, "u long, v long"))
    if edges.count() <= one_task:
        edges = cut(edges.coalesce(1).mapInArrow(_forests, "u long, v long"))
        return edges.select(F.col("u").alias("doc"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("root")).distinct())
    places, turn = None, 0
    while True:
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points = cut(both.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least("m", order("u"))["to"].alias("to")))
        if points.isEmpty():
            break
        if places is None:
            places = points.select(F.col("u").alias("doc"), F.col("to").alias("at"))
        else:
            moved = points.select(F.col("u").alias("at"), "to")
            places = places.join(moved.hint("merge"), "at", "left").select("doc", F.coalesce("to", "at").alias("at"))
        a, b = points.select("u", F.col("to").alias("a")), points.select(F.col("u").alias("v"), F.col("to").alias("b"))
        edges = cut(edges.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
        turn += 1
    if places is None:
        return edges.select(F.col("u").alias("doc"), F.col("v").alias("root"))
    least = places.groupBy("at").agg(F.min("doc").alias("root"))
    return places.join(least.hint("merge"), "at").select("doc", "root")
