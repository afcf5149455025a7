"""Distributed connected components by alternating large and small stars.

Each partition first replaces its own edges by a spanning forest of stars, which is a pre-aggregation: the edges that
are shuffled afterwards number at most the nodes that a partition has seen. Every round is cut by a checkpoint in the
shared folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges but the roots; a root is the smallest node of its tree."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b and the same components as ``edges`` (a, b): each partition's spanning stars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            parts = held or [(np.zeros(0, np.int64),) * 2]
            return forest(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            rows += batch.num_rows
            if rows > 1 << 20:
                a, b = joined()
                held, rows = [(a, b)], len(a)
                if rows > 1 << 19:  # mostly stars already
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    held, rows = [], 0
        a, b = joined()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    kept = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long) that isn't its component's smallest node.

    Self-loops and repeated edges are allowed. The rounds number about the logarithm of the largest component's
    diameter; between rounds only a count and a sum come to the driver.
    """
    e = contracted(edges.where("a <> b")).distinct().checkpoint()
    seen = None
    while True:
        e = _small_star(_large_star(e)).checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
