"""Embedding near-dedup: random-hyperplane sign hashes in several tables, exact cosines, connected components.

Equal vectors are one class, so that a vector which a third of all rows hold is compared once. Classes meet in the
buckets of several tables of sign hashes; a bucket's vectors are compared in blocks by matrix products in double
precision. A pair counts in the first table in which it meets. No pair leaves its task: a task sends, for each class,
how many vectors it linked and the root of the class in the task's own forest.

The signs in a table follow the number of classes (about ``BUCKET`` to a bucket), and the tables follow from that and
the recall that is wanted at the threshold itself; likelier pairs are found with a higher one. A bucket of any size is
cut into blocks, and each pair of blocks is a task of bounded size.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of
different lengths don't link; a null id takes part, and its component is the smallest id of its group, if there is one (it is
kept only if there is none);
repeated rows link with each other; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.components import connected_components, forest
from siftstone.session import scratch_path

THRESHOLD = 0.95
#: Share of the pairs at the threshold that some table finds.
RECALL = 0.999
#: Vectors in a bucket on average, and in a block.
BUCKET, BLOCK = 2048, 2048
#: Tables of buckets above a block that are broadcast; larger ones are joined.
MAX_BROADCAST_BUCKETS = 100_000
SEED = 20240229


def hash_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Signs in a table, and tables, for n vectors."""
    signs = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))
    met = (1.0 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - met)))


def _vectors(column: pa.Array, dtype: str) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Node (a hash of the vector, 0 for none) and the vector of each row, None where it links with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(dtype) + np.zeros(1, dtype)  # no negative zero
            x = x if np.isfinite(x).all() and x.any() else None
        out.append(x)
    nodes = np.array([0 if x is None else np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes()) | 1)) for x in out], np.int64)
    return nodes, out


def _planes(size: int, signs: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, signs * tables))


def _unit(data: list[bytes], dtype: str) -> np.ndarray:
    """Vectors of unit length in double precision."""
    x = np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, signs: int, tables: int, dtype: str) -> DataFrame:
    """(table, bucket, node, many, codes, vector) for each class and table."""

    width = np.dtype(dtype).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                b = batch.slice(first, 1000)
                nodes, many, data = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
                codes = np.empty((len(data), tables), np.int64)
                for size in {len(d) for d in data}:
                    at = [k for k, d in enumerate(data) if len(d) == size]
                    bits = _unit([data[k] for k in at], dtype) @ _planes(size // width, signs, tables) > 0
                    codes[at] = bits.reshape(len(at), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))
                # vectors of another length never share a bucket
                bucket = codes + (np.array([len(d) // width for d in data], np.int64) << 32)[:, None]
                packed = [c.astype("<i4").tobytes() for c in codes]
                rest = [pa.array(nodes), pa.array(many), pa.array(packed, pa.binary()), pa.array(data, pa.binary())]
                for t in range(tables):
                    columns = [pa.array(np.full(len(data), t, np.int32)), pa.array(bucket[:, t]), *rest]
                    yield pa.RecordBatch.from_arrays(columns, names=["table", "bucket", "node", "many", "codes", "vector"])

    return classes.select("node", "many", "vector").mapInArrow(run, "table int, bucket long, node long, many long, codes binary, vector binary")


def _linked(hashed: DataFrame, threshold: float, dtype: str) -> DataFrame:
    """(node, links, root): vectors linked in each task and the root of the node in the task's forest."""
    large = hashed.groupBy("table", "bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).checkpoint()
    few = large.limit(MAX_BROADCAST_BUCKETS + 1).count() <= MAX_BROADCAST_BUCKETS
    sized = hashed.join(F.broadcast(large) if few else large, ["table", "bucket"], "left")
    blocks = F.coalesce(F.ceil(F.col("_n") / F.lit(BLOCK)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # a vector of block s goes to the tasks (s, j) and (j, s) for every block j
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = sized.select("table", "bucket", "node", "many", "codes", "vector", own.alias("own"), F.explode(pairs).alias("_p"))
    placed = placed.select("table", "bucket", "_p.i", "_p.j", "own", "node", "many", "codes", "vector")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        t, _, i, j = (k.as_py() for k in key)
        x = _unit(group["vector"].to_pylist(), dtype)
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), "<i4").reshape(len(x), -1)[:, :t]
        own, nodes, many = group["own"].to_numpy(), group["node"].to_numpy(), group["many"].to_numpy()
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        links, parts = np.zeros(len(x), np.int64), []
        for first in range(0, len(left), 256):
            rows = left[first : first + 256]
            a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
            a, b = rows[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            if t and len(a):
                new = ~(codes[a] == codes[b]).any(axis=1)
                a, b = a[new], b[new]
            links += np.bincount(a, many[b], len(x)).astype(np.int64) + np.bincount(b, many[a], len(x)).astype(np.int64)
            parts.append(np.stack(forest(a, b)))
        child, root = forest(*np.concatenate(parts, axis=1)) if parts else (np.zeros(0, np.int64),) * 2
        roots = np.arange(len(x))
        roots[child] = root
        at = np.flatnonzero(links)
        return pa.table({"node": nodes[at], "links": links[at], "root": nodes[roots[at]]})

    return placed.groupBy("table", "bucket", "i", "j").applyInArrow(compare, "node long, links long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    path = scratch_path(spark, "embeddings")
    # vectors travel as wide as they are stored; what is computed is in double precision
    kind = dict(embeddings.dtypes)["embedding"]
    dtype = "<f4" if kind == "array<float>" else "<f8"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, vectors = _vectors(b.column(1), dtype)
            packed = pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, mask=nodes == 0), packed], names=["vec_id", "node", "vector"])

    embedding = F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), embedding).mapInArrow(read, "vec_id long, node long, vector binary")
    # equal vectors meet first within each task, then among tasks
    classes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.max("vector").alias("vector"))
    classes.write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    signs, tables = hash_shape(classes.count(), threshold, recall)
    _linked(_hashed(classes, signs, tables, dtype), threshold, dtype).write.parquet(f"{path}/links")
    found = spark.read.parquet(f"{path}/links")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = classes.join(groups, "node", "left").select("node", "least", "many", F.coalesce("component", "node").alias("component"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    info = label.join(least, "component").join(links, "node", "left").select("node", "component_id", own)
    # rows without a vector have no node, and would all meet in one task of a join
    ids = rows.select("vec_id", "node")
    alone = ids.where("node is null").select("vec_id", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("links"))
    ids = alone.union(ids.where("node is not null").join(info, "node").select("vec_id", "component_id", "links"))
    component = F.coalesce("component_id", "vec_id")
    kept = F.when(component.isNull(), True).otherwise(F.coalesce(F.col("vec_id") == component, F.lit(False)))
    return ids.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
