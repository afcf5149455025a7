"""Exact counting of keys (64 bits, or 96) over all documents, answered back to the documents that hold them.

Documents are dealt to chunks by a hash. Each chunk sums its own keys first, so that a key of a third of all documents
costs one entry a chunk, and sends them by key range to blocks. A block adds up what all chunks sent and answers each
chunk with the positions, in the chunk's sorted keys, of those keys that occur more than once, with their totals. The
chunk then works its texts again with the answers. The texts are shuffled once; both passes read the same exchange.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import math
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftstone.llm.kernels import pack_sorted, unpack_sorted

#: Least bytes of text in a chunk, and least keys in a block; each is what one Python call holds, and a worker needs about
#: 40 times the bytes of a chunk. Sessions may set them; both grow with the root of the input, see ``shape``.
CHUNK_BYTES = 4 << 20
BLOCK_KEYS = 1_000_000
CHUNK_SETTING, BLOCK_SETTING = "siftstone.chunkBytes", "siftstone.blockKeys"
#: Bytes of text for each key, about a word with its space; used only to size blocks.
BYTES_PER_KEY = 6
#: Keys that a chunk sends to a block, on average, at least.
MESSAGE_KEYS = 128
#: Tables of heavy groups of equal rows up to here are broadcast; larger ones are joined.
MAX_BROADCAST_GROUPS = 100_000
#: Equal rows that may go to one chunk whatever their size.
EQUAL_ROWS = 4096
CHUNK = "_chunk"


class Keys(NamedTuple):
    """What a chunk sends: sorted distinct keys, how often each occurs in the chunk, and 32 more bits of each, if any."""

    keys: np.ndarray
    counts: np.ndarray
    extra: np.ndarray | None = None


def grouped(keys: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys (with equal extra bits) are neighbours, by key first, and where each group begins."""
    order = np.argsort(keys, kind="stable")
    new = keys[order][1:] != keys[order][:-1]
    if extra is not None and ((extra[order][1:] != extra[order][:-1]) & ~new).any():  # keys that meet by chance
        order = np.lexsort((extra, keys))
        new = (keys[order][1:] != keys[order][:-1]) | (extra[order][1:] != extra[order][:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), new]))


def shape(total: int, least: int, chunk_bytes: int = CHUNK_BYTES, block_keys: int = BLOCK_KEYS) -> tuple[int, int]:
    """Chunks and blocks for ``total`` bytes of text: at least ``least`` of both, unless blocks would be tiny.

    Every chunk sends to every block, so a message has (keys in a chunk) * (keys in a block) / (all keys) keys. To hold
    that at ``MESSAGE_KEYS``, chunks and blocks both grow with the root of the input once it is above some 30 GB.
    """
    grown = math.isqrt(MESSAGE_KEYS * total // BYTES_PER_KEY)
    chunk_bytes, block_keys = max(chunk_bytes, grown * BYTES_PER_KEY), max(block_keys, grown)
    chunks = max(least, -(-total // chunk_bytes))
    blocks = max(1, -(-total // (BYTES_PER_KEY * block_keys)), least if total >= least << 16 else 1)
    return int(chunks), int(blocks)


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text, ...) with a chunk number, and the number of blocks for their keys.

    Rows go to chunks by a hash of id and text. Rows that are equal in both, and together more than a chunk, are spread
    by their position in the input, which must then be the same each time it is read, as a table's is.
    """
    spark = docs.sparkSession
    # equal rows are grouped before the shuffle, so this pass sends a few numbers a row
    same = docs.groupBy(F.xxhash64("doc_id", "text").alias("_same")).agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = int(spark.conf.get(CHUNK_SETTING, str(CHUNK_BYTES))), int(spark.conf.get(BLOCK_SETTING, str(BLOCK_KEYS)))
    found = same.agg(F.sum("_bytes").alias("total"), F.sum("_n").alias("rows"), F.max(F.when(F.col("_n") > 1, F.struct("_bytes", "_n"))).alias("top")).first()
    chunks, blocks = shape(found.total or 0, least, *sizes)
    most_bytes, most_rows = max(sizes[0], (found.total or 0) // chunks), max(EQUAL_ROWS, (found.rows or 0) // chunks)
    same_as = F.xxhash64("doc_id", "text")
    at = F.pmod(same_as, F.lit(chunks))
    heavy = same.where((F.col("_n") > 1) & ((F.col("_bytes") > most_bytes) | (F.col("_n") > most_rows)))
    groups = heavy.select("_same", F.greatest(F.ceil(F.col("_bytes") / most_bytes), F.ceil(F.col("_n") / most_rows)).alias("_parts")).checkpoint() if found.top else None
    many = groups.limit(MAX_BROADCAST_GROUPS + 1).count() if groups is not None else 0
    if many:
        turned = docs.withColumns({"_at": F.monotonically_increasing_id(), "_key": same_as})
        joined = turned.join(F.broadcast(groups) if many <= MAX_BROADCAST_GROUPS else groups, F.col("_key") == F.col("_same"), "left")
        spread = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_key", F.col("_at") % F.col("_parts")), F.lit(chunks))).otherwise(at)
        return joined.select(*docs.columns, spread.cast("int").alias(CHUNK)), blocks
    return docs.withColumn(CHUNK, at.cast("int")), blocks


@cache
def _libc() -> ctypes.CDLL | None:
    name = ctypes.util.find_library("c")
    libc = ctypes.CDLL(name) if name else None
    return libc if hasattr(libc, "malloc_trim") else None


def release() -> None:
    """Give memory that a finished group has freed back to the system; a worker lives on beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def _finished(result: pa.Table) -> pa.Table:
    release()
    return result


def _edges(blocks: int) -> np.ndarray:
    return np.array([(b << 64) // blocks for b in range(1, blocks)], np.uint64)


def count_shared(
    chunked: DataFrame, blocks: int, keys_of: Callable[[pa.Table], Keys], finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType | str
) -> DataFrame:
    """Rows of ``finish(texts, totals)`` for each chunk; totals[i] belongs to keys_of(texts).keys[i].

    A total is how often the key occurs in all documents. ``keys_of`` must give equal results for equal texts.
    """
    edges = _edges(blocks)

    def send(table: pa.Table) -> pa.Table:
        keys, counts, extra = keys_of(table)
        at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        rest = lambda i, j: None if extra is None else np.ascontiguousarray(extra[i:j].view(np.uint8).reshape(-1, 4).T).tobytes()
        rows = [(b, pack_sorted(keys[i:j]), _many(counts[i:j]), rest(i, j)) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
        chunk = table[CHUNK][0].as_py()
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int32())]
        return pa.table([*columns, *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["block", CHUNK, "keys", "many", "extra"])

    def add(table: pa.Table) -> pa.Table:
        sent = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = [_counts(len(k), m) for k, m in zip(sent, table["many"].to_pylist(), strict=True)]
        ends = np.cumsum([len(k) for k in sent])
        keys = np.concatenate(sent)
        extra = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in table["extra"].to_pylist() if x is not None]
        order, first = grouped(keys, np.concatenate(extra) if extra else None)
        sums = np.add.reduceat(np.concatenate(counts)[order], first)
        totals = np.empty(len(keys), np.int64)
        totals[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        chunk, block, at, total = [], table["block"][0].as_py(), [], []
        for c, begin, end in zip(table[CHUNK].to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
            own = totals[begin:end]
            found = np.flatnonzero(own > 1)
            if len(found):
                chunk.append(c)
                at.append(found.astype(np.uint32).tobytes())
                total.append(np.minimum(own[found], 0xFFFFFFFF).astype(np.uint32).tobytes())
        columns = [pa.array(chunk, pa.int32()), pa.array([block] * len(chunk), pa.int32()), pa.array(at, pa.binary()), pa.array(total, pa.binary())]
        return pa.table(columns, names=[CHUNK, "block", "at", "total"])

    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return finish(table, np.zeros(0, np.int64))
        keys = keys_of(table).keys
        begins = np.concatenate([[0], np.searchsorted(keys, edges)])
        totals = np.ones(len(keys), np.int64)
        for b, at, total in zip(answers["block"].to_pylist(), answers["at"].to_pylist(), answers["total"].to_pylist(), strict=True):
            totals[begins[b] + np.frombuffer(at, np.uint32)] = np.frombuffer(total, np.uint32)
        return finish(table, totals)

    sent = chunked.groupBy(CHUNK).applyInArrow(lambda t: _finished(send(t)), f"block int, {CHUNK} int, keys binary, many binary, extra binary")
    answers = sent.groupBy("block").applyInArrow(lambda t: _finished(add(t)), f"{CHUNK} int, block int, at binary, total binary")
    return chunked.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(lambda t, a: _finished(apply(t, a)), schema)


def _many(counts: np.ndarray) -> bytes:
    """Counts other than 1, as pairs of position and count."""
    at = np.flatnonzero(counts != 1)
    return np.stack([at, counts[at]]).astype(np.uint32).tobytes()


def _counts(n: int, many: bytes) -> np.ndarray:
    out = np.ones(n, np.int64)
    at, counts = np.frombuffer(many, np.uint32).reshape(2, -1)
    out[at] = counts
    return out
