"""Substring dedup: Rabin-Karp hashes of every window of words, counted over all documents.

Every word that is covered by a window which starts at two or more places of the corpus (the same document included)
is removed; neighbouring and overlapping windows merge into maximal removal intervals. Windows are judged on the input
as it is, so all copies of a passage go.

Windows are compared by hashes of 96 bits: two different windows meet with a chance of about n * n / 2**97 over n windows
(0.0006 for 10**13), and then at most those two windows are removed in error; no repeated window is ever missed.

Defined cases: a null or empty text has no words and an empty kept text; a text with fewer words than a window stays
whole; kept words are joined by one space; repeated rows are documents of their own and so lose their long windows;
null ids are kept; an empty table gives an empty result; extra columns of any name are kept, and the columns in
``ADDED`` replace columns of those names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm.columns import as_row, others
from siftstone.llm.exchange import Keys, count_shared, dealt, grouped
from siftstone.llm.kernels import SECOND_BASE, Words

WINDOW = 35
ADDED = {"n_words": "long", "n_removed": "long", "removed": "array<struct<first:long,end:long>>", "kept_text": "string"}


def wide_windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window in 64 and, by another multiplier, in 32 bits, and each window's first word."""
    hashes = words.hashes()
    keys, at = words.windows(size, hashes)
    extra, _ = words.windows(size, hashes, SECOND_BASE)
    return keys, (extra >> np.uint64(32)).astype(np.uint32), at


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (intervals of word positions) and ``kept_text``."""
    rest = [*ADDED, "text"]
    given = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), as_row(docs, rest).alias("row"))
    chunked, blocks = dealt(given)

    def keys_of(table: pa.Table) -> Keys:
        keys, extra, _ = wide_windows(Words(table["text"]), window)
        order, first = grouped(keys, extra)
        at = order[first]
        return Keys(keys[at], np.diff(np.append(first, len(keys))), extra[at])

    def finish(table: pa.Table, totals: np.ndarray) -> pa.Table:
        words = Words(table["text"])
        keys, extra, at = wide_windows(words, window)
        order, first = grouped(keys, extra)
        often = np.zeros(len(keys), bool)
        often[order] = np.repeat(totals > 1, np.diff(np.append(first, len(keys))))
        repeated = at[often]
        steps = np.zeros(len(words.starts) + 1, np.int64)
        steps[: len(words.starts)] += np.bincount(repeated, minlength=len(words.starts))[: len(words.starts)]
        ended = np.bincount(repeated + window, minlength=len(steps))[: len(steps)]
        gone = np.cumsum(steps - ended)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[words.of[1:]] - before[words.of[:-1]]
        kept = []
        for d, lost in enumerate(removed):
            parts = words.text(d).split()
            kept.append(b" ".join(compress(parts, ~gone[words.of[d] : words.of[d + 1]]) if lost else parts))
        # an interval begins where a removed word follows a kept one, or another document's
        heads, tails = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
        if len(gone):
            heads[0], heads[1:] = gone[0], gone[1:] & ~gone[:-1]
            tails[-1], tails[:-1] = gone[-1], gone[:-1] & ~gone[1:]
            firsts = words.of[:-1][words.of[:-1] < words.of[1:]]
            lasts = words.of[1:][words.of[:-1] < words.of[1:]] - 1
            heads[firsts], tails[lasts] = gone[firsts], gone[lasts]
        head, tail = np.flatnonzero(heads), np.flatnonzero(tails)
        base = words.of[np.searchsorted(words.of, head, "right") - 1] if len(head) else head
        spans = pa.StructArray.from_arrays([pa.array(head - base, pa.int64()), pa.array(tail + 1 - base, pa.int64())], names=["first", "end"])
        columns = {"row": table["row"], "text": table["text"]}
        columns["n_words"] = pa.array(np.diff(words.of), pa.int64())
        columns["n_removed"] = pa.array(removed, pa.int64())
        columns["removed"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(head, words.of), pa.int32()), spans)
        columns["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(columns)

    added = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in ADDED.items()))
    schema = T.StructType([given.schema["row"], given.schema["text"], *added.fields])
    done = count_shared(chunked, blocks, keys_of, finish, schema)
    kept = [F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in others(docs, ADDED)]
    return done.select(*kept, *ADDED)
