"""Mixing sources to target weights, in DataFrame functions only.

Tokens are aggregated per source, targets follow the weights under a cap on repetition, and every document is taken
floor(rate) times plus once more when a coin seeded by its hash falls below the fraction of its source's rate. Of a
list of seeds each source uses the one whose coins bring its taken words nearest to its target, which matters for
sources of few documents.

Defined cases: a null or empty text has size 0 and is taken 0 words (its copies follow its source's rate); a source
without words has target 0 and rate 0; a null source is a source of its own and comes last; rows with equal id
and text throw the same coin, so they are taken alike; an empty table gives an empty result; extra columns of any name
are kept, and the columns that the operator adds carry the names in ``ADDED`` and replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.columns import as_row, quoted, row_columns
from siftstone.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
#: A table of targets with at most so many sources is broadcast; beyond it, documents and targets are shuffled.
MAX_BROADCAST_SOURCES = 10_000
#: Seeds that each source may choose from.
SEEDS = tuple(range(17, 49))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source with ``source_size``, ``target`` and ``rate``; ``sized`` has ``source`` and ``size``.

    Sources in code-point order (null last) weigh ``weights``, repeating. The targets share ``share`` times all sizes
    by weight; a target stops at ``cap`` times its source's size and the excess is shared anew by weight, which ends
    where target = min(weight * level, cap * size) with one level for all. That level is found in closed form: with
    the sources ordered by the level at which each stops, it is the first level that its own source doesn't cut off.
    The windows run over the aggregated sources, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    stops_at = Window.orderBy("_stop", "_rank")
    before = stops_at.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_stop", F.col("_cap") / F.col("_weight"))
        .withColumn("_goal", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_goal") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_first", F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "_rank", F.col("_level").alias("level"))))
        .withColumn("_level", F.min("_first").over(everything)["level"])
    )
    target = F.least("_cap", F.coalesce(F.col("_weight") * F.col("_level"), F.col("_cap")))
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _coin(seed: Column) -> Column:
    """A number from 0 to 1 by the row's hash and a seed."""
    return F.pmod(F.xxhash64(seed.cast("long"), F.col("hash")), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fraction() -> Column:
    return F.col("rate") - F.floor("rate")


def chosen_seeds(sized: DataFrame, targets: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """``targets`` with the ``seed`` by whose coins each source's taken words come nearest to its target.

    Every seed's extra words are summed in one pass over (source, size, hash); the first of equally near seeds is taken.
    """
    extra = [F.sum(F.when(_coin(F.lit(s)) < _fraction(), F.col("size")).otherwise(0)).alias(f"e{k}") for k, s in enumerate(seeds)]
    tried = _with_targets(sized, targets).groupBy("source").agg(*extra)
    joined = targets.join(tried.withColumnRenamed("source", "tried"), F.col("source").eqNullSafe(F.col("tried")), "left")
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.coalesce(f"e{k}", F.lit(0)) - F.col("target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k"), F.lit(s).cast("long").alias("seed")) for k, s in enumerate(seeds)]))
    return joined.select("source", "source_size", "target", "rate", best["seed"].alias("seed"))


def _with_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with their source's target, rate (and seed); targets are broadcast when they are few."""
    few = targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    own = targets.withColumnRenamed("source", "own")
    return sized.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("own")), "left").drop("own")


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seeds: Sequence[int] = SEEDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns in ``ADDED``: how often each document is taken, and how many words that gives.

    Sizes and hashes are written once to the shared folder; targets and seeds are found from them.
    """
    spark = docs.sparkSession
    # the coin is seeded by the id and the text, so that rows without id throw coins of their own
    own = {"source": F.col("source").cast("string"), "size": word_count(F.col("text").cast("string")), "hash": F.xxhash64(quoted(key), F.col("text").cast("string"))}
    columns = [c.alias(n) for n, c in own.items()]
    path = scratch_path(spark, "sizes")
    docs.select(*columns).write.parquet(path)
    sized = spark.read.schema("source string, size long, hash long").parquet(path)
    targets = source_targets(sized, weights, share, cap).checkpoint()
    targets = chosen_seeds(sized, targets, seeds).checkpoint()
    rows = docs.select(as_row(docs, ADDED).alias("row"), *columns)
    copies = F.floor("rate") + (_coin(F.col("seed")) < _fraction()).cast("long")
    planned = _with_targets(rows, targets).withColumn("copies", copies)
    return planned.select(*row_columns(docs, ADDED), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; the columns stay as they are."""
    key = options.get("key", "doc_id")
    used = [docs[c].alias(n) for n, c in (("source", "source"), ("text", "text"), ("key", key))]
    packed = docs.select(as_row(docs, ["text"]).alias("row"), *used)
    planned = plan(packed, **{**options, "key": "key"})
    repeated = planned.select("row", "text", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy"))
    return repeated.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
