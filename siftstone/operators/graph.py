"""Adjacency lists and path entries from edge and entity tables, and walks over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.ranking import with_position
from siftstone.session import shared_dir

#: A list holds at most so many edges; further ones are in further parts of the same entity.
PART = 65_535


def _part(what: Column, part: int) -> Column:
    """Part of a list of ``_n`` items (null where they fit one) that an item goes to: half full on average."""
    return F.pmod(F.xxhash64(what), F.coalesce(F.ceil(F.col("_n") / (part / 2)), F.lit(1)))


def _ends(edges: DataFrame) -> DataFrame:
    """(entity_id, out, edge): each edge at both of its ends."""
    leaving = edges.select(F.col("src").alias("entity_id"), F.lit(True).alias("out"), F.struct(F.col("dst").alias("entity_id"), "rel_kind").alias("edge"))
    return leaving.union(edges.select("dst", F.lit(False), F.struct(F.col("src").alias("entity_id"), "rel_kind")))


def adjacency(edges: DataFrame, part: int = PART) -> DataFrame:
    """(entity_id, part, outgoing, incoming) from edges (src, dst, rel_kind); lists are sorted.

    Edges of an entity are dealt to parts by hash when they are more than ``part``, so no list grows with the data.
    """
    ends = _ends(edges)
    sizes = ends.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    dealt = ends.join(sizes, "entity_id", "left").withColumn("part", _part(F.struct("edge", "out"), part))
    side = lambda out: F.array_sort(F.collect_list(F.when(F.col("out") == out, F.col("edge"))))
    return dealt.groupBy("entity_id", "part").agg(side(True).alias("outgoing"), side(False).alias("incoming"))


def degrees(edges: DataFrame) -> DataFrame:
    """``edge_count`` of the lists that ``adjacency`` would give, counted without building them."""
    return _ends(edges).groupBy("entity_id").agg(F.count("*").alias("edges"), F.count_if(F.col("out")).alias("out_degree"), F.count_if(~F.col("out")).alias("in_degree"))


def edge_count(lists: DataFrame) -> DataFrame:
    """(entity_id, edges, out_degree, in_degree)."""
    out, into = F.size("outgoing"), F.size("incoming")
    counts = {"edges": out + into, "out_degree": out, "in_degree": into}
    return lists.groupBy("entity_id").agg(*[F.sum(c).cast("long").alias(n) for n, c in counts.items()])


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, dst, rel_kind) for the edges that leave the entities in ``seeds`` (entity_id)."""
    return edges.join(seeds.select(F.col("entity_id").alias("src")).distinct(), "src", "left_semi")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(entity_id, hop): entities within ``hops`` edges of the seeds, with the least number of edges. Each hop is a checkpoint."""
    shared_dir(edges.sparkSession)
    reached = seeds.select("entity_id").distinct().withColumn("hop", F.lit(0))
    edge = front = None
    for hop in range(1, hops + 1):
        edge = edge or edges.select("src", "dst")
        front = (reached if front is None else front).select(F.col("entity_id").alias("src"))
        found = edge.join(front, "src").select(F.col("dst").alias("entity_id")).distinct()
        front = found.join(reached, "entity_id", "left_anti").checkpoint()
        reached = reached.union(front.withColumn("hop", F.lit(hop)))
    return reached


def path_entries(entities: DataFrame, part: int = PART) -> DataFrame:
    """(path, part, entries) from rows (path, entity_id, kind); entries of a path are sorted, null ids last.

    A part holds at most ``part`` entries, so no list grows with its folder; the parts of a path follow each other, so
    that one after the other they are its whole sorted list (see ``whole_lists``).
    """
    absent = F.col("entity_id").isNull().alias("absent")
    ordered = with_position(entities.select("path", absent, "entity_id", "kind"), "path", "absent", "entity_id", "kind")
    firsts = ordered.groupBy(F.col("path").alias("of")).agg(F.min("position").alias("first"))
    dealt = ordered.join(firsts, F.col("path").eqNullSafe(F.col("of"))).withColumn("part", F.floor((F.col("position") - F.col("first")) / part))
    placed = F.array_sort(F.collect_list(F.struct("position", F.struct("entity_id", "kind").alias("entry"))))
    return dealt.groupBy("path", "part").agg(F.transform(placed, lambda x: x["entry"]).alias("entries"))


def whole_lists(parts: DataFrame, what: str) -> DataFrame:
    """(path, ``what``): the lists in column ``what`` of a path's parts, joined in order to one list for each path."""
    placed = F.array_sort(F.collect_list(F.struct("part", F.col(what).alias("list"))))
    return parts.groupBy("path").agg(F.flatten(F.transform(placed, lambda x: x["list"])).alias(what))
