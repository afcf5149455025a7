"""N-gram Jaccard join: which documents share enough of their word shingles, and the groups that this makes.

The product of the document-by-shingle incidence matrix with its transpose is taken in blocks of shingles, and only where
a pair can still reach the bound. (1) All shingles are counted over all documents, block by block; a document can have a
partner only when the shingles that other documents have too make up the least overlap that its size allows, which
leaves out most documents. (2) Equal shingle sets form a class, and one set stands for it, named by its signature; what
only its own members have can't link it, which leaves out most classes. (3) A representative's row of the matrix begins
with its rarest shared shingles; as many as any partner must meet (its prefix) are posted, with its size and what is
left of it from there. (4) The columns are dealt by shingle. Under each, pairs whose sizes and places allow a link add
one to their overlap; the sums over all columns, with what is left of both rows, bound each pair's overlap from above,
and pairs below the size-derived bound are discarded. (5) The other columns of the rows of what is left are multiplied
pair by pair, which gives the exact overlap.

A shingle of thousands of near copies would make pairs without end. So pairs come in two steps: first each
representative with the most typical one under each of its shingles, which joins near copies to groups; then, exactly,
all pairs under a shingle that belong to different groups. Pairs within a group can't change it and are never made. A
column with many rows is cut into square cells of ``CELL`` rows a side, so that no task takes a whole hot shingle.

Shingles are compared by 64-bit hashes. Defined cases: a text without words (null, empty, white space) has no
shingles and links with nothing; one with fewer words than a shingle is one shingle; repeated rows are documents of
their own that link; a null id takes part, and its component is the smallest id of its group, if there is one; an empty
table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.columns import as_row, row_columns
from siftstone.llm.components import connected_components
from siftstone.llm.exchange import Keys, count_shared, dealt
from siftstone.llm.kernels import Words, mix
from siftstone.session import scratch_path

SHINGLE = 5
#: Link when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Documents with a shingle are counted up to here in a set.
MANY = 0xFFFF
#: Rows of a shingle's column that meet in one task of the second step.
CELL = 1024


def needed(n: np.ndarray | int, share: tuple[int, int]) -> np.ndarray | int:
    """The least overlap that a set of n shingles needs with any partner: ceil(share * n)."""
    return -(-n * share[0] // share[1])


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE, hashed: bool = False) -> DataFrame:
    """(doc_id, n, s1, s2, grams, counts) per document; all but the first two only where a partner is possible.

    With ``hashed`` each row also has ``text_hash``.

    ``s1``, ``s2`` are a signature of the whole set. ``grams`` are the shared shingles, rarest first, as 64-bit
    integers, and ``counts`` how many documents have each, up to ``MANY``, in 16 bits; within a chunk both are given
    once for each signature.
    """
    more = ["text_hash"] if hashed else []
    chunked, blocks = dealt(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(_text_hash().alias(k) for k in more)))

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (shingle, text) pairs, by shingle and text."""
        keys, of = Words(table["text"], lower=True).shingles(shingle)
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        return keys[new], of[new]

    def keys_of(table: pa.Table) -> Keys:
        return Keys(*np.unique(pairs(table)[0], return_counts=True))

    def finish(table: pa.Table, totals: np.ndarray) -> pa.Table:
        keys, of = pairs(table)
        rows = len(table)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        df = totals[np.cumsum(new) - 1] if len(keys) else totals
        n = np.bincount(of, minlength=rows)
        shared = np.bincount(of[df > 1], minlength=rows)
        alive = (n > 0) & (shared >= needed(n, share))
        order = np.argsort(of, kind="stable")
        order = order[alive[of[order]]]
        at = np.concatenate([[0], np.cumsum(np.where(alive, n, 0))])
        salted = (mix(keys[order] ^ np.uint64(salt)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in salted]
        s1, s2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
        held = order[df[order] > 1]
        held = held[np.lexsort((keys[held], df[held], of[held]))]
        many = np.minimum(df[held], MANY).astype("<u2")
        grams, bounds = keys[held].view(np.int64), np.concatenate([[0], np.cumsum(np.where(alive, shared, 0))])
        seen, out, counts = set(), [], []
        for d in range(rows):
            own, span = (int(s1[d]), int(s2[d])), slice(bounds[d], bounds[d + 1])
            first = alive[d] and own not in seen
            out.append(grams[span].tobytes() if first else None)
            counts.append(many[span].tobytes() if first else None)
            if first:
                seen.add(own)
        signed = {"s1": pa.array(s1, mask=~alive), "s2": pa.array(s2, mask=~alive)}
        packed = {"grams": pa.array(out, pa.binary()), "counts": pa.array(counts, pa.binary())}
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(n, pa.int64()), **signed, **packed, **{k: table[k] for k in more}})

    return count_shared(chunked, blocks, keys_of, finish, ", ".join(["doc_id long, n long, s1 long, s2 long, grams binary, counts binary", *(f"{k} long" for k in more)]))


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _partners(given: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(rep, n, grams) of classes (s1, n, members, grams, counts) that can link with another class.

    A shingle that as many documents have as the class has members is the class's own. What is left must still make up
    the least overlap.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, size, out = [], [], []
            for s1, n, members, g, c in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                count = np.frombuffer(c, "<u2")
                left = np.frombuffer(g, np.int64)[(count != members) | (count == MANY)]
                if len(left) >= needed(n, share):
                    rep.append(s1)
                    size.append(n)
                    out.append(left)
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(size, pa.int64()), _lists(out)], names=["rep", "n", "grams"])

    return given.select("s1", "n", "members", "grams", "counts").mapInArrow(run, "rep long, n long, grams array<long>")


def _postings(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(gram, rep, n, left) for the prefix of each set; ``left`` counts its shared shingles from this one on."""
    p, q = share
    lengths, least = F.size("grams"), F.floor((F.lit(p) * F.col("n") + F.lit(q - 1)) / F.lit(q))
    prefix = F.slice("grams", F.lit(1), (lengths - least + 1).cast("int"))
    posted = sets.select("rep", "n", lengths.alias("all"), F.posexplode(prefix).alias("at", "gram"))
    return posted.select("gram", "rep", "n", (F.col("all") - F.col("at")).cast("long").alias("left"))


def _overlap(n: Column, m: Column, share: tuple[int, int]) -> Column:
    """The least overlap with which sets of n and m shingles link: ceil(p * (n + m) / (p + q))."""
    p, q = share
    return F.floor((F.lit(p) * (n + m) + F.lit(p + q - 1)) / F.lit(p + q))


def _bounded(share: tuple[int, int]) -> Column:
    """Whether sizes and positions of a pair (a, b) that meets at a shingle allow a link."""
    p, q = share
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (q * least >= p * most) & (F.least("a.left", "b.left") >= _overlap(F.col("a.n"), F.col("b.n"), share))


def _across(labelled: DataFrame, mixed: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b) pairs of different groups whose overlap may reach the bound, by (gram, rep, n, left, component) rows.

    ``mixed`` has the shingles of several groups and how many rows each has. Rows of a large column go to cells (i, j) of
    blocks of it; a pair is made in the cell of its own blocks. Its overlap in the posted columns is summed.
    """
    blocks = F.ceil(F.col("many") / F.lit(CELL)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rest = labelled.join(mixed, "gram").select("gram", "rep", "n", "left", "component", own.alias("own"), F.explode(cells).alias("cell"))
    rest = rest.select("gram", "cell.i", "cell.j", "own", "rep", "n", "left", "component")
    # the lower group's row stands first; within a cell off the diagonal only rows of different blocks meet
    same_cell = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    other_block = (F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own"))
    met = rest.alias("a").join(rest.alias("b"), same_cell & other_block & (F.col("a.component") < F.col("b.component")) & _bounded(share))
    sums = [F.count("*").alias("met"), F.min(F.least("a.left", "b.left")).alias("left"), F.first("a.n").alias("na"), F.first("b.n").alias("nb")]
    pairs = met.groupBy(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).agg(*sums)
    # of the last column they met in, one is counted already
    return pairs.where(F.col("met") + F.col("left") - 1 >= _overlap(F.col("na"), F.col("nb"), share)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the distinct pairs (a, b) that link: the product of their whole rows, pair by pair and so of bounded size."""
    p, q = share
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("k"))
    return both.where(q * F.col("k") >= p * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")


def _labelled(docs: DataFrame, shingle: int, share: tuple[int, int], least: Column, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of ``shingle_sets``, and (s1, s2, least, component) of each class, where ``least`` aggregates its rows."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shingles")
    shingle_sets(docs, shingle, share, hashed).write.parquet(f"{path}/documents")
    base = spark.read.parquet(f"{path}/documents")
    classes = base.where("s1 is not null").groupBy("s1", "s2").agg(least.alias("least"), F.count("*").alias("members"))
    one = Window.partitionBy("s1", "s2").orderBy("doc_id")
    given = base.where("grams is not null").withColumn("_k", F.row_number().over(one)).where("_k = 1")
    _partners(given.join(classes, ["s1", "s2"]), share).write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")

    posted = _postings(sets, share)
    top = F.min(F.struct(F.col("n") - F.col("left"), F.col("rep"), F.col("n"), F.col("left"))).alias("t")
    typical = posted.groupBy("gram").agg(F.count("*").alias("many"), top).where("many > 1").select("gram", "t.rep", "t.n", "t.left")
    # what aggregates give is written, so that joins read plain shuffles, which adaptive execution can split
    typical.write.parquet(f"{path}/typical")
    typical = spark.read.parquet(f"{path}/typical")
    met = posted.alias("a").join(typical.alias("b"), F.col("a.gram") == F.col("b.gram"))
    near = met.where(F.col("a.rep") != F.col("b.rep")).where(_bounded(share))
    near = near.select(F.least("a.rep", "b.rep").alias("b"), F.greatest("a.rep", "b.rep").alias("a")).distinct()
    _verified(near, sets, share).write.parquet(f"{path}/links_1")
    first = connected_components(spark.read.parquet(f"{path}/links_1"))

    shared = posted.join(typical.select("gram"), "gram", "left_semi")
    shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).write.parquet(f"{path}/labelled")
    labelled = spark.read.parquet(f"{path}/labelled")
    mixed = labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    mixed.select("gram", "many").write.parquet(f"{path}/mixed")
    far = _across(labelled, spark.read.parquet(f"{path}/mixed"), share)
    _verified(far, sets, share).write.parquet(f"{path}/links_2")
    links = spark.read.parquet(f"{path}/links_1", f"{path}/links_2")
    whole = connected_components(links)

    return base, classes.join(whole, F.col("s1") == F.col("node"), "left").select("s1", "s2", "least", F.coalesce("component", "s1").alias("component"))


def groups(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    base, label = _labelled(docs, shingle, share, F.min("doc_id"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    member = label.join(least, "component").select("s1", "s2", "component_id")
    # documents without a possible partner have no signature, and would all meet in one task of a join
    alone = base.where("s1 is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    grouped = base.where("s1 is not null").join(member, ["s1", "s2"])
    return alone.union(grouped.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``docs`` that have no partner, or the smallest id of their group; rows without id stay."""
    gone = groups(docs, shingle, share).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*row_columns(docs))


def keep_one_row(docs: DataFrame, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The rows of ``docs`` that have no partner, and exactly one row of each group.

    It is a row with the group's smallest id (none is the largest), and of those with the smallest hash of the text;
    among rows equal in both, one by a hash of all columns. So repeated rows and copies without id leave one row, and
    rows that share an id are judged each by its own text.
    """
    spark = docs.sparkSession
    base, label = _labelled(docs, shingle, share, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")), hashed=True)
    member = label.join(label.groupBy("component").agg(F.min("least").alias("first")), "component").select("s1", "s2", "first")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    judged = base.where("s1 is not null").join(member, ["s1", "s2"]).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), is_first.alias("stays"))
    path = scratch_path(spark, "judged")
    # rows that go, and those of which one stays
    counted = judged.groupBy("id", "hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    counted.where("not stays or n > 1").drop("n").write.partitionBy("stays").parquet(path)
    found = spark.read.schema("id long, hash long, stays boolean").parquet(path).alias("found")
    marked = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("hash")).alias("marked")
    on = F.col("marked.id").eqNullSafe(F.col("found.id")) & (F.col("marked.hash") == F.col("found.hash"))
    repeated = marked.join(found.where("stays"), on, "left_semi")
    comparable = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = repeated.groupBy("id", "hash").agg(F.min_by("row", F.xxhash64(*comparable)).alias("row")).select("row")
    return marked.join(found, on, "left_anti").select("row").union(one).select(*row_columns(docs))
