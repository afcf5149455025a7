"""SimHash fingerprints and search within a Hamming radius, in DataFrame functions only.

Every word occurrence votes with its weight on each bit of the fingerprint: for it where the word's hash has a 1,
against it where it has a 0. Longer words, which are rarer, weigh more. The vote is a grouped sum of which two bits
share one 64-bit counter, so that a text is counted in as many sums as half its bits.

Fingerprints within a Hamming radius r are found by permuted block tables: the bits are dealt into blocks, and of more
than r blocks at least one is the same in both, so each table sorts (joins) the fingerprints by another block. Equal
fingerprints are one row of the tables, however many texts have them.

Defined cases: a null or empty text, or one of white space, has no votes and the fingerprint of all zeros; equal texts
have equal fingerprints whatever their id; ties in a vote leave the bit 0; repeated rows stay rows of their own; an
empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Bits of a fingerprint, in words of 64.
WORDS = 2
BITS = 64 * WORDS
#: Weight of a word by its length: 1 up to SHORT characters, then STEP for each further one up to LONG.
SHORT, LONG, STEP = 3, 16, 4
#: About so many documents make a run of neighbouring ids; more when there would be over MAX_RUNS of them.
RUN = 500
MAX_RUNS = 200_000
#: Ids that are drawn for each run; the more, the more even the runs.
DRAWN = 8
#: Bits in which fingerprints of a search differ at most.
RADIUS = 3


def weight(word: Column) -> Column:
    return F.greatest(F.lit(1), STEP * (F.least(F.length(word), F.lit(LONG)) - SHORT))


def votes(terms: DataFrame, keys: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, the numbers ``carried`` (one value for each of ``keys``), and ``fp0``, ``fp1``, ...: 64 bits each.

    ``terms`` has a row for each occurrence of a ``term``; a null term stands for none.
    """
    hashes = [F.xxhash64(F.lit(17 + w), F.col("term")).alias(f"_h{w}") for w in range(WORDS)]
    hashed = terms.select(*keys, *carried, F.when(F.col("term").isNull(), 0).otherwise(weight(F.col("term"))).cast("long").alias("_w"), *hashes)
    # bits b and b + 32 of a word share a counter: the lower in its lower half, the upper in its upper half
    mask = (1 << 32) | 1
    sums = [F.sum(F.col("_w") * F.shiftrightunsigned(f"_h{w}", b).bitwiseAND(F.lit(mask))).alias(f"_c{w}_{b}") for w in range(WORDS) for b in range(32)]
    counted = hashed.groupBy(*keys).agg(F.sum("_w").alias("_all"), *[F.max(c).alias(c) for c in carried], *sums)

    def bit(w: int, b: int) -> Column:
        counter = F.col(f"_c{w}_{b % 32}")
        ones = F.shiftrightunsigned(counter, 32) if b >= 32 else counter.bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(2 * ones > F.col("_all"), F.lit(1)).otherwise(F.lit(0))

    # sixteen bits at a time, so that generated code stays small
    parts = counted.select(*keys, *carried, *[_number([bit(w, 16 * q + b) for b in range(16)]).alias(f"_q{w}_{q}") for w in range(WORDS) for q in range(4)])
    words = [F.col(f"_q{w}_0").bitwiseOR(F.shiftleft(f"_q{w}_1", 16)).bitwiseOR(F.shiftleft(f"_q{w}_2", 32)).bitwiseOR(F.shiftleft(f"_q{w}_3", 48)).alias(f"fp{w}") for w in range(WORDS)]
    return parts.select(*keys, *carried, *words)


def _number(bits: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for b, x in enumerate(bits):
        out = out + x * F.lit(1 << b)
    return out


def terms_of(text: Column) -> Column:
    """Generates the words of a text, split at white space; null where it has none, so that the text keeps a row."""
    return F.explode_outer(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp``, an array of 64-bit words, for each value of ``keys``, which tell the texts apart."""
    return votes(docs.select(*keys, terms_of(F.col(text)).alias("term")), keys).select(*keys, F.array(*[F.col(f"fp{w}") for w in range(WORDS)]).alias("fp"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.element_at(fp, w + 1)), 16, "0") for w in range(WORDS)]))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    out = F.lit(0)
    for w in range(WORDS):
        out = out + F.bit_count(F.element_at(a, w + 1).bitwiseXOR(F.element_at(b, w + 1)))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - distance(a, b) / F.lit(float(BITS))


def _blocks(fp: Column, radius: int) -> Column:
    """Structs (table, block): radius + 1 blocks of neighbouring bits, each a key of the table of its number."""
    n = radius + 1
    borders = [BITS * k // n for k in range(n + 1)]
    out = []
    for k, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
        parts = []
        for w in range(WORDS):
            lo, hi = max(a, 64 * w), min(b, 64 * (w + 1))
            if lo < hi:
                bits = (1 << (hi - lo)) - 1
                bits = bits - (1 << 64) if bits >> 63 else bits
                parts.append(F.shiftrightunsigned(F.element_at(fp, w + 1), lo - 64 * w).bitwiseAND(F.lit(bits)))
        out.append(F.struct(F.lit(k).alias("table"), F.array(*(parts + [F.lit(0).cast("long")] * (WORDS - len(parts)))).alias("block")))
    return F.array(*out)


def within(queries: DataFrame, all_fps: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp, distance): every distinct fingerprint of ``all_fps`` within ``radius`` bits of each distinct query.

    Both tables have ``fp``. A pair that agrees in several blocks is kept in the first of them only.
    """
    q = queries.select(F.col("fp").alias("query")).distinct().withColumn("_b", F.explode(_blocks(F.col("query"), radius))).select("query", "_b.table", "_b.block")
    a = all_fps.select("fp").distinct().withColumn("_b", F.explode(_blocks(F.col("fp"), radius))).select("fp", "_b.table", "_b.block")
    met = q.join(a, ["table", "block"]).withColumn("distance", distance(F.col("query"), F.col("fp"))).where(F.col("distance") <= radius)
    first = F.array_min(F.transform(F.filter(F.arrays_zip(_blocks(F.col("query"), radius).alias("q"), _blocks(F.col("fp"), radius).alias("f")), lambda x: x["q"] == x["f"]), lambda x: x["q"]["table"]))
    return met.where(F.col("table") == first).select("query", "fp", "distance")


def with_near(prints: DataFrame, is_query: Column, radius: int = RADIUS) -> DataFrame:
    """``prints`` (with ``fp``) and ``near_fps``: how many other fingerprints are within ``radius`` bits, for the queries.

    The search is by block tables, for the rows that ``is_query`` names against all; other rows have null.
    """
    asked = prints.where(is_query)
    near = within(asked, prints, radius).groupBy(F.col("query").alias("asked")).agg((F.count("*") - 1).alias("near_fps"))
    rest = prints.where(~F.coalesce(is_query, F.lit(False))).withColumn("near_fps", F.lit(None).cast("long"))
    return asked.join(near, F.col("fp") == F.col("asked")).drop("asked").unionByName(rest)


KEY = "struct<given: boolean, id: bigint, hash: bigint>"


def order_key() -> Column:
    """What documents are ordered by: the id (none is the lowest), and rows of one id by the hash of their text."""
    return F.struct(F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))


def run_cuts(keys: DataFrame, run: int = RUN) -> list[Row]:
    """Keys at which the runs of ``keys`` (key) are cut, about one for ``run`` rows: of keys drawn by their hash every
    DRAWN-th. The list comes to the driver and is bounded by MAX_RUNS * DRAWN."""
    share = max(1, max(run, keys.count() // MAX_RUNS) // DRAWN)
    drawn = keys.where(F.pmod(F.xxhash64(F.lit(29), "key"), F.lit(share)) == 0).distinct().orderBy("key")
    return [r.key for r in drawn.collect()][DRAWN - 1 :: DRAWN]


def cut_table(cuts: list[Row]) -> Column:
    return F.from_json(F.lit(json.dumps([c.asDict() for c in cuts])), f"array<{KEY}>")


def below(cuts: list[Row], key: Column) -> Column:
    """How many of the sorted cuts are below ``key``, bit by bit from the highest."""
    table = cut_table(cuts)
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    fits = lambda k: F.coalesce(F.get(table, k - 1) < key, F.lit(False))
    return F.aggregate(bits, F.lit(0), lambda held, bit: F.when(fits(held + bit), held + bit).otherwise(held))


def with_next(docs: DataFrame) -> DataFrame:
    """(run, place, doc_id, text, next_text, own): each document with the text of the next one by descending id.

    After the last comes the first. The documents are cut into runs at some of their keys; the document at a cut goes to
    both runs (``own`` false in the one that it only ends), so neighbours are found within runs and texts are shuffled
    once. Null ids are the last; documents of equal id follow each other by the hash of their text.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = d.select(order_key().alias("key"))
    top = keys.agg(F.max("key")).first()[0]
    cuts = sorted(set(run_cuts(keys)) - {top})
    d = d.withColumn("key", order_key())
    # run k holds the keys above cut k - 1, up to cut k
    d = d.withColumn("at", below(cuts, F.col("key")) if cuts else F.lit(0))
    on_cut = F.coalesce(F.get(cut_table(cuts), F.col("at")) == F.col("key"), F.lit(False)) if cuts else F.lit(False)
    is_top = F.col("key") == F.struct(*[F.lit(v).cast(t).alias(n) for (n, v), t in zip(top.asDict().items(), ("boolean", "long", "long"), strict=True)]) if top else F.lit(False)
    home = lambda run, own, turn: F.struct(run.alias("run"), F.lit(own).alias("own"), F.lit(turn).alias("turn"))
    # a document on a cut is next to the lowest key of the run above it; the highest key is next to the very last document
    homes = [home(F.col("at"), True, 0), F.when(on_cut, home(F.col("at") + 1, False, 1)), F.when(is_top, home(F.lit(0), False, 2))]
    placed = d.withColumn("home", F.explode(F.array_compact(F.array(*homes)))).select("doc_id", "key", "text", "home.*")
    w = Window.partitionBy("run").orderBy("turn", F.col("key").desc())
    following = F.lead(F.coalesce("text", F.lit(""))).over(w)
    return placed.withColumn("place", F.row_number().over(w)).withColumn("next_text", following).drop("turn", "key")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by as many of the next text's first (or all of it)."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring(following, F.lit(1), F.floor(n / 2).cast("int")))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint (``fp``, and in hexadecimal), its edited text's, and its likeness to that and to the
    next document's.

    One shuffle deals texts to runs; words, votes and neighbours then stay within a run's partition.
    """
    d = with_next(docs)
    text, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    own = F.col("own").cast("int").alias("own")
    d = d.select("run", "place", own, "doc_id", F.length(text).cast("long").alias("n_chars"), text.alias("text"), edited_text(text, following).alias("edited"))
    # the digest travels as four numbers, which a hash aggregate can hold
    digest = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"_s{k}") for k in range(4)]
    carried = ("own", "doc_id", "n_chars", *[f"_s{k}" for k in range(4)])
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    texts = d.select("run", "place", "own", "doc_id", "n_chars", *quarters, kinds.alias("_k"))
    terms = texts.select("run", "place", F.col("_k.kind").alias("kind"), *carried, terms_of(F.col("_k.t")).alias("term"))
    prints = votes(terms, ["run", "place", "kind"], carried)
    of = lambda kind: [F.max(F.when(F.col("kind") == kind, F.col(f"fp{w}"))).alias(f"_{kind}_{w}") for w in range(WORDS)]
    both = prints.groupBy("run", "place").agg(*[F.max(c).alias(c) for c in carried], *of(0), *of(1))
    array = lambda kind: F.array(*[F.col(f"_{kind}_{w}") for w in range(WORDS)])
    after = Window.partitionBy("run").orderBy("place")
    both = both.withColumn("fp", array(0)).withColumn("edited_fp", array(1)).withColumn("next_fp", F.lead("fp").over(after)).where("own = 1")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"_s{k}"), 16, "0") for k in range(4)]))
    return both.select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "fp")
