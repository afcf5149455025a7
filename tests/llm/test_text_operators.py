"""Fingerprints, Jaccard join, mixing, substring dedup, packing."""

import bisect
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import reference as ref
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.llm import exchange, fingerprints, jaccard, kernels, mixing, packing, substring_dedup
from siftstone.llm.components import connected_components
from siftstone.llm.queries import QUERIES, tokenizer_path
from siftstone.session import scratch_path

ADDED = {"size": "string", "target": "long", "rate": "string", "copies": "string", "removed": "long", "n_words": "string", "kept_text": "int", "_row": "string"}
#: Names that operators use inside.
INSIDE = ("_chunk", "_source", "_copy", "_same", "row", "key", "own", "hash", "id", "seed", "block", "chunk", "at", "_at", "_key", "stays", "tried", "copy", "_id", "_hash", "a.b", "gone")


def clashing(df):
    return df.withColumns({k: F.lit("1").cast(t) for k, t in ADDED.items()} | {k: F.lit(k) for k in INSIDE})


# kernels


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \t\n\x0b\x0c\ré漢\x1c\x85", max_size=40), max_size=6), st.integers(1, 4))
def test_words_and_windows(texts, k):
    w = kernels.Words(pa.array(texts, pa.string()))
    assert [w.text(d).split() for d in range(len(texts))] == [[x.encode() for x in ref.words(t)] for t in texts]
    assert np.diff(w.of).tolist() == [len(ref.words(t)) for t in texts]
    hashes, at = w.windows(k)
    flat = [x for t in texts for x in ref.words(t)]
    starts = [w.of[d] + i for d, t in enumerate(texts) for i in range(len(ref.words(t)) - k + 1)]
    assert at.tolist() == starts
    meaning = {}
    for h, s in zip(hashes.tolist(), starts, strict=True):
        assert meaning.setdefault(h, tuple(flat[s : s + k])) == tuple(flat[s : s + k])
    assert len(meaning) == len({tuple(flat[s : s + k]) for s in starts})


def test_hashes_do_not_depend_on_place(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(5000)) + " " + "z" * 500 + " tail"
    whole = kernels.Words(pa.array([text])).windows(7)[0]
    monkeypatch.setattr(kernels, "SPAN", 1000)
    parts = kernels.Words(pa.array(["pad", None, text])).windows(7)[0]
    assert (whole == parts).all()
    sliced = pa.array(["x", text, "y"]).slice(1, 1)
    assert (kernels.Words(sliced).windows(7)[0] == whole).all()


def test_packed_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (kernels.unpack_sorted(kernels.pack_sorted(keys)) == keys).all()
    assert len(kernels.unpack_sorted(kernels.pack_sorted(keys[:0]))) == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, docs, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(50)] + [(7, 7)]
    u = ref.Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {n: u.find(n) for n in u.parent if u.find(n) != n}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# substring dedup


def test_repeats_against_brute_force(spark, docs, small):
    for df in (docs, small):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        expected = Counter((i, *x) for (i, _), x in zip(rows, ref.without_repeats([t for _, t in rows]), strict=True))
        got = substring_dedup.remove_repeats(clashing(df))
        assert set(got.columns) == {*df.columns, *ADDED, *INSIDE, "n_removed"}
        assert {r[0] for r in got.select("`a.b`").distinct().collect()} == {"a.b"}
        assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == expected
        assert got.where("n_removed <> aggregate(removed, 0L, (a, x) -> a + x.end - x.first)").count() == 0
        assert got.where("exists(sequence(2, size(removed)), k -> size(removed) > 1 and element_at(removed, k).first <= element_at(removed, k - 1).end)").count() == 0


def test_keys_that_meet_by_chance_are_told_apart(spark, docs, small, monkeypatch):
    keys = np.array([5, 3, 5, 3, 5], np.uint64)
    order, first = exchange.grouped(keys, np.array([1, 7, 2, 7, 1], np.uint32))
    assert keys[order].tolist() == [3, 3, 5, 5, 5] and first.tolist() == [0, 2, 4] and [a.tolist() for a in exchange.grouped(keys[:0], keys[:0])] == [[], []]
    # a second hash of 32 bits is left where the first has 6
    whole = substring_dedup.wide_windows
    rows = [(r.doc_id, r.text) for r in small.limit(80).collect()]
    expected = Counter((i, *x) for (i, _), x in zip(rows, ref.without_repeats([t for _, t in rows]), strict=True))
    table = pa.table({"text": [t for _, t in rows], "row": [i for i, _ in rows], exchange.CHUNK: pa.array([0] * len(rows), pa.int32())})
    found = {}

    def one_chunk(chunked, blocks, keys_of, finish, schema):
        sent = keys_of(table)
        found["rows"] = finish(table, sent.counts)
        return spark.createDataFrame([], schema)

    def narrow(words, size):
        keys, extra, at = whole(words, size)
        return keys % np.uint64(64), extra, at

    monkeypatch.setattr(substring_dedup, "count_shared", one_chunk)
    monkeypatch.setattr(substring_dedup, "wide_windows", narrow)
    substring_dedup.remove_repeats(small.select("doc_id", "text"))
    r = found["rows"]
    assert Counter(zip(r["row"].to_pylist(), r["n_words"].to_pylist(), r["n_removed"].to_pylist(), r["kept_text"].to_pylist(), strict=True)) == expected


def test_repeats_other_window_and_empty(spark, docs, no_docs):
    rows = [(1, "a b c d e"), (2, "x b c d y"), (3, "b c d"), (4, "q q q q")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert got == {1: (3, "a e"), 2: (3, "x y"), 3: (3, ""), 4: (4, "")}
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_equal_rows_are_spread_over_chunks(spark, docs, small, monkeypatch, doc_id):
    monkeypatch.setattr(exchange, "EQUAL_ROWS", 50)
    text = " ".join(f"r{k}" for k in range(40))
    same = spark.range(600).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    df = same.union(small.select("doc_id", "text").where("doc_id <> 7").limit(60)).repartition(3)
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    chunked, _ = exchange.dealt(df)
    assert chunked.where(F.col("text") == text).select(exchange.CHUNK).distinct().count() > 1
    got = substring_dedup.remove_repeats(df).where(F.col("text") == text).select("n_removed").collect()
    assert len(got) == 600 and {r[0] for r in got} == {40}
    found = jaccard.groups(df).where("n_shingles = 36").collect()
    assert sum(r.component_id == doc_id and r.doc_id == doc_id for r in found) == 600


def test_chunks_and_blocks_keep_their_messages():
    for total in (0, 1, 10**6, 10**9, 30 * 10**9, 10**12, 10**14):
        chunks, blocks = exchange.shape(total, 8)
        assert chunks >= 8 and blocks >= 1
        if total >= 10**9:
            assert total / exchange.BYTES_PER_KEY / chunks / blocks >= 0.9 * exchange.MESSAGE_KEYS


# Jaccard


def variants(rng, base, n, share):
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(int(share * len(w)) or 1):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_brute_force(spark, docs, small, seed, monkeypatch):
    if seed == 2:  # columns of more than a few rows are cut into cells
        monkeypatch.setattr(jaccard, "CELL", 3)
    rng, texts = random.Random(seed), []
    for size in (4, 7, 12, 40, 120):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(base)] * 3
        for share in (0.01, 0.02, 0.03, 0.05):
            texts += variants(rng, base, 25, share)
        texts += [" ".join(base[: size * p // 100]) for p in range(60, 100, 3)]
        texts += [" ".join(base) + " " + " ".join(f"t{rng.randrange(10**9)}" for _ in range(size * p // 100)) for p in range(5, 45, 4)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == ref.jaccard_groups(rows)
    if not seed:
        rows = [(r.doc_id, r.text) for r in small.collect()]
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(small).collect()} == ref.jaccard_groups(rows)


def test_overlaps_are_summed_over_columns(spark, docs, monkeypatch):
    """Pairs of different groups that ``_across`` keeps, against all pairs of posted rows."""
    rng, share = random.Random(9), (75, 100)
    rows = {}
    for rep in range(60):  # rows of three families, rarest shingles first by number
        base = [f * 100 + k for f in (rep % 3,) for k in range(12)]
        rows[rep] = sorted(set(base[: 8 + rep % 5]) | {rng.randrange(300, 330) for _ in range(3)})
    posted = []
    for rep, grams in rows.items():
        n = len(grams)
        for k in range(n - -(-n * 75 // 100) + 1):
            posted.append((grams[k], rep, n, n - k, rep % 7))
    expected = set()
    for a in rows:
        for b in rows:
            if a % 7 < b % 7:
                x, y = ([p for p in posted if p[1] == r] for r in (a, b))
                need = -(-75 * (len(rows[a]) + len(rows[b])) // 175)
                both = [min(p[3], q[3]) for p in x for q in y if p[0] == q[0] and min(p[3], q[3]) >= need]
                sizes = sorted([len(rows[a]), len(rows[b])])
                if both and 4 * sizes[0] >= 3 * sizes[1] and len(both) + min(both) - 1 >= need:
                    expected.add((a, b))
    labelled = spark.createDataFrame(posted, "gram long, rep long, n long, left long, component long")
    mixed = labelled.groupBy("gram").agg(F.count("*").alias("many"), F.count_distinct("component").alias("c")).where("c > 1").select("gram", "many")
    for cell in (1024, 4, 1):
        monkeypatch.setattr(jaccard, "CELL", cell)
        assert {tuple(r) for r in jaccard._across(labelled, mixed, share).collect()} == expected and expected


def test_groups_of_awkward_documents(spark, docs, no_docs):
    got = jaccard.groups(clashing(docs)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    unique = {r[0]: r[1] for r in ref.awkward() if r[0] is not None}
    assert by == ref.jaccard_groups(list(unique.items()))
    assert next((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == (4, 15)
    assert jaccard.groups(no_docs).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert {3, 8, 5} <= set(kept) and not {4, 9, 6} & set(kept) and kept.count(8) == 2
    assert jaccard.keep_one(docs).columns == docs.columns


def test_one_row_of_each_group_is_kept(spark, docs, no_docs):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(1, text(1))] * 3 + [(2, text(1))] * 2  # the smallest id repeats
    rows += [(None, text(2))] * 3 + [(None, text(2).upper())]  # copies without id
    rows += [(5, text(3)), (6, text(3)), (6, text(4))]  # an id of a copy and of a text of its own
    rows += [(None, text(5)), (9, text(5)), (None, None), (None, None), (10, ""), (10, ""), (11, text(6))]
    got = jaccard.keep_one_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    kept = Counter((r.doc_id, r.text and r.text.lower()) for r in got)
    assert kept == Counter([(1, text(1)), (None, text(2)), (5, text(3)), (6, text(4)), (9, text(5)), (None, None), (None, None), (10, ""), (10, ""), (11, text(6))])
    assert jaccard.keep_one_row(no_docs).count() == 0
    # all columns stay, and of awkward rows only repeated ones (of 8 and 10) go besides
    by_id, by_row = (Counter(tuple(r) for r in f(docs).collect()) for f in (jaccard.keep_one, jaccard.keep_one_row))
    assert not by_row - by_id and {r[0]: n for r, n in (by_id - by_row).items()} == {8: 1, 10: 1, None: 1}


# mixing


def test_targets_against_resharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 23):
        sizes = {f"s{k:02d}" if k else None: rng.choice([0, 1, 10, 1000, 50_000]) for k in range(n)}
        sized = spark.createDataFrame([(s, z) for s, z in sizes.items()], "source string, size long")
        got = {r.source: r for r in mixing.source_targets(sized).collect()}
        expected = ref.levels(sizes)
        assert set(got) == set(sizes)
        for s, t in expected.items():
            assert got[s].target == pytest.approx(t, rel=1e-9, abs=1e-6) and got[s].target <= 2 * sizes[s]
            assert got[s].rate == pytest.approx(t / sizes[s] if sizes[s] else 0.0, rel=1e-9)


def test_mix(spark, docs, no_docs, small):
    planned = mixing.plan(clashing(docs)).collect()
    assert len(planned) == docs.count()
    for r in planned:
        assert r.size == len(ref.words(r.text)) and r.taken == r.size * r.copies and r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 2
    again = mixing.plan(small).select("doc_id", "copies", "taken").collect()
    assert sorted(again) == sorted(mixing.plan(small.repartition(7)).select("doc_id", "copies", "taken").collect())
    upper = clashing(docs.withColumnRenamed("text", "Text")).drop("size").withColumn("Size", F.lit("kept"))
    assert {r[0] for r in mixing.mix(upper).select("Size").distinct().collect()} == {"kept"} and mixing.mix(upper).columns == upper.columns
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == clashing(docs).columns and mixed.count() == sum(r.copies for r in planned)
    assert dict(mixed.dtypes) == dict(clashing(docs).dtypes)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_small_sources_come_near_their_targets(spark, docs):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 12).cast("string")).alias("source"), F.repeat(F.lit("w "), (5 + F.col("id") * F.col("id") % 97).cast("int")).alias("text"))
    for r in mixing.plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.03)
    # rows without id throw coins by their texts
    plan = mixing.plan(df.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.col("doc_id").isNull().cast("string"), "source")))
    assert plan.count() == 600


def test_mix_meets_its_targets(spark):
    big = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    for r in mixing.plan(big).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.02)


# fingerprints


def test_edits(spark, docs, no_docs, small):
    for df in (docs, small, small.limit(1)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), r[1]))
        expected, prints = [], {}
        for k, (i, t) in enumerate(rows):
            h = len(t) // 2
            following = rows[(k + 1) % len(rows)][1]
            expected.append((i, len(t), hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()))
        got = fingerprints.compare_edits(clashing(df)).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(expected)
        texts = {}
        for i, t in rows:
            texts.setdefault(i, set()).add(t)
        for r in got:
            if len(texts[r.doc_id]) == 1:
                t = next(iter(texts[r.doc_id]))
                assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            differ = bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1")
            assert r.near_edited == 1 - differ / fingerprints.BITS and 0 <= r.near_next <= 1 and len(r.fingerprint) == 32
    assert fingerprints.compare_edits(no_docs).count() == 0


def test_fingerprint_is_the_weighted_vote(spark, docs):
    text = "alpha beta  beta gamma a a a delta-epsilon-zeta-eta-theta"
    df = spark.createDataFrame([(1, text)], "k long, text string")
    got = [w & (2**64 - 1) for w in fingerprints.fingerprints(df, ["k"]).first().fp]
    words = spark.createDataFrame([(w,) for w in text.split()], "w string").select("w", F.xxhash64(F.lit(17), "w").alias("h0"), F.xxhash64(F.lit(18), "w").alias("h1")).collect()
    for part, name in enumerate(("h0", "h1")):
        for b in range(64):
            vote = sum(max(1, 4 * (min(len(r.w), 16) - 3)) * (1 if r[name] >> b & 1 else -1) for r in words)
            assert (got[part] >> b & 1) == (vote > 0)


def test_edited_texts_are_nearer_than_others(small):
    means = fingerprints.compare_edits(small).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert means[0] > 0.62 and means[1] < 0.56


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_radius_search_against_brute_force(spark, docs, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(40)]
    near = [x ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(radius + 3))) for x in base for _ in range(4)]
    every = base + near + base[:5]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([([signed(x & (2**64 - 1)), signed(x >> 64)],) for x in every], "fp array<long>")
    whole = lambda v: (v[0] & (2**64 - 1)) | (v[1] & (2**64 - 1)) << 64
    got = Counter((whole(r.query), whole(r.fp), r.distance) for r in fingerprints.within(df, df, radius).collect())
    expected = {(a, b, bin(a ^ b).count("1")) for a in every for b in every if bin(a ^ b).count("1") <= radius}
    assert set(got) == expected and set(got.values()) == {1}


def test_near_counts_against_brute_force(spark, docs, sf):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(30)]
    fps = [x ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(6))) for x in base for _ in range(5)] + base
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(k if k != 7 else None, [signed(x & (2**64 - 1)), signed(x >> 64)]) for k, x in enumerate(fps)]
    got = {r.k: r.near_fps for r in fingerprints.with_near(spark.createDataFrame(rows, "k long, fp array<long>"), F.col("k") % 3 == 0).collect()}
    expected = {k: sum(0 < bin(x ^ y).count("1") <= fingerprints.RADIUS for y in set(fps)) if k % 3 == 0 else None for k, x in enumerate(fps) if k != 7}
    assert got == {**expected, None: None} and any(expected.values())
    whole = QUERIES["op2_fingerprints"](spark, sf).collect()
    prints = {int(r.fingerprint, 16) for r in whole}
    for r in whole:
        x = int(r.fingerprint, 16)
        assert r.near_fps == (sum(0 < bin(x ^ y).count("1") <= fingerprints.RADIUS for y in prints) if r.doc_id % 50 == 0 else None)


def test_runs_are_even_and_cuts_are_found(spark):
    whole = lambda k: (k["given"], k["id"], k["hash"])
    for given in (True, False):  # a third of all documents may have no id
        ids = spark.range(20_000).select(F.when(F.lit(given), F.col("id") * 3 - 1000).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
        keys = ids.select(fingerprints.order_key().alias("key"))
        cuts = fingerprints.run_cuts(keys)
        assert list(map(whole, cuts)) == sorted(set(map(whole, cuts))) and 25 <= len(cuts) <= 60
        got = keys.select("key", fingerprints.below(cuts, F.col("key")).alias("n")).collect()
        assert [r.n for r in got] == [bisect.bisect_left(list(map(whole, cuts)), whole(r.key)) for r in got]
        assert max(Counter(r.n for r in got).values()) < 4 * fingerprints.RUN
        for some in (cuts[:1], cuts[:2], cuts[:3]):
            assert Counter(r[0] for r in keys.select(fingerprints.below(some, F.col("key"))).collect()) == Counter(bisect.bisect_left(list(map(whole, some)), whole(r.key)) for r in got)


def test_next_documents_of_many_runs(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 16)
    monkeypatch.setattr(fingerprints.run_cuts, "__defaults__", (16,))
    rows = [(k * 7 if k % 3 else None, f"text {k}") for k in range(600)] + [(7, "another of 7"), (7, "text 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    expected = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = fingerprints.with_next(df).where("own").collect()
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == expected and len({r.run for r in got}) > 20


# packing


def packed(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    return by


def hold(rows, window=1024):
    for pieces in packed(rows).values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing_is_exact(spark, docs, no_docs, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = [(100 + k, t) for k, t in enumerate(["a <|endoftext|> b", "a  b \n\n c\t d ", "don't STOP 12,3", "漢字 и кириллица", " lead", "trail ", "\x1c \x85x", "é ñ"])]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    for df in (frame.repartition(3), small):
        rows = packing.pack(df, tokenizer_path()).collect()
        hold(rows)
        expected = Counter()
        for r in df.collect():
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            expected[(r.doc_id, len(ids))] += 1
        texts = {r.doc_id: r.text for r in df.collect()}
        covered = Counter()
        for r in rows:
            covered[(r.doc_id, r.doc_tokens)] += r.length
            ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
            assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert covered == Counter({k: n * k[1] for k, n in expected.items()})
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 5), st.sampled_from([64, 100, 128]))
def test_packer(sizes, open_windows, window):
    out, held = [], []
    packer = packing.Packer(lambda s: (out.append(s), held.append(len(packer.windows))), window, open_windows)
    for k, n in enumerate(sizes):
        packer.add(packing.Piece(k, 0, memoryview(np.full(n, k, "<u4").tobytes()), n))
    packer.close()
    assert max(held, default=0) <= open_windows
    spans = Counter()
    for s in out:
        size = sum(len(p.ids) // 4 for p in s)
        assert size == window or (size < window and size & (size - 1) == 0)
        for p in s:
            for k in range(p.start, p.start + len(p.ids) // 4):
                spans[(p.doc_id, k)] += 1
    assert spans == Counter((k, j) for k, n in enumerate(sizes) for j in range(n))


@pytest.mark.parametrize("name", ["op2_fingerprints", "op4_ngram_jaccard", "op5_mixing", "op6_substring_dedup", "op9_packing"])
def test_queries_cover_all_documents(spark, sf, small, name):
    df = QUERIES[name](spark, sf)
    assert {r.doc_id for r in df.select("doc_id").collect()} == {r.doc_id for r in small.select("doc_id").collect()}
