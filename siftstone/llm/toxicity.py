"""Toxicity by a weighted finite-state grammar over clauses (``toxic_grammar``).

The grammar composes transducers for insults, threats, targets, negation and reported speech. A document is scored by
its matched clauses alone: by what they add up to, by the strongest of them and by the number of matches.

The insult transducer's entries are log-odds learned from labelled documents, a bounded sample of at most
``max_labelled`` rows (taken by hash of the id). An entry is a whole word, or a stem that many different words
of toxic texts carry, and each is held to a test that allows for the number of words tried. How
clause scores make a probability is fitted on the same rows. Only the text is read for a score.

Defined cases: a null or empty text has no clauses and gets the score of a text without matches; texts of any length
are read whole; repeated rows score alike; null labels and labels of unknown documents are left out of learning; with
no labels of one kind there are no entries and every score is the share of the other kind; an empty table gives an
empty result; extra columns are kept, and ``score``, ``predicted`` and ``clauses`` replace columns of those names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.toxic_grammar import STOP, WORD, Clause, Grammar
from siftstone.session import scratch_path

MAX_LABELLED = 20_000
MAX_BROADCAST_LABELS = 100_000
#: Words that a task counts before it sends what it has.
HELD_WORDS = 60_000
THRESHOLD = 0.3
#: A stem has so many characters at least, and is carried by so many different words of toxic texts.
STEM_CHARACTERS, STEM_WORDS = 3, 6
#: An entry is in so many toxic texts at least, and has such log-odds.
LEAST_TEXTS, LEAST_ODDS = 3, 2.0
FEATURES = 4


def features(found: list[Clause], tokens: int) -> list[float]:
    """What the clauses of a text amount to."""
    total = sum(c.score for c in found)
    return [1.0, math.log1p(total), max((c.score for c in found), default=0.0) / 5.0, math.log1p(sum(c.hits for c in found))]


class Model(NamedTuple):
    """Entries of the insult transducer with their weights, and the coefficients over ``features``."""

    entries: dict[str, float]
    coefficients: list[float]


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): texts of both kinds that have a word; the null word has all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flushed() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            numbers = [pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0)]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *numbers], names=["word", "toxic", "clean"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({None, *WORD.findall((text or "").lower())})
                if len(counts[0]) + len(counts[1]) > HELD_WORDS:  # the sums go on after the shuffle
                    yield flushed()
        yield flushed()

    rows = labelled.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long")
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(t: Column, c: Column, toxic: int, clean: int) -> tuple[Column, Column]:
    """Log-odds of t toxic and c clean texts, their lower end; and the log-likelihood ratio against chance."""
    sure, share = F.greatest(t - F.sqrt(t), F.lit(0.5)), toxic / (toxic + clean)
    odds = F.log(sure / toxic) - F.log((c + F.sqrt(c) + 0.5) / clean)
    n = t + c
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(0.0)
    return odds, part(t, share) + part(c, 1.0 - share)


def learn_entries(labelled: DataFrame) -> dict[str, float]:
    """Words and stems of insults, by log-odds of the texts that have them.

    Every word of the sample is counted. A stem is judged without its commonest continuation: what is left must still
    be many words and prove it. So neither a single word nor a longer stem makes stems of its own beginnings.
    """
    spark = labelled.sparkSession
    path = scratch_path(spark, "words")
    _word_counts(labelled).write.parquet(path)
    counted = spark.read.parquet(path)
    totals = counted.where("word is null").first()
    if totals is None or not totals.toxic or not totals.clean:
        return {}
    words = counted.where("word is not null")
    tried = math.log(max(2, words.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).count()))

    def proven(df: DataFrame) -> DataFrame:
        odds, ratio = _evidence(F.col("t").cast("double"), F.col("c").cast("double"), totals.toxic, totals.clean)
        found = df.where(F.col("t") >= LEAST_TEXTS).withColumns({"odds": odds, "ratio": ratio})
        return found.where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= tried + 2.0)).select("entry", "odds")

    whole = proven(words.select(F.concat("word", F.lit(STOP)).alias("entry"), F.col("toxic").alias("t"), F.col("clean").alias("c")))
    ended = F.concat("word", F.lit(STOP))
    lengths = F.sequence(F.lit(STEM_CHARACTERS), F.length("word"))
    head = lambda k: F.struct(F.substring("word", F.lit(1), k).alias("entry"), F.substring(ended, k + 1, F.lit(1)).alias("next"))
    heads = words.where(F.length("word") >= STEM_CHARACTERS).select("toxic", "clean", F.explode(F.transform(lengths, head)).alias("h"))
    # a word's texts count once each, so the sums over a stem's words are of (word, text) pairs
    by_next = heads.groupBy("h.entry", "h.next").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count_if(F.col("toxic") > 0).alias("words"))
    top = F.max(F.struct("t", "c", "words"))
    rest = by_next.groupBy("entry").agg(*[(F.sum(k) - top[k]).alias(k) for k in ("t", "c", "words")])
    stems = proven(rest.where(F.col("words") >= STEM_WORDS))
    return {r.entry: float(r.odds) for r in whole.union(stems).collect()}


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a small ridge, by Newton steps.

    More or stronger matches never lower a score: a feature whose coefficient would be negative is left out.
    """
    used = list(range(x.shape[1]))
    while True:
        part = x[:, used]
        b, ridge = np.zeros(len(used)), np.full(len(used), 0.05)
        ridge[0] = 1e-6
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(part @ b, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p) + 1e-9)[:, None]).T @ part + np.diag(ridge), part.T @ (y - p) - ridge * b)
            b += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        least = 1 + int(np.argmin(b[1:])) if len(used) > 1 else 0
        if not least or b[least] >= 0:
            break
        del used[least]
    out = np.zeros(x.shape[1])
    out[used] = b
    return out.tolist()


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most ``max_labelled`` rows, whatever ids repeat; copies of a text are one row."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # the sample is bounded by its parameter, so documents needn't be shuffled to meet it
    chosen = F.broadcast(chosen) if max_labelled <= MAX_BROADCAST_LABELS else chosen
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    path = scratch_path(spark, "labelled")
    # as many files as tasks are wanted: reading the texts is the work
    texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    texts = spark.read.schema("text string, toxic int").parquet(path)
    # an id may stand for many rows
    if texts.count() > max_labelled:
        cut = texts.select(F.xxhash64("text").alias("h")).orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
        texts = texts.where(F.xxhash64("text") <= cut)
    return texts


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the rows of ``labels`` (doc_id, toxic) on at most ``max_labelled`` of the documents."""
    labelled = sample(docs, labels, max_labelled)
    entries = learn_entries(labelled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(entries)
        for batch in batches:
            rows = [features(*grammar.clauses(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    table = labelled.mapInArrow(run, "x array<double>, toxic int").toArrow()
    y = table["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model({}, [math.log(share / (1 - share)), *[0.0] * (FEATURES - 1)])
    return Model(entries, _fit(np.array(table["x"].to_pylist()), y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and the number of matched ``clauses``."""
    docs = docs.drop("score", "predicted", "clauses")
    text_at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, b = Grammar(model.entries), np.array(model.coefficients)
        for batch in batches:
            found = [grammar.clauses(t or "") for t in batch.column(text_at).to_pylist()]
            x = np.array([features(*f) for f in found]).reshape(-1, FEATURES)
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
            matched = [len(clauses) for clauses, _ in found]
            added = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(matched, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "score", "predicted", "clauses"])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "score double, predicted int, clauses int"]))


def is_held_out(doc_id: str = "doc_id"):
    """Rows that labels are not learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model, learned from ``labels``, doesn't reject."""
    model = train(docs, labels.where(~is_held_out()))
    # all columns travel as one, so that none can clash with what ``score`` adds
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    return score(rows, model, threshold).where("predicted = 0").select("row.*")
