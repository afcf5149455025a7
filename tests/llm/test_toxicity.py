"""The toxicity grammar, what it learns, and its scores."""

import math
import os
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.llm import toxic_grammar as g
from siftstone.llm import toxicity
from siftstone.llm.queries import QUERIES

ENTRIES = {"idiot\x00": 5.0, "fool\x00": 3.0, "moron": 4.0}
#: Clean sentences whose words begin like insults.
INNOCENT = ["We discuss train travel and trade traditions in this district.", "Das Wort und die Antwort: ein Wortschatz.", "El idioma es distinto en cada distrito.", "The closing pattern of the path was a studio portrait.", "Morgen lesen wir den Pfad der Idee."]


def by_cascade(text, entries):
    """Clause scores by running each transducer over what the one before wrote, and multiplying the factors."""
    lexicon = g.Lexicon(entries)
    tokens = g.TOKEN.findall(text.lower())
    symbols, factors = [g.SYMBOLS[lexicon[t]] for t in tokens], [1.0] * len(tokens)
    for machine in g.CASCADE:
        read = machine.read(symbols)
        symbols, factors = [s for s, _ in read], [f * x for f, (_, x) in zip(factors, read, strict=True)]
    out, last = [0.0], 0.0
    for t, s, f in zip(tokens, symbols, factors, strict=True):
        if s in (g.INSULT, g.AIMED):
            last = lexicon.weight(t) * f
        out[-1] += {g.INSULT: last, g.AIMED: last, g.LATE: last * (g.LATE_BY - 1), g.HARM: g.THREAT_WEIGHT * f}.get(s, 0.0)
        if s in (g.END, g.LINE):
            out.append(0.0)
    return [x for x in out if x]


SOME = st.sampled_from([w for words in g.WORDS.values() for w in words[:4]] + ["idiot", "fool", "moronic", "word", "other"])


@settings(max_examples=300, deadline=None)
@given(st.lists(SOME, max_size=25))
def test_composition_equals_the_cascade(words):
    text = " ".join(words)
    found, tokens = GRAMMAR.clauses(text)
    assert [c.score for c in found] == pytest.approx(by_cascade(text, ENTRIES)) and tokens == len(g.TOKEN.findall(text.lower()))


GRAMMAR = g.Grammar(ENTRIES)


def one(text):
    return sum(c.score for c in GRAMMAR.clauses(text)[0])


def test_insults_and_targets():
    assert one("such an idiot") == 5.0 and one("MORONIC plan") == 4.0 and one("a foolish idiotic plan") == 0 and one("") == 0
    assert one("you are an idiot") > one("idiot, you") > one("such an idiot") and one("they are. an idiot") == 5.0
    assert one("one idiot\ntwo idiot") == 10.0 and len(GRAMMAR.clauses("one idiot\ntwo idiot. x")[0]) == 2


def test_negation_has_a_scope():
    aimed = one("you are an idiot")
    assert one("you are not an idiot") == pytest.approx(aimed * g.NEGATED_BY)
    for text in ("not that it matters you are an idiot", "no, you are an idiot", "you are nothing but an idiot", "not now. you are an idiot", "you never know what to do with it, you are an idiot"):
        assert one(text) >= 5.0


def test_reported_speech_has_a_scope():
    aimed = one("you are an idiot")
    assert one("she said that you are an idiot") == one('he wrote: "you are an idiot"') == pytest.approx(aimed * g.QUOTED_BY)
    assert one('he wrote: "fine. you are an idiot"') == pytest.approx(aimed * g.QUOTED_BY)
    assert one('he wrote: "fine" to you, an idiot') > 5.0 - 1e-9 and one("she said that it rains. you are an idiot") == aimed
    assert one("I say you are an idiot") == aimed and one('he wrote: "never closed\nyou are an idiot') == aimed
    assert one("she said you are not an idiot") == pytest.approx(aimed * g.QUOTED_BY * g.NEGATED_BY)


def test_threats_have_an_order():
    assert one("i will kill you") > one("kill you") > 0 and one("you kill will i") == one("to kill time") == one("you kill time") == 0
    assert one("you will be killed") > 0 and one("killed will you be") == 0
    assert one("i will not kill you") == pytest.approx(one("i will kill you") * g.NEGATED_BY)


def test_order_matters():
    rng, words = random.Random(2), "she said that you are not an idiot but i will kill you".split()
    assert len({round(one(" ".join(rng.sample(words, len(words)))), 6) for _ in range(40)}) > 5


# learning


def toxic_corpus(n=600, seed=5):
    rng = random.Random(seed)
    stems, plain = ["vrilk", "zondu"], [f"{a}{b}" for a in ("the", "ona", "rit", "lum", "sev", "kam") for b in ("", "en", "or", "ist", "al", "um")]
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        bad = k % 6 == 0
        if bad:
            for _ in range(max(2, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(["Moronic", "blarghead", rng.choice(stems) + rng.choice(plain)])
        rows.append((k, ". ".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))))
        labels.append((k, int(bad)))
    return rows, labels


def brute_entries(texts):
    """What ``learn_entries`` gives, from (text, toxic) pairs."""
    n = [sum(1 for _, y in texts if y == k) for k in (0, 1)]
    words = {}
    for text, y in texts:
        for w in set(g.WORD.findall((text or "").lower())):
            words.setdefault(w, [0, 0])[y] += 1
    tried = math.log(max(2, sum(sum(c) >= toxicity.LEAST_TEXTS for c in words.values())))

    def proven(c, t):
        odds = math.log(max(t - math.sqrt(t), 0.5) / n[1]) - math.log((c + math.sqrt(c) + 0.5) / n[0])
        part = lambda k, p: k * math.log(k / ((t + c) * p)) if k else 0.0
        ratio = part(t, n[1] / sum(n)) + part(c, n[0] / sum(n)) if t + c else 0.0
        return odds if t >= toxicity.LEAST_TEXTS and odds >= toxicity.LEAST_ODDS and ratio >= tried + 2.0 else None

    out = {w + g.STOP: proven(*c) for w, c in words.items()}
    for stem in {w[:k] for w in words for k in range(toxicity.STEM_CHARACTERS, len(w) + 1)}:
        parts = {}
        for w, (c, t) in words.items():
            if w.startswith(stem):
                p = parts.setdefault((w + g.STOP)[len(stem)], [0, 0, 0])
                parts[(w + g.STOP)[len(stem)]] = [p[0] + t, p[1] + c, p[2] + (t > 0)]
        top = max(parts.values())
        t, c, many = (sum(p[k] for p in parts.values()) - top[k] for k in range(3))
        out[stem] = proven(c, t) if many >= toxicity.STEM_WORDS else None
    return {k: v for k, v in out.items() if v is not None}


def test_learned_entries_against_brute_force(spark, docs):
    rows, labels = toxic_corpus()
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    entries = toxicity.learn_entries(toxicity.sample(d, lab))
    expected = brute_entries([(t, y) for (_, t), (_, y) in zip(rows, labels, strict=True)])
    assert entries.keys() == expected.keys() and all(entries[k] == pytest.approx(v) for k, v in expected.items())
    assert {"blarghead\x00", "vrilk", "zondu"} <= entries.keys() and not any("blarghead".startswith(k) for k in entries)


def test_toxicity_learns_words_and_stems(spark, docs):
    rows, labels = toxic_corpus()
    d, held = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("kept"), "clauses": F.lit(9), "row": F.lit("r"), "SCORE_": F.lit(1)}), {k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (999_999, 1)], "doc_id long, toxic int")
    assert {r.doc_id for r in d.where(toxicity.is_held_out()).collect()} == held
    model = toxicity.train(d, lab.where(~toxicity.is_held_out()))
    trie = g.Trie(model.entries)
    assert trie.weight("blarghead") > 2 and trie.weight("vrilkanything") > 2 and trie.weight("theor") == 0 and trie.weight("blargh") == 0
    scored = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    right = [scored[k].predicted == y for k, y in labels if k in held]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in scored.values())
    # a score is the fitted function of the clauses that the cascade gives
    for k, text in rows[:60]:
        found = by_cascade(text, model.entries)
        x = [1.0, math.log1p(sum(found)), max(found, default=0.0) / 5.0, math.log1p(sum(c.hits for c in g.Grammar(model.entries).clauses(text)[0]))]
        assert scored[k].score == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.coefficients, strict=True)))), rel=1e-6)
    clean = toxicity.drop_toxic(d, lab)
    assert clean.columns == d.columns and dict(clean.dtypes) == dict(d.dtypes)
    assert abs(clean.count() - sum(1 - y for _, y in labels)) < 15


def test_toxicity_of_awkward_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for lab in (labels, spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, toxic int"), spark.createDataFrame([(3, 1), (7, 0), (8, 0)], "doc_id long, toxic int")):
        model = toxicity.train(docs, lab)
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.train(no_docs, labels).entries == {}


def test_the_sample_is_bounded(spark, docs):
    many = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    assert toxicity.sample(many, labels, 50).count() == 50
    assert Counter(r.toxic for r in toxicity.sample(many, labels, 5000).collect()) == {1: 3000}


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_toxicity_on_labelled_documents(spark, scale):
    d = f"/root/testdata/{scale}"
    if not os.path.isdir(d):
        pytest.skip("no labelled documents")
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = QUERIES["op7_toxicity"](spark, d).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    y, s = got.toxic.to_numpy(), got.score.to_numpy()
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93 and (got.predicted & y).sum() / y.sum() >= 0.9 and (got.predicted & y).sum() / got.predicted.sum() >= 0.9
    model = toxicity.train(documents, labels.where(~toxicity.is_held_out()))
    said = {"insult": "You are an idiot.", "denied": "You are not an idiot.", "reported": "He said that you are an idiot."}
    rows = [(t, "") for t in INNOCENT] + [(t, k) for k, t in said.items()]
    scores = {r.doc_id or r.text: r.score for r in toxicity.score(spark.createDataFrame(rows, "text string, doc_id string"), model).collect()}
    assert all(scores[t] < 0.3 for t in INNOCENT) and scores["denied"] < 0.3 and scores["reported"] < 0.3 and scores["insult"] >= 0.3
