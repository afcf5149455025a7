"""Brute-force versions that the operators are held against, and documents with every awkward case."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))


def awkward():
    """(doc_id, text, lang, source, n_chars): nulls in any column, empty and very long texts, ties, repeated rows."""
    rows = [
        (0, None, "en", "a", None), (1, "", None, "a", 0), (2, " \t\n\r\x0b\x0c ", "en", None, 7), (3, "one", "en", "b", 3), (4, "One", "en", "b", 3),
        (5, LONG, "en", "b", None), (6, LONG + " tail", "en", "b", 0), (7, "é x ß 漢字 👍", "de", "c", 9), (8, "one two three four five", "en", "c", 1),
        (9, "ONE two\nthree  four five", "en", "c", 1), (10, f"start {PASSAGE} end", "en", "a", 1), (11, f"{PASSAGE} other {PASSAGE}", "fr", "a", 1), (12, "x" * 70_000, "en", "d", 1),
        (13, "x" * 70_000 + " y", "en", "d", 1), (None, "no id here but words enough to shingle", "en", "e", 1), (15, "no id here but words enough to shingle", "en", "e", 1),
        (16, "a\x1cb a\x85b a b " * 20, "en", "e", 1), (17, "the same words " * 400, "en", "a", 1),
    ]
    return rows + [rows[8], rows[10], rows[0]]


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def jaccard_groups(docs):
    """{doc_id: (n_shingles, component)} by comparing all pairs; ids must be there."""
    sets, u = {i: shingles(t) for i, t in docs}, Union()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        u.find(a)
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def without_repeats(texts, k=35):
    """(words, removed, kept words) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def levels(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess until no source is above its cap; sizes by source, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = goal - sum(full.values())
        target = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if target[s] > cap * sizes[s]]
        if not over:
            return {**full, **target}
        full.update({s: cap * sizes[s] for s in over})


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
