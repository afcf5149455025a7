"""Weighted finite-state transducers over the words of a text, and their composition.

A lexicon turns each word and mark into one symbol. Four transducers then read the symbols in turn, each what the one
before wrote: negation weakens insults and threat verbs within its scope, reported speech weakens what is quoted or
told of others, threats are verbs (or fates)
that meet "you" in the right order, and targets, of second or third person, aim insults. The fifth,
the insults, is the lexicon's trie of learned words and stems. An arc carries a factor, and composition multiplies the
factors, so that a clause's score is the sum over its matches of the insult's weight times the factors on its arc.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable
from functools import cache
from typing import NamedTuple

# Symbols: other, insult, threat verb, what befalls someone, second and third person, negation, end of a negation's
# scope, reporting verb, complementizer, first person, modal, quotation mark, soft break, end of clause, of paragraph.
OTHER, INSULT, THREAT, FATE, YOU, THEY, NEGATION, BREAK, REPORT, THAT, SELF, MODAL, QUOTE, SOFT, END, LINE = "o I K Y U T N B R W F M Q S C E".split()
SYMBOLS = (OTHER, INSULT, THREAT, FATE, YOU, THEY, NEGATION, BREAK, REPORT, THAT, SELF, MODAL, QUOTE, SOFT, END, LINE)
#: A threat verb under negation, in reported speech, and both.
WEAKENED = {(False, False): THREAT, (True, False): "Kn", (False, True): "Kq", (True, True): "Knq"}
MARKED = {v: k for k, v in WEAKENED.items()}
#: Written by the last transducers: an aimed insult, a target that aims the insult before it, a threat that is complete.
AIMED, LATE, HARM = "A", "Z", "X"

# Fixed word lists of the closed classes, in English, German, French and Spanish.
WORDS = {
    THREAT: "kill murder hurt beat smash destroy burn shoot stab hang strangle töten umbringen schlagen vernichten erschießen verbrennen tuer tuerai frapper détruire brûler matar mataré golpear destruir quemar".split(),
    FATE: "dead killed murdered beaten suffer sterben tot getötet mourir mort morir muerto".split(),
    YOU: "you your yours yourself u ur du dich dir dein deine deinen euch tu te toi vous votre vos usted ustedes ti tus vosotros".split(),
    THEY: "they them their he him she her ihr ihn ihm ihnen il elle ils elles él ella ellos ellas".split(),
    NEGATION: "not no never nor neither without hardly nobody nothing isn't aren't ain't wasn't weren't don't doesn't didn't cannot can't won't wouldn't nicht kein keine keinen keiner nie niemals ohne pas jamais aucun aucune sans nunca jamás tampoco sin ni".split(),
    BREAK: "but only except however just sondern aber nur außer mais seulement sauf pero sino solo sólo".split(),
    REPORT: "said says say saying told tells claimed claims reported reports quoted quotes wrote writes called calls sagte sagt schrieb nannte behauptet dit disait affirme écrit appelé dijo dice afirma escribió llamó".split(),
    THAT: "that dass daß que qu'il qu'elle".split(),
    SELF: "i we ich wir je nous yo nosotros".split(),
    MODAL: "will gonna going shall should must deserve deserves i'll we'll werde wirst wird sollst soll vais vas va devrais voy vas debe deberías".split(),
    QUOTE: "\" “ ” „ « »".split(),
    SOFT: ", : –".split(),
    END: ". ! ? ; …".split(),
    LINE: ["\n"],
}
#: Tokens that a negation reaches, that a reporting verb waits for a quotation, that lie between a verb and its object,
#: that a modal or target lies before a verb, and between a target and an insult.
NEGATION_SCOPE, REPORT_WAIT, OBJECT_WITHIN, BEFORE_VERB, AIM_WITHIN, LATE_WITHIN = 4, 3, 2, 3, 4, 2
#: Factors of the arcs: under negation, in reported speech, aimed by what precedes or follows, with a modal before.
NEGATED_BY, QUOTED_BY, AIMED_BY, LATE_BY, INTENDED_BY = 0.15, 0.15, 1.25, 1.1, 1.5
#: Weight of a complete threat, in the log-odds of insults.
THREAT_WEIGHT = 5.0
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«».!?;…,:–\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Ends a word in a trie.
STOP = "\x00"

Step = Callable[[tuple, str], tuple[tuple, str, float]]


class Transducer(NamedTuple):
    """Arcs (state, symbol read) to (state, symbol written, factor); every state has an arc for each symbol it can read."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, str, float]]

    def read(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, written, factor = self.arcs[state, s]
            out.append((written, factor))
        return out


def machine(start: tuple, alphabet: Iterable[str], step: Step) -> Transducer:
    """The transducer of a rule, with all states that can be reached."""
    arcs, todo, alphabet = {}, [start], tuple(alphabet)
    seen = {start}
    while todo:
        state = todo.pop()
        for s in alphabet:
            arcs[state, s] = step(state, s)
            if arcs[state, s][0] not in seen:
                seen.add(arcs[state, s][0])
                todo.append(arcs[state, s][0])
    return Transducer(start, arcs)


def written(t: Transducer) -> set[str]:
    return {out for _, out, _ in t.arcs.values()}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and writes what ``second`` makes of it; factors multiply."""
    alphabet = {s for _, s in first.arcs}

    def step(state: tuple, symbol: str) -> tuple[tuple, str, float]:
        a, between, x = first.arcs[state[0], symbol]
        b, out, y = second.arcs[state[1], between]
        return (a, b), out, x * y

    return machine((first.start, second.start), alphabet, step)


def _negation(state: tuple, s: str) -> tuple[tuple, str, float]:
    (left,) = state
    if s == NEGATION:
        return (NEGATION_SCOPE,), s, 1.0
    if s in (BREAK, THAT, SOFT, QUOTE, END, LINE):
        return (0,), s, 1.0
    out = WEAKENED[True, False] if s == THREAT and left else s
    return (max(0, left - 1),), out, NEGATED_BY if left and s in (INSULT, FATE) else 1.0


def _reported(state: tuple, s: str) -> tuple[tuple, str, float]:
    """States: (mode, tokens that the reporting verb still waits); a quotation ends at its mark, a told clause at its end."""
    mode, left = state
    if s == LINE:
        return ("none", 0), s, 1.0
    weak = mode in ("quoted", "told", "armed")
    out = WEAKENED[MARKED[s][0], True] if weak and s in MARKED else s
    factor = QUOTED_BY if weak and s in (INSULT, FATE) else 1.0
    if mode in ("quoted", "plain"):
        return (("none", 0) if s == QUOTE else state), out, factor
    if mode == "told":
        return (("none", 0) if s in (END, BREAK) else ("quoted", 0) if s == QUOTE else state), out, factor
    if mode == "armed":
        if s == QUOTE:
            return ("quoted", 0), out, factor
        if s in (THAT, YOU, THEY):
            return ("told", 0), out, factor
        if s in (END, BREAK) or left == 1:
            return ("none", 0), out, factor
        return ("armed", REPORT_WAIT if s == SOFT else left - 1), out, factor
    if s == REPORT:
        return (("none", 0) if mode == "self" else ("armed", REPORT_WAIT)), out, factor
    return (("plain", 0) if s == QUOTE else ("self", 0) if s == SELF else ("none", 0)), out, factor


def _threat(state: tuple, s: str) -> tuple[tuple, str, float]:
    """States: tokens since a modal and a target may still count, and the verb that waits for its object."""
    modal, target, verb, strength, left = state
    lapse = (max(0, modal - 1), max(0, target - 1), *((verb, strength, left - 1) if left > 1 else ("", 1.0, 0)))
    if s in (END, LINE, SOFT):
        return (0, 0, "", 1.0, 0), s, 1.0
    if s == MODAL:
        return (BEFORE_VERB, *lapse[1:]), s, 1.0
    if s in MARKED:
        return (0, lapse[1], s, INTENDED_BY if modal else 1.0, OBJECT_WITHIN + 1), OTHER, 1.0
    if s == YOU:
        if verb:
            negated, quoted = MARKED[verb]
            return (0, BEFORE_VERB, "", 1.0, 0), HARM, strength * (NEGATED_BY if negated else 1.0) * (QUOTED_BY if quoted else 1.0)
        return (lapse[0], BEFORE_VERB, *lapse[2:]), s, 1.0
    if s == FATE:
        return ((0, 0, "", 1.0, 0), HARM, 1.0) if modal and target else (lapse, OTHER, 1.0)
    return lapse, s, 1.0


def _target(state: tuple, s: str) -> tuple[tuple, str, float]:
    """States: tokens for which a target still aims, and for which an insult waits for one after it."""
    target, late = state
    if s in (END, LINE):
        return (0, 0), s, 1.0
    if s == INSULT:
        return ((target, 0), AIMED, AIMED_BY) if target else ((0, LATE_WITHIN), s, 1.0)
    if s in (YOU, THEY, HARM):
        return (AIM_WITHIN, 0), LATE if s != HARM and late else s, 1.0
    return (max(0, target - 1), max(0, late - 1)), s, 1.0


NEGATIONS = machine((0,), SYMBOLS, _negation)
REPORTS = machine(("none", 0), written(NEGATIONS), _reported)
THREATS = machine((0, 0, "", 1.0, 0), written(REPORTS), _threat)
TARGETS = machine((0, 0), written(THREATS), _target)
CASCADE = (NEGATIONS, REPORTS, THREATS, TARGETS)


def grammar() -> Transducer:
    out = CASCADE[0]
    for t in CASCADE[1:]:
        out = compose(out, t)
    return out


class Trie:
    """The insult transducer: reads a word's characters and writes the weight of the most certain entry on its path.

    An entry is a whole word (with ``STOP`` at its end) or a stem; 0 if there is none.
    """

    def __init__(self, entries: dict[str, float]):
        self.states: list[dict[str, int]] = [{}]
        self.outputs = [0.0]
        for entry, weight in entries.items():
            at = 0
            for c in entry:
                if c not in self.states[at]:
                    self.states[at][c] = len(self.states)
                    self.states.append({})
                    self.outputs.append(0.0)
                at = self.states[at][c]
            self.outputs[at] = max(weight, self.outputs[at])

    def weight(self, word: str) -> float:
        at, best = 0, 0.0
        for c in f"{word}{STOP}":
            at = self.states[at].get(c, -1)
            if at < 0:
                break
            best = max(best, self.outputs[at])
        return best


class Lexicon(dict):
    """Symbol (by its place in ``SYMBOLS``) of each token; ``weights`` has those of the insults met so far."""

    HELD = 200_000

    def __init__(self, entries: dict[str, float]):
        self.trie, self.weights = Trie(entries), {}
        self.closed = {w: SYMBOLS.index(s) for s, words in reversed(WORDS.items()) for w in words}

    def __missing__(self, token: str) -> int:
        if len(self) > self.HELD:
            self.clear()
            self.weights.clear()
        symbol = self.closed.get(token.replace("’", "'"), 0)
        if not symbol and (weight := self.trie.weight(token)):
            symbol, self.weights[token] = SYMBOLS.index(INSULT), weight
        self[token] = symbol
        return symbol

    def weight(self, token: str) -> float:
        found = self.weights.get(token)
        return self.trie.weight(token) if found is None else found


@cache
def _table() -> list[list[tuple[int, str, float]]]:
    """Rows by state of the composed transducer, columns by symbol: the next state, what is written, the factor."""
    composed = grammar()
    number = {composed.start: 0}
    for state, _ in composed.arcs:
        number.setdefault(state, len(number))
    table = [[(0, OTHER, 1.0)] * len(SYMBOLS) for _ in number]
    for (state, s), (after, out, factor) in composed.arcs.items():
        table[number[state]][SYMBOLS.index(s)] = (number[after], out, factor)
    return table


class Clause(NamedTuple):
    """A matched clause's score, and how many insults and threats it has."""

    score: float
    hits: int


class Grammar:
    """The composed transducer as a table of numbers, over the symbols of a lexicon."""

    def __init__(self, entries: dict[str, float]):
        self.lexicon = Lexicon(entries)
        self.table = _table()
        self.matters = {SYMBOLS.index(s) for s in (INSULT, THREAT, FATE)}

    def clauses(self, text: str) -> tuple[list[Clause], int]:
        """Matched clauses of a text, and the number of its tokens."""
        tokens = TOKEN.findall(text.lower())
        symbols = list(map(self.lexicon.__getitem__, tokens))
        if self.matters.isdisjoint(symbols):
            return [], len(tokens)
        out: list[Clause] = []
        state, score, hits, last = 0, 0.0, 0, 0.0
        for token, symbol in zip(tokens, symbols, strict=True):
            state, event, factor = self.table[state][symbol]
            if event in (INSULT, AIMED):
                last = self.lexicon.weight(token) * factor
                score, hits = score + last, hits + 1
            elif event == LATE:
                score += last * (LATE_BY - 1.0)
            elif event == HARM:
                score, hits = score + THREAT_WEIGHT * factor, hits + 1
            elif event in (END, LINE) and hits:
                out.append(Clause(score, hits))
                score, hits = 0.0, 0
        if hits:
            out.append(Clause(score, hits))
        return out, len(tokens)
