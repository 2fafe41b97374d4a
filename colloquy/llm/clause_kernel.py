"""Weighted finite-state clause grammar for toxicity, and the kernels that learn and apply it.

The lexicon is a transducer from tokens to tags, with an arc for every tag that a token can
have. Transducers for negation, reported speech, targets and threats rewrite the tags in turn
and a last one names events; all are composed into one machine, whose arcs are made as they
are needed. The best path through it is sought token by token, with the best weight for each
state, so a clause costs time in proportion to its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

#: A word, where a form of n't stays whole, or a comma.
_TOKEN = re.compile(r"[^\W_]*n['’]t(?![^\W_])|[^\W_]+|,")
_CLAUSE = re.compile(r"[^.!?;\n]+")

#: Closed-class words that start a context, in the four languages of the texts.
WORDS = {
    "threat": frozenset("kill hurt destroy beat punish burn smash töten verletzen schlagen zerstören tuer frapper détruire matar golpear destruir".split()),
    "target": frozenset("you your yours he she they them him her us we du dich dir ihr euch sie er tu toi vous ils elles il elle tú usted ustedes ellos ellas él ella".split()),
    "negation": frozenset("not no never nor neither cannot nicht kein keine nie niemals pas jamais aucun ni nunca jamás ningún".split()),
    "report": frozenset("said says say wrote writes claimed reported quoted called sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split()),
}

#: Shortest and longest stems that the insult lexicon may hold; a longer word may enter whole.
STEM = (4, 8)

#: What an event of each kind is worth before any label is seen, and how many labelled documents that counts for.
_PLAIN, _MODIFIED = {"insult": 0.9, "target+insult": 0.95, "threat": 0.75}, {"": 1.0, "negated ": 0.45, "reported ": 0.55, "reported negated ": 0.3}
PRIOR = {m + k: round(w * v, 3) for k, w in _PLAIN.items() for m, v in _MODIFIED.items()}
PRIOR_WEIGHT = 2.0

#: Tokens that each context reaches over: after a negation, a report, a target or a threat word, and from an insult on to a target.
REACH = {"negation": 5, "report": 6, "target": 4, "threat": 4, "ahead": 2}

#: Tags of tokens: insult, threat word, target, negation, report, comma, any other word.
TAGS = {"insult": "I", "threat": "H", "target": "T", "negation": "N", "report": "Q"}
COMMA, OTHER = ",", "o"


class Transducer:
    """A letter-to-letter transducer: step(state, symbol) gives (symbol written, next state) for each arc; a path may end in states where ends(state) holds."""

    start: object = 0

    def step(self, state, symbol: str):
        raise NotImplementedError

    def ends(self, state) -> bool:
        return True


class Scope(Transducer):
    """Marks insults and threat words within reach of an opener; the state is how far it still reaches. A comma may end it, and is no token of its reach."""

    def __init__(self, opener: str, mark: str, reach: int, comma_ends: bool = False):
        self.opener, self.mark, self.reach, self.comma_ends = opener, mark, reach, comma_ends

    def step(self, state: int, symbol: str):
        if symbol == self.opener:
            yield symbol, self.reach
        elif symbol == COMMA:
            yield symbol, 0 if self.comma_ends else state
        else:
            yield symbol + self.mark if state and symbol[0] in "IH" else symbol, max(0, state - 1)


class Target(Transducer):
    """Marks insults near a target. Before a target it must guess: such a path ends only once the target has come.

    The state is how far the last target reaches, and how far ahead one must come (0: none).
    """

    start = (0, 0)

    def step(self, state: tuple[int, int], symbol: str):
        behind, ahead = state
        if symbol == COMMA:
            yield symbol, state
            return
        if symbol == "T":
            yield symbol, (REACH["target"], 0)
            return
        if ahead == 1:  # the guess was wrong
            return
        left = (max(0, behind - 1), max(0, ahead - 1))
        if symbol[0] != "I":
            yield symbol, left
        elif behind or ahead:
            yield symbol + "@", left
        else:
            yield symbol, left
            yield symbol + "@", (0, REACH["ahead"])

    def ends(self, state) -> bool:
        return not state[1]


class Threat(Transducer):
    """Takes a threat word for a threat (X) if a target or an insult comes within reach, and else for any other word; it must guess which."""

    def step(self, state: int, symbol: str):
        if symbol == COMMA:
            yield symbol, state
        elif symbol[0] in "TI":
            yield symbol, 0
        elif state == 1:  # the guess was wrong
            return
        elif symbol[0] == "H":
            yield OTHER, max(0, state - 1)
            if not state:
                yield "X" + symbol[1:], REACH["threat"]
        else:
            yield symbol, max(0, state - 1)

    def ends(self, state) -> bool:
        return not state


class Events(Transducer):
    """Writes the kind of each insult and threat, and nothing for other symbols."""

    def step(self, state, symbol: str):
        if symbol[0] not in "IX":
            yield "", state
            return
        plain = "threat" if symbol[0] == "X" else "target+insult" if "@" in symbol else "insult"
        yield ("reported " if '"' in symbol else "") + ("negated " if "-" in symbol else "") + plain, state


class Composed(Transducer):
    """first, and second on what it writes; arcs are made when they are first needed and then kept."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.start = first, second, (first.start, second.start)
        self.known: dict = {}

    def step(self, state, symbol: str):
        if (arcs := self.known.get((state, symbol))) is None:
            a, b = state
            arcs = [(out, (x, y)) for mid, x in self.first.step(a, symbol) for out, y in self.second.step(b, mid)]
            self.known[state, symbol] = arcs
        return arcs

    def ends(self, state) -> bool:
        return self.first.ends(state[0]) and self.second.ends(state[1])


def grammar() -> Transducer:
    """Negation, reported speech, targets and threats, composed into one transducer from tags to kinds of events."""
    return reduce(Composed, [Scope("N", "-", REACH["negation"], comma_ends=True), Scope("Q", '"', REACH["report"]), Target(), Threat(), Events()])


def cost(kind: str, weight: float, weights: dict[str, float]) -> float:
    """Log of the chance that an event is harmless."""
    return math.log1p(-min(weights[kind] * weight, 1 - 1e-9))


def best_path(machine: Transducer, readings, weights: dict[str, float]) -> list[tuple[str, float]]:
    """(kind, weight) of the events on the path of least cost; readings are the (tag, weight) arcs of each token.

    For each state only the best path to it is kept, so a clause takes time in proportion to
    its tokens. Of paths that cost the same the one found first stays.
    """
    now = {machine.start: (0.0, None)}
    for arcs in readings:
        following: dict = {}
        for state, (so_far, events) in now.items():
            for tag, weight in arcs:
                for kind, to in machine.step(state, tag):
                    total = so_far + (cost(kind, weight, weights) if kind else 0.0)
                    if to not in following or total < following[to][0]:
                        following[to] = (total, (events, kind, weight) if kind else events)
        now = following
    done = [x for state, x in now.items() if machine.ends(state)]
    _, events = min(done, key=lambda x: x[0])
    found = []
    while events:
        events, kind, weight = events
        found.append((kind, weight))
    return found[::-1]


def stems(token: str):
    """The lexicon entries that a token can match: its stems, and itself with an end mark."""
    yield token + "$"
    for n in range(STEM[0], min(len(token), STEM[1] + 1)):
        yield token[:n]


def features(text: str | None) -> set[str]:
    return {s for t in set(_TOKEN.findall((text or "").lower())) if t != COMMA for s in stems(t)}


class Tagger:
    def __init__(self, lexicon: dict[str, float]):
        self.whole = {s[:-1]: w for s, w in lexicon.items() if s.endswith("$")}
        self.stem = {s: w for s, w in lexicon.items() if not s.endswith("$")}
        self.lengths = sorted({len(s) for s in self.stem})
        self.machine = grammar()

    def insult(self, token: str) -> float:
        """Weight of the insult arc for this token; 0 where there is none."""
        best = self.whole.get(token, 0.0)
        for n in self.lengths:
            if n < len(token):
                best = max(best, self.stem.get(token[:n], 0.0))
        return best

    def readings(self, token: str) -> list[tuple[str, float]]:
        """The lexicon transducer's arcs for a token: every tag that it can have, with a weight; any word can be just a word unless it is an insult."""
        if token == COMMA:
            return [(COMMA, 1.0)]
        weight = self.insult(token)
        found = [("I", weight)] if weight else []
        found += [(TAGS[k], 1.0) for k, own in WORDS.items() if token in own or k == "negation" and token.endswith(("n't", "n’t"))]
        return found or [(OTHER, 1.0)]

    def clauses(self, text: str | None, weights: dict[str, float]):
        """(kind, weight) of every event in the best reading of each clause."""
        lowered = (text or "").lower()
        tokens = set(_TOKEN.findall(lowered))
        arcs = {t: own for t in tokens if (own := self.readings(t))[0][0] != OTHER}
        telling = {t for t, own in arcs.items() if any(tag in "IH" for tag, _ in own)}
        if not telling:
            return
        plain = [(OTHER, 1.0)]
        for m in _CLAUSE.finditer(lowered):
            words = _TOKEN.findall(m[0])
            if not telling.isdisjoint(words):
                yield from best_path(self.machine, [arcs.get(w, plain) for w in words], weights)


def count_features(rows, wanted: frozenset | None = None):
    """(feature, toxic documents, other documents) over labelled rows (text, toxic), summed within the partition."""
    yes, no = Counter(), Counter()
    for text, toxic in rows:
        found = features(text)
        (yes if toxic else no).update(found if wanted is None else found & wanted)
    for f in yes.keys() | no.keys():
        yield f, yes[f], no[f]


def count_clauses(rows, lexicon: dict[str, float]):
    """(kind, toxic documents, other documents); kind 'none' for texts without an event."""
    tagger, yes, no = Tagger(lexicon), Counter(), Counter()
    for text, toxic in rows:
        kinds = {k for k, _ in tagger.clauses(text, PRIOR)} or {"none"}
        (yes if toxic else no).update(kinds)
    for k in yes.keys() | no.keys():
        yield k, yes[k], no[k]


def score(text: str | None, tagger: Tagger, weights: dict[str, float], shift: float = 0.0) -> tuple[float, int]:
    """(score, events): noisy-or over the events of all clauses, starting from the rate of texts without any, then shifted on the logit scale."""
    log_miss, n = math.log1p(-weights["none"]), 0
    for kind, weight in tagger.clauses(text, weights):
        log_miss += cost(kind, weight, weights)
        n += 1
    log_hit = math.log(max(-math.expm1(log_miss), 1e-300))
    return 1 / (1 + math.exp(min(700.0, log_miss - log_hit - shift))), n


def score_rows(rows, lexicon: dict[str, float], weights: dict[str, float], shift: float = 0.0):
    """From (text, columns to pass on): these, the score and the number of events."""
    tagger = Tagger(lexicon)
    for text, *own in rows:
        yield *own, *score(text, tagger, weights, shift)
