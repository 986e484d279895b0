"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns a clause's words into tags with weights: an insult ("hit") or threat with its
weight, a target (the person spoken to or about), a negation, a verb of saying, or nothing. Five
transducers read the tags, each an arc table, and pass them on with a factor:

* insult: a hit becomes harm;
* threat: a threat becomes harm, in full if a target stands in the clause, else at ``UNAIMED``;
* target: harm counts ``AIMED`` times if a target stands in the clause, before or after it;
* negation: opens a scope of ``SCOPE`` words in which harm counts for little;
* reported speech: harm counts half in a clause with a verb of saying, wherever that stands.

What stands later in a clause is guessed by the start state and confirmed by the final one, so a clause has
exactly one path. ``compose`` joins the transducers, two by two, to one automaton over tags; the
clause's score is the sum of its words' weights, each by the factor of its arc on that path.

Insults are words, or word beginnings (for languages that inflect and compound). Beside a
fixed seed they are learned from labelled rows: one by one, the word or beginning is taken that
stands in the most toxic texts not explained yet, each clean text counting against it.
Weights are log odds; a logistic regression on the log of the summed clause scores and the text's
length turns them into a probability. Texts without a match get the rate of such texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, short_batches

#: Labelled rows that are learned from at most, toxic and clean ones, chosen by a hash of the id.
SAMPLE = {1: 1000, 0: 2000}
#: Words after a negation that it covers.
SCOPE = 3
#: A learned entry explains so many more toxic texts of the sample at least; a clean text counts against so many.
LEAST_TEXTS, CLEAN_COST = 4, 3.0
#: Letters of the shortest word beginning.
SHORTEST = 4
#: Factors: a threat without a target, harm with one, denied, reported.
UNAIMED, AIMED, DENIED, REPORTED = 0.3, 1.25, 0.25, 0.5
#: Words whose tags a Python worker remembers (it starts anew then), and letters of the longest one.
REMEMBERED, LONGEST = 300_000, 64
#: A text is toxic from this score on.
THRESHOLD = 0.3

# The seed lexicons.
INSULTS = "bastard clown disgusting dumb filth fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash ugly useless vermin worthless".split()
THREATS = "beat burn crush destroy hang hurt kill murder punch shoot smash stab strangle".split()
TARGETS = "he her him she them they u ur you your yourself".split()
NEGATIONS = "aren't isn't neither never no nor not wasn't without".split()
SAYING = "called calls claimed claims quoted quotes said says told wrote writes".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)|\n+")


class Transducer:
    """States are names; ``arcs``: (state, tag) -> [(next state, tag out, factor)]. A path runs from a start to a final state."""

    def __init__(self, starts: set, finals: set, arcs: dict[tuple, list[tuple]]):
        self.starts, self.finals, self.arcs = starts, finals, arcs

    def pruned(self) -> Transducer:
        """Without states that no start reaches or that reach no final state."""
        ahead: dict[object, set] = {}
        back: dict[object, set] = {}
        for (state, _), outs in self.arcs.items():
            for to, _, _ in outs:
                ahead.setdefault(state, set()).add(to)
                back.setdefault(to, set()).add(state)

        def reached(first: set, steps: dict[object, set]) -> set:
            seen, new = set(first), set(first)
            while new:
                new = set().union(*(steps.get(s, set()) for s in new)) - seen
                seen |= new
            return seen

        live = reached(self.starts, ahead) & reached(self.finals, back)
        arcs = {k: kept for k, outs in self.arcs.items() if k[0] in live and (kept := [o for o in outs if o[0] in live])}
        return Transducer(self.starts & live, self.finals & live, arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Reads as ``a``, writes what ``b`` makes of it; states are pairs, factors multiply."""
    by_state: dict[object, list[tuple]] = {}
    for (state, tag), outs in b.arcs.items():
        by_state.setdefault(state, []).append((tag, outs))
    arcs: dict[tuple, list[tuple]] = {}
    for (state, tag), outs in a.arcs.items():
        for other, theirs in by_state.items():
            read = dict(theirs)
            for to, between, x in outs:
                for to_b, out, y in read.get(between, ()):
                    arcs.setdefault(((state, other), tag), []).append(((to, to_b), out, x * y))
    pairs = lambda x, y: {(i, j) for i in x for j in y}
    return Transducer(pairs(a.starts, b.starts), pairs(a.finals, b.finals), arcs).pruned()


#: Tags; harm is what insults and threats become.
HIT, THREAT, WHO, NOT, SAY, OTHER, HARM = TAGS = "hit", "threat", "who", "not", "say", "", "harm"


def _guessing(sign: str, factors: dict[str, tuple[float, float]], out: dict[str, str]) -> Transducer:
    """Without ``sign``: state "none"; with it: "due" until it comes, then "met". ``factors``: tag -> (without, with) it."""
    arcs = {}
    for tag in TAGS:
        without, with_ = factors.get(tag, (1.0, 1.0))
        to = out.get(tag, tag)
        if tag == sign:
            arcs["due", tag] = arcs["met", tag] = [("met", to, with_)]
        else:
            arcs |= {("none", tag): [("none", to, without)], ("due", tag): [("due", to, with_)], ("met", tag): [("met", to, with_)]}
    return Transducer({"none", "due"}, {"none", "met"}, arcs)


def insult_transducer() -> Transducer:
    return Transducer({0}, {0}, {(0, t): [(0, HARM if t == HIT else t, 1.0)] for t in TAGS})


def threat_transducer() -> Transducer:
    return _guessing(WHO, {THREAT: (UNAIMED, 1.0)}, {THREAT: HARM})


def target_transducer() -> Transducer:
    return _guessing(WHO, {HARM: (1.0, AIMED)}, {})


def negation_transducer() -> Transducer:
    """State: words left in the scope."""
    arcs = {}
    for left in range(SCOPE + 1):
        for tag in TAGS:
            arcs[left, tag] = [(SCOPE if tag == NOT else max(0, left - 1), tag, DENIED if left and tag == HARM else 1.0)]
    return Transducer({0}, set(range(SCOPE + 1)), arcs)


def reported_transducer() -> Transducer:
    return _guessing(SAY, {HARM: (1.0, REPORTED)}, {})


def automaton() -> Transducer:
    """All five, composed."""
    out = insult_transducer()
    for t in (threat_transducer(), target_transducer(), negation_transducer(), reported_transducer()):
        out = compose(out, t)
    return out


class Grammar:
    """Lexicon and automaton. Entries of ``insults`` that end in ``*`` are word beginnings."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        self.tags = {w: (SAY, 0.0) for w in SAYING} | {w: (NOT, 0.0) for w in NEGATIONS} | {w: (WHO, 0.0) for w in TARGETS}
        self.tags |= {w: (HIT, x) for w, x in insults.items() if w[-1] != "*"} | {w: (THREAT, x) for w, x in threats.items()}
        self.beginnings = {w[:-1]: (HIT, x) for w, x in insults.items() if w[-1] == "*"}
        self.lengths = sorted({len(w) for w in self.beginnings}, reverse=True)
        self.known: dict[str, tuple[str, float]] = {}
        self.fit = np.array([-4.0, 1.5, 0.0])
        self.plain = 0.02  # score of a text without matches, whatever its length
        whole = automaton()
        number = {s: i for i, s in enumerate(sorted({s for s, _ in whole.arcs}, key=repr))}
        self.starts, self.finals = sorted(number[s] for s in whole.starts), {number[s] for s in whole.finals}
        self.arcs = {(number[s], tag): [(number[to], x) for to, _, x in outs] for (s, tag), outs in whole.arcs.items()}

    def tag(self, w: str) -> tuple[str, float]:
        found = self.known.get(w)
        if found is None:
            found = self.tags.get(w)
            if found is None:
                found = next((self.beginnings[w[:n]] for n in self.lengths if w[:n] in self.beginnings), (OTHER, 0.0))
            if len(w) > LONGEST:
                return found
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[w] = found
        return found

    def clause(self, words: list[str]) -> tuple[float, int]:
        """Score and number of matches of one clause: the sum along the automaton's one path."""
        tags = [self.tag(w) for w in words]
        found = sum(x > 0 for _, x in tags)
        if not found:
            return 0.0, 0
        paths = {s: 0.0 for s in self.starts}
        for tag, weight in tags:
            paths = {to: total + weight * x for s, total in paths.items() for to, x in self.arcs.get((s, tag), ())}
        (total,) = (x for s, x in paths.items() if s in self.finals)
        return total, found

    def matched(self, text: str) -> tuple[float, int, int, int]:
        """Summed clause scores, clauses with matches, matches, and words of a text."""
        low = text.lower()
        words = _WORD.findall(low)
        total, clauses, found = 0.0, 0, 0
        if any(self.tag(w)[1] for w in set(words)):
            for part in _CLAUSE.split(low):
                here, n = self.clause(_WORD.findall(part))
                if n:
                    total, clauses, found = total + here, clauses + 1, found + n
        return total, clauses, found, len(words)

    def probability(self, total: float, words: int) -> float:
        if total <= 0:
            return self.plain
        x = float(self.fit @ (1.0, math.log1p(total), math.log1p(words)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))

    def score(self, text: str) -> tuple[float, int, int]:
        """The text's score, the clauses with matches, and the matches."""
        total, clauses, found, words = self.matched(text)
        return self.probability(total, words), clauses, found


def _beginnings(w: str) -> list[str]:
    return [w, *(w[:n] + "*" for n in range(SHORTEST, len(w)))]


def learn(rows: list[tuple[str, int]]) -> Grammar:
    """A grammar from (text, toxic) rows; the seed lexicon with set weights, if one label has none."""
    toxic = [set(_WORD.findall((t or "").lower())) for t, y in rows if y == 1]
    clean = [set(_WORD.findall((t or "").lower())) for t, y in rows if y == 0]
    insults, threats = {w: 4.0 for w in INSULTS}, {w: 3.0 for w in THREATS}
    if not toxic or not clean:
        return Grammar(insults, threats)
    other = {*TARGETS, *NEGATIONS, *SAYING}
    holders: dict[str, set[int]] = {}
    for i, words in enumerate(toxic):
        for w in words - other:
            for e in _beginnings(w):
                holders.setdefault(e, set()).add(i)
    holders = {e: at for e, at in holders.items() if len(at) >= LEAST_TEXTS or e in insults or e in threats}
    against: dict[str, set[int]] = {e: set() for e in holders}
    for i, words in enumerate(clean):
        for w in words:
            for e in _beginnings(w):
                if e in against:
                    against[e].add(i)

    def odds(e: str) -> float:
        c1, c0 = len(holders.get(e, ())), len(against.get(e, ()))
        return math.log((c1 + 0.5) / (len(toxic) + 1)) - math.log((c0 + 0.5) / (len(clean) + 1))

    for lexicon in (insults, threats):
        for w in lexicon:
            if len(holders.get(w, ())) + len(against.get(w, ())) >= LEAST_TEXTS:
                lexicon[w] = max(0.0, min(6.0, odds(w)))
    open_ = set(range(len(toxic))) - {i for w in insults if insults[w] >= 2 for i in holders.get(w, ())}
    clear = set(range(len(clean)))
    scale = len(toxic) / len(clean)
    while True:
        # Of equal gains, the longer beginning: it says more.
        gain, _, best = max(((len(at & open_) - CLEAN_COST * scale * len(against[e] & clear), len(e), e) for e, at in holders.items()), default=(0, 0, ""))
        if gain < LEAST_TEXTS:
            break
        insults[best] = max(0.5, min(6.0, odds(best)))
        open_ -= holders[best]
        clear -= against[best]
        holders = {e: at for e, at in holders.items() if len(at & open_) >= LEAST_TEXTS}
    grammar = Grammar(insults, threats)
    seen = [(*grammar.matched(t or ""), y) for t, y in rows]
    x = np.array([(1.0, math.log1p(m[0]), math.log1p(m[3])) for m in seen])
    y = np.array([m[4] for m in seen], float)
    fit = np.zeros(3)
    for _ in range(25):  # Newton steps with a small penalty, which keeps separable samples finite
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -40, 40)))
        fit -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (p - y) + 0.05 * fit)
    grammar.fit = fit
    rest = y[x[:, 1] <= 0]
    grammar.plain = (rest.sum() + 0.5) / (len(rest) + 2)
    return grammar


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learns from labelled rows whose crc32(doc_id) modulo 4 is not 2, at most SAMPLE of each label.

    Rows without id, text or label are not learned from.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    marked = marked.filter(remainder(F.col("id"), 4) != 2).distinct().orderBy(F.xxhash64("id"))
    marked = marked.filter("toxic = 1").limit(SAMPLE[1]).unionByName(marked.filter("toxic = 0").limit(SAMPLE[0]))
    rows = docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic").filter("text is not null")
    return learn([(r.text, r.toxic) for r in rows.orderBy("doc_id", "toxic", "text").toLocalIterator()])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            found = [grammar.score(t or "") for t in batch.column(1).to_pylist()]
            score = np.array([f[0] for f in found], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())],
                ["doc_id", "score", "predicted", "clauses", "matches"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses, matches), a row for each row of ``docs`` (doc_id, text).

    Null and empty texts have no matches and get the score of such texts. held_out is false for a null doc_id.
    Repeated rows are scored each. An empty table gives an empty one; without labels the seed lexicon decides.
    """
    spark = docs.sparkSession
    short_batches(spark)
    grammar = spark.sparkContext.broadcast(fit(docs, labels))
    schema = "doc_id long, score double, predicted int, clauses int, matches int"
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(grammar), schema)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", "predicted", "clauses", "matches")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the toxic rows, all columns kept. Decided in the row's own task, so no join is needed.

    Null and empty texts have no match and go only if most such texts of the labelled rows are toxic. Repeated
    rows are decided alike; a null doc_id plays no part. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    grammar = spark.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = grammar.value
        for batch in batches:
            yield batch.filter(pa.array([rules.score(t or "")[0] < THRESHOLD for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
