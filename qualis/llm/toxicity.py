"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause, each from its own alphabet of word classes: insults, threats,
targets (whom it is said to), negation and reported speech. Their composition is built once, as the product of
their reachable states, and read as one transition table. A clause ends at a sign of punctuation or a new line;
the state reached there says which pattern it matched (say "insult, with a target, not negated, reported"),
and the strongest word met on the way gives the match its weight. Words outside a matched clause count nothing.

What the labels teach: which words and word beginnings insult (log odds over a bounded sample of labelled rows), and
the weight of every clause pattern, by logistic regression on the patterns of each document's clauses. So a negated
or reported insult counts as little as it did among the labelled rows. Labels, language, source and ids are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import per_text, stored
from qualis.llm.labelled import remainder, sample

FIT_ROWS = 12_000  # labelled rows the fit takes at most
MOST_TERMS = 2_000  # learned insult words and beginnings
SUPPORT, ODDS = 5, 4.0  # documents a term must be in, and its least log odds
STEMS = (5, 6, 7, 8)  # lengths of word beginnings that may stand for all their words
SPREAD = 2.0  # a beginning counts if it is in so many times the toxic rows of any one of its words
THRESHOLD, MODULUS, HELD_OUT = 0.3, 4, 2
SEED_WEIGHT = 2.0
MEMO = 300_000

#: Seed words of each class, in the four languages of the corpus.
SEEDS = {
    "insult": "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile fool "
    "dummkopf trottel arschloch idiota estúpido imbécil connard crétin stupide",
    "threat": "kill hurt destroy beat punch stab shoot burn attack töten schlagen matar golpear tuer frapper",
    "target": "you your yours yourself u they them their he she him her du dich dir ihr euch sie tu te toi vous usted ustedes él ella",
    "negation": "not no never nor none without isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás sin sans ohne",
    "reported": "said says say called calls claimed quote quoted reported wrote sagte sagt nannte dijo dice dit disait",
}
OTHER, CLASSES = 0, {name: i + 1 for i, name in enumerate(SEEDS)}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:,\n|\"]+")
NEGATION_REACH = 3  # words a negation governs

#: The component transducers: start state 0, transitions by word class, any other word by the last entry.
COMPONENTS: dict[str, dict[tuple[int, str], int]] = {
    "insult": {(0, "insult"): 1, (1, "insult"): 2, (2, "insult"): 2},
    "threat": {(0, "threat"): 1, (1, "threat"): 1},
    "target": {(0, "target"): 1, (1, "target"): 1},
    "negation": {(s, "negation"): 1 for s in range(NEGATION_REACH + 2)}
    | {(s, c): (s + 1 if s < NEGATION_REACH else 0) for s in range(1, NEGATION_REACH + 1) for c in ("other", "target", "reported")}
    | {(s, c): NEGATION_REACH + 1 for s in range(1, NEGATION_REACH + 1) for c in ("insult", "threat")},
    "reported": {(0, "reported"): 1, (1, "reported"): 1},
}


def compose() -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product automaton: a table (state, class) -> state, and the component states each one stands for."""
    names = ["other", *CLASSES]
    states, table, i = [tuple(0 for _ in COMPONENTS)], [], 0
    number = {states[0]: 0}
    while i < len(states):
        row = []
        for c in names:
            new = tuple(t.get((s, c), s) for s, t in zip(states[i], COMPONENTS.values(), strict=True))
            if new not in number:
                number[new] = len(states)
                states.append(new)
            row.append(number[new])
        table.append(row)
        i += 1
    return np.array(table), states


TABLE, STATES = compose()
STEP = [[int(x) for x in row] for row in TABLE]


def pattern(state: int) -> int | None:
    """The clause pattern of a final state: kind (insult, several, threat, both) x target x negated x reported."""
    insult, threat, target, negation, reported = STATES[state]
    if not insult and not threat:
        return None
    kind = 3 if insult and threat else 2 if threat else insult - 1
    return kind * 8 + target * 4 + (negation == NEGATION_REACH + 1) * 2 + reported


PATTERNS = 4 * 2 * 2 * 2
FINAL = [pattern(s) for s in range(len(STATES))]


@dataclass
class Grammar:
    """``terms``: learned weights (log odds above the least) of words, and of beginnings (written ``abcd*``)."""

    terms: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * PATTERNS))
    bias: float = 0.0
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.seeds = {w: (CLASSES[c], SEED_WEIGHT) for c, words in SEEDS.items() for w in words.split()}

    def word(self, word: str) -> tuple[int, float]:
        """Class and weight of a word."""
        got = self.known.get(word)
        if got is None:
            low = word.lower()
            learned = max([self.terms.get(low, 0.0), *(self.terms.get(low[:n] + "*", 0.0) for n in STEMS if len(low) >= n)])
            got = (CLASSES["insult"], learned) if learned else self.seeds.get(low, (OTHER, 0.0))
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[word] = got
        return got

    def clauses(self, text: str) -> np.ndarray:
        """For every pattern: the log count of clauses that match it, and the largest weight of a match."""
        out = np.zeros(2 * PATTERNS)
        state, most, known = 0, 0.0, self.known
        for token in TOKEN.findall(text):
            if token[0].isalnum():
                kind, weight = known.get(token) or self.word(token)
                state = STEP[state][kind]
                if weight > most and kind <= CLASSES["threat"]:
                    most = weight
            elif state or most:
                if (p := FINAL[state]) is not None:
                    out[p] += 1
                    out[PATTERNS + p] = max(out[PATTERNS + p], most)
                state, most = 0, 0.0
        if (p := FINAL[state]) is not None:
            out[p] += 1
            out[PATTERNS + p] = max(out[PATTERNS + p], most)
        out[:PATTERNS] = np.log1p(out[:PATTERNS])
        return out

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -60, 60))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the intercept is free. A row counts as often as ``times`` says
    (default: once)."""
    times = np.ones(len(y)) if times is None else times
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (times * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (times * (p - y)) + penalty * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learned_terms(taught: DataFrame, most: int = MOST_TERMS) -> dict[str, float]:
    """Words and beginnings by their log odds between toxic and other labelled rows; at most ``most`` rows
    reach the driver. Counted as a grouped aggregation over the sample."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    def stems(n: int) -> Column:
        return F.transform(F.filter("w", lambda x: F.length(x) >= n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))

    rows = taught.select("y", "n", words.alias("w"))
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(total) < 2:
        return {}
    counted = (
        rows.select("y", "n", F.explode(F.array_distinct(F.concat("w", *map(stems, STEMS)))).alias("term"))
        .groupBy("term").agg(F.sum(F.col("y") * F.col("n")).alias("bad"), F.sum("n").alias("n"))
        .where(F.col("bad") >= SUPPORT)
    )
    odds = F.log((F.col("bad") + 0.5) / (total[1] + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (total[0] + 1))
    best = counted.select("term", odds.alias("odds"), "bad").where(F.col("odds") >= ODDS).orderBy(F.desc("bad"), "term").limit(most)
    found = {r.term: r for r in best.collect()}
    alone: dict[str, int] = {}
    for r in found.values():
        if not r.term.endswith("*"):
            for n in STEMS:
                alone[r.term[:n] + "*"] = max(alone.get(r.term[:n] + "*", 0), r.bad)
    return {t: r.odds - ODDS + 0.5 for t, r in found.items() if r.bad >= SPREAD * alone.get(t, 0)}


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, modulus: int = MODULUS, held: int = HELD_OUT) -> Grammar:
    """The grammar of the labelled sample. The driver gets ``MOST_TERMS`` terms and, for each sampled
    row, a vector of ``2 * PATTERNS`` numbers."""
    taught = stored(sample(docs, labels, "toxic", modulus, held, rows), "toxicity-taught")
    grammar = Grammar(learned_terms(taught))

    def make():
        return lambda texts: {"x": [grammar.clauses(t or "").tobytes() for t in texts]}

    got = sorted(per_text(taught, make, "x binary", ["doc_id", "y", "n"]).select("doc_id", "y", "x", "n").collect())
    if got:
        y, times = (np.array([r[c] for r in got], dtype=float) for c in ("y", "n"))
        if 0 < y.sum() < len(y):
            grammar.weights, grammar.bias = logistic(np.array([np.frombuffer(r.x) for r in got]), y, times=times)
        else:
            grammar.bias = float(np.log((y @ times + 1) / (times.sum() - y @ times + 1)))
    grammar.known.clear()
    return grammar


def classify(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` for every row's whole text, beside the columns of ``docs`` (or ``keep``).

    Null is as the empty text, which has no clauses and gets the score of the bias. Repeated rows and ties each get
    their own row; an empty table gives an empty table; columns named as the new ones are replaced.
    """

    def make():
        def run(texts):
            scores = [grammar.score(grammar.clauses(t or "")) for t in texts]
            return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return run

    return per_text(docs, make, "score double, predicted int", keep)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    out = classify(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
