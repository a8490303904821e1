"""Quality classifier: naive Bayes support vectors.

Every text is a set of n-gram indicators, hashed into a fixed number of buckets. Each indicator is scaled by the
log ratio of its smoothed counts in good and bad documents; a linear hinge-loss model over the scaled indicators is
then fitted by dual coordinate descent, interpolated with its mean weight, and its margin mapped to a probability.

N-grams: words, pairs of words, the *shapes* of words (runs of capitals, small letters, digits and of each other sign),
pairs of shapes, and n-grams that repeat at once (how many words in a row equal the word a few places before). Labels, language, source and ids are not looked at.

The fit uses a bounded sample (``FIT_ROWS`` labelled rows) and a model of ``BUCKETS`` numbers, whatever the size of
the corpus. Scoring is a narrow map over whole texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import per_text
from qualis.llm.labelled import remainder, sample

FIT_ROWS = 6_000  # labelled rows the fit takes at most
BUCKETS = 1 << 18
SMOOTHING, PENALTY, EPOCHS, BLEND = 1.0, 1.0, 15, 0.25
MODULUS, HELD_OUT = 3, 1
MEMO = 300_000
LAGS, RUN_LENGTHS = (1, 2, 3, 4), (1, 3, 6, 9)

RUNS = regex.compile(r"(?P<A>\p{Lu}+)|(?P<a>\p{L}+)|(?P<d>\p{N}+)|(.)\4*", regex.DOTALL)


def bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def shape(word: str) -> str:
    """``Don't!!`` -> ``Aa'a!``: each run as its class, or as its own sign."""
    return "".join(m.lastgroup or m.group()[0] for m in RUNS.finditer(word))


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


class Indicators:
    """The distinct n-gram buckets of a text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def code(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            got = self.known[word] = bucket(word) | bucket(shape(word)) << 32
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        codes = np.fromiter(map(self.code, words), np.uint64, len(words))
        one, form = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
        again = np.array([10 * lag + run for lag in LAGS for run in RUN_LENGTHS if longest_run(codes[lag:] == codes[:-lag]) >= run], np.uint64)

        def mixed(x: np.ndarray, kind: int) -> np.ndarray:
            x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
            return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)

        pairs = one[1:] * np.uint64(31) + one[:-1] * np.uint64(1_000_003)
        forms = form[1:] * np.uint64(31) + form[:-1] * np.uint64(1_000_003)
        found = np.concatenate([mixed(one, 1), mixed(pairs, 2), mixed(form, 3), mixed(forms, 4), mixed(again, 5)])
        seen = np.zeros(BUCKETS, bool) if len(found) > 4096 else None
        if seen is None:
            return np.unique(found).astype(np.int64)
        seen[found.astype(np.int64)] = True
        return np.flatnonzero(seen)


@dataclass
class Model:
    """``weights`` already hold the log-count ratios; ``used`` marks the buckets seen in the sample."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratios[x]
        size = float(np.sqrt(r @ r))
        return float(self.weights[x].sum()) / size + self.bias if size else self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -60, 60))))


def fit(rows: list[np.ndarray], y: np.ndarray, times: np.ndarray | None = None) -> Model:
    """Ratios, then hinge loss by dual coordinate descent on ratio-scaled, length-normalised indicators.
    A row counts as often as ``times`` says (default: once)."""
    zero = np.zeros(BUCKETS, np.float32)
    times = np.ones(len(y), np.int64) if times is None else times
    good, bad = int(times[y > 0].sum()), int(times[y <= 0].sum())
    if not good or not bad:  # nothing to tell apart: the smoothed share of the one class
        p = (good + 1) / (good + bad + 2)
        return Model(zero, zero, 0.0, 0.0, float(np.log(p / (1 - p))))
    count = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for x, label, n in zip(rows, y, times, strict=True):
        count[int(label)][x] += n
    p, q = count[1] + SMOOTHING, count[0] + SMOOTHING
    ratios = np.where(count[0] + count[1] > 0, np.log(p / p.sum() * q.sum() / q), 0.0)
    scaled = []
    for x in rows:
        v = ratios[x]
        size = np.sqrt(v @ v)
        scaled.append(v / size if size else v)
    sign = np.where(y > 0, 1.0, -1.0)
    most = np.where(y > 0, (good + bad) / (2 * good), (good + bad) / (2 * bad)) * times * PENALTY  # both classes weigh the same
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    norm = np.array([v @ v + 1 for v in scaled])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            x, v = rows[i], scaled[i]
            slack = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), most[i])
            if step := (new - alpha[i]) * sign[i]:
                w[x] += step * v
                bias += step
                alpha[i] = new
    used = ratios != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    w = np.where(used, (1 - BLEND) * mean + BLEND * w, 0.0)
    model = Model((w * ratios).astype(np.float32), ratios.astype(np.float32), BLEND * bias, 1.0, 0.0)
    m = np.array([model.margin(x) for x in rows])
    model.slope, model.shift = calibrated(m, y, most / PENALTY)
    return model


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by damped Newton steps."""
    spread = margin.std() or 1.0
    a, b, z = 1.0, 0.0, (margin - margin.mean()) / spread
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([e @ z + 0.01 * a, e.sum()])
        hess = np.array([[h @ (z * z) + 0.01, h @ z], [h @ z, h.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -2, 2)
    return float(a / spread), float(b - a * margin.mean() / spread)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, modulus: int = MODULUS, held: int = HELD_OUT) -> Model:
    """The model of the labelled sample. The driver gets its indicator buckets: at most ``rows`` x ``BUCKETS``
    small integers, mostly far fewer, however often a row is there."""

    def make():
        indicators = Indicators()
        return lambda texts: {"x": [indicators(t).astype("<i4").tobytes() for t in texts]}

    taught = per_text(sample(docs, labels, "quality", modulus, held, rows), make, "x binary", ["doc_id", "y", "n"])
    got = sorted(taught.select("doc_id", "y", "x", "n").collect())
    y, times = (np.array([r[c] for r in got], dtype=np.int64) for c in ("y", "n"))
    return fit([np.frombuffer(r.x, "<i4").astype(np.int64) for r in got], y, times)


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` for every row's whole text, beside the columns of ``docs`` (or ``keep``).

    Null is as the empty text, which gets the score of a text without n-grams. Repeated rows and ties each get
    their own row; an empty table gives an empty table; columns named as the new ones are replaced.
    """

    def make():
        indicators = Indicators()

        def run(texts):
            scores = [model.score(indicators(t)) for t in texts]
            return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return run

    return per_text(docs, make, "score double, predicted int", keep)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns, whatever their names."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return classify(row, model, ["row"]).where("predicted = 1").select("row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    out = classify(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", "predicted")
