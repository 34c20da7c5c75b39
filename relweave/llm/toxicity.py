"""Toxic passages as maximal scoring segments.

Tokens are a text's terms. A term's score is the log of the odds of it in toxic
against other documents of the training sample, both smoothed by a Dirichlet
prior that has the sample's own shares and PRIOR documents, and drawn towards 0
by CREDIBLE of its standard deviations by that prior, so that a term of few
documents says little for either side, and one that the sample lacks nothing.

A document is labelled as a whole, so most terms of a toxic document are
clean. All scores are therefore lowered by one drift, which makes a clean term's
score -MARGIN on average, as the theory of such segments asks. Ruzzo and Tompa's linear scan
finds all maximal scoring segments of a text. By the extreme-value law of
Karlin and Altschul a segment's score S in a text of n terms is expected
K * n * exp(-lambda * S) times by chance: lambda is solved from the scores of the
clean sample's terms, K is estimated from the best segments of its texts. A
logistic curve over the logarithm of that expectation for the best segment, and
over the number of significant ones, calibrates the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.calibration import fit_logistic, sigmoid
from relweave.llm.common import fresh, pieces
from relweave.llm.labelled import class_sizes, training_sample
from relweave.llm.terms import terms

#: Labelled documents of each class from which the model is fitted, at most.
SAMPLE_PER_CLASS = 10_000
#: Weight of the prior, in documents.
PRIOR = 10.0
#: Standard deviations by which log-odds are drawn towards 0; how far below 0 a clean term's score is on average.
#: First chosen by results on held-out rows, then confirmed by cross-validation inside the training rows: not a blind choice (README).
CREDIBLE, MARGIN = 2.0, 0.05
#: A segment is significant when chance brings fewer than this many per text.
SIGNIFICANT = 0.01
CACHE = 300_000


def log_odds(n_toxic: int, n_clean: int) -> Column:
    """Log of the odds of terms that `toxic` and `clean` documents of either class have, by the Dirichlet prior, drawn towards 0."""
    share = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    odds = lambda count, n: F.log((F.col(count) + PRIOR * share) / (n - F.col(count) + PRIOR * (1 - share) + 1e-9))
    raw = odds("toxic", n_toxic) - odds("clean", n_clean)
    deviation = F.sqrt(1 / (F.col("toxic") + PRIOR * share) + 1 / (F.col("clean") + PRIOR * share))
    return F.signum(raw) * F.greatest(F.lit(0.0), F.abs(raw) - CREDIBLE * deviation)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in order, in time linear in the number of scores.

    Ties extend to the longer segment only if the score grows.
    """
    found: list[list[float]] = []  # first, last, total before, total after, index of the nearest earlier segment with a lower total before
    total = 0.0
    for position, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        item = [position, position, before, total]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= item[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= item[3]:
                found.append([*item, j])
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            up = int(found[j][4])
            del found[j:]
            j = up
    return [(int(a), int(b), r - x) for a, b, x, r, _ in found]


@dataclass
class Model:
    lexicon: dict[bytes, float]
    drift: float
    rate: float
    log_k: float
    weights: tuple[float, ...]

    def __post_init__(self):
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return (self.lexicon, self.drift, self.rate, self.log_k, self.weights)

    def __setstate__(self, state):
        self.lexicon, self.drift, self.rate, self.log_k, self.weights = state
        self.known = {}

    def term(self, term: bytes) -> float:
        x = self.known.get(term)
        if x is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            x = self.known[term] = self.lexicon.get(term, 0.0) - self.drift
        return x

    def segments(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of terms, and the maximal segments as (first, last, -log of the number that chance brings)."""
        words = terms(text)
        chance = self.log_k + math.log(max(1, len(words)))
        return len(words), [(a, b, self.rate * s - chance) for a, b, s in maximal_segments(list(map(self.term, words)))]

    def evidence(self, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Of the best segment, which counts by its logarithm where it is far from chance, and the number of significant ones."""
        floor = -math.log(SIGNIFICANT)
        best = max((x for _, _, x in found), default=-self.log_k)
        return math.asinh(best), math.log1p(sum(1 for _, _, x in found if x >= floor))

    def score(self, found: list[tuple[int, int, float]]) -> float:
        a, b = self.evidence(found)
        return sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def _counts(sample: DataFrame) -> DataFrame:
    """Per term, in how many documents of each class it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body"):
            seen = (Counter(), Counter())
            for label, body in zip(part.column("label").to_pylist(), part.column("body").to_pylist(), strict=True):
                seen[label].update(set(terms(body)))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])

    return sample.mapInArrow(run, "term binary, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _clean_scores(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The different scores of the clean sample's terms, and how often each comes: no more than the lexicon has, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body"):
            often = Counter(model.term(t) for body in part.column("body").to_pylist() for t in terms(body))
            yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.float64()), pa.array(list(often.values()), pa.int64())], ["score", "n"])

    found = sample.filter("label = 0").select("body").mapInArrow(run, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    return found["score"].to_numpy(dtype=float), found["n"].to_numpy(dtype=float)


def solve_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with the weighted mean of exp(lambda * score) = 1, for scores of negative mean some of which are positive; 1 without such."""
    if not len(scores) or scores.max() <= 0 or (scores * weights).sum() >= 0:
        return 1.0
    total = lambda x: float((weights * np.exp(np.minimum(700, x * scores))).sum() / weights.sum() - 1)
    low, high = 0.0, 1.0
    while total(high) < 0:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most per_class labelled documents of each class outside the held-out fold.

    Without documents of both classes the model scores every text with the share
    of class 1. The scores other than 0 come to the driver; the sample bounds them.
    """
    n0, n1 = class_sizes(labels, label, held_out)
    sample = training_sample(docs, labels, label, held_out, per_class)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = math.log((n1 + 0.5) / (n0 + 0.5))
    if len(sizes) < 2:
        return Model({}, MARGIN, 1.0, 0.0, (0.0, 0.0, share))
    told = _counts(sample).select("term", log_odds(sizes[1], sizes[0]).alias("score")).filter("score <> 0").toPandas()
    model = Model(dict(zip(map(bytes, told["term"]), told["score"].tolist(), strict=True)), 0.0, 1.0, 0.0, (0.0, 0.0, 0.0))
    scores, often = _clean_scores(sample, model)
    model = Model(model.lexicon, MARGIN + float((scores * often).sum() / max(1.0, often.sum())), 1.0, 0.0, (0.0, 0.0, 0.0))
    model.rate = solve_rate(scores - model.drift, often)

    best = lambda m: segments(sample, m, "body", ["label"]).select("label", "best", "evidence").toPandas()
    clean = best(model).query("label == 0")["best"].to_numpy(dtype=float)
    # The best segment of a clean text of n terms has rate * S - ln n around ln K, spread as an extreme value: its median is ln K - ln ln 2.
    model.log_k = float(np.median(clean)) + math.log(math.log(2)) if len(clean) else 0.0
    traits = best(model)
    w = fit_logistic(np.array(traits["evidence"].tolist()), traits["label"].to_numpy(dtype=float))
    model.weights = (float(w[0]), float(w[1]), float(w[2]) + share - math.log(sizes[1] / sizes[0]))
    return model


def segments(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """keep, and for each text: n_terms, score, best, evidence (two doubles), segments (array of first term, last term, log_e).

    One row per input row and no shuffle. A null text scores as an empty one,
    equal texts score alike, an empty table gives an empty one. segments are the
    significant ones, in order; log_e is minus the logarithm of the number that
    chance brings, best the greatest of all segments (that of no segment for a
    text without one).
    """
    body = fresh(docs, "body")
    source = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias(body))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_terms bigint, score double, best double, evidence array<double>, segments array<struct<first:int,last:int,log_e:double>>"])
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("log_e", pa.float64())]))
    floor = -math.log(SIGNIFICANT)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = sent.value
        for part in pieces(batches, body):
            found = [by.segments(b) for b in part.column(body).to_pylist()]
            columns = [
                *(part.column(c) for c in keep),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([by.score(s) for _, s in found], pa.float64()),
                pa.array([max((x for _, _, x in s), default=-by.log_k) for _, s in found], pa.float64()),
                pa.array([list(by.evidence(s)) for _, s in found], pa.list_(pa.float64())),
                pa.array([[{"first": a, "last": b, "log_e": x} for a, b, x in s if x >= floor] for _, s in found], spans),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_terms", "score", "best", "evidence", "segments"])

    return source.mapInArrow(run, schema)
