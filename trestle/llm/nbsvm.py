"""Quality classifier: naive Bayes support vectors.

Features are indicators of the byte 1-, 2- and 3-grams of the whole text and of
how often a word repeats the one before it, hashed to ``2**BITS`` places.  Each
indicator is scaled by the log ratio of its (smoothed) counts in the two
classes, a text's vector is brought to length 1, and a linear hinge-loss model
is fitted by dual coordinate descent.  A logistic curve fitted on the fifth of
the sample that the descent doesn't see turns margins into scores.

The classifier is fitted on a bounded sample of the labelled rows: about
``sample_docs``, chosen by a hash of the id.  The texts of the sample become
feature lists on the executors; the driver gets those lists only.  Scoring is a
narrow map over whole texts with a model of 2 MB.

Defined results: null and empty texts have no n-grams and get the score of the
bias; ids with contradicting labels and null labels are left out; ids that
occur several times in either table count once; with labels of one class or
none, every score is the smoothed share of label 1.  Input columns named like
an output column are replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.llm.common import annotate, utf8

BITS = 18
_SHIFT = np.uint32(32 - BITS)
_MUL = np.uint32(2654435761)  # Knuth's multiplicative hash


def _hashed(grams: np.ndarray) -> np.ndarray:
    return (grams * _MUL) >> _SHIFT


def _repeats(text: bytes) -> list[int]:
    """Indicators of repeated-word bigrams, by their share of all bigrams, and of few distinct words."""
    words = text.split()
    if len(words) < 2:
        return []
    same = sum(map(operator.eq, words, words[1:])) / (len(words) - 1)
    kinds = len(set(words)) / len(words)
    out = [1 + i for i, least in enumerate((1e-9, 0.02, 0.1, 0.3, 0.6)) if same >= least]
    return out + [16 + i for i, most in enumerate((0.02, 0.05, 0.1, 0.2)) if kinds <= most and len(words) >= 20]


def features(text: bytes | None) -> np.ndarray:
    """Places of the text's indicators, ascending."""
    if not text:
        return np.zeros(0, np.uint32)
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    grams = [a, (a[:-1] | a[1:] << 8) + np.uint32(1 << 25), (a[:-2] | a[1:-1] << 8 | a[2:] << 16) + np.uint32(1 << 26)]
    extra = np.array(_repeats(text), np.uint32) + np.uint32(1 << 27)
    seen = np.zeros(1 << BITS, bool)
    for g in (*grams, extra):
        seen[_hashed(g)] = True
    return np.flatnonzero(seen).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray  # log-count ratio of each place
    weights: np.ndarray  # of the scaled, normalised vector
    bias: float
    slope: float  # of the logistic curve
    offset: float

    def margin(self, places: np.ndarray) -> float:
        x = self.ratios[places]
        length = float(np.sqrt(x @ x))
        return float(self.weights[places] @ x) / length + self.bias if length else self.bias

    def score(self, places: np.ndarray) -> float:
        z = self.slope * self.margin(places) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for places, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[places] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(
    rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; each class weighs as much as the other."""
    rng = np.random.default_rng(seed)
    xs = []
    for places in rows:
        x = ratios[places]
        length = np.sqrt(x @ x)
        xs.append(x / length if length else x)
    upper = cost * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    diagonal = np.array([x @ x + 1.0 for x in xs])
    w, b, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            places, x = rows[i], xs[i]
            gradient = y[i] * (w[places] @ x + b) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[places] += step * x
                b += step
                moved += abs(step)
                alpha[i] = new
        if moved < 1e-4 * len(y):
            break
    return w, b


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with Platt's smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    # each class weighs the same, so that 0.5 lies between them
    weight = np.where(y > 0, 0.5 / max(1, pos), 0.5 / max(1, neg)) * len(y)
    x = np.stack([margins, np.ones(len(y))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 and np.isfinite(theta).all() else (2.0, 0.0)


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """A model from feature lists and labels (0 or 1)."""
    y = np.where(np.array(labels, int) > 0, 1, -1)
    zero = np.zeros(1 << BITS)
    share = ((y > 0).sum() + 1) / (len(y) + 2)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(rows, y)
    held = np.arange(len(y)) % 5 == 4
    if not all(((y[~held] == s).any() and (y[held] == s).any()) for s in (1, -1)):
        held[:] = False
    seen = np.flatnonzero(~held)
    w, b = dual_coordinate_descent([rows[i] for i in seen], ratios, y[seen])
    raw = Model(ratios, w, b, 1.0, 0.0)
    tested = np.flatnonzero(held) if held.any() else seen
    slope, offset = logistic_curve(np.array([raw.margin(rows[i]) for i in tested]), y[tested])
    return Model(ratios.astype(np.float32), w.astype(np.float32), b, slope, offset)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = 8000,
) -> Model:
    """A model from a sample of the documents that ``labels`` marks."""
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(label_col).alias("__y"), F.max(label_col).alias("__most"))
        .where("__y = __most")
    )
    n = marked.count()
    share = min(1.0, sample_docs / max(1, n))
    sample = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share * (1 << 30)).select("__id", "__y")
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    # about sample_docs ids: a bounded broadcast, so the documents aren't shuffled
    chosen = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__id", "__y", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([features(t) for t in utf8(b.column(2))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), made], names=["id", "y", "places"])

    kind = chosen.schema["__id"].dataType.simpleString()
    found = {r["id"]: r for r in chosen.mapInArrow(run, f"id {kind}, y int, places array<int>").toLocalIterator()}
    ids = sorted(found)
    return fit([np.array(found[i]["places"], np.int64) for i in ids], [found[i]["y"] for i in ids])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        use = shared.value

        def run(texts: list[bytes | None]) -> list[pa.Array]:
            s = [use.score(features(t)) for t in texts]
            return [pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]

        return run

    return annotate(docs, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)
