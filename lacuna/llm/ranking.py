"""Quality classifier by Bradley-Terry pairwise ranking.

Of two labelled documents, one of quality 1 and one of quality 0, the first is preferred. Each document has a score w . x, and the model says
that i is preferred to j with probability sigmoid(w . (x_i - x_j)); w minimises the logistic loss over preference pairs, with a
small penalty, by Newton's method. x are counts of the whole text made ratios, each cut into steps at its quantiles over the
examples, so that the score may rise and fall in it.

The threshold is a quantile of the examples' scores: that at which most examples are on their side of it. The published
score is sigmoid of the distance to the threshold in units of the scores' spread, so the threshold is at 0.5.

Cases. Null or empty text: all counts 0, scored like any other. Texts of any length are read whole. Repeated rows get one score. Without examples of
both labels, every score is the share of label 1. Empty tables give empty results; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import labelled

PAIRS = 20_000
STEPS = 10
PENALTY = 1.0

FEATURES = ("words", "mean_word", "symbols", "bars", "marks", "stops", "upper", "digits", "distinct", "adjacent", "line_words", "dup_lines", "titled", "long_words")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGITS = re.compile(r"[0-9]+")


def features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    count = text.count
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)),
        chars / n,
        (count("#") + count("*") + count("$") + count("%") + count("&")) / chars,
        (count("|") + count("<") + count(">")) / chars,
        (count("!") + count("?")) / chars,
        (count(".") + count(",")) / chars,
        sum(map(len, _UPPER.findall(text))) / chars,
        sum(map(len, _DIGITS.findall(text))) / chars,
        float(np.log1p(len(set(words))) / np.log1p(n)),
        1 - sum(1 for _ in groupby(words)) / n,
        float(np.log1p(n / len(lines))) if lines else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        sum(map(str.istitle, words)) / n,
        float((lengths > 20).mean()),
    ]


@dataclass
class Model:
    edges: np.ndarray  # (features, STEPS - 1)
    weights: np.ndarray
    threshold: float
    spread: float
    quantile: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return stepped(x, self.edges) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)
        return 1 / (1 + np.exp(-z))


def stepped(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each feature and each of its edges, whether the value is over the edge."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(float)


def prefer(d: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """w of least penalised logistic loss over the pairs' differences d, by Newton's method."""
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w))
        step = np.linalg.solve(h, d.T @ (p - 1) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 17) -> Model:
    """x: (texts, FEATURES) of labelled texts, y: their labels."""
    x, y = np.asarray(x, float).reshape(len(y), len(FEATURES)), np.asarray(y)
    if not 0 < y.sum() < len(y):
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros((len(FEATURES), STEPS - 1)), np.zeros(len(FEATURES) * (STEPS - 1)), -float(np.log(share / (1 - share))), 1.0, 1 - share)
    # half of the edges from quantiles of either label's examples, as one label may be rare
    q = np.linspace(0, 1, STEPS // 2 + 2)[1:-1]
    edges = np.concatenate([np.quantile(x[y == 1], q, axis=0), np.quantile(x[y == 0], q, axis=0)]).T[:, : STEPS - 1]
    s = stepped(x, edges)
    r = np.random.default_rng(seed)
    d = s[r.choice(np.flatnonzero(y == 1), pairs)] - s[r.choice(np.flatnonzero(y == 0), pairs)]
    w = prefer(d)
    scores = s @ w
    levels = np.linspace(0.002, 0.998, 499)
    cuts = np.quantile(scores, levels)
    right = [((scores >= c) == (y == 1)).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(right, max(right)))
    at = best[len(best) // 2]
    # between the neighbouring scores, so that no example is on the edge
    below, above = scores[scores < cuts[at]], scores[scores >= cuts[at]]
    threshold = float((below.max(initial=cuts[at] - 1) + above.min(initial=cuts[at] + 1)) / 2)
    return Model(edges, w, threshold, float(max(scores.std(), 1e-6)), float(levels[at]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, raw."""

    def run(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(x)), pa.array(model.raw(x))], names=["doc_id", "score", "raw"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, raw double")


def measured(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the examples (doc_id, text, y), by doc_id; the texts stay on the executors."""

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])

    rows = sorted(examples.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x array<double>, y int").collect())
    return np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[2] for r in rows], int)


def fitted(docs: DataFrame, labels: DataFrame, modulus: int, fold: int) -> Model:
    """The model of ``labels.quality`` from the rows outside the held-out fold."""
    return fit(*measured(labelled.examples(docs, labels, "quality", modulus, fold)))


THRESHOLD = 0.5
MODULUS, FOLD = 3, 1


def op8_bradley_terry(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MODULUS, FOLD)
    scored = score(docs, model)
    return scored.select("doc_id", labelled.held_out(MODULUS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
