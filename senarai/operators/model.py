"""Classifiers over TF-IDF vectors: one-vs-rest linear SVM with calibrated confidence, and cosine nearest neighbours.

Both are fitted on a sample of bounded size, MAX_TRAIN rows, taken from every label; every row is then scored where it
lies, in one Arrow stage with the model and the idf of the vocabulary broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classifier_text
from ..session import cut_lineage
from . import features

MAX_TRAIN, COST, TOLERANCE, STEPS, FOLDS = 500, 1.0, 1e-3, 5_000, 5
#: Largest sample that the driver may fit.
MAX_SAMPLE = 10_000
UNKNOWN, ERROR, NEUTRAL = "unknown", "error", "netral"


class ModelError(ValueError):
    """The training table can't give a model."""


def hinge_machines(x: np.ndarray, y: np.ndarray, cost: float = COST, tolerance: float = TOLERANCE, steps: int = STEPS) -> np.ndarray:
    """Weights of linear SVMs with hinge loss, a row for each column of y (+1 or -1), by accelerated projected gradient on
    the dual of all at once. The last weight of a row is its bias, that of a constant feature 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / max(np.linalg.norm(x, 2) ** 2, 1e-12)
    alpha = ahead = np.zeros(y.shape)
    pace = np.ones(y.shape[1])
    for _ in range(steps):
        slope = y * (x @ (x.T @ (ahead * y))) - 1
        after = np.clip(ahead - step * slope, 0, cost)
        if np.abs(after - ahead).max() < tolerance * step:
            alpha = after
            break
        pace = np.where(((ahead - after) * (after - alpha)).sum(axis=0) > 0, 1.0, pace)  # momentum that leads uphill starts anew
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = after + (pace - 1) / faster * (after - alpha)
        alpha, pace = after, faster
    return (x.T @ (alpha * y)).T


def sigmoid_scale(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a m + b))) of a margin m, by Newton steps on smoothed targets."""
    up, down = positive.sum(), (~positive).sum()
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, np.log((up + 1) / (down + 1))])
    rows = np.stack([margins, np.ones_like(margins)], axis=1)
    loss = lambda v: float((np.logaddexp(0, rows @ v) - target * (rows @ v)).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -500, 500)))
        slope = rows.T @ (p - target)
        if np.abs(slope).max() < 1e-6:
            break
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-9 * np.eye(2), slope)
        scale, before = 1.0, loss(at)
        while scale > 1e-10 and loss(at - scale * step) > before - 1e-4 * scale * float(slope @ step):
            scale /= 2
        at = at - scale * step
    return float(at[0]), float(at[1])


def calibrated(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """A row (a, b) for each column of y, from the margins of machines fitted without the row (FOLDS folds)."""
    fold = np.arange(len(x)) % min(FOLDS, len(x))
    margins = np.zeros(y.shape)
    for k in range(fold.max() + 1):
        out = fold == k
        if (~out).any():
            w = hinge_machines(x[~out], y[~out], cost)
            margins[out] = x[out] @ w[:, :-1].T + w[:, -1]
    return np.array([sigmoid_scale(margins[:, j], y[:, j] > 0) for j in range(y.shape[1])])


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("__key"), classifier_text(F.coalesce(F.col(text), F.lit(""))).alias("__text"))


def _scored(df: DataFrame, key: str, text: str, shared, score: Callable[[dict[str, float], object], tuple[str, float]]) -> DataFrame:
    """key, predicted_label, confidence of every row; a row that can't be scored is `error` with 0 and fails nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, model = shared.value
        for batch in batches:
            labels, confidence = [], []
            for t in batch.column(1).to_pylist():
                try:
                    found = score(features.row_weights(t, idf), model)
                except Exception:  # noqa: BLE001 - whatever a row brings about, the others are scored
                    found = (ERROR, 0.0)
                labels.append(found[0])
                confidence.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(confidence, pa.float64())], names=["__key", "predicted_label", "confidence"])

    rows = _keyed(df, key, text)
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, predicted_label string, confidence double").withColumnRenamed("__key", key)


@dataclass
class OneVsRest:
    """Per label a linear SVM and the calibration of its margin; labels in first-seen order."""

    labels: list[str]
    places: dict[str, int]
    weights: np.ndarray
    scales: np.ndarray
    idf: dict[str, float]

    def probabilities(self, weights: dict[str, float]) -> np.ndarray:
        """P(label) of a row by its term weights, each label for itself."""
        held = [(self.places[w], v) for w, v in weights.items() if w in self.places]
        margins = self.weights[:, -1].copy()
        if held:
            margins += self.weights[:, [k for k, _ in held]] @ np.array([v for _, v in held])
        return 1 / (1 + np.exp(-np.clip(self.scales[:, 0] * margins + self.scales[:, 1], -500, 500)))

    def predict(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, predicted_label, confidence: every row of df; the earliest label wins ties. Confidence is the winner's
        probability, not normalised over labels. Null and empty texts are scored as empty. Without any label the
        prediction is `unknown` with 0. One narrow stage."""
        if not self.labels:
            return df.select(key, F.lit(UNKNOWN).alias("predicted_label"), F.lit(0.0).alias("confidence"))

        def score(weights: dict[str, float], model: OneVsRest) -> tuple[str, float]:
            p = model.probabilities(weights)
            best = int(p.argmax())
            return model.labels[best], float(p[best])

        shared = df.sparkSession.sparkContext.broadcast((self.idf, self))
        return _scored(df, key, text, shared, score)


def _sample(df: DataFrame, key: str, text: str, label: str, max_train: int) -> tuple[DataFrame, dict[str, float], list]:
    """(idf of all training rows, the same by term, sampled rows (key, text, label) in the order of key)."""
    if max_train > MAX_SAMPLE:
        raise ValueError(f"a sample has at most {MAX_SAMPLE} rows")
    clean = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), classifier_text(F.col(text)).alias("text"), F.col(label).alias("label"))
    idf = cut_lineage(features.smoothed_idf(clean, "text"))
    known = features.broadcast_idf(idf)
    if known is None:
        raise ModelError(f"a vocabulary of more than {features.BROADCAST_TERMS} terms")
    chosen = features.stratified_sample(clean, "key", "label", max_train).select("key")
    rows = clean.join(F.broadcast(chosen.distinct()), "key", "left_semi").orderBy("key").limit(MAX_SAMPLE).collect()
    return idf, known, rows


def train_one_vs_rest(
    df: DataFrame, key: str, text: str, label: str, max_train: int = MAX_TRAIN, max_vocabulary: int = features.MAX_VOCABULARY, cost: float = COST
) -> OneVsRest:
    """A linear SVM for each label against the rest, hinge loss with cost C, and a sigmoid of its margin fitted on held-out
    folds.

    idf comes from all rows; the machines are fitted on a stratified sample of max_train rows, with a row of every label
    however many there are, and the max_vocabulary terms that most rows of it hold. Raises ModelError with the reason where
    there is no vocabulary or fewer than two labels.
    """
    _, known, rows = _sample(df, key, text, label, max_train)
    if not known:
        raise ModelError("the vocabulary is empty")
    labels = list(dict.fromkeys(r.label for r in rows))
    if len(labels) < 2:
        raise ModelError("fewer than two labels")
    weights = [features.row_weights(r.text, known) for r in rows]
    held: dict[str, int] = {}
    for r, found in zip(rows, weights):  # in first-seen order
        for w in r.text.split(" "):
            if w in found:
                held.setdefault(w, 0)
        for w in found:
            held[w] += 1
    order = {w: k for k, w in enumerate(held)}
    top = sorted(sorted(held, key=lambda w: (-held[w], order[w]))[:max_vocabulary], key=order.get)
    places = {w: k for k, w in enumerate(top)}
    x = np.zeros((len(rows), len(top)))
    for i, found in enumerate(weights):
        for w, v in found.items():
            if w in places:
                x[i, places[w]] = v
    y = np.where(np.array([r.label for r in rows])[:, None] == np.array(labels)[None], 1.0, -1.0)
    return OneVsRest(labels, places, hinge_machines(x, y, cost), calibrated(x, y, cost), known)


def classified(train: DataFrame, test: DataFrame, key: str, text: str, label: str, **settings) -> tuple[DataFrame, str | None]:
    """(key, predicted_label, confidence of every row of test, None), or no rows and the reason where there is no model."""
    try:
        return train_one_vs_rest(train, key, text, label, **settings).predict(test, key, text), None
    except ModelError as reason:
        empty = test.limit(0).select(key, F.lit("").alias("predicted_label"), F.lit(0.0).alias("confidence"))
        return empty, str(reason)


def accuracy(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, total_samples, correct_predictions, wrong_predictions, accuracy: matches of rows with an actual label (neither
    null, empty nor `0`) among all rows, so rows without one count as wrong. 0 for no rows."""
    given = ~F.coalesce(F.col(actual), F.lit("")).isin("", "0")
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(given & (F.col(actual) == F.col(predicted))).alias("correct_predictions"))
    total, hit = F.col("total_samples"), F.col("correct_predictions")
    return counts.select(*by, total, hit, (total - hit).alias("wrong_predictions"), F.when(total > 0, hit / F.greatest(total, F.lit(1))).otherwise(0.0).alias("accuracy"))


def summary(spark: SparkSession, train: DataFrame, text: str, label: str, scored: DataFrame, actual: str, error: str | None) -> DataFrame:
    """One row: the training summary, the accuracy over all test rows, macro metrics over the labelled ones, and the reason
    of a failure; a failed training has zeros everywhere."""
    from . import evaluate

    if error is not None:
        numbers = ("vocabulary_size", "total_documents", "avg_idf", "min_idf", "max_idf", "n_labels", "total_samples", "correct_predictions", "wrong_predictions", "accuracy", "precision", "recall", "f1_score")
        return spark.range(1).select(*[F.lit(0.0).alias(n) for n in numbers], F.lit(error).alias("error"))
    macro = evaluate.method_metrics(evaluate.cells(scored.where(F.col(actual).isNotNull()), actual, "predicted_label")).select("precision", "recall", "f1_score")
    whole = features.training_summary(train, text, label).join(F.broadcast(accuracy(scored, actual, "predicted_label"))).join(F.broadcast(macro))
    return whole.withColumn("error", F.lit(None).cast("string"))


def cosine_neighbours(
    train: DataFrame, test: DataFrame, key: str, text: str, label: str, k: int = 5, max_train: int = MAX_TRAIN
) -> DataFrame:
    """key, predicted_label, confidence of every row of test by its k most similar rows of a stratified sample of train.

    Similarity is the cosine of the TF-IDF vectors, equal ones in the order of key; votes are weighted by it; ties go to
    the smaller label. Rows that share no term with any, empty and null texts among them, are netral with confidence 0.
    The sample's bound is that of the broadcast and of the candidates of a row. One narrow stage over test.
    """
    _, known, rows = _sample(train, key, text, label, max_train)
    columns: dict[str, list[tuple[int, float]]] = {}
    for i, r in enumerate(rows):
        for w, v in features.row_weights(r.text, known).items():
            columns.setdefault(w, []).append((i, v))
    matrix = {w: (np.array([i for i, _ in c]), np.array([v for _, v in c])) for w, c in columns.items()}

    def score(weights: dict[str, float], model: tuple[dict, list[str]]) -> tuple[str, float]:
        columns, labels = model
        sims, met = np.zeros(len(labels)), np.zeros(len(labels), dtype=bool)
        for w, v in weights.items():
            if w in columns:
                at, held = columns[w]
                sims[at] += v * held
                met[at] = True
        near = np.flatnonzero(met)
        near = near[np.lexsort((near, -np.round(sims[near], 9)))][:k]
        votes: dict[str, float] = {}
        for i in near.tolist():
            votes[labels[i]] = votes.get(labels[i], 0.0) + float(sims[i])
        if not votes:
            return NEUTRAL, 0.0
        best = min(votes, key=lambda x: (-round(votes[x], 9), x))
        return best, max(votes.values()) / sum(votes.values())

    shared = test.sparkSession.sparkContext.broadcast((known, (matrix, [r.label for r in rows])))
    return _scored(test, key, text, shared, score)
