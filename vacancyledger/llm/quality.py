"""Quality classifier: Naive Bayes log-count ratios scale a linear hinge-loss model (NB-SVM)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import apart, columns_of, written

#: The classifier is fitted on at most so many labelled documents (the smallest of a seeded hash).
FIT_DOCUMENTS = 8192
#: n-grams are hashed to 2^BITS features.
BITS = 18
THRESHOLD = 0.3

#: Words and runs of marks; digits and letters are words.
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Ids(dict):
    """Token to a 32-bit hash, kept for the tokens met last."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[token] = value = xxhash.xxh32_intdigest(token.encode())
        return value


_ids = _Ids()


def indicators(text: str | None) -> np.ndarray:
    """Sorted feature numbers of the one- and two-token n-grams of the whole text; null has none."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, dtype=np.int64)
    one = np.fromiter(map(_ids.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xFF51AFD7ED558CCD)])
    return np.unique(mixed >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weight per feature (ratio times SVM weight), bias, and the line that turns margins to odds."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        norm = float(np.sqrt(len(features))) or 1.0
        margin = float(self.weights[features].sum()) / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of (share of a feature among label 1) / (share among label 0), smoothed."""
    counts = np.full((2, 1 << BITS), smoothing)
    for features, label in zip(rows, labels, strict=True):
        counts[int(label), features] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1 hinge-loss SVM on rows of ratios scaled to their length.

    One dual variable per row, in [0, cost of its class], is set to its optimum at a time; classes
    weigh the same in total. Stops when no variable moves.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max(1, int((labels == c).sum())) for c in (0, 1)]) / max(1, len(labels))
    upper = cost * 0.5 / share[labels.astype(int)]
    weights, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[f] / (np.sqrt(len(f)) or 1.0) for f in rows]
    square = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic line through held-back margins (Newton, smoothed targets)."""
    ones, zeros = float((labels == 1).sum()), float((labels == 0).sum())
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    at = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        at -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 1e-6), float(at[1])


def fit_model(rows: list[np.ndarray], labels: np.ndarray, held_back: np.ndarray) -> Model:
    """Ratios and SVM from the rows not held back, calibration from those held back (all, if none).

    With no rows, or one class only, every document gets the share of label 1 (1/2 for no rows).
    """
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    learn = ~held_back if len(set(labels[~held_back].tolist())) == 2 else np.ones(len(labels), bool)
    check = held_back if len(set(labels[held_back].tolist())) == 2 else np.ones(len(labels), bool)
    some = [r for r, k in zip(rows, learn, strict=True) if k]
    ratios = log_count_ratios(some, labels[learn])
    weights, bias = dual_coordinate_descent(some, labels[learn], ratios)
    model = Model(weights * ratios, bias, 1.0, 0.0)
    margins = np.array(
        [model.weights[r].sum() / (np.sqrt(len(r)) or 1.0) + bias for r, k in zip(rows, check, strict=True) if k]
    )
    return Model(model.weights, bias, *calibrate(margins, labels[check]))


def held_out(doc_id) -> F.Column:
    """Whether a document's labels may not be learnt from; null ids may not either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most ``fit_documents`` labelled documents that are not held out.

    Which ones is decided on the labels alone (the smallest seeded hashes of doc_id), so just those
    texts move. Documents without label, with a null label or with two different ones are not learnt
    from; repeated rows count once per row of documents.
    """
    known = (
        columns_of(labels, doc_id="long", quality="int")
        .filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .filter("quality = _most")
        .select("doc_id", "quality")
    )
    chosen = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(fit_documents)
    # At most fit_documents rows of two numbers.
    texts = columns_of(documents, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        import pyarrow as pa

        for b in batches:
            found = [indicators(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))],
                ["doc_id", "quality", "features"],
            )

    rows = texts.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, features array<int>")
    rows = written(rows, "features")

    def train(batches):
        import pyarrow as pa

        ids, ys, xs = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            xs += [np.asarray(x.values, dtype=np.int64) for x in b.column(2)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i], len(xs[i])))
        labels_, rows_ = np.array([ys[i] for i in order]), [xs[i] for i in order]
        back = np.array([ids[i] % 4 == 0 for i in order], dtype=bool)
        model = fit_model(rows_, labels_, back)
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict(
            {
                "at": pa.array([-1, -2, -3, *used.tolist()], pa.int32()),
                "value": pa.array([model.bias, model.slope, model.shift, *model.weights[used].tolist()], pa.float64()),
            }
        )

    # One task: the bounded sample, whatever the size of the tables.
    got = rows.coalesce(1).mapInArrow(train, "at int, value double").collect()
    values = dict(got)
    weights = np.zeros(1 << BITS)
    for at, value in got:
        if at >= 0:
            weights[at] = value
    if not got:
        return fit_model([], np.array([], dtype=int), np.array([], dtype=bool))
    return Model(weights, values[-1], values[-2], values[-3])


def _with_score(documents: DataFrame, model: Model, threshold: float) -> DataFrame:
    """``doc`` (a struct of all columns), score and predicted; nothing is shuffled."""
    # 2^BITS doubles: 2 MB, whatever the input.
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            scores = [model.score(indicators(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc", "score", "predicted"],
            )

    rows = documents.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["doc"]]).add("score", DoubleType()).add("predicted", IntegerType())
    return rows.mapInArrow(run, schema)


def scored(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``documents`` plus ``score`` and ``predicted``; nothing is shuffled.

    Whole texts are scored one at a time; null and empty ones get the score of no features. Rows are
    scored alone, so ties and repeated rows do not matter. A column called like an added one is
    returned with ``_input`` after its name. An empty table gives no rows.
    """
    return _with_score(apart(documents, "score", "predicted"), model, threshold).select("doc.*", "score", "predicted")


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that the model does not reject, with their columns as they are."""
    return _with_score(documents, model, threshold).filter("predicted = 1").select("doc.*")
