"""The classifier: its parts against plain forms, held-out accuracy, awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancyledger.llm import quality


def hinge_objective(weights, bias, rows, labels, ratios, cost, upper):
    sign = np.where(labels == 1, 1, -1)
    margins = np.array([weights[r] @ ratios[r] / np.sqrt(len(r)) for r in rows]) + bias
    return 0.5 * (weights @ weights + bias**2) + (upper * np.maximum(0, 1 - sign * margins)).sum()


def test_descent_reaches_the_optimum():
    """Against subgradient descent on the primal of a small problem."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    labels = np.array([int(5 in r or 6 in r) for r in rows])
    ratios = np.zeros(30) + rng.normal(size=30)
    weights, bias = quality.dual_coordinate_descent(rows, labels, ratios, epochs=400)
    share = np.array([(labels == c).mean() for c in (0, 1)])
    upper = 0.5 / share[labels]
    best = hinge_objective(weights, bias, rows, labels, ratios, 1.0, upper)
    w, b, sign = np.zeros(30), 0.0, np.where(labels == 1, 1, -1)
    least = np.inf
    for t in range(1, 20_000):
        gw, gb = w.copy(), b
        for r, y, u in zip(rows, sign, upper, strict=True):
            v = ratios[r] / np.sqrt(len(r))
            if y * (w[r] @ v + b) < 1:
                gw[r] -= u * y * v
                gb -= u * y
        w, b = w - gw / t, b - gb / t
        if t % 500 == 0:
            least = min(least, hinge_objective(w, b, rows, labels, ratios, 1.0, upper))
    assert best <= least + 0.02 * abs(least)


def test_ratios_are_log_count_ratios():
    rows = [np.array([1, 2]), np.array([1]), np.array([2, 3])]
    got = quality.log_count_ratios(rows, np.array([1, 1, 0]))
    n = 1 << quality.BITS
    assert got[1] == pytest.approx(np.log((3 / (n + 3)) / (1 / (n + 2))))
    assert got[3] == pytest.approx(np.log((1 / (n + 3)) / (2 / (n + 2))))


def test_calibration_orders_and_centres():
    rng = np.random.default_rng(1)
    margins = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margins + 0.5)))).astype(int)
    slope, shift = quality.calibrate(margins, labels)
    assert slope == pytest.approx(2, abs=0.3) and shift == pytest.approx(0.5, abs=0.2)


def test_held_out_rows(spark):
    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    rows = rows.filter(quality.held_out(F.col("doc_id"))).select("score", "predicted", "quality").collect()
    score, good = np.array([r.score for r in rows]), np.array([r.quality for r in rows]) == 1
    auc = (score[good][:, None] > score[~good][None, :]).mean()
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_matter(spark, sample):
    docs, labels = sample("documents"), sample("labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels), quality.fit(docs.withColumn("lang", F.lit("x")), turned)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)] + [(4, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(awkward, labels)
    rows = quality.scored(awkward, model)
    assert {"score", "predicted", "score_input", "predicted_input"} <= set(rows.columns)
    got = rows.collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1
    assert quality.accepted(awkward, model).schema == awkward.schema
    assert quality.scored(nothing, model).count() == 0
    none = quality.fit(nothing, labels.limit(0))
    assert {r.score for r in quality.scored(awkward, none).collect()} == {0.5}


def test_sample_is_bounded(spark, sample):
    docs, labels = sample("documents"), sample("labels")
    few, same = quality.fit(docs, labels, fit_documents=20), quality.fit(docs.repartition(6), labels, fit_documents=20)
    assert np.array_equal(few.weights, same.weights)
    assert not np.array_equal(few.weights, quality.fit(docs, labels).weights)
