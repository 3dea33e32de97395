"""Logistic regressions of classes along trajectories cover all rows."""

import numpy as np
import pytest

from filigree.operators import trajectories as T


def plain_r2(t, y, steps=50):
    """One-against-rest curves over all rows in numpy, and R2 of the likeliest class."""
    x, classes, scores = np.stack([np.ones(len(t)), (t - t.mean()) / t.std()], 1), np.unique(y), []
    for c in classes:
        w = np.zeros(2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-6, 1.0]), x.T @ (p - (y == c)) + np.array([0.0, 1.0]) * w)
        scores.append(x @ w)
    predicted = classes[np.argmax(scores, axis=0)]
    return 1 - ((y - predicted) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_classes_are_fitted_over_all_rows(spark):
    rng = np.random.default_rng(3)
    t = rng.random(3000)
    two = (t + rng.normal(0, 0.3, 3000) > 0.6).astype(float)
    three = np.floor(3 * np.clip(t + rng.normal(0, 0.2, 3000), 0, 0.999))
    rows = [(0, float(a), v, float(b)) for v, y in (("two", two), ("three", three), ("one", np.full(3000, 0.1))) for a, b in zip(t, y)]
    table = spark.createDataFrame(rows, "traj_id int, pst double, var string, v double")
    got = {r["var"]: r["r2"] for r in T.regression(table, "CATEGORICAL", threshold=-10).collect()}
    assert got == {"two": pytest.approx(plain_r2(t, two), abs=1e-9), "three": pytest.approx(plain_r2(t, three), abs=1e-9), "one": 0.0}
