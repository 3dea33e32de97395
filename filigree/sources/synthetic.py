"""Branching random walks: walkers drift, diffuse and now and then branch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def walkers(number: int = 1, dims: int = 3, mean: float = 1.0, sd: float = 0.3, seed: int = 0) -> list[dict]:
    """Walkers at the origin with a drift of random signs and normal sizes."""
    rng = np.random.default_rng(seed)
    return [{"at": np.zeros(dims), "drift": rng.choice([-1, 1], dims) * rng.normal(mean, sd, dims), "age": 0} for _ in range(number)]


def grow(start: list[dict], sd: float = 0.1, steps: int = 100, chance: float = 0.01, least_age: int = 50, branch_dims: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and walker numbers of all steps; a walker older than ``least_age`` branches with the given chance,
    the new one drifting the other way in some dimensions."""
    rng, now = np.random.default_rng(seed), [dict(w) for w in start]
    places, owners = [], []
    for _ in range(steps):
        for i in range(len(now)):
            w = now[i]
            w["at"] = w["at"] + w["drift"] / steps + rng.normal(0, sd, len(w["at"]))
            w["age"] += 1
            places.append(w["at"])
            owners.append(i)
            if w["age"] > least_age and rng.random() < chance:
                turn = np.ones(len(w["at"]))
                turn[rng.choice(len(turn), min(branch_dims, len(turn)), replace=False)] = -1
                now.append({"at": w["at"], "drift": w["drift"] * turn, "age": 0})
                w["age"] = 0
    return np.array(places), np.array(owners)


def walk_points(spark: SparkSession, number: int = 8, dims: int = 3, seed: int = 0, **kwargs) -> DataFrame:
    """``(point_id, x, w, walker, branch)``: each walker with its branches is walked in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                x, owner = grow(walkers(1, dims, seed=seed + i), seed=seed + i, **kwargs)
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), x.ravel())
                ids = (np.int64(i) << 32) + np.arange(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids), rows, pa.array(np.ones(len(x))), pa.array(np.full(len(x), i, np.int32)), pa.array(owner.astype(np.int32))], ["point_id", "x", "w", "walker", "branch"])

    return spark.range(0, number, 1, min(number, 64)).mapInArrow(run, "point_id long, x array<double>, w double, walker int, branch int")
