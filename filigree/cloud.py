"""Point clouds: the large side of every computation.

``PointCloud`` is a DataFrame ``points (point_id, x array<double>, w double)``.
Fitting needs few things of it: weighted sums per node for a batch of candidate
graphs, moments, and small samples.  Two engines give them: one that sends the
nodes to the partitions of the DataFrame and adds up partial sums, and one for
clouds that are proven small (rows times dimensions up to SMALL), which holds
the coordinates on the driver and needs no job per iteration.  The first packs
the coordinates once into blocks of bytes and keeps these, so that a pass moves
them as they are instead of turning every array into a row again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coordinates that the driver holds at most; rows measured at once; partial sums of a candidate that reach the driver where they are added up before.
SMALL, AT_ONCE, PARTIALS = 1 << 22, 8192, 16
#: Coordinates of a block; nodes of several candidates measured at once; bytes of partial sums that may reach the driver as they are.
BLOCK, STACK, DIRECT = 1 << 18, 256, 1 << 25


@dataclass
class Stats:
    """Of one candidate: weight and weighted sum of the points of each node, their squared distances, all weight."""

    weight: np.ndarray
    sums: np.ndarray
    spread: float
    total: float

    @property
    def mse(self) -> float:
        return self.spread / self.total if self.total else 0.0

    def __add__(self, other: "Stats") -> "Stats":
        return Stats(self.weight + other.weight, self.sums + other.sums, self.spread + other.spread, self.total + other.total)


def distances2(x: np.ndarray, x2: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows to nodes by one matrix product."""
    return np.maximum(0, x2[:, None] + (y**2).sum(1) - 2 * x @ y.T)


def nearest(x: np.ndarray, y: np.ndarray, radius: float = np.inf, x2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Node and squared distance of each row; the lowest node wins ties; beyond ``radius`` node -1 and the radius squared.

    Without ``x2``, the rows' squared norms, places are taken from the middle of the nodes, so that no digits are lost far from the origin.
    """
    if not len(x):
        return np.empty(0, np.int64), np.empty(0)
    if x2 is None:
        x, y = x - y.mean(0), y - y.mean(0)
    x2 = (x**2).sum(1) if x2 is None else x2
    node, d2 = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), AT_ONCE):
        d = distances2(x[i : i + AT_ONCE], x2[i : i + AT_ONCE], y)
        node[i : i + AT_ONCE] = own = d.argmin(1)
        d2[i : i + AT_ONCE] = d[np.arange(len(d)), own]
    far = d2 > radius * radius
    return np.where(far, -1, node), np.where(far, radius * radius, d2)


def partial(x: np.ndarray, x2: np.ndarray, w: np.ndarray, y: np.ndarray, radius: float) -> Stats:
    node, d2 = nearest(x, y, radius, x2)
    near = node >= 0
    at, own = node[near], w[near]
    weight = np.bincount(at, own, len(y))
    if len(y) * 4 < x.shape[0]:
        onehot = np.zeros((len(y), near.sum()))
        onehot[at, np.arange(len(at))] = own
        sums = onehot @ x[near]
    else:
        sums = np.zeros_like(y)
        np.add.at(sums, at, own[:, None] * x[near])
    return Stats(weight, sums, float((w * d2).sum()), float(w.sum()))


def partials(x: np.ndarray, w: np.ndarray, ys: list[np.ndarray], radius: float) -> Iterator[Stats]:
    """``partial`` for each of ``ys``; small candidates are measured STACK nodes at a time by one matrix product, and summed by another."""
    x2, total, first = (x**2).sum(1), float(w.sum()), 0
    while first < len(ys):
        last, nodes = first + 1, len(ys[first])
        while last < len(ys) and nodes + len(ys[last]) <= STACK:
            nodes, last = nodes + len(ys[last]), last + 1
        if nodes > STACK:
            yield partial(x, x2, w, ys[first], radius)
            first = last
            continue
        y = np.vstack(ys[first:last])
        d2 = np.maximum(0, x2 + (y**2).sum(1)[:, None] - y @ (2 * x).T)
        own, spreads, at = np.zeros_like(d2), [], 0
        for k in map(len, ys[first:last]):
            node, least = np.full(len(x), at), d2[at].copy()
            for j in range(at + 1, at + k):  # along the rows: the lowest node wins ties
                node[d2[j] < least] = j
                np.minimum(least, d2[j], out=least)
            far = least > radius * radius
            own[node, np.arange(len(x))] = np.where(far, 0, w)
            spreads.append(float((w * np.where(far, radius * radius, least)).sum() if far.any() else (w * least).sum()))
            at += k
        weight, sums, at = own.sum(1), own @ x, 0
        for k, spread in zip(map(len, ys[first:last]), spreads):
            yield Stats(weight[at : at + k], sums[at : at + k], spread, total)
            at += k
        first = last


class Engine:
    """What fitting asks of a cloud."""

    dim: int
    count: int

    def stats(self, ys: list[np.ndarray], radius: float = np.inf) -> list[Stats]:
        raise NotImplementedError

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sample covariance, unweighted."""
        raise NotImplementedError

    def sample(self, n: int, seed: int) -> np.ndarray:
        """At most ``n`` points, the same ones for the same seed."""
        raise NotImplementedError

    def moved(self, shift: np.ndarray, turn: np.ndarray | None = None) -> "Engine":
        """The cloud with ``shift`` subtracted and, if given, multiplied by ``turn``."""
        raise NotImplementedError

    def close(self) -> None:
        """Gives back what the engine keeps on the executors."""


class LocalEngine(Engine):
    def __init__(self, x: np.ndarray, w: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, float)
        self.w = np.ones(len(x)) if w is None else np.asarray(w, float).ravel()
        self.x2 = (self.x**2).sum(1)
        self.count, self.dim = self.x.shape

    def stats(self, ys, radius=np.inf):
        return [partial(self.x, self.x2, self.w, y, radius) for y in ys]

    def moments(self):
        cov = np.atleast_2d(np.cov(self.x, rowvar=False)) if self.count > 1 else np.zeros((self.dim, self.dim))
        return self.x.mean(0), cov

    def sample(self, n, seed):
        if self.count <= n:
            return self.x
        return self.x[np.sort(np.random.default_rng(seed).choice(self.count, n, replace=False))]

    def moved(self, shift, turn=None):
        x = self.x - shift
        return LocalEngine(x if turn is None else x @ turn, self.w)


class SparkEngine(Engine):
    """Nodes go out with the task, partial sums come back: per task and candidate one row, added up in two steps where they are many.

    ``blocks``: the packed points, kept until ``close``.
    """

    def __init__(self, points: DataFrame, dim: int, count: int, shift: np.ndarray | None = None, turn: np.ndarray | None = None, blocks: DataFrame | None = None):
        self.points, self.dim, self.count = points, dim, count
        self.shift, self.turn = np.zeros(dim) if shift is None else shift, turn
        self.blocks = packed(points, dim).persist() if blocks is None else blocks
        self._moments: tuple[np.ndarray, np.ndarray] | None = None

    def close(self) -> None:
        """Gives the kept blocks back; the engine and those moved from it can still be asked, at the price of packing again."""
        self.blocks.unpersist()

    def stats(self, ys, radius=np.inf):
        arrays, sizes = _reader(self.dim, self.shift, self.turn), [len(y) for y in ys]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Stats | None] = [None] * len(ys)
            for x, w in arrays(batches):
                for c, s in enumerate(partials(x, w, ys, radius)):
                    held[c] = s if held[c] is None else held[c] + s
            yield _rows(held)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Stats | None] = [None] * len(ys)
            for b in batches:
                for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = _stats(raw, sizes[c])
                    held[c] = s if held[c] is None else held[c] + s
            yield _rows(held)

        few = self.blocks.mapInArrow(run, "cand int, raw binary")
        if 8 * sum(2 + y.size + len(y) for y in ys) * self.blocks.rdd.getNumPartitions() > DIRECT:
            few = few.repartition(PARTIALS, F.spark_partition_id()).mapInArrow(add, "cand int, raw binary")
        out: list[Stats] = [Stats(np.zeros(len(y)), np.zeros_like(y, float), 0.0, 0.0) for y in ys]
        for c, raw in few.collect():  # DIRECT bytes, or PARTIALS rows per candidate, at most
            out[c] = out[c] + _stats(bytes(raw), sizes[c])
        return out

    def moments(self):
        if self._moments is not None:
            return self._moments
        arrays, width = _reader(self.dim, self.shift, self.turn), self.dim if self.turn is None else self.turn.shape[1]

        def row(held: tuple) -> pa.RecordBatch:
            raw = np.concatenate([np.ravel(v) for v in held]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([raw], pa.binary())], ["cand", "raw"])

        def unpacked(raw: bytes) -> tuple:
            v = np.frombuffer(raw)
            return v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for x, _ in arrays(batches):
                mean = x.mean(0)
                held = _merged(held, (float(len(x)), mean, (x - mean).T @ (x - mean)))
            if held is not None:
                yield row(held)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                for raw in b.column(1).to_pylist():
                    held = _merged(held, unpacked(raw))
            if held is not None:
                yield row(held)

        parts = self.blocks.mapInArrow(run, "cand int, raw binary").repartition(PARTIALS, F.spark_partition_id()).mapInArrow(add, "cand int, raw binary")
        held = None
        for r in parts.collect():  # PARTIALS rows at most
            held = _merged(held, unpacked(bytes(r[1])))
        n, mean, scatter = held
        self._moments = mean, scatter / max(n - 1, 1)
        return self._moments

    def sample(self, n, seed):
        share = min(1.0, 1.5 * n / max(self.count, 1) + 20 / max(self.count, 1))
        pick = (F.xxhash64("point_id", F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5) < share
        got = self.points.where(pick).orderBy(F.xxhash64("point_id", F.lit(seed + 1))).limit(n).select("x", "w").toArrow()
        x = np.stack([np.asarray(v) for v in got["x"].to_pylist()]) if got.num_rows else np.empty((0, self.dim))
        x = x - self.shift
        return x if self.turn is None else x @ self.turn

    def moved(self, shift, turn=None):
        if self.turn is not None:
            raise ValueError("a cloud is turned once")
        return SparkEngine(self.points, self.dim, self.count, self.shift + shift, turn, self.blocks)


def packed(points: DataFrame, dim: int) -> DataFrame:
    """``(kind, x, w)``: blocks of BLOCK coordinates as bytes, in single precision where that loses nothing, with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK // max(dim, 1))
        for b in batches:
            for i in range(0, len(b), rows):
                part = b.slice(i, rows)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    short = x.astype("<f4")
                kind = "<f4" if (short == x).all() else "<f8"
                raw, w = (short if kind == "<f4" else x.astype("<f8")).tobytes(), part.column(1).to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([raw], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["kind", "x", "w"])

    return points.select("x", "w").mapInArrow(run, "kind string, x binary, w binary")


def _reader(dim: int, shift: np.ndarray, turn: np.ndarray | None):
    """What gives the shifted and turned coordinates and the weights of each block."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for kind, raw, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x = np.frombuffer(raw.as_buffer(), kind).reshape(-1, dim) - shift
                yield (x if turn is None else x @ turn), np.frombuffer(w.as_buffer(), "<f8")

    return arrays


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and scatter matrices of two parts as those of the whole; nothing cancels far from the origin."""
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _rows(held: list[Stats | None]) -> pa.RecordBatch:
    known = [(c, np.concatenate([[s.spread, s.total], s.weight, s.sums.ravel()]).tobytes()) for c, s in enumerate(held) if s is not None]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in known], pa.int32()), pa.array([r for _, r in known], pa.binary())], ["cand", "raw"])


def _stats(raw: bytes, k: int) -> Stats:
    v = np.frombuffer(raw)
    return Stats(v[2 : 2 + k], v[2 + k :].reshape(k, -1), v[0], v[1])


class PointCloud:
    """``points (point_id, x array<double>, w double)`` with its size, cached while it is worked on.

    Rows whose vector is null, holds nulls or non-finite numbers, or has another
    dimension than most take no part; a null weight counts as 1.
    """

    def __init__(self, points: DataFrame):
        if "w" not in points.columns:
            points = points.withColumn("w", F.lit(1.0))
        fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        points = points.select("point_id", F.col("x").cast("array<double>").alias("x"), F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w")).where(F.col("x").isNotNull() & fine)
        sizes = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dim, self.count = (int(sizes[0][0]), int(sizes[0][1])) if sizes else (0, 0)
        self.points = points.where(F.size("x") == self.dim)

    @classmethod
    def of(cls, table: DataFrame, id_col: str, vector: str | list[str], weight: str | None = None) -> "PointCloud":
        """From a table with a vector column or one column per coordinate."""
        x = F.col(vector) if isinstance(vector, str) else F.array(*[F.col(c).cast("double") for c in vector])
        return cls(table.select(F.col(id_col).alias("point_id"), x.alias("x"), (F.col(weight) if weight else F.lit(1.0)).alias("w")))

    def engine(self, small: int = SMALL) -> Engine:
        if self.count * max(self.dim, 1) <= small:
            got = self.points.orderBy("point_id").toArrow()
            x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim) if got.num_rows else np.empty((0, self.dim))
            return LocalEngine(x, got["w"].to_numpy())
        return SparkEngine(self.points, self.dim, self.count)
