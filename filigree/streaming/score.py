"""Scoring streams: the graph is static and small, so scoring is stateless and maps over micro-batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cloud import Stats
from ..graph import Graph
from ..operators.assign import nearest_node
from ..operators.paths import pseudotime
from ..operators.project import project
from ..plans.embed import solve


def score(points: DataFrame, g: Graph) -> DataFrame:
    """Projection of a stream (or table) ``(point_id, x)``: see ``operators.project.project``."""
    return project(points, g)


def score_pseudotime(points: DataFrame, g: Graph, source: int, target: int | None = None) -> DataFrame:
    """``(point_id, pt)`` of a stream: the joins are with small static tables."""
    return pseudotime(project(points, g), g, source, target)


class Drift:
    """Sums per node over the micro-batches of a stream, and a step of the graph towards them.

    ``update`` is what ``foreachBatch`` takes.  ``decay`` below 1 lets old batches fade.
    A batch that is delivered again is counted once.  With a ``path`` in a shared folder the sums and positions are
    stored with the batch's number, by turns in two tables, and a new object goes on from there after a restart.
    Points without a place take no part.
    """

    def __init__(self, g: Graph, decay: float = 1.0, path: str | None = None):
        self.graph, self.decay, self.last, self.path = g, decay, -1, path
        self.stats = Stats(np.zeros(g.k), np.zeros_like(g.y), 0.0, 0.0)
        if path is not None:
            self._restore()

    def _store(self, spark: SparkSession) -> None:
        s = self.stats
        row = (self.last, [float(v) for v in np.concatenate([[s.spread, s.total], s.weight, s.sums.ravel(), self.graph.y.ravel()])])
        spark.createDataFrame([row], "batch long, state array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.last % 2}")

    def _restore(self) -> None:
        spark, k, shape, best = SparkSession.active(), self.graph.k, self.graph.y.shape, None
        for turn in (0, 1):
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{turn}/_SUCCESS")  # a write that broke off has none
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                row = spark.read.parquet(f"{self.path}/{turn}").first()
                best = row if best is None or row["batch"] > best["batch"] else best
        if best is not None:
            v, n = np.array(best["state"]), self.graph.y.size
            self.last = best["batch"]
            self.stats = Stats(v[2 : 2 + k], v[2 + k : 2 + k + n].reshape(shape), v[0], v[1])
            self.graph = self.graph.with_positions(v[2 + k + n :].reshape(shape))

    def update(self, points: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        own = nearest_node(points, self.graph.y, keep=["x"]).where("node_id >= 0")
        long = own.select("node_id", "d2", F.posexplode("x").alias("dim", "v"))
        rows = long.groupBy("node_id", "dim").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.sum("d2").alias("d")).collect()  # nodes times dimensions
        new = Stats(np.zeros(self.graph.k), np.zeros_like(self.graph.y), 0.0, 0.0)
        for r in rows:
            new.sums[r["node_id"], r["dim"]] = r["s"]
            new.weight[r["node_id"]] = r["n"]
            new.spread += r["d"] if r["dim"] == 0 else 0.0
        new.total = float(new.weight.sum())
        old = self.stats
        self.stats = Stats(old.weight * self.decay, old.sums * self.decay, old.spread * self.decay, old.total * self.decay) + new
        self.last = batch_id
        if self.path is not None:
            self._store(points.sparkSession)

    def step(self) -> Graph:
        """The graph after one solve with the sums so far."""
        if self.stats.total:
            self.graph = self.graph.with_positions(solve(self.graph, self.stats))
        return self.graph


def occupancy(points: DataFrame, y: np.ndarray, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, end, node_id, n)`` of a stream ``(point_id, ts, x)``: points per node and window; later than the watermark is left out."""
    own = points.withColumn("b", F.struct("point_id", "ts"))
    ids = own.select(F.col("b").alias("point_id"), "x")
    scored = nearest_struct(ids, y).select("point_id.ts", "node_id")
    counts = scored.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "node_id").agg(F.count("*").alias("n"))
    return counts.select("w.start", "w.end", "node_id", "n")


def nearest_struct(points: DataFrame, y: np.ndarray) -> DataFrame:
    """Nearest node by expressions, so that the watermark's column passes through unchanged."""
    from ..operators.assign import nearest_node_expression

    return nearest_node_expression(points, y)
