"""Points to nodes: nearest-node joins and what is summed over them.

Nodes are few and travel with the tasks; points are never shuffled for an
assignment.  The kernel measures an Arrow batch by one matrix product; the
expression form stays in the JVM and is what Catalyst can see through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cloud import nearest
from ..functions import vectors as V


def batch(b: pa.RecordBatch, column: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A vector column of a batch as a matrix, and which rows are fine.

    A row that is null, of another dimension, or holds nulls or numbers that are not finite is not; it holds zeros.
    """
    fine = pc.fill_null(pc.equal(pc.list_value_length(b.column(column)), dim), False).to_numpy(zero_copy_only=False)
    x = np.zeros((len(b), dim))
    x[fine] = b.column(column).filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    fine = fine & np.isfinite(x).all(1)
    x[~fine] = 0
    return x, fine


def nearest_node(points: DataFrame, y: np.ndarray, radius: float = np.inf, keep: list[str] | None = None) -> DataFrame:
    """``(point_id, node_id, d2)``: nearest node and squared distance; beyond ``radius`` node -1 and the radius squared.

    ``keep``: further columns of ``points`` to carry along, instead of a join by id afterwards.  A
    point that is null, of another dimension, or holds nulls or numbers that are not finite has a null node and distance.
    """
    dim, more = np.shape(y)[1], keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fine = batch(b, 1, dim)
            node, d2 = nearest(x, y, radius)
            found = [pa.array(node.astype(np.int32), mask=~fine), pa.array(d2, mask=~fine)]
            yield pa.RecordBatch.from_arrays([b.column(0), *found, *(b.column(2 + i) for i in range(len(more)))], ["point_id", "node_id", "d2", *more])

    kind = points.schema["point_id"].dataType.simpleString()
    kinds = "".join(f", `{c}` {points.schema[c].dataType.simpleString()}" for c in more)
    own = points.select("point_id", F.col("x").cast("array<double>").alias("_x"), *more)
    return own.mapInArrow(run, f"point_id {kind}, node_id int, d2 double{kinds}")


def nearest_node_expression(points: DataFrame, y: np.ndarray) -> DataFrame:
    """The same by expressions within the row, without a join."""
    nodes = F.array(*[F.struct(F.lit(i).alias("node_id"), F.array(*map(F.lit, map(float, v))).alias("y")) for i, v in enumerate(y)])
    best = F.array_min(F.transform(nodes, lambda n: F.struct(V.sqdist(F.col("x"), n["y"]).alias("d2"), n["node_id"].alias("node_id"))))
    return points.select("point_id", best.alias("b")).select("point_id", "b.node_id", "b.d2")


def distance_arrays(points: DataFrame, y: np.ndarray) -> DataFrame:
    """``(point_id, x, d2s)``: the squared distances to all nodes, kept for assignments after an edit; null for points without a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, fine = batch(b, 1, np.shape(y)[1])
                d = np.stack([((x - v) ** 2).sum(1) for v in y], 1)
                rows = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel(), mask=pa.array(~fine))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], ["point_id", "x", "d2s"])

    kind = points.schema["point_id"].dataType.simpleString()
    return points.select("point_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"point_id {kind}, x array<double>, d2s array<double>")


def reassign(known: DataFrame, edit: str, node: int | None = None, at: np.ndarray | None = None) -> DataFrame:
    """``(point_id, node_id, d2)`` after an edit of the nodes that ``known (point_id, x, d2s)`` was measured for.

    ``add`` appends a node at ``at``, ``move`` puts ``node`` there, ``remove`` drops ``node``; only the
    changed node is measured.
    """
    new = V.sqdist(F.col("x"), F.array(*map(F.lit, map(float, at)))) if at is not None else None
    d = F.col("d2s")
    if edit == "add":
        d = F.concat(d, F.array(new))
    elif edit == "move":
        d = F.transform(d, lambda v, i: F.when(i == node, new).otherwise(v))
    elif edit == "remove":
        d = F.filter(d, lambda v, i: i != node)
    else:
        raise ValueError(f"no such edit: {edit}")
    least = F.array_min("d")
    return known.select("point_id", d.alias("d")).select("point_id", (F.array_position("d", least) - 1).cast("int").alias("node_id"), least.alias("d2"))


def barycentric(points: DataFrame, y: np.ndarray, before: DataFrame | None = None) -> DataFrame:
    """``(point_id, node_id, d)`` by ``d2 / s + s``, ``s`` the spread of all coordinates of a node's points in the assignment before; null for points without a place."""
    before = before if before is not None else nearest_node(points, y)
    flat = points.join(before.where("node_id >= 0").select("point_id", "node_id"), "point_id").select("node_id", F.explode("x").alias("v"))
    rows = flat.groupBy("node_id").agg(F.stddev_pop("v").alias("s"), F.count("*").alias("n")).collect()  # a row per node
    spread = np.full(len(y), 1e-100)
    for r in rows:
        if r["n"] > len(y[0]):
            spread[r["node_id"]] = max(r["s"], 1e-100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, fine = batch(b, 1, np.shape(y)[1])
                d = np.stack([((x - v) ** 2).sum(1) for v in y], 1) / spread + spread
                node = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.astype(np.int32), mask=~fine), pa.array(d[np.arange(len(d)), node], mask=~fine)], ["point_id", "node_id", "d"])

    kind = points.schema["point_id"].dataType.simpleString()
    return points.select("point_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"point_id {kind}, node_id int, d double")


def coordinates(points: DataFrame, *keep: str) -> DataFrame:
    """Long form: ``(keep..., dim, v)``."""
    return points.select(*keep, F.posexplode("x").alias("dim", "v"))


def node_means(assigned: DataFrame, k: int | None = None, w: Column | None = None) -> DataFrame:
    """``(node_id, dim, center, rel_size)`` of ``assigned (node_id, x, w)``.

    Trimmed points (node -1) have no centre, but their weight counts in the
    whole; points without a place (a null node) take no part.  With ``k`` nodes without points are listed with size 0 and centre 0.
    """
    w = F.col("w") if w is None else w
    total = assigned.where("node_id is not null").agg(F.sum(w).alias("_all"))
    sums = assigned.where("node_id >= 0").select("node_id", w.alias("_w"), F.posexplode("x").alias("dim", "v")).groupBy("node_id", "dim").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("center"), F.sum("_w").alias("_n"))
    if k is not None:
        spark = assigned.sparkSession
        grid = spark.range(k).select(F.col("id").cast("int").alias("node_id")).crossJoin(sums.select("dim").distinct())
        sums = grid.join(sums, ["node_id", "dim"], "left").fillna({"center": 0.0, "_n": 0.0})
    return sums.crossJoin(F.broadcast(total)).select("node_id", "dim", "center", (F.col("_n") / F.col("_all")).alias("rel_size"))


def to_matrix(means: DataFrame, k: int) -> np.ndarray:
    """The centres of ``node_means`` as a matrix on the driver: a row per node."""
    rows = means.select("node_id", "dim", "center").collect()
    y = np.zeros((k, 1 + max((r["dim"] for r in rows), default=-1)))
    for r in rows:
        y[r["node_id"], r["dim"]] = r["center"]
    return y


def radial_count(points: DataFrame, y: np.ndarray, radii: list[float]) -> DataFrame:
    """``(radius, n_pairs)``: pairs of a point and a node that are closer than each radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(radii), np.int64)
        for b in batches:
            if len(b):
                x, fine = batch(b, 0, np.shape(y)[1])
                x = x[fine]
                d = np.stack([((x - v) ** 2).sum(1) for v in y], 1)
                n += np.array([(d < r * r).sum() for r in radii])
        yield pa.RecordBatch.from_arrays([pa.array(radii, pa.float64()), pa.array(n)], ["radius", "n"])

    return points.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "radius double, n long").groupBy("radius").agg(F.sum("n").alias("n_pairs"))
