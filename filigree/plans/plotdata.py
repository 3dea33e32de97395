"""What plots are drawn from: places, layouts and shares as tables. Drawing is left to the caller."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.project import project
from ..operators.trajectories import label_shares
from .fit import signed


def node_axes(g: Graph, dims: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the nodes and the first principal axes of their places, in columns."""
    mean = g.y.mean(0)
    _, _, vt = np.linalg.svd(g.y - mean, full_matrices=False)
    return mean, signed(vt.T[:, :dims])


def scatter(points: DataFrame, g: Graph, dims: int = 2) -> DataFrame:
    """``(point_id, dim, value)``: points on the principal axes of the nodes."""
    mean, axes = node_axes(g, dims)
    long = points.select("point_id", F.posexplode("x").alias("i", "v"))
    table = points.sparkSession.createDataFrame([(i, d, float(axes[i, d]), float(mean[i])) for i in range(len(mean)) for d in range(dims)], "i int, dim int, a double, m double")
    return long.join(F.broadcast(table), "i").groupBy("point_id", "dim").agg(F.sum((F.col("v") - F.col("m")) * F.col("a")).alias("value"))


def layout(g: Graph, rounds: int = 300) -> np.ndarray:
    """Plane places whose distances follow the hops between nodes, by stress majorisation from a fixed start."""
    hops = np.full((g.k, g.k), np.inf)
    from ..operators.paths import bfs

    for i in range(g.k):
        for j, d in bfs(g, i)[1].items():
            hops[i, j] = d
    hops[~np.isfinite(hops)] = hops[np.isfinite(hops)].max() + 1
    w = 1 / np.maximum(hops, 1) ** 2
    np.fill_diagonal(w, 0)
    v = np.diag(w.sum(1)) - w
    inverse = np.linalg.pinv(v)
    angle = np.linspace(0, 2 * np.pi, g.k, endpoint=False)
    at = np.stack([np.cos(angle), np.sin(angle)], 1) * hops.max() / 2
    for _ in range(rounds):
        d = np.linalg.norm(at[:, None] - at, axis=2)
        b = -np.divide(w * hops, d, out=np.zeros_like(d), where=d > 0)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        at = inverse @ b @ at
    return at


def tree_view(points: DataFrame, g: Graph, scatter_share: float = 0.2, seed: int = 0) -> DataFrame:
    """``(point_id, px, py)``: points beside their projection on the layout, off it by the root of what their distance exceeds the 20 % quantile by."""
    at = layout(g)
    found = project(points, g).where("edge_id is not null")
    floor = found.agg(F.percentile_approx("d2_proj", 0.2, 10000)).first()[0] or 0.0
    rows = []
    for e, (a, b) in enumerate(g.edges.tolist()):
        v = at[b] - at[a]
        n = np.array([-v[1], v[0]]) / (np.linalg.norm(v) or 1.0)
        rows.append((e, *map(float, at[a]), *map(float, v), *map(float, n)))
    table = points.sparkSession.createDataFrame(rows, "edge_id int, ax double, ay double, vx double, vy double, nx double, ny double")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("edge_loc")))
    side = F.when(F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    off = F.sqrt(F.greatest(F.lit(0.0), F.col("d2_proj") - floor)) * scatter_share * side
    j = found.join(F.broadcast(table), "edge_id")
    return j.select("point_id", (F.col("ax") + u * F.col("vx") + off * F.col("nx")).alias("px"), (F.col("ay") + u * F.col("vy") + off * F.col("ny")).alias("py"))


def pies(assigned: DataFrame, label: str, g: Graph) -> DataFrame:
    """``(node_id, label, ratio, px, py)``: shares of labels per node and where the node is drawn."""
    spark: SparkSession = assigned.sparkSession
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(layout(g))], "node_id int, px double, py double")
    return label_shares(assigned, label).join(F.broadcast(places), "node_id")
