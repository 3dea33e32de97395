"""Points to edges: projection on the graph, and reports on how well it fits.

A point is projected on the edges at its nearest node only, the nearest
projection wins, of equally near ones the first edge.  Both steps run on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cloud import nearest
from ..functions import vectors as V
from ..graph import Energy, Graph, energy
from .assign import batch

#: Decimals to which distances are compared where edges that share a node tie.
TIES = 9


def project_batch(x: np.ndarray, g: Graph, radius: float = np.inf) -> tuple[np.ndarray, ...]:
    """Node, squared distance to it, edge, share along it, squared distance to it, and place, of every row.

    Rows beyond ``radius`` have node -1, edge -1, share NaN and infinite distance.
    """
    node, d2 = nearest(x, g.y, radius)
    edge, loc, best = np.full(len(x), -1), np.full(len(x), np.nan), np.full(len(x), np.inf)
    place = np.full(x.shape, np.nan)
    for e, (a, b) in enumerate(g.edges.tolist()):
        at = np.nonzero((node == a) | (node == b))[0]
        if not len(at):
            continue
        v = g.y[b] - g.y[a]
        length = v @ v
        u = (x[at] - g.y[a]) @ v / length if length > 0 else np.zeros(len(at))
        foot = np.where((u <= 0)[:, None], g.y[a], np.where((u >= 1)[:, None], g.y[b], g.y[a] + u[:, None] * v))
        d = ((x[at] - foot) ** 2).sum(1)
        better = np.round(d, TIES) < np.round(best[at], TIES)
        own = at[better]
        edge[own], loc[own], best[own], place[own] = e, u[better], d[better], foot[better]
    return node, d2, edge, loc, best, place


def project(points: DataFrame, g: Graph, radius: float = np.inf) -> DataFrame:
    """``(point_id, node_id, d2, edge_id, edge_loc, d2_proj, x_proj)`` of every point; no edge is null.

    All is null for a point that is null, of another dimension, or holds nulls or numbers that are not finite.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, fine = batch(b, 1, g.y.shape[1])
                node, d2, edge, loc, best, place = project_batch(x, g, radius)
                off = (edge < 0) | ~fine
                rows = pa.ListArray.from_arrays(np.arange(0, place.size + 1, place.shape[1], dtype=np.int32), place.ravel(), mask=pa.array(~fine))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(node.astype(np.int32), mask=~fine), pa.array(d2, mask=~fine), pa.array(edge.astype(np.int32), mask=off), pa.array(loc, mask=off), pa.array(best, mask=off), rows],
                    ["point_id", "node_id", "d2", "edge_id", "edge_loc", "d2_proj", "x_proj"],
                )

    kind = points.schema["point_id"].dataType.simpleString()
    return points.select("point_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"point_id {kind}, node_id int, d2 double, edge_id int, edge_loc double, d2_proj double, x_proj array<double>")


def project_join(assigned: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by expressions: ``(point_id, edge_id, edge_loc, d2_proj)`` of ``assigned (point_id, x, node_id)``.

    ``nodes (node_id, y)`` and ``edges (edge_id, src, dst)`` are graph-sized: a node's edges are one row of a broadcast
    table, so points stay where they are.  Points without a node, or at a node without edges, give no row.
    """
    ends = edges.join(nodes.select(F.col("node_id").alias("src"), F.col("y").alias("ya")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("y").alias("yb")), "dst")
    ends = ends.withColumn("node_id", F.explode(F.array("src", "dst"))).groupBy("node_id").agg(F.collect_list(F.struct("edge_id", "ya", "yb")).alias("ends"))

    # The share is bound in a step of its own: within the expression of the place it would be worked out per dimension.
    share = lambda e: F.struct(V.edge_share(F.col("x"), e["ya"], e["yb"]).alias("u"), e.alias("e"))

    def tried(s):
        e = s["e"]
        d = V.sqdist(F.col("x"), V.between(e["ya"], e["yb"], V.clamp(s["u"])))
        return F.struct(F.round(d, TIES).alias("near"), e["edge_id"].alias("edge_id"), s["u"].alias("u"), d.alias("d"))

    at = assigned.join(F.broadcast(ends), "node_id").select("point_id", F.array_min(F.transform(F.transform("ends", share), tried)).alias("b"))
    return at.select("point_id", "b.edge_id", F.col("b.u").alias("edge_loc"), F.col("b.d").alias("d2_proj"))


def fit_report(points: DataFrame, g: Graph, radius: float = np.inf, kind: str = "Base") -> tuple[dict, Energy]:
    """The report row of a graph against a cloud: errors to nodes and to edges and their shares of the variance.

    ``points (point_id, x, w)``; points beyond the radius count with the radius at their node, not at edges.
    Points without a place take no part.  One pass; per task one row comes back.  The variance is summed around the
    mean of the nodes, so that a cloud far from the origin loses no digits.
    """
    from ..plans.fit import report_row

    m, middle = g.y.shape[1], g.y.mean(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros(6 + 2 * m)
        for b in batches:
            if len(b):
                x, fine = batch(b, 0, m)
                x, w = x[fine], b.column(1).to_numpy(zero_copy_only=False)[fine]
                _, d2, _, _, best, _ = project_batch(x, g, radius)
                on = np.isfinite(best)
                s[:6] += len(x), w.sum(), (w * d2).sum(), w[on].sum(), (w[on] * best[on]).sum(), 0
                s[6 : 6 + m] += (x - middle).sum(0)
                s[6 + m :] += ((x - middle) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(s)], ["i", "v"])

    sums = points.select(F.col("x").cast("array<double>").alias("x"), F.col("w").cast("double").alias("w")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    s = np.zeros(6 + 2 * m)
    for r in sums:
        s[r["i"]] = r["v"]
    n, mean = s[0], s[6 : 6 + m] / s[0]
    variance = float(((s[6 + m :] - n * mean**2) / max(n - 1, 1)).sum())
    e = energy(g, s[2] / s[1], kind)
    return report_row(g, e, variance, s[4] / s[3] if s[3] else None), e
