"""Edits of a fitted graph: leaves extended, branches collapsed or shifted, paths added, found and deleted.

What has a row per point runs as DataFrame aggregates; the graph is rewired on
the driver.  ``points (point_id, x, w)`` throughout.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cloud import Engine, LocalEngine, PointCloud
from ..functions import plane
from ..graph import Graph, uniform, uniform_with_cycle
from ..plans import topologies
from ..plans.embed import Rules
from . import paths as P
from .assign import nearest_node
from .project import project
from .trajectories import leaf_points

#: Points of a pair of nodes that a new path is fitted to on the driver, at most.
LOCAL = 100_000
#: Parts that the candidates of a leaf are dealt in at most; pairs of candidates and points measured at once.
TRIED, END_PAIRS = 24, 1 << 19


def segment_distance2(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to the segment from ``a`` to ``b``."""
    v = b - a
    length = v @ v
    u = np.clip((x - a) @ v / length, 0, 1) if length > 0 else np.zeros(len(x))
    return ((x - a - u[:, None] * v) ** 2).sum(1)


def end_costs(x: np.ndarray, a: np.ndarray, ends: np.ndarray, par: float) -> np.ndarray:
    """For each of ``ends`` the quantile ``par`` of the squared distances of the rows to its segment from ``a``.

    Distances come from one product for some ends at a time; ends as good as the least but for rounding are
    measured anew by their segments, so that the first of equals is the least.
    """
    p, q = x - a, ends - a
    p2, q2, cost = (p**2).sum(1), (q**2).sum(1), np.empty(len(ends))
    few = max(1, END_PAIRS // max(1, len(x)))
    for i in range(0, len(ends), few):
        dot, length = q[i : i + few] @ p.T, q2[i : i + few, None]
        u = np.clip(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), 0, 1)
        cost[i : i + few] = quantiles(p2 + u * (u * length - 2 * dot), par)
    for i in np.flatnonzero(cost <= cost.min() + 1e-9 * (1 + p2.max() + q2.max())):
        cost[i] = np.quantile(segment_distance2(x, a, ends[i]), par)
    return cost


def quantiles(rows: np.ndarray, par: float) -> np.ndarray:
    """The quantile of each row, interpolated as numpy does, without a full sort."""
    at = par * (rows.shape[1] - 1)
    low = int(np.floor(at))
    high = min(low + 1, rows.shape[1] - 1)
    rows.partition((low, high), axis=1)
    return rows[:, low] + (rows[:, high] - rows[:, low]) * (at - low)


def anneal(objective, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Simulated annealing in a box: Gaussian steps that shrink as it cools."""
    rng, at, cost = np.random.default_rng(seed), start.copy(), objective(start)
    best, best_cost, span = at, cost, np.maximum(high - low, 1e-12)
    for i in range(rounds):
        heat = max(1 - i / rounds, 1e-3)
        new = np.clip(at + rng.normal(0, 0.25 * heat, len(at)) * span, low, high)
        c = objective(new)
        if c < cost or rng.random() < np.exp(-(c - cost) / max(heat * 0.1 * abs(best_cost), 1e-12)):
            at, cost = new, c
            if c < best_cost:
                best, best_cost = new, c
    return best


def extended_ends(points: DataFrame, g: Graph, mode: str = "QuantDists", par: float = 0.9, anneal_rounds: int = 2000, leaves: list[int] | None = None, radius: float = np.inf, seed: int = 0) -> DataFrame:
    """``(leaf, dim, value)``: where each leaf that has points beyond it is extended to.

    ``QuantCentroid``: mean of the points at least as far from the leaf as the
    quantile ``par`` of their distances; ``WeightedCentroid``: mean with weights
    ``d2 ** (2 par)`` over the largest; both are aggregates.  ``QuantDists``: the
    point (or the place that annealing finds from it) for which the quantile of the distances to
    the new segment is least.  Every point is tried: candidates are dealt over tasks, each with all of the leaf's
    points, so work follows their square; annealing from the best one runs in a task per leaf.
    """
    beyond = leaf_points(project(points, g, radius), g, leaves).select("point_id", "leaf", "d2").join(points.select("point_id", "x"), "point_id")
    if mode == "QuantCentroid":
        cut = beyond.groupBy("leaf").agg(F.percentile("d2", F.lit(float(par))).alias("q"))
        chosen = beyond.join(F.broadcast(cut), "leaf").where(F.col("d2") >= F.col("q") - 1e-12)
        return chosen.select("leaf", F.posexplode("x").alias("dim", "v")).groupBy("leaf", "dim").agg(F.avg("v").alias("value"))
    if mode == "WeightedCentroid":
        top = beyond.groupBy("leaf").agg(F.max(F.pow("d2", F.lit(2.0 * par))).alias("t"))
        weighted = beyond.join(F.broadcast(top), "leaf").withColumn("w", F.pow("d2", F.lit(2.0 * par)) / F.col("t"))
        long = weighted.select("leaf", "w", F.posexplode("x").alias("dim", "v"))
        return long.groupBy("leaf", "dim").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    if mode != "QuantDists":
        raise ValueError(f"no such mode: {mode}")

    def read(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        ids, x = rows.column("point_id").to_numpy(), rows.column("x").combine_chunks()
        order = np.argsort(ids, kind="stable")
        return rows.column("leaf")[0].as_py(), ids[order], x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]

    def tried(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The candidates of a part that may be best of it, by one product per few of them."""
        if not asked.num_rows:
            return pa.table({"leaf": pa.array([], pa.int32()), "best": pa.array([], pa.int64()), "cost": pa.array([], pa.float64())})
        leaf, ids, b = read(asked)
        x = read(rows)[2]
        cost = end_costs(x, g.y[leaf], b, par)
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "best": pa.array(ids[[cost.argmin()]], pa.int64()), "cost": pa.array([cost.min()], pa.float64())})

    def one(rows: pa.Table) -> pa.Table:
        leaf, ids, x = read(rows)
        a = g.y[leaf]
        cost = lambda b: float(np.quantile(segment_distance2(x, a, b), par))
        best = x[np.searchsorted(ids, rows.column("best")[0].as_py())]
        if anneal_rounds:
            best = anneal(cost, best, x.min(0), x.max(0), anneal_rounds, seed + leaf)
        return pa.table({"leaf": pa.array([leaf] * len(best), pa.int32()), "dim": pa.array(range(len(best)), pa.int32()), "value": pa.array(best, pa.float64())})

    beyond = beyond.select(F.col("point_id").cast("long").alias("point_id"), F.col("leaf").cast("int").alias("leaf"), F.col("x").cast("array<double>").alias("x"))
    parts = F.broadcast(beyond.groupBy("leaf").agg(F.greatest(F.lit(1), F.least(F.lit(TRIED), F.ceil(F.count("*") / 64))).cast("int").alias("parts")))  # a row per leaf
    dealt = lambda df: df.select("point_id", "leaf", "x", "part").repartition(4 * TRIED, "leaf", "part").groupBy("leaf", "part")
    asked = beyond.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("point_id", "x"), "parts").cast("int"))
    again = beyond.select([F.col(c).alias(c) for c in beyond.columns]).join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = dealt(asked).cogroup(dealt(again)).applyInArrow(tried, "leaf int, best long, cost double")
    best = found.groupBy("leaf").agg(F.min_by("best", F.struct("cost", "best")).alias("best"))
    return beyond.join(F.broadcast(best), "leaf").groupBy("leaf").applyInArrow(one, "leaf int, dim int, value double")


def extend_leaves(points: DataFrame, g: Graph, lam: float | None = None, mu: float | None = None, **kwargs) -> Graph:
    """The graph with a node beyond each leaf that has points there; leaves without such points stay."""
    rows = extended_ends(points, g, **kwargs).collect()  # a row per leaf and dimension
    ends: dict[int, np.ndarray] = {}
    for r in rows:
        ends.setdefault(r["leaf"], np.zeros(g.y.shape[1]))[r["dim"]] = r["value"]
    order = sorted(ends)
    if not order:
        return g
    links = np.array([[leaf, g.k + i] for i, leaf in enumerate(order)])
    near = g.neighbours()
    bend = g.mu.copy()
    for leaf in order:
        bend[leaf] = mu if mu is not None else g.mu[near[leaf][0]]
    new_lam = np.full(len(order), lam if lam is not None else g.lam.mean())
    return Graph(np.vstack([g.y, [ends[i] for i in order]]), np.vstack([g.edges, links]), np.append(g.lam, new_lam), np.append(bend, np.zeros(len(order))))


def branch_stats(projected: DataFrame, g: Graph) -> DataFrame:
    """``(branch_id, n_points, n_inner, n_leaf, n_edges, length)``.

    ``n_points``: points whose edge is the branch's; ``n_inner``: those that fall within an edge
    rather than on a branch's end; ``n_leaf``: points whose node is the branch's leaf.
    """
    spark, found, degree, lengths = projected.sparkSession, P.branches(g), g.degrees(), g.edge_lengths()
    number = {tuple(e): i for i, e in enumerate(g.edges.tolist())}
    edges, leaves, sizes = [], [], []
    for b, path in enumerate(found):
        own = [number[min(p, q), max(p, q)] for p, q in zip(path, path[1:])]
        sizes.append((b, len(own), float(lengths[own].sum())))
        edges += [(e, b) for e in own]
        leaves += [(int(n), b) for n in (path[0], path[-1]) if degree[n] == 1]
    at = projected.join(F.broadcast(spark.createDataFrame(edges, "edge_id int, branch_id int")), "edge_id")
    inside = ((F.col("edge_loc") > 0) & (F.col("edge_loc") < 1)).cast("int")
    per = at.groupBy("branch_id").agg(F.count("*").alias("n_points"), F.sum(inside).alias("n_inner"))
    on_leaf = projected.join(F.broadcast(spark.createDataFrame(leaves, "node_id int, branch_id int")), "node_id").groupBy("branch_id").agg(F.count("*").alias("n_leaf"))
    out = spark.createDataFrame(sizes, "branch_id int, n_edges int, length double").join(per, "branch_id", "left").join(on_leaf, "branch_id", "left")
    return out.na.fill(0, ["n_points", "n_inner", "n_leaf"]).select("branch_id", "n_points", "n_inner", "n_leaf", "n_edges", "length")


#: What a branch is measured by in each mode, and whether leaves alone are looked at.
COLLAPSE = {"PointNumber": ("n_points", False), "PointNumber_Extrema": ("n_inner", False), "PointNumber_Leaves": ("n_leaf", True), "EdgesNumber": ("n_edges", False), "EdgesLength": ("length", False)}


def collapse_branches(points: DataFrame, g: Graph, mode: str = "PointNumber", par: float = 5, radius: float = np.inf) -> Graph:
    """The graph without branches that measure less than ``par``: ends are cut off, bridges are contracted to the centre of their points' nodes."""
    column, leaves_only = COLLAPSE[mode]
    measured = {r["branch_id"]: r[column] for r in branch_stats(project(points, g, radius), g).collect()}
    degree, found = g.degrees(), P.branches(g)
    drop, merge = set(), []
    for b, path in enumerate(found):
        end = degree[path[0]] == 1 or degree[path[-1]] == 1
        if measured[b] >= par or (leaves_only and not end) or len(found) == 1:
            continue
        if end:
            drop |= {n for n in path if degree[n] <= 2}
        else:
            merge.append(path)
    group = np.arange(g.k)
    for path in merge:
        least = min(group[n] for n in path)
        for old in {group[n] for n in path}:
            group[group == old] = least
    keep = [i for i in sorted(set(group.tolist())) if i not in drop]
    if len(keep) < 2:
        return g
    y = np.array([g.y[(group == i)].mean(0) for i in keep])
    mu = np.array([g.mu[group == i].max() for i in keep])
    number = {i: n for n, i in enumerate(keep)}
    edges: dict[tuple[int, int], float] = {}
    for (a, b), v in zip(g.edges.tolist(), g.lam):
        a, b = group[a], group[b]
        if a != b and a in number and b in number:
            p, q = sorted((number[a], number[b]))
            edges[p, q] = max(v, edges.get((p, q), 0.0))
    out = Graph(y, np.array(list(edges)), np.array(list(edges.values())), mu)
    largest = max(P.components(out), key=len)
    return out if len(largest) == out.k else out.relabelled(np.array(largest))


def shift_targets(points: DataFrame, g: Graph, mode: str = "NodePoints", density_radius: float | None = None, most: int = 3, junctions: list[int] | None = None, radius: float = np.inf) -> DataFrame:
    """``(node_id, target, hops, value)``: for each junction the node within ``most`` hops with the most points, or the most within ``density_radius``.

    Of equal ones the nearest in hops, then the smallest.  A path to the target passes no other junction.
    """
    spark = points.sparkSession
    if mode == "NodePoints":
        value = nearest_node(points, g.y, radius).where("node_id >= 0").groupBy("node_id").agg(F.count("*").alias("value"))
    elif mode == "NodeDensity":
        if density_radius is None:
            raise ValueError("NodeDensity needs density_radius")
        from .assign import distance_arrays

        close = F.explode(F.filter(F.transform("d2s", lambda v, i: F.when(v < density_radius**2, i).otherwise(-1)), lambda i: i >= 0))
        value = distance_arrays(points, g.y).select(close.alias("node_id")).groupBy("node_id").agg(F.count("*").alias("value"))
    else:
        raise ValueError(f"no such mode: {mode}")
    degree, rows = g.degrees(), []
    for j in junctions if junctions is not None else np.nonzero(degree > 2)[0].tolist():
        _, depth, parent = P.bfs(g, j)
        for n, h in depth.items():
            if h <= most and (n == j or degree[n] <= 2):
                up, fine = n, True
                while up != j:
                    up = parent[up]
                    fine &= up == j or degree[up] <= 2
                if fine:
                    rows.append((int(j), int(n), int(h)))
    near = spark.createDataFrame(rows, "junction int, node_id int, hops int").join(value, "node_id", "left").na.fill(0, ["value"])
    best = F.min_by(F.struct("node_id", "hops", "value"), F.struct(-F.col("value"), "hops", "node_id"))
    return near.groupBy("junction").agg(best.alias("b")).select(F.col("junction").alias("node_id"), F.col("b.node_id").alias("target"), "b.hops", "b.value")


def shift_branching(points: DataFrame, g: Graph, mode: str = "NodePoints", targets: dict[int, int] | None = None, **kwargs) -> Graph:
    """The graph with each junction's branches moved to its target (``targets`` for mode Manual)."""
    if mode != "Manual":
        targets = {r["node_id"]: r["target"] for r in shift_targets(points, g, mode, **kwargs).collect()}
    edges, lam = {tuple(e): v for e, v in zip(g.edges.tolist(), g.lam)}, g.lam.mean()
    mu = g.mu.copy()
    for j, t in sorted((targets or {}).items()):
        if j == t:
            continue
        now = Graph(g.y, np.array(list(edges)), np.array(list(edges.values())), mu)
        path = P.shortest_path(now, j, t)
        for n in now.neighbours()[j]:
            if n != path[1] and n != t:
                edges.pop((min(j, n), max(j, n)))
                edges[min(t, n), max(t, n)] = lam
        mu[t] = max(mu[t], mu[j])
        if len(path) > 2 or j != path[0]:
            kept = now.neighbours()[j]
            if len(kept) == 1:
                mu[j] = 0.0
    return Graph(g.y, np.array(list(edges)), np.array(list(edges.values())), mu)


def _points_of(points: DataFrame, g: Graph, nodes: list[int]) -> LocalEngine:
    """The points of a few nodes on the driver; an error where they are too many for one path."""
    own = points.join(nearest_node(points, g.y).where(F.col("node_id").isin([int(n) for n in nodes])).select("point_id"), "point_id", "left_semi")
    got = own.select("x", "w").limit(LOCAL + 1).toArrow()
    if got.num_rows > LOCAL:
        raise ValueError(f"more than {LOCAL} points at nodes {nodes}; fit a finer graph first")
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, g.y.shape[1])
    return LocalEngine(x, got["w"].to_numpy())


def splice(g: Graph, path: np.ndarray, source: int, target: int | None, lam: float, mu: float) -> tuple[Graph, list[int]]:
    """The graph with new nodes ``path`` between two nodes (or from one on); the new path's nodes in order."""
    new = list(range(g.k, g.k + len(path)))
    chain = [source, *new] + ([target] if target is not None else [])
    links = np.array(list(zip(chain, chain[1:])))
    mus = np.append(g.mu, np.full(len(new), mu))
    for n in (source, target):
        if n is not None:
            mus[n] = max(mus[n], mu)
    if target is None:
        mus[new[-1]] = 0.0
    return Graph(np.vstack([g.y, path]) if len(path) else g.y, np.vstack([g.edges, links]), np.append(g.lam, np.full(len(links), lam)), mus), chain


def fit_between(cloud: Engine, a: np.ndarray, b: np.ndarray, inner: int, lam: float, mu: float) -> np.ndarray:
    """Positions of ``inner`` nodes of a curve from ``a`` to ``b`` through a cloud, both ends fixed."""
    y = np.vstack([a, b, a + np.linspace(0, 1, inner + 2)[1:-1, None] * (b - a)])
    chain = [0, *range(2, inner + 2), 1]
    g = uniform(y, np.array(list(zip(chain, chain[1:]))), lam, mu)
    if not cloud.count:
        return y[2:]
    from ..plans.embed import embed

    return embed(cloud, [g], Rules(fixed=2))[0].graph.y[2:]


def crosses_itself(g: Graph) -> bool:
    """Whether two edges without a common node cross in the first two dimensions."""
    return len(plane.remove_crossings(g.y[:, :2], g.edges)[0]) > g.k


def add_path(points: DataFrame, g: Graph, source: int, target: int | np.ndarray, n_nodes: int = 6, refit: bool = False, lam: float = 0.01, mu: float = 0.1, cycle_lam: float = 0.01, cycle_mu: float = 0.1, allow_crossing: bool = False) -> Graph:
    """The graph with a curve fitted from a node to another one, or to a place; an error if it then crosses itself."""
    at_node = np.ndim(target) == 0
    end = g.y[int(target)] if at_node else np.asarray(target, float)
    cloud = _points_of(points, g, [source, int(target)] if at_node else [source])
    path = fit_between(cloud, g.y[source], end, n_nodes, lam, mu)
    new, chain = splice(g, path if at_node else np.vstack([path, end]), source, int(target) if at_node else None, lam, mu)
    if not allow_crossing and crosses_itself(new) and not crosses_itself(g):
        raise ValueError("the new path crosses the graph")
    return refit_graph(points, new, lam=lam, mu=mu, cycle_lam=cycle_lam, cycle_mu=cycle_mu) if refit else new


def path_nodes(g: Graph, source: int, target: int, include: list[int] | None = None) -> list[int]:
    return P.simple_path_through(g, source, target, include) if include else P.shortest_path(g, source, target)


def delete_path(g: Graph, source: int, target: int, include: list[int] | None = None) -> Graph:
    """The graph without the edges of the path, nodes that are left alone dropped and the rest numbered anew."""
    path = path_nodes(g, source, target, include)
    gone = {(min(a, b), max(a, b)) for a, b in zip(path, path[1:])}
    keep = np.array([tuple(e) not in gone for e in g.edges.tolist()], bool)
    left = np.unique(g.edges[keep])
    if not len(left):
        raise ValueError("nothing would be left of the graph")
    return Graph(g.y, g.edges[keep], g.lam[keep], g.mu).relabelled(left)


def refit_graph(points: DataFrame, g: Graph, held: dict[int, np.ndarray] | None = None, lam: float | None = None, mu: float | None = None, cycle_lam: float | None = None, cycle_mu: float | None = None) -> Graph:
    """The graph embedded anew, with given nodes moved and held, and its own elasticity on cycles if asked for."""
    if lam is not None:
        on = sorted({n for c in P.cycles(g) for n in c})
        g = uniform_with_cycle(g.y, g.edges, lam, mu or 0.0, cycle_lam if cycle_lam is not None else lam, cycle_mu if cycle_mu is not None else (mu or 0.0), on)
    return topologies.refit(PointCloud(points).engine(), g, Rules(), held).graph


@dataclass
class Loop:
    """A path that closes a loop, and how good it is."""

    source: int
    target: int
    path: np.ndarray
    msep: float
    inner: float
    compactness: float
    points: frozenset


def find_paths(
    points: DataFrame, g: Graph, min_path_len: int | None = None, n_nodes: int | None = None, max_inner_fraction: float = 0.1, min_node_points: int = 2, max_points: int | None = None, min_compactness: float = 0.5,
    radius: float | None = None, allow_same_branch: bool = True, fit_loops: bool = True, lam: float = 0.01, mu: float = 0.1, cycle_lam: float = 0.01, cycle_mu: float = 0.1, ignore_equivalent: bool = False,
) -> Graph | None:
    """Looks for paths from leaves that close loops the cloud really has; None if there is none.

    Each leaf is tried with every node within ``radius`` whose way over the
    graph is longer than ``min_path_len``.  A loop counts if few points lie inside it,
    every new node has points, and it is compact; the best per leaf stays, and of loops that share two thirds of
    their points the better one.  ``points`` of this search fit on the driver (see PointCloud.engine).
    """
    cloud = PointCloud(points).engine()
    if not isinstance(cloud, LocalEngine):
        raise ValueError("the search for loops works on a sample that fits the driver; sample the cloud first")
    x, k = cloud.x, g.k
    radius = float(g.edge_lengths().mean() * k / 10) if radius is None else radius
    min_path_len = k // 5 if min_path_len is None else min_path_len
    max_points = int(0.05 * len(x)) if max_points is None else max_points
    n_nodes = int(np.clip(k // 3, 6, 16)) if n_nodes is None else n_nodes
    mean, axes, _ = topologies.principal_axes(cloud, min(2, cloud.dim))
    flat = lambda v: (v - mean) @ axes
    from ..cloud import nearest

    node, _ = nearest(x, g.y)
    branch = P.branches(g)
    best: dict[int, Loop] = {}
    for leaf in np.nonzero(g.degrees() == 1)[0].tolist():
        for other in range(k):
            if other == leaf or np.linalg.norm(g.y[leaf] - g.y[other]) > radius:
                continue
            way = P.shortest_path(g, leaf, other)
            if len(way) <= min_path_len or (not allow_same_branch and any({leaf, other} <= set(b) for b in branch)):
                continue
            own = LocalEngine(x[np.isin(node, [leaf, other])])
            new, chain = splice(g, fit_between(own, g.y[leaf], g.y[other], n_nodes, lam, mu), leaf, other, lam, mu)
            ring = way + chain[1:-1][::-1]
            new = uniform_with_cycle(new.y, new.edges, lam, mu, cycle_lam, cycle_mu, ring)
            new = topologies.refit(cloud, new, Rules()).graph
            loop = _judge(x, flat, new, g.k, ring, leaf, other)
            fine = loop is not None and loop.inner <= max_inner_fraction and loop.compactness >= min_compactness
            if fine and min(np.bincount(nearest(x, new.y)[0], minlength=new.k)[g.k :], default=0) >= min_node_points and _inside(x, flat, new, ring) <= max_points:
                if leaf not in best or loop.msep < best[leaf].msep:
                    best[leaf] = loop
    loops = sorted(best.values(), key=lambda v: v.msep)
    if not ignore_equivalent:
        loops = distinct_loops(loops)
    if not loops:
        return None
    out = g
    for loop in loops:
        out, _ = splice(out, loop.path, loop.source, loop.target, lam, mu)
    if fit_loops:
        out = refit_graph(points, out, lam=lam, mu=mu, cycle_lam=cycle_lam, cycle_mu=cycle_mu)
        if cloud.dim == 2:
            y, edges = plane.remove_crossings(out.y, out.edges)
            out = out if len(y) == out.k else uniform(y, edges, lam, mu)
    return out


def _inside(x: np.ndarray, flat, g: Graph, ring: list[int]) -> int:
    corners = flat(g.y[ring])
    inner = plane.inset(corners)
    q = flat(x)
    return int((plane.in_polygon(inner, q) & plane.in_hull(corners, q)).sum()) if len(corners) > 2 else 0


def _judge(x: np.ndarray, flat, g: Graph, first_new: int, ring: list[int], leaf: int, other: int) -> Loop | None:
    from ..cloud import nearest
    from .project import project_batch

    if crosses_itself(replace(g, y=flat(g.y))) or len(ring) < 4:
        return None
    node, _, _, _, best, _ = project_batch(x, g)
    own = np.nonzero(np.isin(node, ring))[0]
    inner = _inside(x, flat, g, ring) / max(len(own), 1)
    new = [n for n in ring if n >= first_new]
    at = frozenset(np.nonzero(np.isin(nearest(x, g.y)[0], new))[0].tolist())
    return Loop(leaf, other, g.y[first_new:], float(best.mean()), inner, plane.compactness(flat(g.y[ring])), at)


def distinct_loops(loops: list[Loop], share: float = 2 / 3) -> list[Loop]:
    """Of loops that share more than two thirds of the larger one's points the one with the smaller error."""
    out: list[Loop] = []
    for loop in sorted(loops, key=lambda v: v.msep):
        if all(len(loop.points & o.points) <= share * max(len(loop.points), len(o.points), 1) for o in out):
            out.append(loop)
    return out


def equivalent(loops: DataFrame) -> DataFrame:
    """``(a, b, overlap)`` of ``loops (loop_id, points array)``: pairs that share more than two thirds of the larger one's points."""
    a, b = loops.alias("a"), loops.alias("b")
    share = F.size(F.array_intersect("a.points", "b.points")) / F.greatest(F.size("a.points"), F.size("b.points"))
    return a.join(F.broadcast(b), F.col("a.loop_id") < F.col("b.loop_id")).select(F.col("a.loop_id").alias("a"), F.col("b.loop_id").alias("b"), share.alias("overlap")).where(F.col("overlap") > 2 / 3)
