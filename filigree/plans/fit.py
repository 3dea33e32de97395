"""The search for a graph: grow and shrink by the edit of least energy until the graph has its size."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..cloud import Engine, LocalEngine, PointCloud
from ..graph import Energy, Graph, adjust_by_constant, barcode, uniform
from .embed import Embedded, Rules, embed
from .grammar import candidates, check_limits, unbend_leaves

#: Replicas that are fitted side by side.
AT_ONCE = 4
#: Names of the columns of a report, in their order.
REPORT = ("barcode", "energy", "nnodes", "nedges", "nribs", "nstars", "nrays", "nrays2", "mse", "msep", "fve", "fvep", "ue", "ur", "urn", "urn2", "ursd")


@dataclass(frozen=True)
class Options:
    """What a fit is told; the defaults are those of all topologies."""

    nodes: int
    lam: float = 0.01
    mu: float = 0.1
    max_edges: float = np.inf
    max_steps: float = np.inf
    max_failed: float = np.inf
    grow: tuple[tuple[str, ...], ...] = ()
    shrink: tuple[tuple[str, ...], ...] = ()
    order: tuple[str, ...] = ("Grow", "Shrink")
    optimise: bool = False
    limits: dict[str, float] = field(default_factory=dict)
    avoid_solitary: bool = False
    adjust: Callable[[Graph], Graph] | bool | None = None
    adjust_first: Callable[[Graph], Graph] | None = None
    rules: Rules = Rules()
    center: bool = True
    dimensions: list[int] | float | None = None
    goals: Callable[[Graph, Embedded], np.ndarray] | None = None
    trace: bool = False


@dataclass
class Fitted:
    """A fitted graph with how it came about; ``report`` has a row per step if it was traced."""

    graph: Graph
    energy: Energy
    variance: float
    options: Options
    seconds: float = 0.0
    report: list[dict] = field(default_factory=list)
    subset: int = 0
    replica: int = 0

    def final_report(self, msep: float | None = None) -> dict:
        return report_row(self.graph, self.energy, self.variance, msep)

    def report_frame(self, spark: SparkSession) -> DataFrame:
        rows = self.report or [self.final_report()]
        kinds = ", ".join(f"{c} {'string' if c == 'barcode' else 'int' if c[0] == 'n' else 'double'}" for c in REPORT)
        return spark.createDataFrame([tuple(r[c] for c in REPORT) for r in rows], kinds)


def report_row(g: Graph, e: Energy, variance: float, msep: float | None = None) -> dict:
    """The seventeen numbers that describe an embedded graph; ``variance`` is the cloud's total variance."""
    degree, k = g.degrees(), g.k
    share = lambda v: None if v is None or variance <= 0 else float((variance - v) / variance)
    values = (barcode(g), e.total, k, len(g.edges), int((degree == 2).sum()), int((degree == 3).sum()), 0, 0, e.mse, msep, share(e.mse), share(msep), e.stretch, e.bend, e.bend * k, e.bend * k * k, 0.0)
    return dict(zip(REPORT, values))


def best_edit(cloud: Engine, now: Embedded, edits: tuple[str, ...], o: Options) -> Embedded | None:
    """Of all graphs that the edits make the embedded one of least energy, the first of equals; None if there is none."""
    weight = now.stats.weight
    centres = np.divide(now.stats.sums, weight[:, None], out=np.zeros_like(now.stats.sums), where=weight[:, None] > 0)
    found = [c for edit in edits for c in candidates(now.graph, edit, weight, centres, o.limits, o.rules.fixed)]
    if not found:
        return None
    first = cloud.stats([c.y for c in found], o.rules.radius)
    if o.avoid_solitary:
        fine = [(s.weight[o.rules.fixed :] > 0).all() for s in first]
        found, first = [c for c, f in zip(found, fine) if f], [s for s, f in zip(first, fine) if f]
        if not found:
            return None
    if o.adjust:
        found = [(adjust_by_constant if o.adjust is True else o.adjust)(c) for c in found]
    goals = [o.goals(c, now) for c in found] if o.goals else None
    made = embed(cloud, found, o.rules, goals, first)
    energies = [m.energy.total if np.isfinite(m.energy.total) else np.inf for m in made]
    return made[int(np.argmin(energies))]


def search(cloud: Engine, start: Graph, o: Options) -> tuple[Embedded, list[dict]]:
    """Applies rounds of edits until the graph has its nodes or edges, or steps or patience run out.

    To optimise is to apply the rounds ``max_steps`` times whatever the size.
    """
    check_limits(o.limits)
    if o.adjust_first:
        start = o.adjust_first(start)
    now, failed, steps, report = embed(cloud, [start], o.rules)[0], 0, 0, []
    variance = float(np.trace(cloud.moments()[1])) if o.trace else 0.0
    rounds = {"Grow": o.grow, "Shrink": o.shrink}
    while steps < o.max_steps and failed <= o.max_failed:
        if not o.optimise and (now.graph.k >= o.nodes or len(now.graph.edges) >= o.max_edges):
            break
        steps += 1
        moved = False
        for kind in o.order:
            for edits in rounds[kind]:
                best = best_edit(cloud, now, edits, o)
                if best is None:
                    failed += 1
                    continue
                moved = True
                now = best
                if kind == "Grow" and now.graph.k == 3 and (unbent := unbend_leaves(now.graph)) is not now.graph:
                    now = replace(now, graph=unbent)
        if o.trace and moved:
            report.append(report_row(now.graph, now.energy, variance))
        if not moved:
            break
    return now, report


def _reduction(cloud: Engine, o: Options) -> tuple[Engine, np.ndarray, np.ndarray | None]:
    """The cloud as it is fitted, what was subtracted, and the kept directions if any were dropped.

    A full rotation changes no distance, so it is left out; centring is not,
    as convergence in mode 1 depends on the origin.
    """
    mean, cov = cloud.moments()
    shift = mean if o.center else np.zeros(cloud.dim)
    if o.dimensions is None:
        return cloud.moved(shift), shift, None
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)
    value, vector = value[order], signed(vector[:, order])
    if isinstance(o.dimensions, float):
        keep = list(range(1 + int(np.searchsorted(np.cumsum(value) / value.sum(), o.dimensions))))
    else:
        keep = list(o.dimensions)
    return cloud.moved(shift, vector[:, keep]), shift, vector[:, keep]


def signed(vectors: np.ndarray) -> np.ndarray:
    """Principal directions, in columns, with their largest entry positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def fit(cloud: Engine, start: Callable[[Engine], Graph] | Graph, o: Options, fixed_points: list[np.ndarray] | None = None) -> Fitted:
    """Fits a graph: reduces the cloud, embeds the start, searches, and turns the nodes back.

    ``fixed_points``: one set of points per node that is to stay at their mean; such a node comes
    first and is tied to the nearest node of the start.
    """
    began = time.time()
    reduced, shift, turn = _reduction(cloud, o)
    forward = lambda y: (y - shift) if turn is None else (y - shift) @ turn
    g = start(reduced) if callable(start) else start.with_positions(forward(start.y))
    if fixed_points:
        at = forward(np.array([np.mean(p, axis=0) for p in fixed_points]))
        near = ((at[:, None] - g.y) ** 2).sum(2).argmin(1)
        f = len(at)
        links = np.stack([np.arange(f), near + f], 1)
        g = Graph(np.vstack([at, g.y]), np.vstack([links, g.edges + f]), np.append(np.full(f, o.lam), g.lam), np.append(np.full(f, o.mu), g.mu))
        o = replace(o, rules=replace(o.rules, fixed=f))
    done, report = search(reduced, g, o)
    y = done.graph.y if turn is None else done.graph.y @ turn.T
    variance = float(np.trace(cloud.moments()[1]))
    return Fitted(done.graph.with_positions(y + shift), done.energy, variance, o, time.time() - began, report)


def fit_replicas(
    cloud: PointCloud, start: Callable[[Engine], Graph], o: Options, replicas: int = 1, share: float = 1.0, subsets: list[list[int]] | None = None, seed: int = 0, consensus: bool = True, fixed_points=None, sample_start: bool = True
) -> list[Fitted]:
    """A fit per subset of the columns and replica of a row sample, and per subset the consensus of its replicas.

    A replica sees each point with probability ``share``, the same points for the same seed, weights along
    with them.  A start that is made from points is made from the replica's, or from all if not ``sample_start``.
    The consensus is fitted to the pooled nodes of the replicas and comes last.  AT_ONCE replicas are fitted
    side by side: each waits for many short jobs, one after another, that leave cores idle.
    """
    from pyspark import inheritable_thread_target
    from pyspark.sql import functions as F

    def one(points: DataFrame, begin: Callable[[Engine], Graph] | Graph) -> Fitted:
        engine = PointCloud(points).engine()
        try:
            return fit(engine, begin, o, fixed_points)
        finally:
            engine.close()

    out = []
    for s, columns in enumerate(subsets or [None]):
        every = cloud.points
        if columns is not None:
            every = every.withColumn("x", F.array(*[F.col("x")[c] for c in columns]))
        begin = start if sample_start or not callable(start) else start(PointCloud(every).engine())
        drawn = [every] * replicas
        if share < 1:
            drawn = [every.where((F.xxhash64("point_id", F.lit(seed * 1000 + r)).cast("double") / F.lit(2.0**64) + 0.5) < share) for r in range(replicas)]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            fits = [pool.submit(inheritable_thread_target(every.sparkSession)(one), points, begin) for points in drawn]
            own = [replace(f.result(), subset=s, replica=r) for r, f in enumerate(fits)]
        out += own
        if replicas > 1 and consensus:
            pooled = LocalEngine(np.vstack([f.graph.y for f in own]))
            out.append(replace(fit(pooled, start, o, fixed_points), subset=s, replica=replicas))
    return out


def start_graph(y: np.ndarray, edges: np.ndarray, o: Options) -> Graph:
    return uniform(y, edges, o.lam, o.mu)
