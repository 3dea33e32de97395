"""Embedding a graph into a cloud: nearest nodes, then one linear solve, until nothing moves.

All candidates of a search step are embedded together: one pass over the cloud
gives the sums of every candidate that still moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from ..cloud import Engine, Stats
from ..graph import Energy, Graph, energy


@dataclass(frozen=True)
class Rules:
    """How graphs are embedded and what their energy is."""

    iterations: int = 10
    eps: float = 0.01
    mode: int = 1
    radius: float = np.inf
    final_energy: str = "Base"
    alpha: float = 0.0
    beta: float = 0.0
    fixed: int = 0
    goal_pull: float = 0.0
    refresh: bool = False


@dataclass
class Embedded:
    """A graph in place, its energy, and the sums of the last assignment."""

    graph: Graph
    energy: Energy
    stats: Stats = field(repr=False)
    iterations: int = 0


def solve(g: Graph, stats: Stats, fixed: int = 0, goals: np.ndarray | None = None, pull: float = 0.0) -> np.ndarray:
    """Positions of least energy for the given assignment; the first ``fixed`` nodes stay.

    Nodes without points have no weight of their own and follow their springs.
    The weight of points that belong to fixed nodes does not count.
    """
    weight, sums = stats.weight[fixed:], stats.sums[fixed:]
    total = stats.total - stats.weight[:fixed].sum()
    share = weight / total if total > 0 else np.zeros_like(weight)
    centre = np.divide(sums, weight[:, None], out=np.zeros_like(sums), where=weight[:, None] > 0)
    if goals is not None and pull > 0:
        known = np.isfinite(goals[fixed:]).all(1)
        centre[known] = (centre[known] + pull * goals[fixed:][known]) / (1 + pull)
    spring = g.laplacian()
    right = share[:, None] * centre - spring[fixed:, :fixed] @ g.y[:fixed]
    left = np.diag(share) + spring[fixed:, fixed:]
    try:
        moved = np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        moved = np.linalg.lstsq(left, right, rcond=None)[0]
    return np.vstack([g.y[:fixed], moved])


def _relative_shift(old: np.ndarray, new: np.ndarray) -> float:
    """The largest squared shift over the new position's squared norm."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.max(((new - old) ** 2).sum(1) / (new**2).sum(1)))


def embed(cloud: Engine, graphs: list[Graph], rules: Rules, goals: list[np.ndarray | None] | None = None, first: list[Stats] | None = None) -> list[Embedded]:
    """Embeds every graph; those that have settled are left out of later passes.

    Mode 1 ends when no node moves by more than ``eps`` of its squared norm, mode 2 when
    the energy falls by less than ``eps`` of itself.  The mean squared distance
    reported is that of the last assignment, which in mode 1 precedes the last
    move; ``refresh`` assigns once more.
    """
    goals = goals or [None] * len(graphs)
    now, stats = list(graphs), list(first or cloud.stats([g.y for g in graphs], rules.radius))
    measure = lambda i: energy(now[i], stats[i].mse, rules.final_energy, rules.alpha, rules.beta, goals[i])
    done, used = [False] * len(graphs), [0] * len(graphs)
    before = [measure(i).total for i in range(len(graphs))]
    for _ in range(rules.iterations):
        again = []
        for i in [i for i, d in enumerate(done) if not d]:
            used[i] += 1
            new = solve(now[i], stats[i], rules.fixed, goals[i], rules.goal_pull)
            shift = _relative_shift(now[i].y, new)
            now[i] = now[i].with_positions(new)
            done[i] = rules.mode == 1 and not (np.isfinite(shift) and shift >= rules.eps)
            if not done[i]:
                again.append(i)
        if not again:
            break
        for i, s in zip(again, cloud.stats([now[i].y for i in again], rules.radius)):
            stats[i] = s
            if rules.mode == 2:
                after = measure(i).total
                gain = (before[i] - after) / after if after else 0.0
                done[i], before[i] = not (np.isfinite(gain) and gain >= rules.eps), after
    if rules.refresh:
        stats = cloud.stats([g.y for g in now], rules.radius)
    return [Embedded(now[i], measure(i), stats[i], used[i]) for i in range(len(now))]


def embed_barycentric(x: np.ndarray, w: np.ndarray, g: Graph, rules: Rules) -> tuple[Graph, np.ndarray]:
    """Embedding with distances measured in units of each node's spread: ``d2 / s + s``.

    ``s`` is the standard deviation of all coordinates of a node's points in the assignment before.
    For clouds on the driver; ``operators.assign.barycentric`` is the distributed assignment.
    """
    from ..cloud import nearest

    node, _ = nearest(x, g.y, rules.radius)
    for _ in range(rules.iterations):
        spread = np.array([x[node == j].std() if (node == j).sum() > 1 else 1e-100 for j in range(g.k)])
        spread = np.maximum(spread, 1e-100)
        d2 = ((x[:, None] - g.y) ** 2).sum(2)
        node = (d2 / spread + spread).argmin(1)
        own = d2[np.arange(len(x)), node]
        weight = np.bincount(node, w, g.k)
        sums = np.stack([np.bincount(node, w * c, g.k) for c in x.T], 1)
        new = solve(g, Stats(weight, sums, float((w * own).sum()), float(w.sum())), rules.fixed)
        shift, g = _relative_shift(g.y, new), g.with_positions(new)
        if not shift >= rules.eps:
            break
    return g, node


def with_rules(rules: Rules, **changes) -> Rules:
    return replace(rules, **changes)
