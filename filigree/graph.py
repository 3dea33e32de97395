"""The state of an elastic principal graph: small numpy arrays that live on the driver.

A graph has ``k`` nodes with positions, stretch moduli on its edges and a bending
modulus on each node that is a star's centre.  It never grows with the data, so
it is sent to the tasks whole; everything that does grow stays in DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class Graph:
    """Nodes ``y (k, m)``, edges ``(e, 2)`` with small end first, ``lam (e,)``, ``mu (k,)``, ``adjusted (k,)``."""

    y: np.ndarray
    edges: np.ndarray
    lam: np.ndarray
    mu: np.ndarray
    adjusted: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        edges = np.sort(np.asarray(self.edges, np.int64).reshape(-1, 2), axis=1)
        order = np.lexsort((edges[:, 0], edges[:, 1]))  # ids of edges: by the larger end, then the smaller
        lam = np.broadcast_to(np.asarray(self.lam, float), len(edges))
        put = lambda k, v: object.__setattr__(self, k, v)
        put("y", np.asarray(self.y, float))
        put("edges", edges[order])
        put("lam", lam[order])
        put("mu", np.broadcast_to(np.asarray(self.mu, float), len(self.y)).copy())
        put("adjusted", np.zeros(len(self.y), bool) if self.adjusted is None else np.asarray(self.adjusted, bool))

    @property
    def k(self) -> int:
        return len(self.y)

    def with_positions(self, y: np.ndarray) -> "Graph":
        return replace(self, y=y)

    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.k)]
        for a, b in self.edges.tolist():
            out[a].append(b)
            out[b].append(a)
        return [sorted(n) for n in out]

    def degrees(self) -> np.ndarray:
        return np.bincount(self.edges.ravel(), minlength=self.k)

    def edge_lengths(self) -> np.ndarray:
        return np.linalg.norm(self.y[self.edges[:, 0]] - self.y[self.edges[:, 1]], axis=1)

    def matrix(self) -> np.ndarray:
        """The elastic matrix: stretch moduli off the diagonal, bending moduli on it."""
        out = np.diag(self.mu)
        a, b = self.edges.T
        out[a, b] = out[b, a] = self.lam
        return out

    @classmethod
    def from_matrix(cls, y: np.ndarray, matrix: np.ndarray, adjusted: np.ndarray | None = None) -> "Graph":
        a, b = np.nonzero(np.triu(matrix, 1) > 0)
        return cls(y, np.stack([a, b], 1), matrix[a, b], np.diag(matrix).copy(), adjusted)

    def laplacian(self) -> np.ndarray:
        """The spring matrix ``L``: stretch and bending energy of positions ``Y`` is ``tr(Y' L Y)``."""
        out = np.zeros((self.k, self.k))
        for (a, b), v in zip(self.edges.tolist(), self.lam):
            out[[a, b], [a, b]] += v
            out[[a, b], [b, a]] -= v
        for centre, near in enumerate(self.neighbours()):
            if self.mu[centre] > 0 and len(near) > 1:
                star = np.zeros(self.k)
                star[centre], star[near] = 1.0, -1.0 / len(near)
                out += self.mu[centre] * np.outer(star, star)
        return out

    def relabelled(self, keep: np.ndarray) -> "Graph":
        """The graph on the nodes of ``keep`` alone, numbered in their order."""
        number = np.full(self.k, -1)
        number[keep] = np.arange(len(keep))
        inside = (number[self.edges] >= 0).all(1)
        return Graph(self.y[keep], number[self.edges[inside]], self.lam[inside], self.mu[keep], self.adjusted[keep])

    def is_connected(self) -> bool:
        near, seen, todo = self.neighbours(), {0}, [0]
        while todo:
            for n in near[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return len(seen) == self.k


def uniform(y: np.ndarray, edges: np.ndarray, lam: float, mu: float) -> Graph:
    """The same stretch modulus on every edge; the bending modulus where more than one edge ends."""
    degree = np.bincount(np.asarray(edges, np.int64).ravel(), minlength=len(y))
    return Graph(y, edges, lam, np.where(degree > 1, mu, 0.0))


def uniform_with_cycle(y: np.ndarray, edges: np.ndarray, lam: float, mu: float, cycle_lam: float, cycle_mu: float, cycle: list[int]) -> Graph:
    """Uniform, but for edges with an end on the cycle and for the cycle's nodes."""
    g = uniform(y, edges, lam, mu)
    on = np.isin(g.edges, cycle).any(1)
    bend = g.mu.copy()
    bend[list(cycle)] = cycle_mu
    return Graph(y, g.edges, np.where(on, cycle_lam, g.lam), bend)


def adjust_by_constant(g: Graph, order: int = 2, div_mu: float = 10, div_lam: float = 10) -> Graph:
    """Divides the moduli around stars of more than ``order`` rays that have not been adjusted yet.

    A star's order is the number of positive entries of its row of the elastic
    matrix, its own bending modulus included, less one, and 1 at least.
    """
    m = g.matrix()
    size = np.maximum((m > 0).sum(1) - 1, 1)
    done = g.adjusted.copy()
    for i in np.nonzero((size > order) & ~done)[0]:
        bend = m[i, i] / div_mu
        m[i, :] /= div_lam
        m[:, i] /= div_lam
        m[i, i] = bend
        done[i] = True
    return Graph.from_matrix(g.y, m, done)


@dataclass(frozen=True)
class Energy:
    total: float
    mse: float
    stretch: float
    bend: float


def energy(g: Graph, mse: float, kind: str = "Base", alpha: float = 0.0, beta: float = 0.0, goals: np.ndarray | None = None) -> Energy:
    """Elastic energy of a graph whose points lie at mean squared distance ``mse``.

    ``Penalized`` raises a stretch modulus by ``alpha`` per ray that its busier
    end has beyond two, multiplies a bending modulus by the number of rays to the
    power ``beta``, and adds the pull to pseudotime goals where there are any.
    """
    d2 = ((g.y[g.edges[:, 0]] - g.y[g.edges[:, 1]]) ** 2).sum(1)
    lam, near = g.lam, g.neighbours()
    degree = g.degrees()
    if kind == "Penalized" and len(g.edges):
        lam = lam + alpha * np.maximum(0, degree[g.edges].max(1) - 2)
    stretch = float((lam * d2).sum())
    bend = 0.0
    for c, n in enumerate(near):
        if g.mu[c] > 0 and len(n) > 1:
            gain = len(n) ** beta if kind == "Penalized" else 1.0
            bend += g.mu[c] * gain * float(((g.y[c] - g.y[n].mean(0)) ** 2).sum())
    if kind == "Penalized" and goals is not None and len(g.lam):
        known = np.isfinite(goals).all(1)
        stretch += float(g.lam.min() * ((g.y[known] - goals[known]) ** 2).sum())
    return Energy(float(mse + stretch + bend), float(mse), float(stretch), float(bend))


def barcode(g: Graph) -> str:
    """``...|#degree 4|#degree 3||nodes``; a plain line is ``0||nodes``."""
    degree = g.degrees()
    most = int(degree.max(initial=0))
    if most <= 2:
        return f"0||{g.k}"
    return "|".join(str(int((degree == d).sum())) for d in range(most, 2, -1)) + f"||{g.k}"
