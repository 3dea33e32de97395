"""Graph grammars: all graphs that one edit makes of a graph."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from ..graph import Graph

#: Names of the edits, with the number of neighbours that restricts them.
EDITS = ("addnode2node", "addnode2node_1", "addnode2node_2", "removenode", "bisectedge", "bisectedge_3", "shrinkedge", "shrinkedge_3")
NO_LIMIT = {"AddNode2Node": np.inf, "RemoveNode": np.inf, "BisectEdge": np.inf, "ShrinkEdge": np.inf}


def check_limits(limits: dict[str, float]) -> dict[str, float]:
    out = NO_LIMIT | limits
    if set(out) != set(NO_LIMIT):
        raise ValueError(f"limits are for {sorted(NO_LIMIT)}")
    if out["RemoveNode"] != np.inf:
        raise ValueError("RemoveNode takes no limit")
    return out


def bisect_edges(g: Graph, least_degree: int = 1, limit: float = np.inf) -> list[Graph]:
    """One graph per edge with a node in its middle; both halves keep the edge's modulus.

    The new node bends with the mean of its ends' moduli if both bend, else with the larger one.
    With ``limit`` the longest edges are taken, of equally long ones the first.
    """
    degree = g.degrees()
    which = [i for i, (a, b) in enumerate(g.edges.tolist()) if max(degree[a], degree[b]) >= least_degree]
    if len(which) > limit:
        length = np.round(g.edge_lengths(), 12)
        which = sorted(sorted(which, key=lambda i: (-length[i], i))[: int(limit)])
    out = []
    for i in which:
        a, b = g.edges[i]
        edges = np.vstack([np.delete(g.edges, i, axis=0), [[a, g.k], [b, g.k]]])
        lam = np.append(np.delete(g.lam, i), [g.lam[i]] * 2)
        mu = (g.mu[a] + g.mu[b]) / 2 if min(g.mu[a], g.mu[b]) > 0 else max(g.mu[a], g.mu[b])
        out.append(Graph(np.vstack([g.y, (g.y[a] + g.y[b]) / 2]), edges, lam, np.append(g.mu, mu), np.append(g.adjusted, False)))
    return out


def add_nodes(g: Graph, weight: np.ndarray, centres: np.ndarray, most_degree: float = np.inf, limit: float = np.inf, skip: int = 0) -> list[Graph]:
    """One graph per node with a leaf added to it.

    A leaf is continued by its last step and starts to bend like its neighbour;
    another node gets a leaf at the centre of its points, or of its neighbours if it has none.
    ``weight`` and ``centres``: of the points of each node.  With ``limit`` the most populated nodes are taken.
    """
    near, degree = g.neighbours(), g.degrees()
    which = [i for i in range(skip, g.k) if 0 < degree[i] <= most_degree]
    if len(which) > limit:
        which = sorted(sorted(which, key=lambda i: (-weight[i], i))[: int(limit)])
    out = []
    for i in which:
        mu = g.mu.copy()
        touching = (g.edges == i).any(1)
        if degree[i] == 1:
            at = 2 * g.y[i] - g.y[near[i][0]]
            mu[i] = g.mu[near[i][0]]
        else:
            at = centres[i] if weight[i] > 0 else g.y[near[i]].mean(0)
        out.append(Graph(np.vstack([g.y, at]), np.vstack([g.edges, [i, g.k]]), np.append(g.lam, g.lam[touching].mean()), np.append(mu, 0.0), np.append(g.adjusted, False)))
    return out


def remove_leaves(g: Graph, skip: int = 0) -> list[Graph]:
    """One graph per leaf without it; the neighbour keeps its modulus."""
    degree = g.degrees()
    return [g.relabelled(np.delete(np.arange(g.k), i)) for i in range(skip, g.k) if degree[i] == 1]


def shrink_edges(g: Graph, least_degree: int = 1, limit: float = np.inf, skip: int = 0) -> list[Graph]:
    """One graph per inner edge with its ends merged in the middle; parallel edges keep the largest modulus, the node the mean one."""
    degree = g.degrees()
    which = [i for i, (a, b) in enumerate(g.edges.tolist()) if min(degree[a], degree[b]) > 1 and max(degree[a], degree[b]) >= least_degree and a >= skip]
    if len(which) > limit:
        length = np.round(g.edge_lengths(), 12)
        which = sorted(sorted(which, key=lambda i: (length[i], i))[: int(limit)])
    out = []
    for i in which:
        a, b = g.edges[i]
        y, mu = g.y.copy(), g.mu.copy()
        y[a], mu[a] = (y[a] + y[b]) / 2, (mu[a] + mu[b]) / 2
        lam: dict[tuple[int, int], float] = {}
        for (p, q), v in zip(g.edges.tolist(), g.lam):
            p, q = sorted((a if p == b else p, a if q == b else q))
            if p != q:
                lam[p, q] = max(v, lam.get((p, q), 0.0))
        merged = Graph(y, np.array(list(lam)), np.array(list(lam.values())), mu, g.adjusted)
        out.append(merged.relabelled(np.delete(np.arange(g.k), b)))
    return out


def candidates(g: Graph, edit: str, weight: np.ndarray, centres: np.ndarray, limits: dict[str, float] | None = None, skip: int = 0) -> list[Graph]:
    """All graphs that ``edit`` makes of ``g``; limits hold for the names without a number only."""
    limits = check_limits(limits or {})
    match edit:
        case "addnode2node":
            return add_nodes(g, weight, centres, limit=limits["AddNode2Node"], skip=skip)
        case "addnode2node_1" | "addnode2node_2":
            return add_nodes(g, weight, centres, most_degree=int(edit[-1]), skip=skip)
        case "removenode":
            return remove_leaves(g, skip)
        case "bisectedge":
            return bisect_edges(g, limit=limits["BisectEdge"])
        case "bisectedge_3":
            return bisect_edges(g, least_degree=3)
        case "shrinkedge":
            return shrink_edges(g, limit=limits["ShrinkEdge"], skip=skip)
        case "shrinkedge_3":
            return shrink_edges(g, least_degree=3, skip=skip)
    raise ValueError(f"no such edit: {edit}; there are {', '.join(EDITS)}")


def unbend_leaves(g: Graph) -> Graph:
    """A graph of three nodes bends in its middle only."""
    return replace(g, mu=np.where(g.degrees() == 1, 0.0, g.mu)) if g.k == 3 else g
