"""Paths, branches, cycles and pseudotime on a graph.

The graph is small and its structure is found on the driver; what has a row per
point is joined with the small result.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def bfs(g: Graph, root: int) -> tuple[list[int], dict[int, int], dict[int, int]]:
    """Nodes in breadth-first order, their depths and parents; neighbours in ascending order."""
    near, order, depth, parent = g.neighbours(), [root], {root: 0}, {}
    todo = deque([root])
    while todo:
        a = todo.popleft()
        for b in near[a]:
            if b not in depth:
                depth[b], parent[b] = depth[a] + 1, a
                order.append(b)
                todo.append(b)
    return order, depth, parent


def shortest_path(g: Graph, a: int, b: int, weighted: bool = False) -> list[int]:
    """The path from ``a`` to ``b`` with the fewest edges, or the shortest one; the smaller node wins ties; [] if there is none."""
    length = {tuple(e): v for e, v in zip(g.edges.tolist(), g.edge_lengths())}
    near, best, todo = g.neighbours(), {a: (0.0, [a])}, [(0.0, [a])]
    done = set()
    while todo:
        d, path = heapq.heappop(todo)
        at = path[-1]
        if at in done:
            continue
        done.add(at)
        if at == b:
            return path
        for n in near[at]:
            step = d + (float(length[min(at, n), max(at, n)]) if weighted else 1.0)
            if n not in done and (n not in best or step < best[n][0] - 1e-12 or (abs(step - best[n][0]) <= 1e-12 and path + [n] < best[n][1])):
                best[n] = (step, path + [n])
                heapq.heappush(todo, (step, path + [n]))
    return []


def simple_path_through(g: Graph, a: int, b: int, include: list[int]) -> list[int]:
    """The shortest simple path from ``a`` to ``b`` that passes all nodes of ``include``; an error if there is none."""
    near, need, best, todo = g.neighbours(), set(include), None, [[a]]
    while todo:
        path = todo.pop()
        if path[-1] == b:
            if need <= set(path) and (best is None or (len(path), path) < (len(best), best)):
                best = path
            continue
        if best is None or len(path) < len(best):
            todo += [path + [n] for n in reversed(near[path[-1]]) if n not in path]
    if best is None:
        raise ValueError(f"no path from {a} to {b} passes {include}")
    return best


def branches(g: Graph) -> list[list[int]]:
    """Paths between nodes that are not of degree two with only such nodes inside; a lone cycle is one closed branch."""
    degree, near = g.degrees(), g.neighbours()
    ends = [i for i in range(g.k) if degree[i] != 2]
    out, seen = [], set()
    for a in ends:
        for n in near[a]:
            path = [a, n]
            while degree[path[-1]] == 2:
                path.append(next(x for x in near[path[-1]] if x != path[-2] or near[path[-1]].count(x) > 1))
            edge = frozenset(((path[0], path[1]), (path[-1], path[-2])))
            if edge not in seen:
                seen.add(edge)
                out.append(path if path[0] <= path[-1] else path[::-1])
    on = {x for p in out for x in p}
    for i in range(g.k):  # components that are a cycle
        if i not in on and degree[i] == 2:
            path = [i, near[i][0]]
            while path[-1] != i:
                path.append(next(x for x in near[path[-1]] if x != path[-2]))
            out.append(path)
            on |= set(path)
    return sorted(out)


def end_to_end(g: Graph) -> list[list[int]]:
    """Shortest paths between all pairs of leaves."""
    leaves = np.nonzero(g.degrees() == 1)[0].tolist()
    return [shortest_path(g, a, b) for i, a in enumerate(leaves) for b in leaves[i + 1 :]]


def branches_and_points(g: Graph) -> dict[str, list[int]]:
    """Nodes inside each branch, and each node where branches meet, by name."""
    degree, out = g.degrees(), {}
    for i, path in enumerate(branches(g)):
        out[f"Branch_{i}"] = [n for n in path if degree[n] <= 2]
    for i, n in enumerate(np.nonzero(degree > 2)[0].tolist()):
        out[f"BranchPoint_{i}"] = [n]
    return out


def subgraph(g: Graph, structure: str, nodes: list[int] | None = None, circular: bool = True, keep_ends: bool = True):
    """Parts of a graph by name: ``branches``, ``end2end``, ``branches&bpoints``, ``circle`` or ``branching``.

    ``circle``: the cycle in order, from the smallest node or the first of ``nodes``, closed if ``circular``.
    ``branching``: for each junction its branches, without their far ends unless ``keep_ends``.
    """
    if structure == "branches":
        return branches(g) if keep_ends else [p[1:-1] for p in branches(g)]
    if structure == "end2end":
        return end_to_end(g)
    if structure == "branches&bpoints":
        return branches_and_points(g)
    if structure == "circle":
        found = cycles(g)
        if not found:
            raise ValueError("the graph has no cycle")
        ring = list(found[0])
        start = ring.index(nodes[0]) if nodes and nodes[0] in ring else 0
        ring = ring[start:] + ring[:start]
        return ring + ring[:1] if circular else ring
    if structure == "branching":
        meet = np.nonzero(g.degrees() > 2)[0].tolist()
        own = {j: [p if p[0] == j else p[::-1] for p in branches(g) if j in (p[0], p[-1])] for j in meet}
        return own if keep_ends else {j: [p[:-1] for p in ps] for j, ps in own.items()}
    raise ValueError(f"no such structure: {structure}")


def vertex_branches(g: Graph, start: int | None = None) -> dict[int, int]:
    """A branch number for each node, breadth first from ``start`` (the first leaf); junctions begin new branches."""
    degree, near = g.degrees(), g.neighbours()
    start = int(np.nonzero(degree == 1)[0][0]) if start is None and (degree == 1).any() else (start or 0)
    label, todo, new = {start: 0}, deque([start]), 1
    while todo:
        a = todo.popleft()
        for b in near[a]:
            if b not in label:
                if degree[a] > 2 or degree[b] > 2:
                    label[b], new = new, new + 1
                else:
                    label[b] = label[a]
                todo.append(b)
    return label


def root_paths(g: Graph, root: int) -> list[list[int]]:
    """Paths from a leaf to every other leaf, by the leaf's number; the root must have one neighbour at most."""
    degree = g.degrees()
    if degree[root] > 1:
        raise ValueError("the root must be a leaf")
    _, _, parent = bfs(g, root)
    out = []
    for leaf in np.nonzero(degree == 1)[0].tolist():
        if leaf != root:
            path = [leaf]
            while path[-1] != root:
                path.append(parent[path[-1]])
            out.append(path[::-1])
    return out


def rooted_branches(g: Graph, root: int) -> list[list[int]]:
    """Branches from parent to child; a junction belongs to the branch that leads to it."""
    degree, near = g.degrees(), g.neighbours()
    out, todo, seen = [], deque([[root]]), {root}
    while todo:
        path = todo.popleft()
        while True:
            ahead = [n for n in near[path[-1]] if n not in seen]
            if len(ahead) == 1 and degree[path[-1]] <= 2:
                seen.add(ahead[0])
                path.append(ahead[0])
                continue
            for n in ahead:
                seen.add(n)
                todo.append([n])
            break
        out.append(path)
    return out


def trajectories(g: Graph, root: int) -> list[tuple[list[int], list[int]]]:
    """Nodes and edges of the paths from ``root`` to every leaf; the root alone too if it is a leaf itself."""
    number = {tuple(e): i for i, e in enumerate(g.edges.tolist())}
    out = []
    for leaf in np.nonzero(g.degrees() == 1)[0].tolist():
        path = shortest_path(g, root, leaf)
        if path:
            out.append((path, [number[min(a, b), max(a, b)] for a, b in zip(path, path[1:])]))
    return out


def components(g: Graph) -> list[list[int]]:
    out, seen = [], set()
    for i in range(g.k):
        if i not in seen:
            own = sorted(bfs(g, i)[0])
            seen |= set(own)
            out.append(own)
    return out


def canonical_cycle(cycle: list[int]) -> tuple[int, ...]:
    """A cycle from its smallest node, in the direction of the smaller neighbour."""
    i = cycle.index(min(cycle))
    turned = cycle[i:] + cycle[:i]
    return tuple(turned if turned[1] < turned[-1] else [turned[0], *turned[:0:-1]])


def cycles(g: Graph, source: int | None = None, most: int | None = None) -> list[tuple[int, ...]]:
    """Simple cycles, through ``source`` if given, of ``most`` nodes at most, in canonical form, shortest first."""
    near, out = g.neighbours(), set()
    for start in range(g.k) if source is None else [source]:
        todo = [[start]]
        while todo:
            path = todo.pop()
            for n in near[path[-1]]:
                if n == start and len(path) > 2:
                    out.add(canonical_cycle(path))
                elif n not in path and (source is not None or n > start) and (most is None or len(path) < most):
                    todo.append(path + [n])
    return sorted(out, key=lambda c: (len(c), c))


def path_table(spark: SparkSession, paths: list[list[int]]) -> DataFrame:
    """``(path_id, pos, node_id)`` of paths."""
    return spark.createDataFrame([(i, p, int(n)) for i, path in enumerate(paths) for p, n in enumerate(path)], "path_id int, pos int, node_id int")


def members(assigned: DataFrame, paths: list[list[int]]) -> DataFrame:
    """``(path_id, point_id)``: the points of the nodes of each path; a node on several paths gives its points to each."""
    table = path_table(assigned.sparkSession, paths).select("path_id", "node_id").distinct()
    return assigned.join(F.broadcast(table), "node_id").select("path_id", "point_id")


def pseudotime(projected: DataFrame, g: Graph, source: int, target: int | None = None, include: list[int] | None = None) -> DataFrame:
    """``(point_id, pt)``: distance from ``source`` along the path to ``target`` (or over the whole graph); null off the path.

    A point counts if its node is on the path; its share of the edge is clamped
    and turned so that it grows away from the source.
    """
    spark, lengths = projected.sparkSession, g.edge_lengths()
    number = {tuple(e): i for i, e in enumerate(g.edges.tolist())}
    if target is not None:
        order = simple_path_through(g, source, target, include) if include else shortest_path(g, source, target, weighted=True)
        dist = np.concatenate([[0.0], np.cumsum([lengths[number[min(a, b), max(a, b)]] for a, b in zip(order, order[1:])])])
        far = dict(zip(order, dist.tolist()))
    else:
        order, _, parent = bfs(g, source)
        far = {source: 0.0}
        for n in order[1:]:
            p = parent[n]
            far[n] = far[p] + float(lengths[number[min(n, p), max(n, p)]])
    place = {n: i for i, n in enumerate(order)}
    rows = []
    for e, (a, b) in enumerate(g.edges.tolist()):
        forward = place.get(a, g.k) <= place.get(b, g.k)
        near = a if forward else b
        rows.append((e, far.get(near), float(lengths[e]), forward))
    edges = spark.createDataFrame(rows, "edge_id int, near double, len double, forward boolean")
    on = spark.createDataFrame([(int(n), True) for n in order], "node_id int, on_path boolean")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("edge_loc")))
    pt = F.col("near") + F.col("len") * F.when(F.col("forward"), u).otherwise(1 - u)
    joined = projected.join(F.broadcast(edges), "edge_id", "left").join(F.broadcast(on), "node_id", "left")
    return joined.select("point_id", F.when(F.col("on_path"), pt).alias("pt"))


def trajectory_pseudotime(projected: DataFrame, g: Graph, paths: list[list[int]]) -> DataFrame:
    """``(traj_id, point_id, pst)``: on each trajectory the place of the edge's earlier node on it plus the clamped share.

    The share is not turned where an edge runs backwards.  Points whose edge
    leaves the trajectory take its end that lies on it.
    """
    spark = projected.sparkSession
    rows = []
    for t, path in enumerate(paths):
        place = {n: i for i, n in enumerate(path)}
        for e, (a, b) in enumerate(g.edges.tolist()):
            known = [place[n] for n in (a, b) if n in place]
            if known:
                rows.append((t, e, min(known)))
    edges = spark.createDataFrame(rows, "traj_id int, edge_id int, at int")
    nodes = path_table(spark, paths).select(F.col("path_id").alias("traj_id"), "node_id").distinct()
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("edge_loc")))
    return projected.join(F.broadcast(nodes), "node_id").join(F.broadcast(edges), ["traj_id", "edge_id"]).select("traj_id", "point_id", (F.col("at") + u).alias("pst"))


def branch_labels(measured: DataFrame, g: Graph) -> DataFrame:
    """``(point_id, branch_id)`` from ``measured (point_id, d2s)``: the branch of the nearest node.

    A point whose nearest node is a junction goes to that of the junction's branches which has the
    nearest other node.
    """
    degree, found = g.degrees(), branches(g)
    inner = [[n for n in p if degree[n] <= 2] for p in found]
    far = F.lit(float("inf"))
    d = F.col("d2s")
    least = lambda nodes: F.array_min(F.array(*[F.round(d[n], 9) for n in nodes])) if nodes else far
    node = F.array_position(F.transform(d, lambda v: F.round(v, 9)), F.array_min(F.transform(d, lambda v: F.round(v, 9)))) - 1
    own = {n: b for b, nodes in enumerate(inner) for n in nodes}
    best = None
    for n in range(g.k):
        if n in own:
            label = F.lit(own[n])
        else:
            options = [F.struct(least(inner[b]).alias("d"), F.lit(b).alias("b")) for b, p in enumerate(found) if n in p]
            label = F.array_min(F.array(*options))["b"]
        best = F.when(F.col("node") == n, label) if best is None else best.when(F.col("node") == n, label)
    return measured.withColumn("node", node).select("point_id", best.cast("int").alias("branch_id"))
